"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base patterns give spans that always stand. Wider patterns give further candidates: addresses
written with (at) and [dot], telephone numbers without a plus sign, numbers in other groups, and what a base
pattern matched and its check refused. On every candidate four labelers vote yes, no or nothing: a
regular expression on its form, a gazetteer (endings of domains, calling codes, issuers' prefixes,
reserved networks), words of its context, and its layout. Expectation-maximisation estimates each labeler's
reliability per kind from how the labelers agree, without labels. Its posteriors train a logistic classifier on
votes, layout and learned context words; the classifier decides on candidates that aren't base spans.
DataFrame functions only.

What the corpus gives is summed over all candidates: votes (at most 648 patterns), words before a candidate
(in 4,096 buckets a kind) and combinations of features (their number is bounded by the features' levels).
Only these sums reach the driver; the classifier comes back as a table of weights inside an expression,
so a document is judged where it lies, without a shuffle.

Defined cases: null text is empty; an empty text has no spans; repeated rows get one result each, all
alike; no candidates at all leave the reliabilities at their prior; an empty table gives an empty result;
other columns are ignored. Running sums over a text's matches go in blocks, and patterns take no nested
repetition that Java would recurse on, so very long texts and runs of digits are no special case.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "layout")

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns. Same matches as the plain ones: repetitions don't give back, and a search inside a run that failed doesn't start again.
BASE = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: Wider patterns, for candidates only.
WIDE = (
    rf"(?<!{_LOCAL}){_LOCAL}++ ?{_OPEN} ?(?:at|AT|@) ?{_CLOSE} ?[A-Za-z0-9-]++(?:(?:\.| ?{_OPEN} ?(?:dot|DOT|\.) ?{_CLOSE} ?)[A-Za-z0-9-]++)++",
    r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+){3}(?![0-9.])",
    r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    r"(?<![0-9+./-])(?:\([0-9]{2,5}\)|00[0-9]{2,3}|0[0-9]{2,4}|[0-9]{3})[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}+(?![0-9./-])",
)
#: What a text needs for a match to be possible; cheaper than to look for matches.
_BASE_NEEDS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "+")
_WIDE_NEEDS = (rf"{_OPEN} ?(?:at|AT|@) ?{_CLOSE}", r"[0-9][\[(](?:\.|dot)[\])][0-9]", r"[0-9]{4}[./_][0-9]{4}", r"[0-9)][\x20./-]{1,2}[0-9]{2}")

# Gazetteers: fixed values.
DOMAIN_ENDINGS = "com org net edu gov mil int info biz io co me tv dev app ai de fr es it uk nl be ch at pt pl se no fi dk cz ru ua gr ro hu ie us ca mx br ar cl au nz jp cn kr in za tr il".split()
FILE_ENDINGS = "png jpg jpeg gif svg webp css js html htm php py txt pdf zip xml json".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split()
ISSUERS = r"4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|5[1-5][0-9]{14}|222[1-9][0-9]{12}|22[3-9][0-9]{13}|2[3-6][0-9]{14}|27[01][0-9]{13}|2720[0-9]{12}|3[47][0-9]{13}|3[068][0-9]{12}|6011[0-9]{12}|65[0-9]{14}|35[0-9]{14}|62[0-9]{14}"
RESERVED_NETWORKS = r"0|127|22[4-9]|2[3-5][0-9]"
CONTEXT_FOR = (
    "mail|e-mail|email|contact|write|reach|send|correo|courriel|kontakt|contacto",
    "ip|host|server|address|login|client|gateway|from|adresse",
    "card|visa|mastercard|credit|debit|amex|karte|tarjeta|carte",
    "tel|phone|telephone|call|mobile|cell|fax|dial|telefon|anruf|handy|teléfono|téléphone",
)
CONTEXT_AGAINST = (
    "version|package|scale|decorator|param",
    "version|ver|v|release|section|chapter|rev|build|firmware|licen[sc]e",
    "isbn|issn|order|invoice|serial|tracking|token|key|imei|ticket|reference|ref",
    "isbn|issn|order|invoice|serial|tracking|date|dated|page|pages|version|ticket|reference|ref|score|lines",
)


@dataclass(frozen=True)
class Model:
    #: Chance that a vote is right, before any data: of labelers as in LABELERS. Their weight in candidates.
    prior: tuple[float, ...] = (0.9, 0.75, 0.8, 0.65)
    prior_weight: float = 20.0
    #: Spans and others among the matches of base and of wider patterns, before any data.
    shares: tuple[tuple[float, float], tuple[float, float]] = ((2.0, 2.0), (1.0, 4.0))
    #: Labelers are taken to be better than chance.
    least: float = 0.55
    most: float = 0.99
    tolerance: float = 1e-9
    #: A word before candidates is one of 4,096 buckets, and counts from this many candidates.
    word_buckets: int = 4096
    word_least: int = 8
    ridge: float = 1.0
    #: Probability from which a candidate is a span.
    threshold: float = 0.5


# ---- running sums and matches with their places

_BLOCK = 256


def _scan(x: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element, op over all before it; in blocks, since an array grows by copying."""

    def inside(block: Column) -> Column:
        start = F.struct(zero.alias("s"), F.array().cast(f"array<{kind}>").alias("a"))
        return F.aggregate(block, start, lambda acc, v: F.struct(op(acc.s, v).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")))

    def joined(blocks: Column) -> Column:
        ahead = inside(F.transform(blocks, lambda b: b.s)).a
        return F.flatten(F.zip_with(blocks, ahead, lambda b, before: F.transform(b.a, lambda v: op(before, v))))

    blocks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(_BLOCK)), lambda k: inside(F.slice(x, k + 1, F.lit(_BLOCK))))
    return F.when(F.size(x) == 0, F.array().cast(f"array<{kind}>")).otherwise(let(blocks, joined))


def _hits(text: Column, pattern: str, needs: str, wide: bool) -> Column:
    """at, until (code points), s, d (its digits), wide, left and right (text around) of all matches, from left to right."""
    kind = "array<struct<at:int,until:int,s:string,d:string,wide:boolean,left:string,right:string>>"

    def placed(parts: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        return let(
            _scan(sizes, F.lit(0), lambda a, b: a + b, "int"),
            lambda before: F.transform(
                hits,
                lambda h, k: F.struct(
                    (F.get(before, k) + F.length(F.get(parts, k))).alias("at"),
                    (F.get(before, k) + F.length(F.get(parts, k)) + F.length(h)).alias("until"),
                    h.alias("s"),
                    digits(h).alias("d"),
                    F.lit(wide).alias("wide"),
                    F.substring(F.get(parts, k), -40, 40).alias("left"),
                    F.substring(F.get(parts, k + 1), 1, 8).alias("right"),
                ),
            ),
        )

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda parts: placed(parts, hits))))
    possible = F.contains(text, F.lit(needs)) if needs in "@+" else F.rlike(text, F.lit(needs))
    return F.coalesce(F.when(possible, found), F.array().cast(kind))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a run of digits is right."""
    back = F.reverse(number)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return (F.length(number) > 0) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), worth), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _small(part: Column) -> Column:
    """Whether a run of digits is a number up to 255, however many zeros it starts with."""
    core = F.ltrim(part, F.lit("0"))
    return (F.length(core) < 3) | ((F.length(core) == 3) & (core <= "255"))


def _holds(kind: int, h: Column) -> Column:
    """Whether a match of the base pattern passes the kind's check."""
    if kind == 1:
        return F.forall(F.split(h.s, r"\."), _small)
    if kind == 2:
        return luhn(h.d)
    if kind == 3:
        return F.length(h.d).between(9, 15)
    return F.lit(True)


# ---- labelers


def _vote(*cases: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for given, vote in reversed(cases):
        out = F.when(given, vote).otherwise(out)
    return out


def _votes(kind: int, h: Column) -> list[Column]:
    """What the labelers say, in the order of LABELERS: 1, 0 or -1."""
    s, n = h.s, F.length(h.d)
    end = F.lower(F.regexp_extract(s, "([A-Za-z0-9-]+)$", 1))
    near = r"(?iu)(?<![\p{{L}}\d])(?:{})(?![\p{{L}}\d])[^.!?\n]{{0,16}}$"
    context = _vote((F.rlike(h.left, F.lit(near.format(CONTEXT_AGAINST[kind]))), -1), (F.rlike(h.left, F.lit(near.format(CONTEXT_FOR[kind]))), 1))
    if kind == 0:
        form = _vote((F.rlike(end, F.lit("^(?:[0-9].*|.)$")), -1), (F.contains(s, F.lit("@")), 1))
        gazetteer = _vote((end.isin(*FILE_ENDINGS), -1), (end.isin(*DOMAIN_ENDINGS), 1))
        layout = _vote((F.contains(s, F.lit("..")) | F.rlike(s, F.lit(r"^\.|\.@|^.{65}")), -1), (F.rlike(s, F.lit("^[A-Za-z]")), 1))
    elif kind == 1:
        parts = F.split(F.regexp_replace(s, "[^0-9]+", "."), r"\.")
        form = _vote((F.exists(parts, lambda x: ~_small(x) | F.rlike(x, F.lit("^0[0-9]"))), -1), (F.lit(True), 1))
        gazetteer = _vote((F.rlike(F.get(parts, F.lit(0)), F.lit(f"^(?:{RESERVED_NETWORKS})$")), -1), (F.lit(True), 1))
        layout = _vote((F.rlike(h.right, F.lit(r"^[.-]?[0-9A-Za-z]")) | F.rlike(h.left, F.lit(r"[A-Za-z.-]$")), -1), (F.lit(True), 1))
    elif kind == 2:
        form = _vote((luhn(h.d), 1), (F.lit(True), -1))
        gazetteer = _vote((F.rlike(h.d, F.lit(f"^(?:{ISSUERS})$")), 1), (F.lit(True), -1))
        layout = _vote((F.rlike(s, F.lit(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$")), 1), (F.rlike(h.left, F.lit(r"[A-Za-z0-9_=/#-]$")) | F.rlike(h.right, F.lit(r"^[A-Za-z0-9_/]")), -1))
    else:
        code = "|".join(CALLING_CODES)
        form = _vote((~n.between(7, 15), -1), (F.rlike(s, F.lit(r"^[+(0]")) & n.between(9, 15), 1), (~F.rlike(s, F.lit(r"^[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$")), -1))
        gazetteer = _vote((F.rlike(s, F.lit(rf"^(?:\+|00)(?:{code})")), 1), (F.rlike(s, F.lit(r"^(?:\+|00)")), -1))
        layout = _vote((F.rlike(s, F.lit(r"^[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{2,4}$|^[0-9]{4}([./-])[0-9]{1,2}\2[0-9]{1,2}$|/|^[0-9.]+$")), -1), (F.rlike(s, F.lit(r"[()-]")), 1))
    return [form, gazetteer, context, layout]


def _level(x: Column, *bounds: int) -> Column:
    """How many of the bounds x reaches."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


#: Levels of the features besides kind, votes and context: digits, separators, what follows.
_DIGITS, _SEPARATORS, _AFTER, _WORDS = 8, 4, 4, 6


def _described(kind: int, h: Column, model: Model) -> Column:
    """A candidate as small numbers. group: kind and pattern, since the two patterns of a kind are right in different shares."""
    pattern = sum((v * 3**k for k, v in enumerate(_votes(kind, h))), F.lit((81 - 1) // 2))
    number = _level(F.length(h.d), 1, 4, 7, 9, 11, 13, 16)
    separators = let(F.length(F.regexp_replace(h.s, "[A-Za-z0-9]", "")), lambda n: _level(n, 1, 3, 5))
    after = F.when(h.right == "", 0).when(F.rlike(h.right, F.lit(r"^\s")), 1).when(F.rlike(h.right, F.lit(r"^[.,;:!?)\]]")), 2).otherwise(3)
    word = F.lower(F.regexp_extract(h.left, r"([\p{L}]+)[^\p{L}]{0,8}$", 1))
    return F.struct(
        h.at.alias("at"),
        h.until.alias("until"),
        F.lit(kind).alias("kind"),
        (~h.wide & _holds(kind, h)).alias("base"),
        (F.lit(2 * kind) + h.wide.cast("int")).alias("group"),
        pattern.cast("int").alias("votes"),
        ((number * _SEPARATORS + separators) * _AFTER + after).cast("int").alias("layout"),
        F.pmod(F.xxhash64(word), F.lit(model.word_buckets)).cast("int").alias("word"),
    )


def _describer(kind: int, model: Model) -> Callable[[Column], Column]:
    return lambda h: _described(kind, h, model)


def _apart(spans: Column) -> Column:
    """Candidates without those that aren't base and overlap one that is."""
    far = (1 << 31) - 1

    def kept(x: Column) -> Column:
        before = _scan(F.transform(x, lambda e: F.when(e.base, e.until).otherwise(0)), F.lit(0), F.greatest, "int")
        behind = F.reverse(_scan(F.transform(F.reverse(x), lambda e: F.when(e.base, e.at).otherwise(far)), F.lit(far), F.least, "int"))
        return let(F.struct(before.alias("b"), behind.alias("a")), lambda p: F.filter(x, lambda e, k: e.base | (F.get(p.b, k) <= e.at) & (F.get(p.a, k) >= e.until)))

    return let(F.array_sort(spans), lambda x: F.when(F.exists(x, lambda e: ~e.base), kept(x)).otherwise(x))


def candidates(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, spans: each row's candidates in order of place, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for kind in range(len(KINDS)):
        base, wide = _hits(text, BASE[kind], _BASE_NEEDS[kind], False), _hits(text, WIDE[kind], _WIDE_NEEDS[kind], True)
        found.append(F.transform(F.concat(base, wide), _describer(kind, model)))
    return docs.select("doc_id", let(F.concat(*found), _apart).alias("spans"))


# ---- reliabilities and the classifier


def reliabilities(counts: dict[tuple[int, int], int], model: Model = Model()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of a span per group, of a right vote per kind and labeler, and the posterior of each (group, vote pattern), by EM on the patterns' counts."""
    n = np.zeros((2 * len(KINDS), 81))
    for (group, pattern), count in counts.items():
        n[group, pattern] = count
    votes = np.array([[p // 3**k % 3 - 1 for k in range(4)] for p in range(81)])
    yes, no = np.tile(np.array(model.shares), (len(KINDS), 1)).reshape(-1, 2).T
    share, right = yes / (yes + no), np.tile(np.array(model.prior), (len(KINDS), 1))
    prior, w = np.array(model.prior), model.prior_weight

    def posterior() -> np.ndarray:
        odds = np.log(share / (1 - share))[:, None] + np.repeat(np.log(right / (1 - right)) @ votes.T, 2, axis=0)
        return 1 / (1 + np.exp(-odds))

    for _ in range(10_000):
        p = posterior()
        by_kind = lambda x: x.reshape(len(KINDS), 2, -1).sum(1)
        agree = by_kind((n * p) @ (votes == 1) + (n * (1 - p)) @ (votes == -1))
        new = np.clip((w * prior + agree) / (w + by_kind(n @ (votes != 0))), model.least, model.most)
        new_share = np.clip((yes + (n * p).sum(1)) / (yes + no + n.sum(1)), 0.02, 0.98)
        moved = max(np.abs(new - right).max(), np.abs(new_share - share).max())
        right, share = new, new_share
        if moved < model.tolerance:
            break
    return share, right, posterior()


_SIZE = 2 + 4 * 3 + _DIGITS + _SEPARATORS + _AFTER + _WORDS


def _features(group: int, votes: int, layout: int, word: int) -> list[int]:
    """Places of a candidate's features in the table of weights: each kind has its own."""
    at = group // 2 * _SIZE
    out = [at + group % 2]
    at += 2
    for k in range(4):
        out.append(at + votes // 3**k % 3)
        at += 3
    for size, value in ((_DIGITS, layout // (_SEPARATORS * _AFTER)), (_SEPARATORS, layout // _AFTER % _SEPARATORS), (_AFTER, layout % _AFTER), (_WORDS, word)):
        out.append(at + value)
        at += size
    return out


def trained(rows: list[tuple[int, int, int, int, int]], posterior: np.ndarray, model: Model = Model()) -> np.ndarray:
    """Weights of a logistic classifier, by Newton steps. rows: group, votes, layout, word level, and how many candidates have these."""
    weights = np.zeros(len(KINDS) * _SIZE)
    if not rows:
        return weights
    x = np.zeros((len(rows), len(weights)))
    for k, (group, votes, layout, word, _) in enumerate(rows):
        x[k, _features(group, votes, layout, word)] = 1
    n, y = np.array([r[4] for r in rows], dtype=float), np.array([posterior[r[0], r[1]] for r in rows])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - y)) + model.ridge * weights
        curve = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + model.ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _numbers(values: list, kind: str) -> Column:
    """A fixed table as a column: one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class Fitted:
    share: np.ndarray
    right: np.ndarray
    posterior: np.ndarray
    #: Level of each (kind, word bucket): 0 if rare, else 1 (never a span) to 5.
    words: np.ndarray
    weights: np.ndarray


def fit(spans: DataFrame, model: Model = Model()) -> Fitted:
    """Reliabilities, context words and classifier from all candidates. spans: candidates(), kept in a table."""
    each = spans.select(F.explode("spans").alias("e")).select("e.group", "e.votes", "e.layout", "e.word")
    one = F.count(F.lit(1)).alias("n")
    counts = {(r.group, r.votes): r.n for r in each.groupBy("group", "votes").agg(one).collect()}  # at most 648 rows
    share, right, posterior = reliabilities(counts, model)
    p = F.get(_numbers([float(x) for x in posterior.ravel()], "double"), F.col("group") * 81 + F.col("votes"))
    kind = F.floor(F.col("group") / 2).cast("int")
    seen = each.groupBy(kind.alias("kind"), "word").agg(F.sum(p).alias("p"), one).where(F.col("n") >= model.word_least).collect()  # at most 4 times word_buckets
    words = np.zeros((len(KINDS), model.word_buckets), dtype=int)
    for r in seen:
        words[r.kind, r.word] = 1 + min(4, int(5 * (r.p + 1) / (r.n + 2)))
    level = _word_level(words, kind, F.col("word"), model)
    sums = each.select("group", "votes", "layout", level.alias("level")).groupBy("group", "votes", "layout", "level").agg(one)
    rows = sorted(tuple(r) for r in sums.collect())  # bounded by the product of the levels
    return Fitted(share, right, posterior, words, trained(rows, posterior, model))


def _word_level(words: np.ndarray, kind: Column, word: Column, model: Model) -> Column:
    """One byte of a binary literal: no part of the table is built anew for a row."""
    table = F.lit(bytearray(48 + int(x) for x in words.ravel()))
    return F.substring(table, kind * model.word_buckets + word + 1, F.lit(1)).cast("string").cast("int")


def _score(fitted: Fitted, e: Column, model: Model) -> Column:
    """The classifier's log odds."""
    weights = F.array(*(F.lit(float(w)) for w in fitted.weights))
    at = e.kind * _SIZE
    places = [at + e.group % 2, *(at + 2 + 3 * k + F.floor(e.votes / 3**k).cast("int") % 3 for k in range(4))]
    first = 2 + 4 * 3
    values = (F.floor(e.layout / (_SEPARATORS * _AFTER)).cast("int"), F.floor(e.layout / _AFTER).cast("int") % _SEPARATORS, e.layout % _AFTER, _word_level(fitted.words, e.kind, e.word, model))
    for size, value in zip((_DIGITS, _SEPARATORS, _AFTER, _WORDS), values, strict=True):
        places.append(at + first + value)
        first += size
    return let(weights, lambda w: sum((F.get(w, p) for p in places), F.lit(0.0)))


def spans(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, base, spans: arrays of (at, until, kind, base, ...) by place, then kind, for every row of docs; base spans are among the spans."""
    kept = Scratch(docs.sparkSession, "pii").keep(candidates(docs, model), "candidates")
    fitted = fit(kept, model)
    bar = math.log(model.threshold / (1 - model.threshold))
    return kept.select("doc_id", F.filter("spans", lambda e: e.base).alias("base"), F.filter("spans", lambda e: e.base | (_score(fitted, e, model) > bar)).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(found, lambda e: F.struct(e.at.alias("at"), e.kind.alias("kind"), e.until.alias("until"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat_ws(":", F.get(names, e.kind), e.at, e.until)), ",")
