"""Quality rules by cross-document line frequency.

Lines are normalised and hashed, distinct documents are counted per host and line, lines
above the limits go, and documents of which too little stays are rejected. DataFrame
functions only.

Host: the `source` column. A document counts once per text, so that copies of one document
don't turn its lines into boilerplate; a null host is a host like any other. Defined cases:
null or blank text has no words and no lines (it fails the base rule); repeated rows get one
result each, all alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, SPACES, SPACES_RE, Scratch, let, space_words, strip_spaces

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineLimits:
    """A line goes if over min_docs documents and over max_fraction of its host's documents have it.

    It also goes if over max_docs documents have it, whatever the host's size, so that the bar does
    not rise with a host. These are documents that keep min_left of their words without such lines:
    in a group of near copies all lines are shared, which is for near-duplicate removal to settle,
    and no reason to lose all.
    """

    min_docs: int = 5
    max_fraction: float = 0.1
    #: None: no absolute limit.
    max_docs: int | None = 10
    #: A document is depleted if less than this share of its words stays.
    min_left: float = 0.5


def _key() -> list[Column]:
    """Names a row by its content: rows that agree in id, host and text share it, and share all results."""
    return [F.xxhash64("doc_id", "source").alias("_k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k2")]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""
    hashes = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(F.size(words) - 2, F.lit(0)),
    )

    def covered(starts: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, start, lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a.n)

    def few(h: Column, twice: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return covered(F.filter(marked, lambda i: i.isNotNull()))

    def many(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda t: covered(
                F.array_sort(
                    F.transform(
                        F.filter(t, lambda e, k: (e.h == F.get(t, k + 1).h).eqNullSafe(True) | (e.h == F.get(t, F.greatest(k - 1, F.lit(0))).h) & (k > 0)),
                        lambda e: e.i,
                    )
                )
            ),
        )

    def repeated(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (x == F.get(s, i + 1)).eqNullSafe(True))))
        return let(twice, lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= 24, few(h, d)).otherwise(many(h)))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, the row key, the base rule's numbers, and the lines, for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", F.col("source").alias("host"), *_key(), text.alias("text"), space_words(text).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: strip_spaces(x) != "")
    out = first.select(
        "doc_id",
        "host",
        "_k1",
        "_k2",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        _lines(F.col("text")).alias("lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _lines(text: Column) -> Column:
    """Per line with a word: the hash of its normal form (lower case, one space between words) and its words."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(strip_spaces(x), SPACES_RE, " "))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.struct(F.xxhash64(F.lower(x)).alias("line"), F.size(F.split(x, " ")).alias("words")))


def _on_line(a: str, b: str) -> Column:
    return (F.col(f"{a}.line") == F.col(f"{b}.line")) & F.col(f"{a}.host").eqNullSafe(F.col(f"{b}.host"))


def common_lines(base: DataFrame, limits: LineLimits, scratch: Scratch) -> DataFrame:
    """host, line: those above the limits. Lines of few documents go before hosts are joined, so that join stays small. base: base_measures(), kept in a table."""
    lines = base.select("host", "_k2", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    counts = scratch.keep(lines.groupBy("host", "line").agg(F.count_distinct("_k2").alias("docs")).where(F.col("docs") > limits.min_docs), "counts")
    hosts = base.groupBy("host").agg(F.count_distinct("_k2").alias("all"))
    joined = counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    common = joined.where(F.col("docs") > limits.max_fraction * F.col("all")).select("c.host", "c.line")
    if limits.max_docs is None:
        return common
    often = counts.where(F.col("docs") > limits.max_docs)
    every = base.select("host", "_k2", "n_words", F.posexplode("lines").alias("at", "x")).select("host", "_k2", "n_words", "at", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    # copies of one text have the same lines in the same places, and count once
    held = scratch.keep(every.alias("e").join(often.alias("o"), _on_line("e", "o"), "left_semi").dropDuplicates(["host", "_k2", "at"]), "often")
    own = held.groupBy("host", "_k2", "n_words").agg(F.sum("words").alias("shared")).where(F.col("n_words") - F.col("shared") >= limits.min_left * F.col("n_words"))
    own = scratch.keep(own.select("host", "_k2"), "own")
    met = held.alias("e").join(own.alias("o"), (F.col("e._k2") == F.col("o._k2")) & F.col("e.host").eqNullSafe(F.col("o.host")), "left_semi")
    return common.union(met.groupBy("host", "line").agg(F.count_distinct("_k2").alias("docs")).where(F.col("docs") > limits.max_docs).select("host", "line")).distinct()


def removed_lines(base: DataFrame, limits: LineLimits, scratch: Scratch) -> DataFrame:
    """Row key, removed: the hashes of the lines that rows with this key lose. Rows that lose none are absent. base: base_measures(), kept in a table."""
    lines = base.select("host", "_k1", "_k2", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    common = common_lines(base, limits, scratch)
    hit = lines.alias("l").join(common.alias("c"), _on_line("l", "c"))
    return hit.groupBy("_k1", "_k2").agg(F.collect_set("l.line").alias("removed"))


def judged(docs: DataFrame, limits: LineLimits, scratch: Scratch) -> DataFrame:
    """base_measures(), removed, n_words_left and kept, for every row of docs. Texts are read once; everything else comes from the measures and line hashes."""
    base = scratch.keep(base_measures(docs), "measures")
    both = base.join(removed_lines(base, limits, scratch), ["_k1", "_k2"], "left")
    gone = F.filter("lines", lambda x: F.array_contains("removed", x.line))
    lost = F.when(F.col("removed").isNull(), 0).otherwise(F.aggregate(gone, F.lit(0), lambda a, x: a + x.words))
    both = both.withColumn("n_words_left", F.col("n_words") - lost)
    depleted = F.col("n_words_left") < limits.min_left * F.col("n_words")
    return both.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Per row of docs: the base numbers, the verdict, and the words that stay.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_words_left.
    """
    both = judged(docs, limits, Scratch(docs.sparkSession, "quality"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def clean(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that pass, without their common lines; the columns of documents."""
    keyed = docs.select(*DOCUMENT_COLUMNS, *_key())
    passed = judged(docs, limits, Scratch(docs.sparkSession, "quality")).where("kept").groupBy("_k1", "_k2").agg(F.first("removed").alias("removed"))
    both = keyed.join(passed, ["_k1", "_k2"])
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(F.lower(F.regexp_replace(strip_spaces(x), SPACES_RE, " ")))))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    return both.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
