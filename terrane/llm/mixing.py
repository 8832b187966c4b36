"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table predicts each document's posterior over domains. The
documents' rates are the nonnegative numbers whose expected domain token totals (the sum of
rate * tokens * posterior) come as near to the targets as they can: least squares, by
accelerated projected gradient from rate 1, with restarts. Differences from the targets are weighted
by the inverse of the posteriors' second moments, so that domains that are hard to tell apart, or
small, are met as fast as others. A step sums the documents to a few
numbers, one per domain; a document's rate is replayed from those of the last steps, and written
with its row every `kept_steps` steps.

Steps end when every domain's total is within `tolerance` of its target, or when the differences no
longer shrink (`still`): then the targets can't be met, and the rates are the nearest ones. The difference that
is left is given with the result (`residual`, a share of all tokens). If `steps` end first, that is
an error.

The classifier is Bernoulli naive Bayes over all words that some domain has significantly more
or less often, fitted on at most `max_labelled` labelled documents (a bounded sample, by hash of
doc_id). Everything else covers all documents.

Defined cases: null or blank text has no tokens and is classified by the absence of words;
labels without a document, documents without a label and repeated labels are fine (of several
domains for one id the first by name counts); without labels every document keeps rate 1;
repeated rows get one result each; other columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .common import DOCUMENT_COLUMNS, Scratch, ascii_lower, row_key, space_words


@dataclass(frozen=True)
class Mix:
    #: SQL on the labels table; its values name the domains.
    domain: str = "case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'plain' end"
    domains: tuple[str, ...] = ("good", "plain", "toxic")
    #: A domain's expected tokens in the mix, as a share of all tokens that there are.
    shares: tuple[float, ...] = (0.6, 0.36, 0.04)
    #: If set, instead: as a share of those that the domain has.
    weights: tuple[float, ...] | None = None
    max_labelled: int = 20_000
    #: The classifier keeps the words whose count in a domain is so many deviations off; their number is bounded by the sample.
    deviations: float = 6.0
    smoothing: float = 0.5
    tolerance: float = 1e-3
    #: Differences that shrink by less than this share within `kept_steps` steps are final.
    still: float = 1e-2
    steps: int = 5_000
    kept_steps: int = 24


@dataclass(frozen=True)
class Classifier:
    """codes: of its words, sorted; present: what a word adds to each domain's log-likelihood; base: without any word; fitted: whether there were labels."""

    codes: np.ndarray
    present: np.ndarray
    base: np.ndarray
    fitted: bool


def fit(docs: DataFrame, labels: DataFrame, mix: Mix) -> Classifier:
    named = labels.select("doc_id", F.expr(mix.domain).alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(*mix.domains))
    sample = named.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(mix.max_labelled)
    # the sample is at most max_labelled ids
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", F.array_distinct(space_words(ascii_lower(F.col("text")))).alias("words"))
    seen = Scratch(docs.sparkSession, "labelled").keep(seen)
    have = {r["domain"]: r["count"] for r in seen.groupBy("domain").count().collect()}
    sizes = np.array([have.get(d, 0) for d in mix.domains], dtype=float)
    total, k = sizes.sum(), len(mix.domains)
    columns = [F.sum((F.col("domain") == d).cast("int")).alias(f"n{i}") for i, d in enumerate(mix.domains)]
    counts = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *columns)
    off = F.greatest(F.lit(0.0), *(F.abs(F.col(f"n{i}") - F.col("n") * s / max(total, 1)) / F.sqrt(F.col("n") * max(s, 1) / max(total, 1)) for i, s in enumerate(sizes)))
    rows = counts.withColumn("off", off).where(F.col("off") > mix.deviations).collect()
    present = np.array([[r[f"n{i}"] for i in range(k)] for r in rows], dtype=float).reshape(-1, k)
    p = (present + mix.smoothing) / (sizes + 2 * mix.smoothing)
    priors = np.log((sizes + mix.smoothing) / (total + mix.smoothing * k))
    codes = textcodes.words([r["word"] for r in rows])[0]
    order = np.argsort(codes)
    return Classifier(codes[order], (np.log(p) - np.log1p(-p))[order], priors + np.log1p(-p).sum(axis=0), bool(total))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, row key, tokens, p (the posterior of each domain), for every row."""
    k = len(model.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                codes, counts = textcodes.words(b.column("text").to_pylist())
                score = np.tile(model.base, (b.num_rows, 1))
                if len(model.codes):
                    place = np.minimum(np.searchsorted(model.codes, codes), len(model.codes) - 1)
                    hit = model.codes[place] == codes
                    owner = np.repeat(np.arange(b.num_rows), counts)[hit]
                    pair = np.unique(owner * len(model.codes) + place[hit])
                    np.add.at(score, pair // len(model.codes), model.present[pair % len(model.codes)])
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "_k1", "_k2")), pa.array(counts), flat], names=["doc_id", "_k1", "_k2", "tokens", "p"])

    return docs.select(F.col("doc_id").cast("long"), *row_key(), "text").mapInArrow(run, "doc_id long, _k1 long, _k2 long, tokens long, p array<double>")


#: A step: weighted gradient by domain, and how far the next point goes on in the direction of the step.
Step = tuple[np.ndarray, float]
_STATE = "doc_id long, _k1 long, _k2 long, tokens long, p array<double>, r double, y double"


def _p(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _replay(b: pa.RecordBatch, steps: list[Step], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, and the point at which the next gradient is taken."""
    p, r, y = _p(b, k), b.column("r").to_numpy(), b.column("y").to_numpy()
    for g, on in steps:
        new = np.maximum(0.0, y - p @ g)
        r, y = new, new + on * (new - r)
    return r, y


def _totals(state: DataFrame, steps: list[Step], k: int) -> np.ndarray:
    """Expected domain tokens at the rates."""
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            r, _ = _replay(b, steps, k)
            total += (b.column("tokens").to_numpy() * r) @ _p(b, k)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

    out = state.select("tokens", "p", "r", "y").mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
    return np.array([x or 0.0 for x in out])


def _advanced(state: DataFrame, steps: list[Step], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, y = _replay(b, steps, k)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "_k1", "_k2", "tokens", "p")), pa.array(r), pa.array(y)], names=["doc_id", "_k1", "_k2", "tokens", "p", "r", "y"])

    return state.mapInArrow(run, _STATE)


def solve(members: DataFrame, mix: Mix, scratch: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """members with their rates (r), the targets, the totals reached, and all tokens. members: as posteriors() gives them, kept in a table."""
    k = len(mix.domains)
    state = members.withColumns({"r": F.lit(1.0), "y": F.lit(1.0)})
    cells = [F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]
    row = members.agg(F.sum("tokens").alias("tokens"), *cells).first()
    tokens = float(row["tokens"] or 0)
    if not tokens:
        return state, np.zeros(k), np.zeros(k), 0.0
    m = np.array([row[f"m{i}_{j}"] for i in range(k) for j in range(k)]).reshape(k, k) / tokens
    # with this weight the largest curvature is 1, and so is the step
    weight = np.linalg.inv(m + 1e-10 * np.eye(k))
    reached = _totals(state, [], k)
    targets = reached * np.array(mix.weights) if mix.weights else tokens * np.array(mix.shares)
    at, steps, age, kept = reached, [], 0, None
    off = (reached - targets) / tokens
    last = off @ weight @ off
    for _ in range(mix.steps):
        if np.abs(off).max() <= mix.tolerance:
            break
        g, before = weight @ (at - targets) / tokens, off @ weight @ off
        new = _totals(state, [*steps, (g, 0.0)], k)
        off = (new - targets) / tokens
        # totals are linear in the rates, so those of the next point follow; a step that made it worse ends the momentum
        age = 0 if off @ weight @ off > before else age + 1
        on = age / (age + 3)
        steps.append((g, on))
        at, reached = new + on * (new - reached), new
        if len(steps) == mix.kept_steps:
            old, state, steps = kept, scratch.keep(_advanced(state, steps, k), "state"), []
            if old is not None:
                scratch.drop(old)
            kept = state
            if (now := off @ weight @ off) > (1 - mix.still) * last:
                break
            last = now
    else:
        raise RuntimeError(f"mixing: {mix.steps} steps were not enough; of {tokens:.0f} tokens, targets {targets.tolist()}, reached {reached.tolist()}")
    return _advanced(state, steps, k), targets, reached, tokens


def rates(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of docs: doc_id, _k1, _k2, tokens, p, rate, residual (the largest difference of a domain's total from its target, as a share of all tokens)."""
    scratch = Scratch(docs.sparkSession, "members")
    model = fit(docs, labels, mix)
    members = scratch.keep(posteriors(docs, model))
    if not model.fitted:
        return members.withColumns({"rate": F.lit(1.0), "residual": F.lit(None).cast("double")})
    state, targets, reached, tokens = solve(members, mix, scratch)
    residual = float(np.abs(reached - targets).max() / tokens) if tokens else 0.0
    return state.select("doc_id", "_k1", "_k2", "tokens", "p", F.col("r").alias("rate"), F.lit(residual).alias("residual"))


def copies(rate, key):  # noqa: ANN001, ANN201 - columns
    """How often a document enters the mix: rate, rounded up or down at random by key, so that its expectation is rate."""
    u = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of docs: doc_id, tokens, p_<domain> ..., rate, n_copies, residual."""
    rows = rates(docs, labels, mix)
    named = [F.round(F.get("p", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(mix.domains)]
    return rows.select("doc_id", "tokens", *named, F.round("rate", 6).alias("rate"), copies(F.col("rate"), F.xxhash64("_k1", "_k2")).alias("n_copies"), F.round("residual", 9).alias("residual"))


def clean(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Each document as often as copies() says: its rate, rounded by its key so that totals are met in expectation; the columns of documents."""
    rows = rates(docs, labels, mix).select("_k1", "_k2", copies(F.col("rate"), F.xxhash64("_k1", "_k2")).alias("times"))
    chosen = rows.groupBy("_k1", "_k2").agg(F.max("times").alias("times")).where("times > 0")
    both = docs.select(*DOCUMENT_COLUMNS, *row_key()).join(chosen, ["_k1", "_k2"])
    return both.select(*DOCUMENT_COLUMNS, F.explode(F.sequence(F.lit(1), "times")).alias("_copy")).select(*DOCUMENT_COLUMNS)
