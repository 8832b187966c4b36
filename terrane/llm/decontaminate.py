"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of `window` words (the whole item, if it has fewer). A window
is a set of shingles; ordered by rarity over the documents, its first shingle is the prefix
that any document with the window must have, so documents are joined on that one shingle.
Position and length bounds place the window around it, and the words there are compared one by
one. DataFrame functions only.

Documents are looked through once, whatever the number of windows: of their shingles only those
that the benchmark has are kept, as (document, hash, place). They are counted for rarity, and those
that are some window's prefix are candidates. Documents with candidates, and no others, are read
again to compare words. The benchmark's hashes are broadcast while they are at most
`broadcast_rows`; a larger benchmark is joined by shuffle.

Defined cases: null text has no words; the windows of items with null id count like any others,
but nulls are not among the hashed ids, and all items without id count as one; repeated rows get
one result each; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, Scratch, ascii_lower, let, row_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Windows:
    window: int = 10
    shingle: int = 5
    #: A table of hashes and places of so many rows is broadcast (some 40 bytes each); a larger one is shuffled.
    broadcast_rows: int = 1_000_000


def words(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _shingles(run: Column, sizes: list[int]) -> Column:
    """The shingles of these sizes, as (h, at). Words are hashed once each, shingles over the words' hashes."""

    def of(hashes: Column, size: int) -> Column:
        return F.transform(
            F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - size + 1, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(F.lit(size), w, *(F.get(hashes, i + k) for k in range(1, size))).alias("h"), i.alias("at")),
        )

    return let(F.transform(run, lambda w: F.xxhash64(w)), lambda hashes: F.concat(*(of(hashes, size) for size in sizes)))


def item_windows(benchmark: DataFrame, spec: Windows) -> DataFrame:
    """item_id (string), key (of the window's words), run (its words), for every window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - spec.window + 1, F.lit(1)))
    cut = items.where(F.size("words") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, spec.window))).alias("run"))
    return cut.select("item_id", F.md5(F.array_join("run", " ").cast("binary")).alias("key"), "run")


def _sizes(windows: DataFrame, spec: Windows) -> list[int]:
    """Shingle sizes in use: `shingle`, and the lengths of shorter items; at most `shingle` numbers."""
    sizes = windows.select(F.least(F.size("run"), F.lit(spec.shingle)).alias("n")).distinct().collect()
    return sorted(r.n for r in sizes)


def _side(df: DataFrame, spec: Windows) -> DataFrame:
    """A join side, broadcast if it is small. df: kept in a table."""
    return F.broadcast(df) if df.count() <= spec.broadcast_rows else df


def hits(docs: DataFrame, windows: DataFrame, spec: Windows, scratch: Scratch) -> DataFrame:
    """_k1, _k2, key, start, n: every place in a document where a window's words stand. windows: as item_windows gives them, kept in a table."""
    sizes = _sizes(windows, spec)
    if not sizes:
        return docs.sparkSession.createDataFrame([], "_k1 long, _k2 long, key string, start int, n int")
    distinct = windows.groupBy("key").agg(F.first("run").alias("run"))
    size = F.least(F.size("run"), F.lit(spec.shingle))
    choice = F.coalesce(*(F.when(size == n, _shingles(F.col("run"), [n])) for n in sizes))
    parts = scratch.keep(distinct.select("key", F.size("run").alias("n"), F.explode(choice).alias("s")).select("key", "n", "s.h", "s.at"), "parts")
    known = scratch.keep(parts.select("h").distinct(), "hashes")
    every = docs.select(*row_key(), words(F.col("text")).alias("words")).select("_k1", "_k2", F.explode(_shingles(F.col("words"), sizes)).alias("s"))
    # the one look through all documents; rows that are equal count once
    found = scratch.keep(every.select("_k1", "_k2", "s.h", "s.at").join(_side(known, spec), "h", "left_semi").distinct(), "found")
    often = scratch.keep(found.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "often")
    ranked = parts.join(_side(often, spec), "h", "left").select("key", "n", "h", "at", F.coalesce("often", F.lit(0)).alias("often"))
    rarest = ranked.groupBy("key").agg(F.min(F.struct("often", "h", "at")).alias("s"), F.first("n").alias("n"))
    # a window with a shingle that no document has is in none
    prefix = scratch.keep(rarest.where("s.often > 0").select("key", "n", "s.h", F.col("s.at").alias("inside")), "prefixes")
    near = found.join(_side(prefix, spec), "h").select("_k1", "_k2", "key", "n", (F.col("at") - F.col("inside")).alias("start")).where("start >= 0")
    near = scratch.keep(near, "candidates")
    # a document's candidates as one list, so that its words are read once, however many there are
    asked = scratch.keep(near.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("key", "start", "n")).alias("places")), "asked")
    keys = scratch.keep(asked.select("_k1", "_k2"), "keys")
    texts = docs.select(*row_key(), "text").join(_side(keys, spec), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    runs = scratch.keep(distinct.join(near.select("key").distinct(), "key", "left_semi"), "runs")
    met = scratch.keep(texts.select("_k1", "_k2", words(F.col("text")).alias("words")), "texts").join(asked, ["_k1", "_k2"])
    inside = F.filter("places", lambda x: x.start + x.n <= F.size("words"))
    cut = met.select("_k1", "_k2", F.inline(F.transform(inside, lambda x: F.struct(x.key.alias("key"), x.start.alias("start"), x.n.alias("n"), F.slice("words", x.start + 1, x.n).alias("here")))))
    return cut.join(_side(runs, spec), "key").where(F.col("here") == F.col("run")).select("_k1", "_k2", "key", "start", "n")


def _covered(spans: Column) -> Column:
    """Words inside the spans (start, n), which may overlap."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, s: F.struct((a.total + F.greatest(s.start + s.n - F.greatest(a.end, s.start), F.lit(0))).alias("total"), F.greatest(a.end, s.start + s.n).alias("end")),
        lambda a: a.total,
    )


def contamination(docs: DataFrame, benchmark: DataFrame, spec: Windows = Windows()) -> DataFrame:
    """Row key, n_hit, n_items, items (sorted item_ids), for the documents that have a window of an item."""
    scratch = Scratch(docs.sparkSession, "windows")
    windows = scratch.keep(item_windows(benchmark, spec), "items")
    places = scratch.keep(hits(docs, windows, spec, scratch).distinct(), "hits")
    # a document's spans are no more than its words
    words_hit = places.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "n")).alias("spans")).select("_k1", "_k2", _covered(F.col("spans")).cast("long").alias("n_hit"))
    items = places.select("_k1", "_k2", "key").distinct().join(windows.select("key", "item_id").distinct(), "key").select("_k1", "_k2", "item_id").distinct()
    named = items.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.count(F.lit(1)).alias("n_items"))
    return words_hit.join(named, ["_k1", "_k2"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, spec: Windows = Windows()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    every = docs.select("doc_id", *row_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    both = every.join(contamination(docs, benchmark, spec), ["_k1", "_k2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, spec: Windows = Windows()) -> DataFrame:
    """The documents without a window of any item; the columns of documents."""
    return docs.select(*DOCUMENT_COLUMNS, *row_key()).join(contamination(docs, benchmark, spec), ["_k1", "_k2"], "left_anti").select(*DOCUMENT_COLUMNS)
