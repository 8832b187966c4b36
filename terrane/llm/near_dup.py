"""MinHash near-duplicates by fast similarity sketching.

A document is its set of word shingles. Sketches are made in rounds: in round i each shingle
is hashed to one bin with a value in [i, i+1), and after as many rounds as there are bins,
round bins+j puts every shingle into bin j, so every bin of a non-empty set fills. Each bin
keeps its least value. Bins are banded; documents with equal sets are one class, and classes
that share a band are candidates. Every link is confirmed on the full sets.

No bucket is expanded into all pairs. In a first step the members of a bucket are held against
one of them only (the most copied). Components of those links are found; then only buckets
whose members still lie in several components are looked at again, in blocks. A block first holds
sketches only, and keeps the members whose sketch and size may match one of another component; the
few that are left bring their full sets, and the block emits one link for two components that it
joins, never pairs. Blocks are bounded by members and by shingles, so long texts make small blocks.

With 80 bins in 20 bands of 4, a pair at the threshold 0.85 shares no band with a chance of
4e-7, and its sketches agree in fewer than 48 bins with a chance of 4e-7.

Defined cases: null text, or one without words, has an empty set and is its own component;
null doc_id takes part, and its component is the smallest id among the others, or null; rows
with equal ids keep their own sets; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .common import DOCUMENT_COLUMNS, Scratch, row_key


@dataclass(frozen=True)
class Similarity:
    shingle: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80
    bins: int = 80
    rows: int = 4
    #: Pairs whose sketches agree in a smaller share of bins are not verified.
    sketch_floor: float = 0.55
    #: Members of a bucket that one block holds when components are compared, and about how many shingles these have.
    block: int = 384
    #: A block's members go on if one bit of each bin agrees in such a share of bins: at the threshold fewer agree with a chance below 1e-7.
    bit_floor: float = 0.7
    block_shingles: int = 2_000_000


#: The digest query's contract.
CONTRACT = Similarity(shingle=3, percent=85, sketch_floor=0.6)


def sketches(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Sketch of each set: an array (sets, bins). values: all sets' 64-bit elements, one set after the other; empty sets keep the largest value."""
    n = len(counts)
    out = np.full((n, bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n), counts)
    todo, flat = values, out.reshape(-1)
    for i in range(2 * bins):
        if not len(todo):
            break
        h = textcodes.mix(todo + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        bin_ = ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        low = textcodes.mix(h) & np.uint64((1 << 55) - 1)
        np.minimum.at(flat, owner * bins + bin_, low | np.uint64(i << 55))
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.all():
            stay = open_[owner]
            todo, owner = todo[stay], owner[stay]
    return out


def _features(spec: Similarity):
    schema = pa.schema([("doc_id", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                values, counts = textcodes.shingles(*textcodes.words(batch.column("text").to_pylist()), spec.shingle)
                sketch = sketches(values, counts, spec.bins)
                ends = np.cumsum(counts)
                cls = [blake2b(values[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(ends, counts, strict=True)]
                groups = sketch.reshape(len(counts), -1, spec.rows)
                band = np.zeros(groups.shape[:2], dtype=np.uint64) + np.arange(groups.shape[1], dtype=np.uint64)
                for r in range(spec.rows):
                    band = textcodes.mix(band * np.uint64(0xD6E8FEB86659FD93) + groups[:, :, r])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * band.shape[1]), pa.array(band.reshape(-1).view(np.int64)))
                small = (sketch & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "_k1", "_k2")), pa.array(cls, pa.binary()), pa.array(counts), pa.array([x.tobytes() for x in small], pa.binary()), bands], schema=schema
                )

    return run, "doc_id long, _k1 long, _k2 long, cls binary, n_shingles long, sketch binary, bands array<long>"


def features(docs: DataFrame, spec: Similarity) -> DataFrame:
    """doc_id, row key, cls (names the set; null if empty), n_shingles, sketch, bands, for every row."""
    run, schema = _features(spec)
    return docs.select(F.col("doc_id").cast("long"), *row_key(), "text").mapInArrow(run, schema)


def _may_match(spec: Similarity):
    """Of pairs with both sketches and set sizes, those that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for k in ("sa", "sb"))
            ok = (np.minimum(na, nb) * 100 >= spec.percent * np.maximum(na, nb)) & ((a == c).sum(axis=1) >= spec.sketch_floor * spec.bins)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verified(spec: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                values, counts = textcodes.shingles(*textcodes.words(b.column("ta").to_pylist() + b.column("tb").to_pylist()), spec.shingle)
                ends, n = np.cumsum(counts), b.num_rows
                ok = []
                for k in range(n):
                    x, y = values[ends[k] - counts[k] : ends[k]], values[ends[n + k] - counts[n + k] : ends[n + k]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= spec.percent * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def class_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls, text: of the classes in wanted (cls), the text of the row that stands for each."""
    keyed = classes.join(wanted, "cls").select("cls", "_k1", "_k2")
    return docs.select(*row_key(), "text").join(keyed, ["_k1", "_k2"]).dropDuplicates(["cls"]).select("cls", "text")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, spec: Similarity, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough.

    Sizes and sketches go first; then the texts of the classes still concerned are fetched once,
    and each pair's texts meet. A class with many pairs is a split join side under adaptive execution.
    """
    one = classes.select("cls", "n_shingles", "sketch")
    a = one.toDF("a", "na", "sa")
    b = one.toDF("b", "nb", "sb")
    near = scratch.keep(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_may_match(spec), "a binary, b binary"), "near")
    involved = near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).distinct()
    texts = scratch.keep(class_texts(involved, classes, docs), "texts")
    met = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    links = scratch.keep(met.select("a", "b", "ta", "tb").mapInArrow(_verified(spec), "a binary, b binary"), "links")
    scratch.drop(texts)
    return links


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the least node of its component), of edges (a, b) between binary ids.

    Alternates large-star and small-star steps, which never gather a node's neighbours: only
    their least one, which is summed up before the shuffle.
    """
    current = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        last = current
        both = current.union(current.select("v", "u").toDF("u", "v"))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, "large")
        small_least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        met = large.join(small_least, "u")
        small = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = scratch.keep(small, "edges")
        if current.join(last, ["u", "v"], "left_anti").isEmpty() and last.join(current, ["u", "v"], "left_anti").isEmpty():
            break
        for old in (last, least, large, small_least):
            scratch.drop(old)
    return current.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _sets(spec: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                values, counts = textcodes.shingles(*textcodes.words(b.column("text").to_pylist()), spec.shingle)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())], names=["cls", "shingles"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets left with all sets right, as a matrix."""
    every = [*left, *right]
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    values, place, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, len(shared), 2048):
        lo, hi = np.searchsorted(column, [first, first + 2048])
        m = np.zeros((len(every), 2048), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return np.rint(out).astype(np.int64)


def agreements(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bins the lowest bits of each sketch left and each sketch right agree, as one product of matrices."""
    a, b = (((x & 1) * 2.0 - 1.0).astype(np.float32) for x in (left, right))
    return (a @ b.T + left.shape[1]) / 2


def _open_members(spec: Similarity):
    """Of two blocks of a bucket (or one, against itself), the members whose sketches and sizes may match one of another component."""

    def run(group: pa.Table) -> pa.Table:
        left, right, label = _sides(group)
        stays = np.zeros(group.num_rows, dtype=bool)
        if len(left) and label.max() > 0:
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint16).reshape(group.num_rows, -1)
            n = group.column("n_shingles").to_numpy()
            near = (label[left][:, None] != label[right][None, :]) & (np.minimum.outer(n[left], n[right]) * 100 >= spec.percent * np.maximum.outer(n[left], n[right]))
            near &= agreements(sketch[left], sketch[right]) >= spec.bit_floor * spec.bins
            stays[left[near.any(axis=1)]] = True
            stays[right[near.any(axis=0)]] = True
        return group.filter(pa.array(stays)).drop_columns(["sketch", "n_shingles"])

    return run


def _numbered(labels: list[bytes]) -> np.ndarray:
    name: dict[bytes, int] = {}
    return np.array([name.setdefault(x, len(name)) for x in labels], dtype=np.int64)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the members left and right (the same, if a block meets itself), and all members' components as numbers."""
    side = group.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left, _numbered(group.column("label").to_pylist())


def _across(spec: Similarity):
    """Links between components within two blocks of a bucket (or one, against itself), confirmed on the full sets; of links that join the same components one is enough."""

    def run(group: pa.Table) -> pa.Table:
        left, right, label = _sides(group)
        found: list[tuple[bytes, bytes]] = []
        if len(left) and label.max() > 0:
            sets, cls = [np.frombuffer(v, dtype=np.uint64) for v in group.column("shingles").to_pylist()], group.column("cls").to_pylist()
            both = intersections([sets[k] for k in left], [sets[k] for k in right])
            sizes = np.add.outer([len(sets[k]) for k in left], [len(sets[k]) for k in right])
            root = list(range(label.max() + 1))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for k, j in np.argwhere((100 * both >= spec.percent * (sizes - both)) & (label[left][:, None] != label[right][None, :])):
                x, y = top(label[left[k]]), top(label[right[j]])
                if x != y:
                    root[x] = y
                    found.append((min(cls[left[k]], cls[right[j]]), max(cls[left[k]], cls[right[j]])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def open_links(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, spec: Similarity, scratch: Scratch) -> DataFrame:
    """Confirmed links (a, b) between components, in the buckets that still hold several; they join all components that any link of the bucket would. members: band, cls, n_shingles."""
    own = members.join(labels.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    # a bucket's largest component needs no look at itself: only blocks of the rest meet all blocks, itself and the largest's
    sizes = own.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    most = F.max(F.struct("n", "label", "s"))
    several = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("labels"), most.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("labels > 1")

    def blocks(n: Column, s: Column) -> Column:
        return F.ceil(F.greatest(n / spec.block, s / spec.block_shingles)).cast("int")

    several = scratch.keep(several.select("band", F.col("top.label").alias("largest"), blocks(F.col("top.n"), F.col("top.s")).alias("large"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("rest")), "several")
    rows = scratch.keep(own.join(several, "band").select("band", "cls", "label", "n_shingles", (F.col("label") == F.col("largest")).alias("in_large"), "large", "rest"), "open")
    at = F.xxhash64("cls")
    rows = rows.withColumn("block", F.when(F.col("in_large"), F.col("rest") + F.pmod(at, F.col("large"))).otherwise(F.pmod(at, F.col("rest"))).cast("int"))
    # a block meets each block of a higher number, and itself
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("in_large"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("large") - 1))))
    dealt = dealt.select("band", "cls", "label", "n_shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    sketched = dealt.join(classes.select("cls", "sketch"), "cls").select("band", "i", "j", "side", "cls", "label", "n_shingles", "sketch")
    near = scratch.keep(sketched.groupBy("band", "i", "j").applyInArrow(_open_members(spec), "band long, i int, j int, side int, cls binary, label binary"), "near-members")
    sets = scratch.keep(class_texts(near.select("cls").distinct(), classes, docs).mapInArrow(_sets(spec), "cls binary, shingles binary"), "sets")
    links = near.join(sets, "cls").groupBy("band", "i", "j").applyInArrow(_across(spec), "a binary, b binary")
    return links.distinct()


def classify(docs: DataFrame, spec: Similarity = Similarity()) -> DataFrame:
    """Per row of docs: doc_id, _k1, _k2, n_shingles, component_id, label (the component; null for an empty set)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    every = scratch.keep(features(docs, spec), "features")
    by_class = every.where(F.col("cls").isNotNull()).groupBy("cls")
    # of a class's rows, one stands for it: its key, with which its text is found
    one = F.min(F.struct("_k1", "_k2", "n_shingles", "sketch", "bands")).alias("one")
    classes = scratch.keep(by_class.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), one).select("cls", "first_id", "copies", "one.*"), "classes")
    banded = classes.select("cls", "copies", "n_shingles", F.explode("bands").alias("band"))
    # a bucket's pivot: the class with most copies
    pivots = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "cls")).alias("top")).where("n > 1").select("band", F.col("top.cls").alias("pivot"))
    # kept, so that both sides of the join are plain shuffles and a large bucket can be split
    pivots = scratch.keep(pivots, "pivots")
    members = scratch.keep(banded.join(pivots, "band").select("band", "cls", "n_shingles", "pivot"), "members")
    stars = members.where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    links = verify(stars, classes, docs, spec, scratch)
    labels = components(links, scratch)
    more = scratch.keep(open_links(members.select("band", "cls", "n_shingles"), labels, classes, docs, spec, scratch), "links")
    if not more.isEmpty():
        labels = components(links.union(more), scratch)
    named = classes.select("cls", "first_id").join(labels.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = scratch.keep(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    whole = scratch.keep(scratch.keep(named.select("cls", "label"), "named").join(least, "label"), "components")
    rows = every.select("doc_id", "_k1", "_k2", "cls", "n_shingles").join(whole, "cls", "left")
    return rows.select("doc_id", "_k1", "_k2", "n_shingles", _own("component_id").alias("component_id"), "label")


def _own(component: str) -> Column:
    return F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col(component))


def near_duplicates(docs: DataFrame, spec: Similarity = Similarity()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    rows = classify(docs, spec)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def clean(docs: DataFrame, spec: Similarity = Similarity()) -> DataFrame:
    """One document of each component, that with the smallest id; documents without words stay. The columns of documents.

    Rows without id stay where no row of their component has one, one of them; of rows that share the smallest id, one stays.
    """
    rows = classify(docs, spec)
    first = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("x")).select("x._k1", "x._k2")
    empty = rows.where(F.col("label").isNull()).select("_k1", "_k2")
    keys = first.withColumn("one", F.lit(True)).union(empty.withColumn("one", F.lit(False))).dropDuplicates(["_k1", "_k2"])
    kept = docs.select(*DOCUMENT_COLUMNS, *row_key()).join(keys, ["_k1", "_k2"])
    once = kept.where("one").dropDuplicates(["_k1", "_k2"])
    return once.union(kept.where("not one")).select(*DOCUMENT_COLUMNS)
