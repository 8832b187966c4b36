"""Language-model scores by deleted interpolation.

An n-gram model (`order` words; three by default): maximum-likelihood estimates of each order, mixed
with those of the orders below by weights that depend on how often the context occurred (buckets of
its count, by powers of two). The weights are learned by expectation-maximisation on counts held out
from the training documents: one tenth of the documents is deleted from the counts, its tokens are
predicted from the rest. Orders are learned from the lowest up, each on the mixture below it. The
final estimates use all training documents' counts.

Counts travel as blocks. Each task packs the documents it reads into blocks of some megabytes, which
are written once, so that equal documents spread like any others and nothing depends on which task
reads what later. A block asks for the counts of its distinct n-grams: its sorted keys, cut into a
fixed number of key ranges, one row each, so the rows grow with the text and no faster. A range adds
the blocks' counts, and each block gets its numbers back in the order it asked. Where a range would
hold more keys than a task should, askers of a range are merged first, and their keys cut into finer
ranges, as often as needed. So what is shuffled is the text, the distinct n-grams of each block
(4 to 6 bytes each) and their counts, never a row per token; no table of counts is ever in one place.
Words are 64-bit keys, pairs 56-bit keys, longer n-grams 48-bit keys: unequal ones share a key with a
chance of 2**-64, 2**-56 or 2**-48 a pair.

Expectation-maximisation needs of a held-out token only its bucket and by how much the order's
estimate is above that of the mixture below. Those ratios are summed up in cells of 1/64 octave, and
a cell stands for its mean; the weights then run to convergence (`converged`).

Tokens: words between white space, A-Z lowered, then one end token. Defined cases: null text
is empty and has only the end token; documents with null id are scored, and as crc32 of null
is null they are neither held out nor learned from; without training documents every token
has the base probability of an unseen one; repeated rows get one result each (and count as
often as they occur); other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .common import Scratch, text_bytes

END = np.uint64(0x5851F42D4C957F2D)
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
#: Bits that the keys of each order keep: all for words, 56 for pairs, 48 for longer n-grams, of which one in 2**48 / n shares its key with another of n.
_KEPT = {2: np.uint64(2**64 - 2**8)}
_KEPT_LONG = np.uint64(2**64 - 2**16)
#: Context-count buckets: 0, 1, 2-3, 4-7, ... the last is open.
BUCKETS = 24
#: log2 of an order's probability over that of the mixture below, in steps of 1/64; no ratio of counts leaves these bounds.
RATIO_LOW, RATIO_STEPS, RATIO_BINS = -64, 64, 8192
_LESS = ("tokens", "tokens_less", "types", "types_less")
_REQUEST = "asker long, range long, keys binary, sums binary, deleted binary"
_ANSWER = "asker long, range long, totals binary, deleted binary, " + ", ".join(f"{c} long" for c in _LESS)


@dataclass(frozen=True)
class Model:
    order: int = 3
    block_bytes: int = 6 << 20
    #: Of ten parts of the documents by crc32 of the id: 0 is held out for evaluation, this one teaches the weights.
    deleted_part: int = 1
    smoothing: float = 0.1
    #: Weights are final once none moves by more.
    converged: float = 1e-7
    #: Each hop cuts a key range into 2**bits.
    bits: int = 9
    #: Bytes of text whose keys one range takes: some 17 million of an order, 18 bytes each while they are added.
    range_bytes: int = 104 << 20
    #: Askers whose keys are merged in a hop.
    merged: int = 256


def part(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)).cast("int")


# ---- keys and counts -------------------------------------------------------


def _tokens(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of each order for all tokens (a text's tokens, closed by END; before its first token stands END), and texts' token counts."""
    codes, counts = textcodes.words(texts)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(codes) + len(counts), dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside], out[ends] = codes, END
    keys, start = [out], END
    first = np.cumsum(counts + 1) - counts - 1
    for n in range(2, order + 1):
        before, kept = np.empty_like(out), _KEPT.get(n, _KEPT_LONG)
        before[1:] = keys[-1][:-1]
        before[first] = start
        keys.append(textcodes.mix(before * _CHAIN + out + np.uint64(n)) & kept)
        start = (textcodes.mix(np.array([start]) * _CHAIN + END + np.uint64(n)) & kept)[0]
    return keys, counts + 1


def _sum_by_key(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each column of weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first, axis=0)


def _pack(counts: np.ndarray) -> bytes:
    """One byte for a count below 255; larger ones follow, eight bytes each. Most n-grams are rare."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    """Counts of n keys; no bytes mean zeros."""
    if not blob:
        return np.zeros(n, dtype=np.int64)
    out = np.frombuffer(blob, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, dtype=np.int64, offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then differences of four bytes (of keys without their two low bytes), five (without one) or six, where all fit; else all of eight."""
    step = np.diff(keys)
    for width, low in ((4, 2), (5, 1), (6, 0)):
        if len(keys) and not (step >> np.uint64(8 * (width + low))).any() and not (keys & np.uint64(256**low - 1)).any():
            return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, low : low + width]).tobytes()
    return b"\x08" + keys.tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    width = blob[0]
    if width == 8:
        return np.frombuffer(blob, dtype=np.uint64, offset=1)
    step = np.zeros((1 + (len(blob) - 9) // width, 8), dtype=np.uint8)
    step[1:, 6 - width : 6] = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    out = step.view(np.uint64).reshape(-1)
    out[0] = np.frombuffer(blob, dtype=np.uint64, count=1, offset=1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _cut(keys: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of this level that sorted keys touch, and where each begins."""
    prefix = keys >> np.uint64(64 - bits * level)
    begin = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return prefix[begin].astype(np.int64), begin


def _table(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


# ---- blocks ----------------------------------------------------------------


def _packed(model: Model):
    """Documents as blocks, one row each; the deleted documents have blocks of their own, with odd numbers, so that learning reads no others."""
    schema = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [[], [], [], 0], True: [[], [], [], 0]}

        def close(deleted: bool) -> pa.RecordBatch:
            ids, parts, texts, _ = held[deleted]
            held[deleted] = [[], [], [], 0]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            values = (uuid.uuid4().int >> 66 << 1 | deleted, deleted, ids, parts, [len(r) for r in raw], pa.compress(b"".join(raw), "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

        for b in batches:
            for i, p, t in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text"), strict=True):
                deleted, text = p == model.deleted_part, t.as_py() or ""
                mine = held[deleted]
                mine[0].append(i), mine[1].append(p), mine[2].append(text)
                mine[3] += len(text) + 16
                if mine[3] >= model.block_bytes:
                    yield close(deleted)
        for deleted in (False, True):
            if held[deleted][0]:
                yield close(deleted)

    return run, "block long, deleted boolean, ids array<long>, parts array<int>, sizes array<long>, texts binary"


def _texts(b: pa.RecordBatch | pa.Table, at: int = 0) -> list[str]:
    """The texts of a block, which travels compressed."""
    ends = np.cumsum([0, *_rows(b, "sizes", at)]).tolist()
    raw = pa.decompress(_rows(b, "texts", at), ends[-1], "zstd", asbytes=True)
    return [raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(ends, ends[1:], strict=False)]


def _rows(b: pa.RecordBatch | pa.Table, name: str, at: int = 0) -> list:
    return b.column(name)[at].as_py()


def _requests(model: Model):
    """Of a block: its distinct keys of each order, by range, with the counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                block, deleted, parts = _rows(b, "block", at), _rows(b, "deleted", at), np.array(_rows(b, "parts", at))
                every, counts = _tokens(_texts(b, at), model.order)
                learned = np.repeat(parts > 0, counts).astype(np.int64)
                out: dict[str, list] = {"asker": [], "range": [], "keys": [], "sums": [], "deleted": []}
                for order, keys in enumerate(every, 1):
                    keys, sums = _sum_by_key(keys, learned)
                    _send(out, block, order << 48, keys, sums, sums if deleted else None, 1, model.bits)
                yield _table(out, _REQUEST)

    return run


def _send(out: dict[str, list], asker: int, above: int, keys: np.ndarray, sums: np.ndarray, deleted: np.ndarray | None, level: int, bits: int) -> None:
    ranges, begin = _cut(keys, level, bits)
    for r, lo, hi in zip(ranges.tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
        out["asker"].append(asker)
        out["range"].append(above | r)
        out["keys"].append(pack_keys(keys[lo:hi]))
        out["sums"].append(_pack(sums[lo:hi]))
        out["deleted"].append(b"" if deleted is None else _pack(deleted[lo:hi]))


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a group of requests, their sums (all, deleted), and each request's own keys."""
    keys = [unpack_keys(x) for x in group.column("keys").to_pylist()]
    sums = np.concatenate([_unpack(x, len(k)) for x, k in zip(group.column("sums").to_pylist(), keys, strict=True)])
    deleted = np.concatenate([_unpack(x, len(k)) for x, k in zip(group.column("deleted").to_pylist(), keys, strict=True)])
    distinct, both = _sum_by_key(np.concatenate(keys), np.stack([sums, deleted], axis=1))
    return distinct, both, keys


def _answers_to(group: pa.Table, keys: list[np.ndarray], distinct: np.ndarray, both: np.ndarray, stats: list[int]) -> pa.Table:
    """Each request's totals, in the order of its keys; the group's first row carries the statistics."""
    at = [np.searchsorted(distinct, k) for k in keys]
    n = len(at)
    out = {"asker": group.column("asker").to_pylist(), "range": group.column("range").to_pylist(), "totals": [_pack(both[x, 0]) for x in at], "deleted": [_pack(both[x, 1]) for x in at]}
    out |= {c: [v] + [0] * (n - 1) for c, v in zip(_LESS, stats, strict=True)}
    return pa.Table.from_batches([_table(out, _ANSWER)])


class _Packed:
    """Counts that _pack() packed, read by slices: a byte a key in memory, not eight."""

    def __init__(self, blob: bytes, n: int):
        self.small = np.frombuffer(blob, dtype=np.uint8, count=n) if blob else None
        self.at = np.flatnonzero(self.small == 255) if blob else np.zeros(0, np.int64)
        self.large = np.frombuffer(blob, dtype=np.int64, offset=n) if blob else np.zeros(0, np.int64)

    def of(self, a: int, b: int) -> np.ndarray:
        if self.small is None:
            return np.zeros(b - a, dtype=np.int64)
        out = self.small[a:b].astype(np.int64)
        lo, hi = np.searchsorted(self.at, (a, b))
        out[self.at[lo:hi] - a] = self.large[lo:hi]
        return out


class _Packing:
    """Counts of n keys, given slice by slice, packed as by _pack(); nothing if all are zero."""

    def __init__(self, n: int):
        self.small, self.large, self.any = np.zeros(n, dtype=np.uint8), [], False

    def put(self, a: int, counts: np.ndarray) -> None:
        large = counts >= 255
        self.small[a : a + len(counts)] = np.where(large, 255, counts)
        self.large.append(counts[large].astype(np.int64))
        self.any |= bool(counts.any())

    def bytes(self) -> bytes:
        return self.small.tobytes() + b"".join(x.tobytes() for x in self.large) if self.any else b""


#: Keys that are added up at once. A range's keys are hashes, so equal parts of their span hold about as many.
AT_ONCE = 1 << 19


def _reduce(group: pa.Table) -> pa.Table:
    """Adds the counts of one range, part by part of its span of keys, so that only the keys themselves are unpacked whole."""
    keys = [unpack_keys(x.as_py()) for x in group.column("keys")]
    sums = [_Packed(x.as_py(), len(k)) for x, k in zip(group.column("sums"), keys, strict=True)]
    gone = [_Packed(x.as_py(), len(k)) for x, k in zip(group.column("deleted"), keys, strict=True)]
    totals, deleted = [_Packing(len(k)) for k in keys], [_Packing(len(k)) for k in keys]
    words, stats = group.column("range")[0].as_py() >> 48 == 1, np.zeros(4, dtype=np.int64)
    low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
    parts = -(-sum(map(len, keys)) // AT_ONCE)
    ends = np.array([low + (high - low + 1) * p // parts for p in range(1, parts)], dtype=np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(k, ends), [len(k)]]) for k in keys]
    for p in range(parts):
        spans = [(k, int(c[p]), int(c[p + 1])) for k, c in enumerate(cuts) if c[p] < c[p + 1]]
        if not spans:
            continue
        both = np.stack([np.concatenate([x[k].of(a, b) for k, a, b in spans]) for x in (sums, gone)], axis=1)
        distinct, both = _sum_by_key(np.concatenate([keys[k][a:b] for k, a, b in spans]), both)
        less = both[:, 0] - both[:, 1]
        if words:
            stats += (both[:, 0].sum(), less.sum(), (both[:, 0] > 0).sum(), (less > 0).sum())
        for k, a, b in spans:
            at = np.searchsorted(distinct, keys[k][a:b])
            totals[k].put(a, both[at, 0])
            deleted[k].put(a, both[at, 1])
    n = len(keys)
    out = {"asker": group.column("asker").to_pylist(), "range": group.column("range").to_pylist(), "totals": [x.bytes() for x in totals], "deleted": [x.bytes() for x in deleted]}
    out |= {c: [int(v)] + [0] * (n - 1) for c, v in zip(_LESS, stats, strict=True)}
    return pa.Table.from_batches([_table(out, _ANSWER)])


def _finer(level: int, bits: int):
    """Merges the requests of some askers for one range, and asks for them in finer ranges."""

    def run(group: pa.Table) -> pa.Table:
        distinct, both, _ = _merged(group)
        order = group.column("range")[0].as_py() >> 48
        out: dict[str, list] = {"asker": [], "range": [], "keys": [], "sums": [], "deleted": []}
        _send(out, group.column("party")[0].as_py(), order << 48, distinct, both[:, 0], both[:, 1], level, bits)
        return pa.Table.from_batches([_table(out, _REQUEST)])

    return run


def _hand_back(group: pa.Table, answers: pa.Table) -> pa.Table:
    """The totals of merged requests, for each of those that were merged."""
    distinct, _, keys = _merged(group)
    rows = answers.sort_by("range")
    both = np.zeros((len(distinct), 2), dtype=np.int64)
    at = 0
    for totals, deleted, n in zip(rows.column("totals").to_pylist(), rows.column("deleted").to_pylist(), rows.column("n").to_pylist(), strict=True):
        both[at : at + n, 0], both[at : at + n, 1] = _unpack(totals, n), _unpack(deleted, n)
        at += n
    return _answers_to(group, keys, distinct, both, [sum(rows.column(c).to_pylist()) for c in _LESS])


def answered(requests: DataFrame, askers: int, levels: int, model: Model, scratch: Scratch, level: int = 1) -> DataFrame:
    """The answer to each request. levels: how often ranges are cut; requests are those of `level`."""
    if level == levels:
        return requests.groupBy("range").applyInArrow(_reduce, _ANSWER)
    parties = max(1, askers // model.merged)
    mine = scratch.keep(requests.withColumn("party", F.pmod(F.xxhash64("asker"), F.lit(parties))), "requests")
    finer = scratch.keep(mine.groupBy("range", "party").applyInArrow(_finer(level + 1, model.bits), _REQUEST), "finer")
    below = answered(finer, parties, levels, model, scratch, level + 1)
    sizes = finer.select("asker", "range", _n_keys("keys").alias("n"))
    up = F.expr(f"shiftleft(shiftright(range, 48), 48) | shiftright(range & {(1 << 48) - 1}, {model.bits})")
    back = below.join(sizes, ["asker", "range"]).select(F.col("asker").alias("party"), up.alias("up"), "range", "totals", "deleted", "n", *_LESS)
    return mine.groupBy("range", "party").cogroup(back.groupBy("up", "party")).applyInArrow(_hand_back, _ANSWER)


def _n_keys(keys: str) -> Column:
    """How many keys a packed blob has."""
    width = F.conv(F.hex(F.substring(keys, 1, 1)), 16, 10).cast("int")
    return F.when(width == 8, (F.length(keys) - 1) / 8).otherwise(1 + (F.length(keys) - 9) / width).cast("long")


# ---- learning and scoring --------------------------------------------------


def _counts(every: list[np.ndarray], answers: pa.Table, bits: int, less: bool) -> list[np.ndarray]:
    """Count of each token's n-gram of each order, in all training documents or in those that aren't deleted."""
    rows = answers.sort_by("range")
    orders = np.array(rows.column("range").to_pylist(), dtype=np.int64) >> 48
    out = []
    for order, keys in enumerate(every, 1):
        distinct, inverse = np.unique(keys, return_inverse=True)
        _, begin = _cut(distinct, 1, bits)
        sizes = np.diff(np.append(begin, len(distinct)))
        mine = np.flatnonzero(orders == order)
        found = np.zeros(len(distinct), dtype=np.int64)
        for k, at, n in zip(mine.tolist(), begin.tolist(), sizes.tolist(), strict=True):
            found[at : at + n] = _unpack(rows.column("totals")[k].as_py(), n)
            if less:
                found[at : at + n] -= _unpack(rows.column("deleted")[k].as_py(), n)
        out.append(found[inverse])
    return out


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def _mixture(found: list[np.ndarray], counts: np.ndarray, docs: int, tokens: int, types: int, weights: list[np.ndarray], smoothing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Base and mixed probability of each token; and of the next order that has no weights yet, the estimate and the context's count."""
    first = np.cumsum(counts) - counts
    base = (found[0] + smoothing) / (tokens + smoothing * (types + 1))
    p = base
    for n in range(2, len(found) + 1):
        context = np.empty_like(found[0])
        context[1:] = found[n - 2][:-1]
        context[first] = docs
        estimate = np.where(context > 0, found[n - 1] / np.maximum(context, 1), 0.0)
        if n - 2 == len(weights):
            return base, p, estimate, context
        lam = weights[n - 2][_bucket(context)]
        p = lam * estimate + (1 - lam) * p
    return base, p, None, None


def _histogram(model: Model, size: dict[str, int], weights: list[np.ndarray]):
    """Of a deleted block: tokens, and the sum of their ratios, by context bucket and by the ratio of the next order's estimate to the mixture below."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        cells: dict[str, np.ndarray] = {"cell": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "ratio": np.zeros(0)}
        if blocks.num_rows and answers.num_rows:
            every, counts = _tokens(_texts(blocks), model.order)
            found = _counts(every, answers, model.bits, less=True)
            _, low, estimate, context = _mixture(found, counts, size["docs_less"], size["tokens_less"], size["types_less"], weights, model.smoothing)
            ratio = estimate / low
            with np.errstate(divide="ignore"):
                bin_ = np.where(ratio > 0, np.clip((np.log2(ratio) - RATIO_LOW) * RATIO_STEPS, 1, RATIO_BINS - 1), 0).astype(np.int64)
            cell = _bucket(context) * RATIO_BINS + bin_
            n = np.bincount(cell, minlength=BUCKETS * RATIO_BINS)
            at = np.flatnonzero(n)
            cells = {"cell": at.astype(np.int64), "n": n[at].astype(np.int64), "ratio": np.bincount(cell, ratio, len(n))[at]}
        return pa.table(cells)

    return run


def learn(cells: list[tuple[int, int, float]], converged: float) -> np.ndarray:
    """Weight of an order's estimate in each bucket, by EM over held-out tokens to convergence. cells: bucket and ratio bin, tokens, sum of ratios."""
    hist, total = np.zeros(BUCKETS * RATIO_BINS), np.zeros(BUCKETS * RATIO_BINS)
    for cell, n, ratio in cells:
        hist[cell], total[cell] = n, ratio
    used = np.flatnonzero(hist)
    bucket, n, ratio = used // RATIO_BINS, hist[used], total[used] / hist[used]
    seen = np.bincount(bucket, n, BUCKETS)
    weight = np.full(BUCKETS, 0.5)
    while True:
        lam = weight[bucket]
        share = n * lam * ratio / (lam * ratio + 1 - lam)
        new = np.where(seen > 0, np.bincount(bucket, share, BUCKETS) / np.maximum(seen, 1), weight)
        new = np.clip(new, 0.0, 0.9999)
        moved = np.abs(new - weight).max()
        weight = new
        if moved <= converged:
            break
    weight[0] = 0.0  # a context that never occurred has no estimate
    return weight


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(model: Model, size: dict[str, int], weights: list[np.ndarray]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.Table.from_batches([_table({f.split()[0]: [] for f in _SCORED.split(", ")}, _SCORED)])
        every, counts = _tokens(_texts(blocks), model.order)
        found = _counts(every, answers, model.bits, less=False)
        base, p, _, _ = _mixture(found, counts, size["docs"], size["tokens"], size["types"], weights, model.smoothing)
        starts = np.cumsum(counts) - counts
        known = np.add.reduceat((found[0] > 0).astype(np.int64), starts)
        columns = {"doc_id": _rows(blocks, "ids"), "held_out": np.array(_rows(blocks, "parts")) == 0, "n_tokens": counts, "n_known": known, "base_score": np.add.reduceat(np.log10(base), starts), "score": np.add.reduceat(np.log10(p), starts)}
        return pa.Table.from_batches([_table(columns, _SCORED)])

    return run


def score(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text)."""
    scratch = Scratch(docs.sparkSession, "lm")
    own = F.coalesce(part(F.col("doc_id")), F.lit(-1))
    about = docs.select(text_bytes(F.col("text")).alias("bytes"), own.alias("part"))
    known = about.agg(F.sum("bytes").alias("bytes"), F.sum((F.col("part") > 0).cast("long")).alias("docs"), F.sum(((F.col("part") > 0) & (F.col("part") != model.deleted_part)).cast("long")).alias("docs_less")).first()
    run, schema = _packed(model)
    blocks = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("part")).mapInArrow(run, schema), "blocks")
    levels = 1
    while (known["bytes"] or 0) > model.range_bytes << (model.bits * levels):
        levels += 1
    asked = blocks.select("block", "deleted", "parts", "sizes", "texts").mapInArrow(_requests(model), _REQUEST)
    answers = scratch.keep(answered(asked, (known["bytes"] or 0) // model.block_bytes, levels, model, scratch), "answers")
    total = answers.agg(*(F.sum(c).alias(c) for c in _LESS)).first()
    size = {k: int(total[k] or 0) for k in _LESS} | {k: int(known[k] or 0) for k in ("docs", "docs_less")}
    back = answers.select(F.col("asker").alias("block"), "range", "totals", "deleted")
    chosen = blocks.where("deleted").select("block", "sizes", "texts")
    mine = back.where("block % 2 = 1")
    weights: list[np.ndarray] = []
    for _ in range(2, model.order + 1):
        met = chosen.groupBy("block").cogroup(mine.groupBy("block"))
        cells = met.applyInArrow(_histogram(model, size, weights), "cell long, n long, ratio double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio"))
        # at most BUCKETS * RATIO_BINS rows, whatever the input
        weights.append(learn([(r["cell"], r["n"], r["ratio"]) for r in cells.collect()], model.converged))
    met = blocks.select("block", "ids", "parts", "sizes", "texts").groupBy("block").cogroup(back.drop("deleted").groupBy("block"))
    out = met.applyInArrow(_scores(model, size, weights), _SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
