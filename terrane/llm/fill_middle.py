"""Fill-in-the-middle transformation over an index of distinct texts.

Identical texts are grouped by content; each distinct text gets one list of line boundaries in
Elias-Fano form. Documents are joined back to the index by the digest of their text, and each
row's seeded cut is two look-ups in the list. A document is cut into prefix, middle and suffix,
which are put together with sentinels in one of two orders, or left plain.

The index holds a text once, compressed, however many documents share it, so a group of copies
of any size moves its text once; the documents' side of the join is ids and digests, which
adaptive execution splits where one text has many rows. Distinct texts are told apart by all of
their bytes, and a digest that stands for two of them, or for another text, is an error.

Defined cases: null text is empty; an empty text is plain, with no lines; a null doc_id is seeded
by the empty string; repeated rows get one result each, all alike; bytes that aren't UTF-8 are cut
at line feeds like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fim:
    seed: int = 7
    #: Per cent of the documents that are transformed, and of these the share with the suffix first.
    percent: int = 100
    suffix_first: int = 50
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


# ---- Elias-Fano lists

_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


def encode(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """low_bits, low, high of an ascending list of numbers from 0 to universe: about 2 + log2(universe / n) bits a number."""
    n = len(values)
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    values = values.astype(np.int64)
    low = (values[:, None] >> np.arange(low_bits)) & 1
    high = np.zeros((universe >> low_bits) + n + 1 if n else 0, dtype=np.uint8)
    if n:
        high[(values >> low_bits) + np.arange(n)] = 1
    return low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(low_bits: int, low: bytes, high: bytes, at: int) -> int:
    """The number at this place (from 0), without decoding the others."""
    ones = np.cumsum(_ONES[np.frombuffer(high, dtype=np.uint8)])
    byte = int(np.searchsorted(ones, at + 1))
    left = at - (int(ones[byte - 1]) if byte else 0)
    bit = [b for b in range(8) if high[byte] >> b & 1][left]
    value = (8 * byte + bit - at) << low_bits
    for k in range(low_bits):
        place = at * low_bits + k
        value |= (low[place >> 3] >> (place & 7) & 1) << k
    return value


def boundaries(text: bytes) -> np.ndarray:
    """The byte after each line; a line feed belongs to the line it ends."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or data[-1] == 10 else np.append(ends, len(data))


def _chars(data: bytes) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


# ---- the index

_TEXTS = pa.schema([("packed", pa.binary())])
_INDEX = pa.schema([("digest", pa.binary()), ("packed", pa.binary()), ("n", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
_INDEX_DDL = "digest binary, packed binary, n long, low_bits int, low binary, high binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = dict.fromkeys(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(map(pack.compress, texts), pa.binary())], schema=_TEXTS)


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(hashlib.sha256(text := _unpack(p)).digest(), p, *_entry(text)) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * 6, _INDEX, strict=True)], schema=_INDEX)


def _entry(text: bytes) -> tuple[int, int, bytes, bytes]:
    ends = boundaries(text)
    return len(ends), *encode(ends, len(text))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def text_index(docs: DataFrame) -> DataFrame:
    """digest, packed, n, low_bits, low, high: each distinct text of docs with its SHA-256, itself compressed, and the list of its line ends."""
    texts = docs.select(_text().alias("text")).mapInArrow(_packed, "packed binary").distinct()
    return texts.mapInArrow(_listed, _INDEX_DDL)


# ---- cuts

_OUT = pa.schema([("doc_id", pa.binary()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def _part(seeds: Column, k: int) -> Column:
    """The k-th 8-digit group of a hex digest, as a number."""
    return F.conv(F.substring(seeds, 8 * k + 1, 8), 16, 10).cast("long")


def _cutter(fim: Fim):  # noqa: ANN202
    marks = [m.encode() for m in fim.marks]
    p_mark, s_mark, m_mark = marks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, bytes, bytes] = (b"", b"", b"")
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("digest", "doc_id", "h", "n", "low_bits", "low", "high")}
            held = batch.column("packed")
            out: list[list] = [[] for _ in _OUT]
            size = 0
            for k, digest in enumerate(c["digest"]):
                packed = held[k].as_py()
                if (digest, packed) != last[:2]:  # copies follow each other: the join has sorted its rows
                    if digest == last[0] or hashlib.sha256(text := _unpack(packed)).digest() != digest:
                        raise ValueError("a digest stands for two texts, or for another text")
                    last = digest, packed, text
                text, n, h = last[2], c["n"][k], c["h"][k]
                form, prefix, middle, output = "plain", None, None, text
                if text and h[2] % 100 < fim.percent and not any(m in text for m in marks):
                    a, b = sorted(x % (n + 1) for x in h[:2])
                    i, j = (select(c["low_bits"][k], c["low"][k], c["high"][k], x - 1) if x else 0 for x in (a, b))
                    pre, mid, suf = text[:i], text[i:j], text[j:]
                    form, prefix, middle = "spm" if h[3] % 100 < fim.suffix_first else "psm", _chars(pre), _chars(mid)
                    output = s_mark + suf + p_mark + pre + m_mark + mid if form == "spm" else p_mark + pre + s_mark + suf + m_mark + mid
                for cell, value in zip(out, (c["doc_id"][k], n, form, prefix, middle, output), strict=True):
                    cell.append(value)
                size += len(output)
                if size > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)
                    out, size = [[] for _ in _OUT], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)

    return cut


def fill_in_middle(docs: DataFrame, fim: Fim = Fim(), index: DataFrame | None = None) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output: one row for each row of docs.

    index: text_index() of the same documents, if it was kept in a table.
    """
    kind = docs.schema["doc_id"].dataType
    # ids become text behind the shuffle: whatever their type is, they come back as they were
    met = docs.select("doc_id", F.unhex(F.sha2(_text(), 256)).alias("digest")).join(text_index(docs) if index is None else index, "digest")
    name = F.col("doc_id").cast("string")
    seeds = F.sha2(F.concat(F.lit(f"{fim.seed}:"), F.coalesce(name, F.lit(""))), 256)
    cut = met.select("digest", name.cast("binary").alias("doc_id"), F.array(*(_part(seeds, k) for k in range(4))).alias("h"), "packed", "n", "low_bits", "low", "high").mapInArrow(_cutter(fim), "doc_id binary, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.select(F.col("doc_id").cast("string").cast(kind).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(form: Column, output: Column, fim: Fim = Fim()) -> Column:
    """The text that output was made from. Texts that are transformed hold no mark, and no mark overlaps itself, so the first one found is the one that was put in."""

    def after(x: Column, mark: str) -> Column:
        return F.substring(x, F.instr(x, mark) + len(mark), F.length(x))

    def before(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    p, s, m = fim.marks
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
