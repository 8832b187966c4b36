"""Fill-in-middle cuts against a brute-force version; Elias-Fano lists against plain ones."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.llm import fill_middle
from terrane.llm.fill_middle import Fim

SCHEMA = "doc_id long, text string, digest string, packed string, n string, h string"


def brute(doc_id, text, fim=Fim()):
    text = text or ""
    h = hashlib.sha256(f"{fim.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in fim.marks) or h[2] % 100 >= fim.percent:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < fim.suffix_first else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), out)


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "one line", "ends\n", "\n\n\n", "a\nb\nc\nd", "x<P>y\nz", "<S>", "half <P\n> mark\n", "Ünï\n日本\n🙂 end\r\nx", "a\n" * 5000, "line without end " * 3000, "zero\0byte\nx"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, "shared\ntext\nof many\n") for k in range(40)] + [(7, "same row\ntwice"), (7, "same row\ntwice"), (None, "no\nid")]
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA), rows


@pytest.mark.parametrize("fim", [Fim(), Fim(seed=11, percent=50, suffix_first=100)])
def test_rows_equal_brute_force(docs, fim):
    frame, rows = docs
    got = sorted(map(repr, map(tuple, fill_middle.fill_in_middle(frame, fim).collect())))
    assert got == sorted(repr(brute(i, t, fim)) for i, t in rows)


def test_texts_come_back(docs):
    frame, rows = docs
    made = fill_middle.fill_in_middle(frame).select("doc_id", fill_middle.restored(F.col("form"), F.col("output")).alias("t"))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(repr((i, t or "")) for i, t in rows)


def test_index_has_each_text_once(docs):
    frame, rows = docs
    index = fill_middle.text_index(frame).collect()
    assert len(index) == len({t or "" for _, t in rows})
    by_digest = {bytes(r.digest): r for r in index}
    for _, t in rows:
        r, raw = by_digest[hashlib.sha256((t or "").encode()).digest()], (t or "").encode()
        ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", raw)]
        assert [fill_middle.select(r.low_bits, r.low, r.high, k) for k in range(r.n)] == ends


def test_kept_index_and_empty_table(spark, docs):
    frame, rows = docs
    held = spark.createDataFrame(fill_middle.text_index(frame).collect(), "digest binary, packed binary, n long, low_bits int, low binary, high binary")
    assert fill_middle.fill_in_middle(frame, index=held).count() == len(rows)
    assert fill_middle.fill_in_middle(frame.limit(0)).collect() == []


def test_wrong_index_is_refused(spark, docs):
    frame, _ = docs
    bad = fill_middle.text_index(frame).withColumn("packed", F.first("packed").over(Window.partitionBy(F.lit(1)).orderBy("digest")))
    with pytest.raises(Exception, match="a digest stands for two texts"):
        fill_middle.fill_in_middle(frame, index=bad).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=80), st.integers(0, 10**6))
def test_elias_fano(values, more):
    values = sorted(values)
    universe = max(values, default=0) + more
    bits, low, high = fill_middle.encode(np.array(values, dtype=np.int64), universe)
    assert [fill_middle.select(bits, low, high, k) for k in range(len(values))] == values
    assert len(low) + len(high) <= len(values) * (2.2 + max(0, np.log2((universe + 1) / max(1, len(values))))) / 8 + 4
