"""The pipeline on tables with nulls, repeated rows, clashing columns, and on empty ones."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, _k1 string, words string, slot string, copies string"


def write(spark, folder, docs, labels=(), bench=()):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", "w", "s", "c") for i, t, s in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = text(30)
    clean = {k: text(120) for k in range(60)}
    docs = [(k, t, None if k % 4 == 0 else f"s{k % 3}") for k, t in clean.items()]
    docs += [(3, clean[3], "s0")] * 3 + [(100, None, "s1"), (None, text(120), None), (101, "", "s2"), (102, " \n\t", None), (103, text(60) + " " + bench + " " + text(60), "s1"), (104, clean[5], "s2"), (105, "\n".join(text(40) for _ in range(4000)), "s0")]
    labels = [(k, 1, 0, "x") for k in range(30)] + [(None, 1, 1, None), (7, None, None, "y"), (5, 1, 0, "z"), (5, 1, 0, "z")]
    write(spark, tmp_path, docs, labels, [(1, bench, "a"), (None, None, None), (2, "", "b"), (1, bench, "a")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    # copies of 5 go to the one with the least id; the benchmark's, the null and the blank ones go
    assert ids == {*clean, None, 105}
    assert {r.shard for r in got} <= set(range(40))


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_labels_and_no_benchmark(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(100))
    write(spark, tmp_path, [(k, text(), "s") for k in range(20)])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))
