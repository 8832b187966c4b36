"""Personal data: base spans against plain regular expressions, EM against a version over single candidates, decisions on planted spans."""

import math
import random
import re
import time

import numpy as np
import pytest

from terrane.llm import pii

SCHEMA = "doc_id long, text string, spans string, base int, kind string"
RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    text = text or ""
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(RX) for m in re.finditer(RX[kind], text) if passes(kind, m.group()))
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found]


def results(spark, texts):
    frame = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], SCHEMA)
    from pyspark.sql import functions as F

    found = pii.spans(frame)
    return {r.doc_id: (r.b.split(",") if r.b else [], r.s.split(",") if r.s else []) for r in found.select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()}


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(11)
    pieces = ["a.b@c.d", "x@y", "@", ".", "..", "-", "_", "+", "%", " ", "  ", "\n", "é", "日", "🙂", "(", ")", "1", "12", "255", "256", "0000255", "999", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+44 20", "1.2.3.4", "1.2.3", "user@host.example.com", "a@b.c_d@e.f", "word", "5", "00"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(1500)]
    texts += [None, "", " ", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1+2 345 678 90-", "0" * 40, "x@" * 50, "4111111111111111" * 3, "4111 1111 1111 1111  4111111111111111"]
    got = results(spark, texts)
    wrong = [(t, got[k][0], base(t)) for k, t in enumerate(texts) if got[k][0] != base(t)]
    assert not wrong
    assert all(set(b) <= set(s) for b, s in got.values())


def test_very_long_texts(spark):
    texts = ["9" * 300_000, "a" * 500_000, "1 " * 100_000, "a.b.c." * 50_000 + "@x", "u@h.org " * 20_000, "1.2.3." * 50_000, "+1 2" * 50_000]
    began = time.time()
    got = results(spark, texts)
    assert [len(got[k][0]) for k in range(7)] == [0, 0, 0, 0, 20_000, 37_500, 0]
    assert got[4][0][-1] == "email:159992:159999"
    assert time.time() - began < 120


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    name = lambda: "".join(rng.choices("abcdefgh", k=6))
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    texts, wanted = [], []
    for k in range(60):
        texts.append(f"Please write to mail {name()}@{name()}.com or call +1 (212) 555-{d(4)} today.")
        wanted.append(None)
        hidden = f"{name()} [at] {name()} [dot] org"
        texts.append(f"Send email {hidden} with thanks.")
        wanted.append(("email", hidden))
        number = f"(212) 555-{d(4)}"
        texts.append(f"You can phone {number} at noon.")
        wanted.append(("phone", number))
        texts.append(f"It was built on {rng.randint(100, 999)} {d(3)} {d(3)} pages and order 555-{d(3)}-{d(3)} of version 1.2.{300 + k}.4 came.")
        wanted.append(())
        texts.append(f"token {d(15)}{'x'} and numbers such as 1234567890123{k:03d}")
        wanted.append(())
    return texts, wanted


def test_planted_spans_are_found_and_others_left(spark, planted):
    texts, wanted = planted
    got = results(spark, texts)
    for k, (text, want) in enumerate(zip(texts, wanted)):
        added = [x for x in got[k][1] if x not in got[k][0]]
        if want is None or want == ():
            assert added == [], text
        else:
            at = text.index(want[1])
            assert added == [f"{want[0]}:{at}:{at + len(want[1])}"], text


def test_reliabilities_equal_em_over_single_candidates():
    rng = random.Random(4)
    model = pii.Model(tolerance=1e-13)
    each = [(g, tuple(rng.choice((-1, 0, 1, 1)) for _ in range(4))) for g in (0, 1, 5) for _ in range(200)]
    counts = {}
    for g, v in each:
        key = (g, sum((x + 1) * 3**k for k, x in enumerate(v)))
        counts[key] = counts.get(key, 0) + 1
    share, right, posterior = pii.reliabilities(counts, model)
    s = {g: model.shares[g % 2][0] / sum(model.shares[g % 2]) for g in range(8)}
    r = {(k, j): model.prior[j] for k in range(4) for j in range(4)}
    clip = lambda x, a, b: min(b, max(a, x))
    for _ in range(3000):
        ps = [1 / (1 + math.exp(-math.log(s[g] / (1 - s[g])) - sum(x * math.log(r[g // 2, j] / (1 - r[g // 2, j])) for j, x in enumerate(v)))) for g, v in each]
        for k in range(4):
            for j in range(4):
                mine = [(p, v[j]) for p, (g, v) in zip(ps, each) if g // 2 == k and v[j]]
                r[k, j] = clip((model.prior_weight * model.prior[j] + sum(p if x > 0 else 1 - p for p, x in mine)) / (model.prior_weight + len(mine)), model.least, model.most)
        for g in range(8):
            a, b = model.shares[g % 2]
            mine = [p for p, (h, _) in zip(ps, each) if h == g]
            s[g] = clip((a + sum(mine)) / (a + b + len(mine)), 0.02, 0.98)
    assert np.allclose([s[g] for g in range(8)], share, atol=1e-6)
    assert np.allclose([[r[k, j] for j in range(4)] for k in range(4)], right, atol=1e-6)
    assert posterior.shape == (8, 81)


def test_classifier_learns_the_posteriors():
    rng = random.Random(9)
    posterior = np.full((8, 81), 0.1)
    posterior[:, 54:] = 0.9  # the last labeler says yes
    rows = [(g, v, rng.randrange(128), rng.randrange(6), 50) for g in range(8) for v in range(81)]
    w = pii.trained(rows, posterior, pii.Model())
    score = lambda r: sum(w[i] for i in pii._features(*r[:4]))
    assert all((score(r) > 0) == (posterior[r[0], r[1]] > 0.5) for r in rows)
    assert not pii.trained([], posterior).any()


def test_scan_equals_running_sums(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 1000)]
    frame = spark.createDataFrame(rows, "x array<int>")
    got = frame.select("x", pii._scan(F.col("x"), F.lit(0), lambda a, b: a + b, "int").alias("y")).collect()
    assert all(r.y == [sum(r.x[:k]) for k in range(len(r.x))] for r in got)


def test_empty_table(spark):
    assert pii.spans(spark.createDataFrame([], SCHEMA)).collect() == []
