"""Quality rules, decontamination, near-duplicates and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrane.llm import decontaminate, line_frequency, near_dup, sharding, textcodes
from terrane.llm.common import UPPER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, words string"
LOWER = str.maketrans(UPPER, UPPER.lower())


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def frame(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, source), with columns that clash with inner names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["the", "of", "Ünï", "A b", *("".join(rng.choices("abcdehil", k=rng.randint(2, 6))) for _ in range(300))]
    rows = []
    for k in range(60):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 25))) for _ in range(rng.randint(1, 9))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "Subscribe  to our NEWSLETTER now #1")
        if k % 7 == 0:
            lines += lines[:2]
        rows.append((k, "\n".join(lines), f"s{k % 2}"))
    rows += [(100, None, "s0"), (101, "", None), (102, " \t\r\n\x0b", "s1"), (None, "alone with no id " * 20, None), (103, rows[3][1], "s1"), (103, rows[3][1], "s1"), (104, "x y z " * 4000, "s0"), (105, "one", "s0"), (106, "one two", "s1")]
    near = rows[5][1].split(" ")
    near[3] = "changed"
    rows += [(107, " ".join(near), "s0"), (108, rows[5][1] + " and a bit more", "s1"), (109, rows[5][1].upper(), "s1")]
    rows += [(200 + k, f"Short Items here {k}\n" + "menu home about\n" * (k % 2) + "menu home about", "s9") for k in range(12)]
    return rows


def brute_quality(rows, limits):
    out = []
    norm = lambda x: " ".join(words(x)).lower()
    seen, hosts = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        hosts[source].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                seen[source, norm(line)].add(text)
    # the absolute limit: by texts of which enough stays without the lines above it
    often = {x for x, have in seen.items() if limits.max_docs is not None and len(have) > limits.max_docs}
    own = defaultdict(set)
    for _, text, source in rows:
        lines = [(source, norm(x)) for x in (text or "").split("\n") if words(x)]
        if len(words(text)) - sum(len(x[1].split(" ")) for x in lines if x in often) >= limits.min_left * len(words(text)):
            for x in often.intersection(lines):
                own[x].add(text)
    common = {x for x, have in seen.items() if len(have) > max(limits.min_docs, limits.max_fraction * len(hosts[x[0]]))}
    common |= {x for x, have in own.items() if len(have) > limits.max_docs}
    for i, text, source in rows:
        t = text or ""
        w = words(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        lost = sum(len(words(x)) for x in lines if (source, norm(x)) in common)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed, not failed and len(w) - lost >= limits.min_left * len(w), len(w) - lost))
    return out


def test_quality(spark, corpus):
    limits = line_frequency.LineLimits(min_docs=3)
    got = line_frequency.quality(frame(spark, corpus), limits).collect()
    assert Counter(map(tuple, got)) == Counter(brute_quality(corpus, limits))
    assert any(r.n_words != r.n_words_left for r in got)
    assert line_frequency.quality(frame(spark, []), limits).count() == 0


def test_quality_cleaning(spark, corpus):
    limits = line_frequency.LineLimits(min_docs=3)
    kept = line_frequency.clean(frame(spark, corpus), limits).collect()
    want = Counter(r[0] for r in brute_quality(corpus, limits) if r[7])
    assert Counter(r.doc_id for r in kept) == want
    assert not any("newsletter" in r.text.lower() for r in kept)


def alnum(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def brute_hits(rows, items):
    out = []
    windows = defaultdict(set)
    for i, text in items:
        w = alnum(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])].add(None if i is None else str(i))
    sizes = {len(w) for w in windows}
    for i, text, _ in rows:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate(spark, corpus):
    pick = lambda k, a, b: " ".join(alnum(corpus[k][1])[a:b])
    items = [(1, pick(2, 0, 14)), (2, pick(3, 2, 10).upper()), (3, "!!! " + pick(4, 1, 4) + "?"), (10, pick(2, 0, 14)), (4, None), (5, "..."), (6, "never seen words " * 5), (None, pick(6, 0, 12)), (7, "x"), (7, pick(8, 3, 25)), (8, "x y z x y z x y z x y z")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, key string")
    for spec in (decontaminate.Windows(), decontaminate.Windows(broadcast_rows=0)):
        got = decontaminate.decontaminate(frame(spark, corpus), bench, spec).collect()
        assert Counter(map(tuple, got)) == Counter(brute_hits(corpus, items))
    clean = decontaminate.clean(frame(spark, corpus), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in brute_hits(corpus, items) if not r[5])
    assert decontaminate.decontaminate(frame(spark, corpus), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def sets(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()


def brute_components(rows, spec):
    shingles = [sets(t, spec.shingle) for _, t, _ in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= spec.percent * len(shingles[a] | shingles[b]):
                label[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        least[root(k)].append(i)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [x for x in least[root(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(shingles[k]), c, None if i is None else i == c))
    return out


@pytest.mark.parametrize("spec", [near_dup.CONTRACT, near_dup.Similarity()])
def test_near_duplicates(spark, corpus, spec):
    got = near_dup.near_duplicates(frame(spark, corpus), spec).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept if r.component_id is not None else None) for r in got) == Counter((a, b, c, d if c is not None else None) for a, b, c, d in brute_components(corpus, spec))


def test_near_duplicate_cleaning(spark, corpus):
    kept = [r.doc_id for r in near_dup.clean(frame(spark, corpus), near_dup.CONTRACT).collect()]
    want = {r[0] for r in brute_components(corpus, near_dup.CONTRACT) if r[3]} | {None}
    assert set(kept) == want and len(kept) == len(want)
    assert near_dup.clean(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [{}, {"block": 3}, {"block_shingles": 500}])
def test_links_across_stars(spark, block):
    """Chains in which neighbours are alike and ends are not, so that one pivot can't reach all; and a crowd just below the threshold."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, base = [], [word() for _ in range(200)]
    for k in range(40):
        rows.append((k, " ".join(base), "s"))
        base = base[5:] + [word() for _ in range(5)]
    core = [word() for _ in range(120)]
    for k in range(50, 90):
        own = list(core)
        for at in rng.sample(range(120), 1 + k % 4):
            own[at] = word()
        rows.append((k, " ".join(own), "s"))
    spec = near_dup.Similarity(**(vars(near_dup.CONTRACT) | block))
    got = near_dup.near_duplicates(frame(spark, rows), spec).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(brute_components(rows, spec))
    assert {r.component_id for r in got if r.doc_id < 40} == {0}


def test_very_long_texts_in_a_bucket(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(k, " ".join([*long[: 60_000 - 3000 * k], *(f"x{k}_{j}" for j in range(100 * k))]), "s") for k in range(6)] + [(9, "w " * 100_000, "s"), (10, "w " * 90_000, "s")]
    got = near_dup.near_duplicates(frame(spark, rows), near_dup.CONTRACT).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(brute_components(rows, near_dup.CONTRACT))


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for size in (1, 7, 60, 500, 4000):
        errors = []
        for _ in range(20):
            x = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            cut = size // 3
            a, b = x[:size], x[cut : cut + size]
            s = near_dup.sketches(np.concatenate([a, b]), np.array([size, size]), 80)
            assert (s != np.iinfo(np.uint64).max).all()
            errors.append((s[0] == s[1]).mean() - (size - cut) / (size + cut))
        assert abs(np.mean(errors)) < 0.06 and np.std(errors) < 0.12


def test_word_codes():
    texts = ["a b", None, "", "B  a\x0bb\xa0c", "é É é", "\ud800x", " lead"]
    codes, counts = textcodes.words(texts)
    assert counts.tolist() == [len(words(t)) for t in texts]
    flat = [w.translate(LOWER) for t in texts for w in words(t)]
    assert len(set(flat)) == len(set(codes.tolist())) and all((flat[a] == flat[b]) == (codes[a] == codes[b]) for a in range(len(flat)) for b in range(a))


def test_sharding(spark, corpus):
    got = sharding.assign(frame(spark, corpus), n_shards=5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert sharding.assign(frame(spark, [])).count() == 0


def test_slot_map(spark, tmp_path):
    rng = random.Random(5)
    sizes = {k: rng.randint(1, 1000) for k in range(0, 2048, 2)}
    first = sharding.SlotMap.deal(sizes, 8, 2048)
    loads = first.loads(sizes)
    assert max(loads) - min(loads) <= 1000
    grown = first.rebalance(sizes, 9)
    after = grown.loads(sizes)
    assert grown.version == 2 and max(after) < 1.06 * sum(after) / 9
    assert {k for k in range(2048) if grown.shard[k] != first.shard[k]} == set(grown.moved) and all(grown.shard[k] == 8 for k in grown.moved)
    fewer = grown.rebalance(sizes, 7)
    assert max(fewer.shard) == 6 and max(fewer.loads(sizes)) < 1.1 * sum(after) / 7
    store = sharding.SlotMapStore(spark, str(tmp_path / "map"))
    store.save(first), store.save(grown)
    assert store.load(1).shard == first.shard and store.load(2).shard == grown.shard
    with pytest.raises(Exception, match="(?i)exists"):
        store.save(first)


def test_shared_line_of_a_large_source(spark):
    """A line of 300 of 20,000 documents is far below the fraction, and goes; a line of 10 stays."""
    import corpus_pipeline

    words = " ".join(f"a{k}" for k in range(60))
    rows = [(k, f"own{k} {words}" + ("\nShared by hundreds" if k < 300 else "") + ("\nShared by ten" if k < 10 else ""), "en", "big", 0) for k in range(20_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, table, "").where("doc_id < 400").collect()}
    assert got == {k: f"own{k} {words}" + ("\nShared by ten" if k < 10 else "") for k in range(400)}


def test_near_copies_keep_their_lines(spark):
    """Thirty near copies share all but one line: they stay for near-duplicate removal; a notice in thirty documents of their own goes."""
    notice = "please accept our notice " + " ".join(f"n{k}" for k in range(60))
    same = "\n".join(" ".join(f"c{j}_{k}" for k in range(10)) for j in range(9))
    rows = [(k, f"{same}\nedited{k} last line", "s") for k in range(30)]
    rows += [(100 + k, notice + "\n" + " ".join(f"own{k}_{j}" for j in range(90)), "s") for k in range(30)]
    rows += [(200, notice + "\nlittle else", "s")]
    rows += [(300 + k, " ".join(f"rest{k}_{j}" for j in range(60)), "s") for k in range(400)]
    got = {r.doc_id: r.text for r in line_frequency.clean(frame(spark, rows), line_frequency.LineLimits(max_docs=10)).collect()}
    assert all(got[k] == rows[k][1] for k in range(30))
    assert all(notice not in got[100 + k] for k in range(30)) and 200 not in got and len(got) == 460


def test_copies_of_a_text_count_once(spark):
    """Twelve texts, in three copies each, share a line of a third of their words: each keeps the rest, so the line goes, against brute force."""
    notice = " ".join(f"n{k}" for k in range(30))
    rows = [(40 * c + k, notice + "\n" + " ".join(f"own{k}_{j}" for j in range(60)), "s") for c in range(3) for k in range(12)]
    rows += [(1000 + k, " ".join(f"rest{k}_{j}" for j in range(60)), "s") for k in range(300)]
    limits = line_frequency.LineLimits()
    got = line_frequency.quality(frame(spark, rows), limits).collect()
    assert Counter(map(tuple, got)) == Counter(brute_quality(rows, limits))
    assert all(r.n_words_left == 60 and r.kept for r in got)


def test_codes_of_structured_long_words():
    """Thue-Morse words and their complements, whose polynomial hashes agree modulo any power of two from some length on."""
    made = []
    for n in range(4, 14):
        bits = [bin(k).count("1") & 1 for k in range(1 << n)]
        made += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "x" + "".join("ab"[b] for b in bits)]
    codes, counts = textcodes.words([" ".join(made), *made])
    assert len(set(codes[: len(made)].tolist())) == len(made) and codes[: len(made)].tolist() == codes[len(made) :].tolist()
    assert counts.tolist() == [len(made)] + [1] * len(made)
    upper, _ = textcodes.words([made[-1].upper()])
    assert upper[0] == codes[-1]
