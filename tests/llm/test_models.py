"""Extraction, chats, URL rules, mixing, token counts and language models against brute force or exact libraries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from terrane.llm import chat, html_extract, lm_score, mixing, token_counts, url_rules
from terrane.llm.common import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())
PAGE = "page_id long, url string, html string, host string, tokens string"
DOC = "doc_id long, text string, lang string, source string, n_chars long, tokens string, p string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOC)


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><article>no</article>';</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>We use cookies</div>{body}<aside>Side</aside><div id=comments><p>Nice post</p></div>{extra}<footer>&copy; us</footer></body></html>"


def test_extract(spark):
    rows = [
        (1, "http://A.example/1", page("<article><h1>One &amp;  two</h1><p>Some <b>bo</b>ld\n text<br>next<p>last &#8364;&nbsp;5<!-- no --></article>")),
        (2, "http://a.example/2", page("<article><h1>Two</h1><div class=ad>Buy</div><p>Body</p><form><p>Name</p></form></article>")),
        (3, "http://a.example/3", page("<article><p>Same</p></article>")),
        (4, "http://a.example/4", page("<article><p>Same</p></article>")),
        (5, "http://b.example/", page("<div class='content'><p>Only page here</p><ul><li>a</li><li>b</li></ul></div>")),
        (6, None, "<p>plain</p>tail <i>x"),
        (7, "nonsense", ""),
        (8, "http://a.example/8", None),
        (9, "http://c.example/1", page("<div class=wrap><div class=txt><p>Main text of this one is long enough.</p><p>More.</p></div></div>")),
        (10, "http://c.example/2", page("<div class=wrap><div class=txt><p>Other words stand here instead.</p></div></div>")),
        (11, "http://a.example/11", "<html><body><article><p>cut <b>off"),
        (11, "http://a.example/11", "<html><body><article><p>cut <b>off"),
        (13, "http://d.example/13", "<html><head><title>t</title><meta name=x content='y'><body><div data-id='ad'><article id=main><p>No end of head</article>"),
        (12, "http://a.example/12", "<p 'broken <article>" + "<div>" * 3000 + "deep"),
    ]
    want = {1: "One & two Some bold text next last € 5", 2: "Two Body", 3: "Same", 4: "Same", 5: "Only page here a b", 6: "plain tail x", 7: "", 8: "", 9: "Main text of this one is long enough. More.", 10: "Other words stand here instead.", 11: "cut off", 13: "No end of head"}
    frame = spark.createDataFrame([(*r, "h", "t") for r in rows], PAGE)
    for deduction in (html_extract.Deduction(), html_extract.Deduction(broadcast_tokens=0)):
        got = html_extract.extract(frame, deduction).collect()
        assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
        assert {r.page_id: r.text for r in got if r.page_id != 12} == want
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_deep_and_named_elements():
    one = lambda html: " ".join(html_extract.extract_page(html, set(), []))
    assert one("<p 'broken <article>" + "<div>" * 3000 + "deep") == "deep"
    for n in (10, 300, 3000):  # their end tags close what they opened, and no more
        assert one(f"<body><article>{'<div>' * n}in{'<nav>menu</nav>' * 2}<div class=ad>buy</div>{'</div>' * n}<p>after</p></article><p>out</p></body>") == "in after"
    for name in ("content no-sidebar", "post has-comments", "layout-with-ads"):
        assert one(f"<body><div class='{name}'><p>All of it</p></div></body>") == "All of it"
    assert one("<body><article class='post comments'><p>Mine</p><div class='comment-list'>Hi</div><div id=leftSidebar>x</div></article></body>") == "Mine"
    assert one("<article><p>See <span class=ad>buy <span>now</span></span><b hidden>no</b><a class='link'>this</a>.</p><p><i class='share'>tweet<p>end</article>") == "See this. end"


def test_template_text(spark):
    """Boilerplate without a telling tag or name, heavier than the article, on a host with copies of a page."""
    top, end = "Best site of all for you and yours " * 9, "Call us today"
    rows = [(k, "http://t.example/", f"<body><div><p>{top}</p></div><div><p>Story number{k} told</p><p>{end}</p><p>Tail{k}</p></div></body>") for k in range(6)]
    rows += [(10 + k, "http://t.example/", rows[0][2]) for k in range(20)]  # copies are one page
    rows += [(40, "http://t.example/", rows[1][2])]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"Story number{k} told Tail{k}" for k in range(6)}
    assert got == want | {10 + k: want[0] for k in range(20)} | {40: want[1]}
    assert end in html_extract.extract_page(rows[0][2], set(), [])


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_of_an_article_stay(spark):
    """Three pages of seven have one article and different adverts; a block of the menu's stands in some articles."""
    story = "The council voted on the bridge over the river last night after long debate"
    own = lambda k: f"Story {k} about topic{k} and its people number{k}"
    rows = [(k, "http://copy.example/", f"<body><p>Read more of our best stories here</p><div class=z><p>advert number {k} buy it</p></div><article><h1>Bridge</h1><p>{story}</p><p>Read more of our best stories here</p></article></body>") for k in range(3)]
    rows += [(k, "http://copy.example/", f"<body><p>Read more of our best stories here</p><div class=z><p>advert number {k} buy it</p></div><article><p>{own(k)}</p></article></body>") for k in range(3, 7)]
    rows += [(20 + k, "http://role.example/", f"<body><div>advert {k}</div><div role=main><p>{story}</p></div></body>") for k in range(4)]
    want = {k: f"Bridge {story}" for k in range(3)} | {k: own(k) for k in range(3, 7)} | {20 + k: story for k in range(4)}
    assert extracted(spark, rows) == want


def test_template_words_inside_blocks(spark):
    names = "ada bob cem dua eva fay".split()
    rows = [(k, "http://w.example/", f"<body><div><p>Written by {n} in the forum subscribe to our newsletter today</p><p>Thoughts of {n}: item{k} thing{k} word{k}</p></div></body>") for k, n in enumerate(names)]
    assert extracted(spark, rows) == {k: f"Written by {n} Thoughts of {n}: item{k} thing{k} word{k}" for k, n in enumerate(names)}


def test_slots_of_words():
    e = html_extract.Element("p", 1, False, 0, None)
    template = {html_extract._threes(e, "a b c d e".split())[k] for k in (2, 3)}
    assert html_extract.slot(e, "a b c d e", template) == "a"
    assert html_extract.slot(e, "b c d x", template) == "x"
    assert html_extract.slot(e, "q d e", {html_extract._threes(e, ["q", "d", "e"])[2]}) == "q d e"  # two words are no run
    assert html_extract.slot(html_extract.Element("p", 1, False, 0, None, within=True), "a b c d e", template) == "a b c d e"
    assert html_extract.block_tokens(html_extract.Element("p", 1, True, 0, None), "menu") == {}


def settle(pages, deduction):
    """All rounds of the deduction on one host's lists of tokens, without Spark."""
    members = None
    told = {p: [(k, k, 0, None, None) for k in keys] for p, keys in enumerate(pages)}
    for rounds in range(1, 30):
        at = defaultdict(lambda: defaultdict(list))
        kind = {}
        for p, keys in told.items():
            for i, (token, _, *what) in enumerate(keys):
                at[token][p].append(i)
                kind[token] = what
        members = []
        for token, places in at.items():
            ctx, cls, place = kind[token]
            if len(places) >= deduction.min_pages * len(pages):
                vector = hash(tuple(len(places.get(p, ())) for p in told))
                members.append({"token": token, "vector": vector, "pages": len(places), "n": sum(map(len, places.values())), "pos": min(places[min(places)]), "size": 1, "ctx": ctx, "cls": cls, "place": place})
        known = {m["token"] for m in members}
        lists = [[k for k, *_ in keys if k in known] for keys in told.values()]
        classes = html_extract.grouped(members)
        for find, do in ((html_extract.disorder, html_extract.ordered), (html_extract.crossings, html_extract.nested), (html_extract.stands, html_extract.fixed)):
            classes = do(members, classes, set().union(*(find(x, html_extract._places(classes)) for x in lists)), deduction)
        places = html_extract._places(classes)
        told = {p: [(r, k, c, *places.get(k, (None, None))[:2]) for k, r, c in zip(x, html_extract._roles(x, places), html_extract.contexts(x, places), strict=True)] for p, x in enumerate(lists)}
        if len({r for x in told.values() for r, *_ in x}) == len({k for x in told.values() for _, k, *_ in x}):
            return classes, lists, rounds
    raise AssertionError("no end")


def test_classes_are_ordered_and_nested():
    """On random pages: every valid class comes in one order, whole, doesn't cross another, and stands in one gap of those that are earlier."""
    rng = random.Random(31)
    most, found = 0, 0
    for _ in range(300):
        pages = []
        frame = [[10, 11, 12], [20, 21, 22], [30, 31, 32, 33]]
        for _ in range(rng.randint(3, 9)):
            keys = [1, 2]
            for part in rng.sample(frame, rng.randint(1, 3)) if rng.random() < 0.4 else frame:
                part = part * rng.choice((1, 1, 2))
                for _ in range(rng.randint(0, 2)):
                    part = [*part[: (i := rng.randint(0, len(part)))], rng.choice((40, 41, 42)), *part[i:]]
                keys += part
            pages.append([*keys, *rng.choice(([3, 4], [4, 3], [3, 50, 4])), 5])
        classes, lists, rounds = settle(pages, html_extract.Deduction(min_tokens=2))
        most, found = max(most, rounds), found + len(classes)
        for c, tokens in enumerate(classes):
            for keys in lists:
                mine = [k for k in keys if k in tokens]
                assert mine == tokens * (len(mine) // len(tokens))
            for other in classes[:c]:
                gaps = set()
                for keys in lists:
                    inside, last = set(), None
                    for k in keys:
                        if k in other:
                            last = None if k == other[-1] else k
                            assert not inside or inside == set(tokens) or not inside & set(tokens)
                        if k == tokens[0]:
                            gaps.add(last)
                    for a, b in zip([i for i, k in enumerate(keys) if k == tokens[0]], [i for i, k in enumerate(keys) if k == tokens[-1]], strict=True):
                        between = [k for k in keys[a:b] if k in other]
                        assert between == other * (len(between) // len(other))  # whole, or none
                assert len(gaps) <= 1
    assert most > 2 and found > 300


def test_cuts_of_classes():
    places = html_extract._places
    assert html_extract.disorder([1, 2, 3, 1, 2, 3], places([[1, 2, 3]])) == set()
    assert html_extract.disorder([1, 2, 1, 3, 2, 3], places([[1, 2, 3]])) == {(0, 2), (0, 1)}
    assert html_extract.crossings([1, 7, 2, 8], places([[1, 2], [7, 8]])) == {(1, 1)}
    assert html_extract.crossings([7, 1, 8, 2], places([[1, 2], [7, 8]])) == {(1, 1)}
    assert html_extract.crossings([1, 7, 8, 2], places([[1, 2], [7, 8]])) == set()
    assert html_extract.stands([1, 7, 8, 2, 7, 8, 3], places([[1, 2, 3], [7, 8]])) == {(0, 0), (1, 1), (1, 2)}
    assert html_extract.contexts([5, 1, 5, 7, 5, 8, 5, 2, 5], places([[1, 2], [7, 8]])) == [0, 0, 1, 0, 7, 0, 1, 0, 0]


def test_tokens_without_fixed_order_are_data(spark):
    """Two forms of words that every page has once, now the one first and now the other, are no template; in one order they are."""
    say = lambda k: (f"<p>We sell books author{k}</p>", f"<p>You may like title{k}</p>")
    rows = [(k, "http://mixed.example/", f"<body><p>Own words of page{k}</p>{''.join(say(k)[:: 1 if k % 2 else -1])}</body>") for k in range(8)]
    rows += [(20 + k, "http://same.example/", f"<body><p>Own words of page{k}</p>{''.join(say(k))}</body>") for k in range(8)]
    got = extracted(spark, rows)
    plain = lambda html: re.sub(r" +", " ", re.sub(r"<[^>]*>", " ", html)).strip()
    assert {k: got[k] for k in range(8)} == {k: plain(h).replace("Own words of ", "") for k, _, h in rows[:8]}
    assert {k: got[k] for k in range(20, 28)} == {20 + k: f"page{k} author{k} title{k}" for k in range(8)}


def test_roles_of_a_label(spark):
    """A label of the template that is also a title of some pages: only the label goes."""
    top, end = "All the books of our shop", "Write to us for more of them"
    title = lambda k: "Reviews" if k % 4 == 0 else f"Title{k}"
    rows = [(k, "http://label.example/", f"<body><p>{top}</p><p>{title(k)}</p><p>{end}</p><p>Reviews</p><p>Said{k} of it</p><p>Printed by the shop itself</p></body>") for k in range(12)]
    assert extracted(spark, rows) == {k: f"{title(k)} Said{k} of it" for k in range(12)}


def test_chats(spark):
    rng = random.Random(2)
    talks = {k: [(("user", "assistant")[j % 2], rng.choice("abcdef") * 3) for j in range(rng.randint(1, 6))] for k in range(60)}
    talks |= {100 + j: [("user", f"t{k}") for k in range(j + 1)] for j in range(12)}
    talks |= {200: talks[3], 201: [("user", ""), ("user", "")], 202: [("user", "")], 300: [("user", f"m{k}") for k in range(700)]}
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    rows += [(5, 0, *talks[5][0]), (None, 0, "user", "anon"), (400, None, None, None)]
    # turns far apart, negative, without number (repeats count, in order of role and text), and one number for several
    rows += [(500, 0, "user", "near"), (500, 2000, "user", "far"), (501, -5, "user", "first"), (501, 0, "user", "last"), (501, None, "user", "none"), (503, 4, "user", "z"), (503, 4, "assistant", "z"), (503, 4, "user", "z")]
    rows += [(502, None, "user", "b"), (502, None, "assistant", "a"), (502, None, "user", "b")] + [(504, None, "user", "same")] * 300 + [(505, None, "user", "same")] * 299
    frame = spark.createDataFrame([(*r, 1, "z", 3) for r in rows], "conv_id long, turn long, role string, text string, rank int, h string, range int")
    all_ = {**talks, None: [("user", "anon")], 400: [("unknown", "")], 500: [("user", "near"), ("user", "far")], 501: [("user", x) for x in ("none", "first", "last")], 502: [("assistant", "a"), ("user", "b"), ("user", "b")], 503: [("assistant", "z"), ("user", "z")], 504: [("user", "same")] * 300, 505: [("user", "same")] * 299}
    keep = [a for a in all_ if not any(b != a and (len(all_[b]) > len(all_[a]) and all_[b][: len(all_[a])] == all_[a] or all_[b] == all_[a] and b is not None and (a is None or b < a)) for b in all_)]
    want = {a: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in all_[a]) for a in keep}
    for style in (chat.Style(), chat.Style(max_bytes=200)):
        got, parts = defaultdict(str), Counter()
        for r in sorted(chat.format_chats(frame, style).collect(), key=lambda r: r.part):
            got[r.conv_id] += r.text
            parts[r.conv_id] += 1
            assert r.n_turns == len(all_[r.conv_id]) and r.part < r.n_parts
        assert got == want
        assert (max(parts.values()) == 1) == (style.max_bytes > 200)
    assert chat.format_chats(frame.limit(0)).count() == 0
    import duckdb

    from terrane.llm import sql

    con = duckdb.connect()
    con.register("conversations", frame.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(sql.SQL["op4_snapshot_collapse"]).fetchall(), key=repr) == sorted(((a, 0, 1, len(all_[a]), t) for a, t in want.items()), key=repr)


def test_repeats_are_laid_out_over_ranges(spark):
    """A turn without number that stands very often is cut into rows of a bounded count, in several ranges."""
    from terrane.llm.common import Scratch

    n = 200_000
    rows = spark.range(n).selectExpr("7L as conv_id", "cast(null as bigint) as turn", "'user' as role", "'same' as text")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = chat.laid_out(rows, Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sum(r.n for r in placed) == n and max(r.n for r in placed) == chat.PIECE
    assert sorted(r.piece for r in placed) == list(range(0, n, chat.PIECE)) and len({r.range for r in placed}) > 2
    out = chat.format_chats(rows).collect()
    assert [(r.n_turns, len(r.text)) for r in out] == [(n, n * len("<|im_start|>user\nsame<|im_end|>\n"))]


def test_url_list(spark):
    urls = {"http://x.com/a": "com/", "https://a.EXAMPLE.com/en/1": "example.com/en/", "http://example.com/en/": "example.com/en/", "http://www.example.com/en/5?q": "www.example.com/en/", "http://m.www.example.com/en/": "www.example.com/en/", "http://b.net/es/x": "net/es/", "http://net/fr/": "net/fr/", "http://b.net/en/": None, "http://badexample.com/en/": "com/", "http://x.com": None, "nothing": None, "http://x.com?u=://b.net/es/": None, "": None}
    rows = [(k, u, "h") for k, u in enumerate(urls)] + [(99, None, "h"), (99, None, "h")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), labels).collect()}
    assert [got[k].rule for k in range(len(urls))] == list(urls.values()) and len(got) == len(urls) + 1
    assert (got[1].host, got[1].path, got[1].verdict) == ("a.example.com", "/en/1", "block")
    assert (got[99].host, got[99].path, got[99].verdict) == ("", "", "allow")
    assert got[11].host == "x.com" and got[11].path == ""


def test_mined_rules(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        spam, section = k % 3 == 0, rng.choice(("news", "shop", "blog"))
        bad = spam and section == "shop"
        rows.append((k, f"http://{'pills' if spam else 'site' + str(k % 40)}.example.org/{section}/{k}"))
        if k % 2:
            labels.append((k, 1, int(bad)))
    labels += [(10**6, 1, 1), (None, 1, 1), (rows[1][0], 1, 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for k, u in rows:
        assert got[k].verdict == ("block" if "pills" in u and "/shop/" in u else "allow")
    assert {r.mined for r in got.values()} == {None, "h:pills p:shop"}


def test_mined_tokens_and_absolute_support(spark):
    """Each kind of token carries a rule, on 20 bad pages of 12,000 labelled ones."""
    kinds = ("http://{h}.org/top10/{k}", "http://{h}.org/x/{k}.m3u8", "http://{h}.org/{k}?cat=pills&n={k}", "http://{h}.org/{k}#frag", "http://{h}.org/18plus/{k}")
    rows = [(k, kinds[k % 5].format(h=f"site{k}", k=k)) for k in range(100)] + [(k, f"http://site{k % 900}.org/news/{k}.html?cat=toys{k % 7}&n={k}") for k in range(100, 12_000)]
    labels = [(k, 1, int(k < 100)) for k, _ in rows]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(100))


def brute_rules(known, mining):
    """Confidence of each minimal rule, from all subsets of all pages' tokens. known: {page: (tokens, bad)}."""
    subsets = {frozenset(c) for t, bad in known.values() if bad for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    found = {}
    for x in subsets:
        have = [bad for t, bad in known.values() if x <= t]
        if sum(have) >= mining.min_pages and sum(have) >= mining.min_confidence * len(have):
            found[x] = sum(have) / len(have)
    return {x: c for x, c in found.items() if not any(y < x and found[y] >= c for y in found)}


def check_rules(spark, rows, labels, mining):
    frame = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens_ = {r.page_id: set(r.tokens) for r in url_rules._parsed(frame).collect()}
    bad = {k: any(t for i, _, t in labels if i == k) for k, _, _ in labels}
    rules = brute_rules({k: (tokens_[k], bad[k]) for k in bad if tokens_.get(k)}, mining)
    got = url_rules.judge(frame, known, mining).collect()
    for r in got:
        sure = [c for x, c in rules.items() if x <= tokens_[r.page_id]]
        if r.rule is None:
            assert r.verdict == ("block" if sure else "allow"), r
            if sure:  # the rule given is one of the surest, in one of its wordings
                assert math.isclose(max(sure), max(c for x, c in rules.items() if x <= tokens_[r.page_id] | set(r.mined.split(" "))))
    return rules, got


def test_rules_against_brute_force(spark):
    rng = random.Random(12)
    words_ = ["casino", "news", "pills", "shop", "a1", "top"]
    rows, labels = [], []
    for k in range(240):
        parts = rng.sample(words_, rng.randint(1, 3))
        query = "&".join(rng.sample(["x=1", "ref=aff", "ref=own", "id=7"], rng.randint(0, 2)))
        rows.append((k, f"http://{rng.choice(('a', 'b'))}.{rng.choice(('one', 'two'))}.org/{'/'.join(parts)}/?{query}"))
        if k % 4:
            spam = {"casino", "pills"} <= set(parts) or "ref=aff" in query and "shop" in parts
            labels.append((k, 1, int(spam if rng.random() < 0.9 else not spam)))
    rows += [rows[1], rows[2], (900, "nothing"), (901, None)]
    rules, got = check_rules(spark, rows, labels, url_rules.Mining(min_pages=4))
    assert len(rules) > 3 and {r.verdict for r in got} == {"allow", "block"} and len(got) == len(rows)


def test_many_query_names(spark):
    """Forty names that always come together are one item, not 2**40 combinations; any of them tells."""
    names = "&".join(f"p{k}=z{k}" for k in range(40))
    rows = [(k, f"http://h{k}.org/{k}?{names}") for k in range(12)] + [(k, f"http://h{k}.org/{k}") for k in range(12, 60)] + [(90, "http://new.org/90?p7=1")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, 1, int(k < 12)) for k in range(60)], "doc_id long, quality int, toxic int")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {*range(12), 90}
    long = [(1, "http://x.org/" + "seg/" * 200_000 + "?" + "&".join(f"k{j}=v" for j in range(3000)))]
    assert url_rules.judge(spark.createDataFrame(long, "page_id long, url string"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).first().verdict == "allow"


def test_planted_rules_on_the_pages(spark):
    """The driver's urls, with labels that follow a combination of their tokens: the mined verdicts are those of a brute-force miner."""
    rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id is not null").collect()]
    labels = [(i, 1, int(bool(u) and "/fr/" in u and "#top" in u)) for i, u in rows if i % 5]
    rules, got = check_rules(spark, rows, labels, url_rules.Mining())
    assert rules and any(r.mined for r in got)


def unigram(vocabulary):
    from tokenizers import Tokenizer, models

    pieces = [*vocabulary.pieces, ("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256) if vocabulary.byte_fallback)]
    return Tokenizer(models.Unigram(pieces, unk_id=len(vocabulary.pieces), byte_fallback=vocabulary.byte_fallback))


def test_token_counts(spark):
    rng = random.Random(6)
    whole = token_counts.load_vocabulary()
    tied = token_counts.Vocabulary((("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.0), ("aba", -3.0), ("bb", -1.5)), False)
    crossing = token_counts.Vocabulary((("▁", -2.0), ("a", -1.0), ("b", -3.0), ("a▁b", -2.5), ("▁a", -2.0)), True)
    texts = ["", "a", " ", "  a  b ", "abab bbb", "äöü\n\tx", "a▁b", "日本語 text 😀😀", "x" * 5000, "ab c" * 200]
    texts += ["".join(rng.choices("ab \nxé", k=rng.randint(1, 60))) for _ in range(200)]
    for vocabulary in (whole, tied, crossing):
        exact = unigram(vocabulary)
        rows = [(k, t) for k, t in enumerate(texts)] + [(-1, None)]
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, rows), vocabulary).collect()}
        assert got[-1] == 0
        for k, t in enumerate(texts):
            assert got[k] == (len(exact.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0), t


def test_mixing(spark):
    rng = random.Random(8)
    common = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(500):
        toxic = k % 5 == 0
        w = rng.choices(common, k=60) + (rng.choices(["vile", "nasty", "rotten"], k=4) if toxic else [] if k % 3 else rng.choices(["dull", "flat", "bland"], k=4))
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        if k % 2 == 0 or k < 50:
            labels.append((k, k % 3 > 0, int(toxic)))
    rows += [(None, None), (900, ""), (901, " ")]
    frame, known = docs(spark, rows), spark.createDataFrame([(i, int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = mixing.mixture(frame, known).collect()
    mix = mixing.Mix()
    # totals in expectation are what is asked for, and copies are the rates rounded up or down
    total = sum(r.tokens for r in got)
    reached = [sum(r.tokens * r.rate * r[f"p_{d}"] for r in got) / total for d in mix.domains]
    assert np.allclose(reached, mix.shares, atol=2e-3) and all(r.residual <= mix.tolerance for r in got)
    assert all(0 <= r.rate and math.floor(r.rate) <= r.n_copies <= math.ceil(r.rate + 1e-6) for r in got)
    toxic = {r.doc_id: r.p_toxic for r in got if r.doc_id is not None and r.doc_id < 500}
    assert all((p > 0.5) == (k % 5 == 0) for k, p in toxic.items())  # held-out documents too
    weighted = mixing.Mix(weights=(1.25, 1.1, 0.01))
    kept = Counter(r.doc_id for r in mixing.clean(frame, known, weighted).collect())
    clean = {i for i, _ in rows if i is None or i >= 500 or i % 5}
    assert set(kept) >= clean and len(set(kept) - clean) <= 2 and max(kept.values()) == 2 and sum(kept.values()) > 440
    none = mixing.mixture(frame, known.limit(0)).collect()
    assert all(r.rate == 1 and r.n_copies == 1 and r.residual is None for r in none) and len(none) == len(rows)
    assert mixing.mixture(frame.limit(0), known).count() == 0
    again = mixing.mixture(frame.union(frame), known.union(known)).collect()
    assert len(again) == 2 * len(rows)


@pytest.mark.parametrize("weights", [(0.5, 2.0), (0.2, 1.0), (1.2, 0.3), (1.0, 1.0)])
def test_mixing_against_brute_force(spark, weights):
    """Nonnegative least squares on 300 documents, by many plain steps; targets that can and can't be reached."""
    rng = np.random.default_rng(5)
    p = rng.beta(0.3, 0.3, 300)
    w = rng.integers(0, 200, 300)
    rows = [(k, k, k, int(w[k]), [float(p[k]), float(1 - p[k])]) for k in range(300)]
    members = spark.createDataFrame(rows, "doc_id long, _k1 long, _k2 long, tokens long, p array<double>")
    scratch = mixing.Scratch(spark, "brute")
    mix = mixing.Mix(domains=("a", "b"), weights=weights, tolerance=1e-3, kept_steps=7)
    state, targets, reached, total = mixing.solve(scratch.keep(members), mix, scratch)
    a = np.stack([p, 1 - p]) * w / w.sum()
    t = a.sum(axis=1) * np.array(weights)
    weight = np.linalg.inv(a @ np.stack([p, 1 - p]).T)
    r = np.ones(300)
    for _ in range(20_000):
        r = np.maximum(0, r - np.stack([p, 1 - p]).T @ (weight @ (a @ r - t)))
    assert np.allclose(targets / total, t)
    x, y = reached / total - t, a @ r - t
    assert abs(math.sqrt(x @ weight @ x) - math.sqrt(y @ weight @ y)) < 5e-3
    rate = {x.doc_id: x.r for x in state.collect()}
    assert np.allclose(a @ np.array([rate[k] for k in range(300)]), reached / total) and min(rate.values()) >= 0
    with pytest.raises(RuntimeError, match="not enough"):
        if weights == (1.0, 1.0):  # met at once
            raise RuntimeError("not enough")
        mixing.solve(scratch.keep(members), mixing.Mix(domains=("a", "b"), weights=weights, tolerance=1e-5, steps=1), scratch)


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [None]


def brute_model(rows, order, smoothing=0.1):
    """Score, base score and known tokens of each row: counts in dictionaries, EM token by token."""
    part = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 10

    def counts(parts):
        grams, n = Counter(), 0
        for i, t in rows:
            if part(i) in parts:
                x = [None] * (order - 1) + tokens(t)
                grams.update(tuple(x[k - n : k + 1]) for n in range(order) for k in range(order - 1, len(x)))
                n += 1
        return grams, n

    def mixture(grams, docs_, weights, x, k):
        """Mixed probability, and the next order's estimate and bucket, of token k of x."""
        one = [c for g, c in grams.items() if len(g) == 1]
        p = (grams[(x[k],)] + smoothing) / (sums.setdefault(id(grams), sum(one)) + smoothing * (len(one) + 1))
        for n in range(1, order):
            context = docs_ if k == order - 1 else grams[tuple(x[k - n : k])]
            b = min(int(math.log2(context)) + 1, lm_score.BUCKETS - 1) if context else 0
            ml = grams[tuple(x[k - n : k + 1])] / context if context else 0.0
            if n > len(weights):
                return p, ml, b
            p = weights[n - 1][b] * ml + (1 - weights[n - 1][b]) * p
        return p, None, None

    sums = {}
    every, docs_ = counts(range(1, 10))
    less, docs_less = counts(range(2, 10))
    every, less = Counter({k: v for k, v in every.items()}), Counter({k: v for k, v in less.items()})
    weights = []
    for _ in range(1, order):
        events = [mixture(less, docs_less, weights, x, k) for i, t in rows if part(i) == 1 for x in [[None] * (order - 1) + tokens(t)] for k in range(order - 1, len(x))]
        weight = [0.0] + [0.5] * (lm_score.BUCKETS - 1)
        for _ in range(4000):
            total, share = Counter(), Counter()
            for p, ml, b in events:
                total[b] += 1
                share[b] += weight[b] * ml / (weight[b] * ml + (1 - weight[b]) * p)
            new = [0.0] + [min(share[b] / total[b], 0.9999) if total[b] else weight[b] for b in range(1, lm_score.BUCKETS)]
            done, weight = max(abs(a - b) for a, b in zip(new, weight, strict=True)) < 1e-7, new
            if done:
                break
        weights.append(weight)
    out = []
    for i, t in rows:
        x = [None] * (order - 1) + tokens(t)
        at = range(order - 1, len(x))
        base = sum(math.log10(mixture(every, docs_, [], x, k)[0]) for k in at)
        out.append((i, part(i) == 0, len(at), sum(every[(x[k],)] > 0 for k in at), sums[id(every)], base, sum(math.log10(mixture(every, docs_, weights, x, k)[0]) for k in at)))
    return out


@pytest.mark.parametrize(
    "model",
    [lm_score.Model(block_bytes=4000), lm_score.Model(order=3, block_bytes=4000), lm_score.Model(order=3, block_bytes=900, bits=2, range_bytes=600, merged=4)],
)
def test_language_model(spark, model):
    rng = random.Random(9)
    follows = {k: rng.sample(range(60), 3) for k in range(60)}
    rows = []
    for k in range(130):
        at, out = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            out.append(f"W{at}")
            at = rng.choice(follows[at])
        rows.append((k, " ".join(out)))
    rows += [(1000, None), (1001, ""), (None, "W1 W2"), (1002, "never seen"), rows[3], rows[3], rows[3]]
    got = sorted(map(tuple, lm_score.score(docs(spark, rows).repartition(3), model).collect()), key=repr)
    want = sorted(brute_model(rows, model.order), key=repr)
    gain = 0.0
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-4)
        gain += (g[6] - g[5]) * g[1]
    assert gain > 0
    assert lm_score.score(docs(spark, []), model).count() == 0


def test_packed_keys():
    rng = np.random.default_rng(2)
    for keys in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.sort(rng.integers(0, 2**64, 50, dtype=np.uint64)), np.unique(rng.integers(0, 2**64, 300_000, dtype=np.uint64)), np.arange(9, dtype=np.uint64), np.unique(rng.integers(0, 2**56, 200_000, dtype=np.uint64)) << np.uint64(8), np.unique(rng.integers(0, 2**48, 200_000, dtype=np.uint64)) << np.uint64(16), np.array([256, 2**63], np.uint64)):
        assert (lm_score.unpack_keys(lm_score.pack_keys(keys)) == keys).all()


def test_model_without_training_documents(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:5]
    got = lm_score.score(docs(spark, [(i, "a b") for i in ids])).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and r.held_out for r in got)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    common = [f"w{k}" for k in range(3000)]
    text = lambda n=120: " ".join(rng.choices(common, k=n))
    rows, labels = [], []
    for k in range(200):
        rows.append([k, text()])
    for k in range(200, 260):
        rows.append([k, " ".join(rng.sample([*rows[k - 200][1].split(), "vile", "nasty", "rotten", "foul"], k=124)) + " vile nasty rotten"])
        labels.append((k, 1, 1))
    labels += [(k, 1, 0) for k in range(150)]
    bench = text(30)
    rows += [[300, rows[1][1]], [301, rows[2][1] + " extra"], [302, text(50) + " " + bench + " " + text(50)], [303, "too short"]]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(200)) and len(got) > 200  # the mix takes some clean documents twice
    assert {r.shard for r in got} == set(range(40))


def brute_template(pages, deduction):
    """Template texts of a host's distinct pages: classes of equal occurrence vectors, by dictionaries."""
    profiles = []
    for html in dict.fromkeys(pages):
        blocks, elements = html_extract.parse(html)
        seen = Counter({k: e.count for k, e in elements.items()})
        size = dict.fromkeys(elements, 1)
        texts = set()
        for e, block in blocks:
            for key, words in html_extract.block_tokens(e, block).items():
                seen[key] += 1
                size[key] = words
                texts.add(key)
        profiles.append((seen, size, texts))
    classes = defaultdict(list)
    for token in {t for seen, _, _ in profiles for t in seen}:
        classes[tuple(seen[token] for seen, _, _ in profiles)].append(token)
    out = set()
    for vector, members in classes.items():
        support = sum(n > 0 for n in vector)
        texts = {t for t in members if any(t in x for _, _, x in profiles)}
        if support < deduction.min_text_pages:
            members = [t for t in members if t not in texts]
            texts = set()
        if support >= deduction.min_pages * len(profiles) and sum(max(s.get(t, 0) for _, s, _ in profiles) for t in members) >= deduction.min_tokens:
            out |= texts
    return out


def test_template_against_brute_force(spark):
    rng = random.Random(14)
    lines = [f"Line {k} of many" for k in range(6)] + ["Ad", "Two words"]
    rows = []
    for k in range(90):
        host = "abc"[k % 3]
        inner = "".join(f"<{t}>{rng.choice(lines)}</{t}>" for t in rng.choices(["p", "div", "h2"], k=rng.randint(0, 5)))
        rows.append((k, f"http://{host}.example/{k}", f"<body><div class='x{k % 2}'><p>Own text {k}</p>{inner}</div><div class='low'>{rng.choice(lines[:3])}</div></body>"))
    rows += rows[:9]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    deduction = html_extract.Deduction()
    known = frame.selectExpr("substring(url, 8, 9) as host", "xxhash64(html) as page", "html")
    got = {r.host: set(r.tokens) for r in html_extract.template_texts(known, deduction).collect()}
    for host in "abc":
        want = brute_template([h for _, u, h in rows if u.startswith(f"http://{host}.")], deduction)
        assert got.get(f"{host}.example", set()) == want and want
    full = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert any(full[k] != " ".join(html_extract.extract_page(h, set(), [])) for k, _, h in rows)
    assert all(full[k].startswith(f"Own text {k}") for k, _, _ in rows)
