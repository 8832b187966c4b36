"""DuckDB SQL for the queries that SQL can express, over the same tables."""

SQL: dict[str, str] = {}

#: Words between white space of a text column t.
_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op2_line_frequency"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {_WORDS.format(t="text")} AS w FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM seen WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, source, md5(text) AS txt, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT rid, source, txt, line, lower(array_to_string({_WORDS.format(t="line")}, ' ')) AS norm, len({_WORDS.format(t="line")}) AS words FROM l),
full_l AS (SELECT * FROM ln WHERE words > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM full_l GROUP BY rid),
host AS (SELECT source, count(DISTINCT md5(text)) AS n FROM d GROUP BY source),
cnt AS (SELECT source, norm, count(DISTINCT txt) AS c FROM full_l GROUP BY source, norm),
one AS (SELECT min(rid) AS rid FROM d GROUP BY source, md5(text)),
held AS (
  SELECT f.rid, f.source, f.norm, f.words FROM full_l f JOIN one USING (rid)
  JOIN cnt ON cnt.norm = f.norm AND cnt.source IS NOT DISTINCT FROM f.source WHERE cnt.c > 10),
own AS (SELECT rid FROM (SELECT rid, sum(words) AS n FROM held GROUP BY rid) x JOIN w USING (rid) WHERE len(w.w) - x.n >= 0.5 * len(w.w)),
common AS (
  SELECT cnt.source, cnt.norm FROM cnt JOIN host h ON h.source IS NOT DISTINCT FROM cnt.source WHERE cnt.c > 5 AND cnt.c > 0.1 * h.n
  UNION SELECT source, norm FROM held JOIN own USING (rid) GROUP BY source, norm HAVING count(DISTINCT rid) > 10),
lost AS (SELECT f.rid, sum(f.words) AS n FROM full_l f JOIN common c ON c.norm = f.norm AND c.source IS NOT DISTINCT FROM f.source GROUP BY f.rid),
b AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - lost >= 0.5 * n_words AS kept,
  (n_words - lost)::BIGINT AS n_words_left
FROM b
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = rf"list_filter(regexp_split_to_array(translate({{t}}, '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL["op10_prefix_filter"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM.format(t="coalesce(text, '')")} AS w FROM documents),
it AS (SELECT item_id::VARCHAR AS item_id, {_ALNUM.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, i, k, item_id FROM dw JOIN win USING (k, s)),
hw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, list_sort(list(item_id) FILTER (WHERE item_id IS NOT NULL)) AS items, count(*) AS k FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(hi.k, 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

SQL["op8_fast_similarity"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e2.b FROM r JOIN e2 ON e2.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id, d.doc_id = min(r.seen) AS kept
FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

SQL["op4_snapshot_collapse"] = """
WITH g AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CASE WHEN turn IS NULL THEN count(*) ELSE 1 END AS n
  FROM conversations GROUP BY 1, 2, 3, 4),
t AS (SELECT conv_id, turn, role, text, unnest(range(n)) AS again FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS rank FROM t),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY rank) AS l FROM k GROUP BY conv_id),
p AS (SELECT DISTINCT md5(l[1:j]::VARCHAR) AS h, j FROM (SELECT l, unnest(range(1, n)) AS j FROM c)),
one AS (SELECT l, any_value(n) AS n, min(conv_id) AS conv_id FROM c GROUP BY l)
SELECT conv_id, 0::INTEGER AS part, 1::BIGINT AS n_parts, n::BIGINT AS n_turns,
  array_to_string(list_transform(l, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS text
FROM one WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = md5(one.l::VARCHAR) AND p.j = one.n)
"""

SQL["op12_distinct_text_index"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(out) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

# Forward over a conversation's rows, with the best (cost, edits) of each grammar state as text that sorts by cost, then edits.
_CRC = "xor(list_reduce(list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)), 4294967295::BIGINT), 4294967295)"


def _op13() -> str:
    def add(state: str, cost: str, letter: str, given: str) -> str:
        return f"CASE WHEN a.{state} IS NOT NULL AND {given} THEN lpad((a.{state}[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || a.{state}[10:] || '{letter}' END"

    stays, more = "x.f NOT IN (1, 2)", "CASE WHEN x.f = 3 THEN 3 ELSE 0 END"
    keep = lambda s, role: add(s, f"({more})", "K", f"{stays} AND x.i = '{role}'")  # noqa: E731
    rerole = lambda s: add(s, f"(3 + {more})", "R", stays)  # noqa: E731
    gone = lambda s: add(s, "4", "D", "true")  # noqa: E731
    insert = lambda x: f"lpad(({x}[1:9]::BIGINT + 3)::VARCHAR, 9, '0') || {x}[10:] || 'I'"  # noqa: E731
    row = {
        "o": gone("o"),
        "s": f"least({gone('s')}, {keep('o', 's')})",
        "u": f"least({gone('u')}, {', '.join(keep(x, 'u') + ', ' + rerole(x) for x in 'osa')})",
        "a": f"least({gone('a')}, {keep('u', 'a')}, {rerole('u')})",
    }
    # inserts behind the row: a user turn from everywhere but u, then an assistant turn, then a user turn again
    settle = lambda e: (  # noqa: E731
        f"list_transform(list_transform([{e}], lambda a: {{'o': a.o, 's': a.s, 'u': least(a.u, {insert('a.o')}, {insert('a.s')}, {insert('a.a')}), 'a': a.a}}), "
        f"lambda a: {{'o': a.o, 's': a.s, 'u': a.u, 'a': least(a.a, {insert('a.u')})}})[1]"
    )
    step = settle("{" + ", ".join(f"'{k}': {v}" for k, v in row.items()) + "}")
    first = settle("{'o': '000000000', 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR}")
    return rf"""
WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
k AS (SELECT *, {_CRC} % 20 AS kind FROM o),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM k WHERE kind <> 0),
p AS (
  SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen, lag(role[1:1]) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
f AS (
  SELECT *, CASE WHEN regexp_full_match(text, '[ 	-]*') THEN 1 WHEN seen > 1 THEN 2 WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1:] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f
  FROM p),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
    count(*) FILTER (WHERE before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, list({{'f': f, 'i': role[1:1], 'r': role, 't': text}} ORDER BY pos) AS rows
  FROM f GROUP BY conv_id),
b AS (SELECT *, least(e.o, e.a) AS best FROM (SELECT *, list_reduce(list_transform(rows, lambda x: {{'a': NULL::STRUCT(o VARCHAR, s VARCHAR, u VARCHAR, a VARCHAR), 'x': x}}),
    lambda y, z: {{'a': list_transform([{{'a': y.a, 'x': z.x}}], lambda q: list_transform([q.a], lambda a: list_transform([q.x], lambda x: {step})[1])[1])[1], 'x': z.x}},
    {{'a': {first}, 'x': NULL::STRUCT(f INTEGER, i VARCHAR, r VARCHAR, t VARCHAR)}}).a AS e FROM c)),
g AS (SELECT *, best[1:9]::BIGINT AS cost, best[10:] AS audit FROM b),
w AS (
  SELECT conv_id, rows, audit, unnest(range(1, len(audit) + 1)) AS j FROM g),
v AS (
  SELECT conv_id, j, audit[j:j] AS e, rows[len(replace(audit[1:j], 'I', ''))] AS x FROM w WHERE audit[j:j] <> 'D'),
n AS (
  SELECT conv_id, j, e, x, row_number() OVER (PARTITION BY conv_id ORDER BY j) - (CASE WHEN first_value(e || x.i) OVER (PARTITION BY conv_id ORDER BY j) = 'Ks' THEN 1 ELSE 0 END) AS nth FROM v),
t AS (
  SELECT conv_id, string_agg(CASE e WHEN 'K' THEN x.r ELSE CASE nth % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE x.t END, chr(10) ORDER BY j) AS text FROM n GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


SQL["op13_cost_to_go_repair"] = _op13()
