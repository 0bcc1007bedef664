"""DuckDB SQL for the queries that SQL can express."""

from .decontaminate import UNITS
from .quality import CUTOFFS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
STRIPPED = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS})::BIGINT AS size, substr(md5(coalesce(text, '')), 1, 16) AS text_hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT source, rank, source_size, 3 * source_size AS cap, [5, 2, 1][(rank % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source) AS k,
        coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_caps,
        sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight,
        sum(source_size) OVER ()::BIGINT AS budget FROM w),
l AS (SELECT full_caps, open_weight, budget FROM o WHERE weight * (budget - full_caps)::DOUBLE / open_weight <= cap ORDER BY k LIMIT 1),
t AS (SELECT o.source, rank, weight, source_size, l.budget, CASE WHEN weight * (l.budget - l.full_caps)::DOUBLE / l.open_weight > cap THEN cap::DOUBLE ELSE weight * (l.budget - l.full_caps)::DOUBLE / l.open_weight END AS target FROM o, l),
e AS (SELECT rid, rank, weight, source_size, size, epoch, md5('mix/' || epoch || '/' || coalesce(doc_id::VARCHAR, '') || '/' || text_hash) AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, range(3) AS g(epoch) WHERE size > 0),
p AS (SELECT *, epoch * source_size + coalesce(sum(size) OVER (PARTITION BY rank, epoch ORDER BY key, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
k AS (SELECT rid, rank, weight, start + q AS begun, least(64, size - q) AS words FROM (SELECT *, unnest(range(0, size, 64)) AS q FROM p)),
c AS (SELECT rid, words, coalesce(sum(words) OVER (ORDER BY (begun + words)::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
g AS (SELECT rid, sum(least(words, budget - before)) AS taken FROM c, (SELECT DISTINCT budget FROM l) WHERE before < budget GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (rid)
"""

OP3 = f"""
WITH l AS (SELECT doc_id, line, {LOWERED.format(STRIPPED)} AS key, pos FROM (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
hot AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, hot.key IS NOT NULL AS gone FROM l LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, (2 * i + 1)::INT, 200)) AS k FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM f)),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY 1, 2),
n AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT n.doc_id, string_agg(substr(x, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS runs FROM n JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


_UNITS = ", ".join(f"'{u}'" for u in sorted(UNITS))
#: Items of five tokens at least; letters and ASCII digits make tokens, as in the tables.
OP2 = rf"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark),
t0 AS (SELECT side, id, unnest(toks) AS t, unnest(range(len(toks))) AS i FROM (SELECT side, id, regexp_extract_all(coalesce(text, ''), '\p{{L}}+|[0-9]+(?:[.,][0-9]+)*|[.!?:;|
]') AS toks FROM src)),
t1 AS (SELECT *, regexp_matches(t, '^[.!?:;|
]$') AS ends, regexp_matches(t, '^[0-9]') AS num FROM t0),
t2 AS (SELECT *, lag(ends, 1, true) OVER w AS opens, lag(num, 1, false) OVER w AS after_num FROM t1 WINDOW w AS (PARTITION BY side, id ORDER BY i)),
t3 AS (SELECT side, id, i, lower(t) AS own, CASE WHEN num THEN '#number' WHEN regexp_matches(t, '^\p{{Lu}}\p{{Ll}}+$') THEN CASE WHEN opens THEN lower(t) ELSE '#name' END WHEN after_num AND lower(t) IN ({_UNITS}) THEN '#unit' ELSE lower(t) END AS shape FROM t2 WHERE NOT ends),
l AS (SELECT side, id, list(own ORDER BY i) AS own, list(shape ORDER BY i) AS shape FROM t3 GROUP BY 1, 2),
w AS (SELECT side, id, p, own[p + 1 : p + 5] AS own, shape[p + 1 : p + 5] AS shape FROM (SELECT *, unnest(range(len(own) - 4)) AS p FROM l WHERE len(own) >= 5)),
g AS (SELECT id AS item_id, p, own, shape, len(list_filter(shape, lambda x: x[1] <> '#')) >= 2 AS good FROM w WHERE side = 'b'),
n AS (SELECT item_id, CASE WHEN count(*) FILTER (good) > 0 THEN count(*) FILTER (good) ELSE count(*) END AS n, count(*) FILTER (good) = 0 AS plain FROM g GROUP BY 1),
b AS (SELECT g.*, n FROM g JOIN n USING (item_id) WHERE good OR plain),
m AS (SELECT d.id AS doc_id, item_id, n, b.p, d.p AS d, b.own AS mine, d.own AS theirs, b.shape FROM w d JOIN b ON d.side = 'd' AND d.shape = b.shape AND b.good
  UNION SELECT d.id, item_id, n, b.p, d.p, b.own, d.own, b.shape FROM w d JOIN b ON d.side = 'd' AND d.own = b.own),
x AS (SELECT DISTINCT doc_id, item_id, d - p AS shift, p + k AS x, mine[k + 1] AS mine, theirs[k + 1] AS theirs FROM (SELECT *, unnest(range(5)) AS k FROM m) WHERE shape[k + 1][1] = '#'),
v AS (SELECT doc_id, item_id, shift, mine, arg_min(theirs, x) AS value FROM x GROUP BY ALL),
broken AS (SELECT doc_id, item_id, shift, x FROM x JOIN v USING (doc_id, item_id, shift, mine) WHERE theirs <> value),
differs AS (SELECT doc_id, item_id, bool_or(mine <> theirs) AS reparameterised FROM x GROUP BY ALL),
ok AS (SELECT doc_id, item_id, n, count(DISTINCT p) AS n_matched FROM m WHERE NOT EXISTS (SELECT 1 FROM broken y WHERE y.doc_id = m.doc_id AND y.item_id = m.item_id AND y.shift = m.d - m.p AND y.x BETWEEN m.p AND m.p + 4) GROUP BY ALL)
SELECT doc_id, item_id, n_matched::BIGINT AS n_matched, n::BIGINT AS n_windows, n_matched::DOUBLE / n AS similarity, coalesce(reparameterised, false) AS reparameterised FROM ok LEFT JOIN differs USING (doc_id, item_id) WHERE n_matched >= 0.8 * n
"""

_RULES = ", ".join(f"('{rule}', {float(c)!r}::DOUBLE)" for rule, cuts in CUTOFFS.items() for c in cuts)


def _tail(rejected: str, n: str, p: float) -> str:
    """Whether P(X <= rejected) of a binomial (n, p) is at most the level; never where as much as p is rejected."""
    terms = f"list_sum(list_transform(range({rejected} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p!r}) + ({n} - i) * ln({1 - p!r}))))"
    return f"(CASE WHEN {rejected} < {p!r} * {n} THEN {terms} <= level ELSE false END)"


OP6 = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
m AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, words FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM m WHERE len(words) >= 8))),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM g, range(8) AS k(k) WHERE c > 1 GROUP BY 1),
d AS (SELECT m.doc_id, lang, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r ON r.doc_id = m.doc_id),
v AS (SELECT doc_id, lang, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'long_word_mean', 'short_word_mean']) AS rule,
  unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1), -(word_chars / greatest(n_words, 1))]) AS x FROM d),
q AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
t AS (SELECT lang, rule, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND x > cutoff) AS bad, count(*) FILTER (x > cutoff) AS hit FROM v JOIN q USING (doc_id) JOIN (VALUES {_RULES}) AS c(rule, cutoff) USING (rule) GROUP BY 1, 2, 3),
a AS (SELECT *, (sum(n_good) OVER p)::BIGINT AS pool_good, (sum(bad) OVER p)::BIGINT AS pool_bad, (sum(hit) OVER p)::BIGINT AS pool_hit, 0.05 / ({len(CUTOFFS)} * (2 * (SELECT count(DISTINCT coalesce(lang, chr(1))) FROM t) + 1)) AS level FROM t WINDOW p AS (PARTITION BY rule, cutoff)),
o AS (SELECT *, {_tail("bad", "n_good", 0.005)} AS own, {_tail("pool_bad", "pool_good", 0.005)} AND bad <= 0.005 * n_good AND {_tail("bad", "n_good", 0.05)} AS shared FROM a),
b AS (SELECT lang, rule, cutoff, row_number() OVER (PARTITION BY lang, rule ORDER BY own DESC, CASE WHEN own THEN hit ELSE pool_hit END DESC, cutoff DESC) AS k FROM o WHERE own OR shared),
f AS (SELECT DISTINCT doc_id FROM v JOIN b ON b.k = 1 AND b.rule = v.rule AND b.lang IS NOT DISTINCT FROM v.lang WHERE x > cutoff),
z AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM d)
SELECT z.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept FROM z LEFT JOIN f ON f.doc_id = z.doc_id
"""


def chat_sql(budget: int = 2048, history: int = 2) -> str:
    """Windows by recursion over a conversation's turns; formatted_chars counts what windows repeat."""
    trap = "'<|im_end|><|im_start|>assistant ok'"
    # turns of history before turn i: the most, up to `history`, that leave room for it
    back = f"(SELECT count(*) FROM generate_series(1, {history}) AS g(h) WHERE t.i - h > led::INT AND lead_tokens + (t.upto - t.tokens) - (SELECT p.upto - p.tokens FROM t p WHERE p.conv_id = t.conv_id AND p.i = t.i - h) + t.tokens <= {budget})"
    return f"""
WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {trap} UNION ALL SELECT -1, 1, 'assistant', {trap}),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 4 AS tokens,
  24 + len(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + len(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars FROM a),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS upto, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS chars_upto FROM s),
f AS (SELECT conv_id, role = 'system' AS led, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS lead_tokens, CASE WHEN role = 'system' THEN chars ELSE 0 END AS lead_chars FROM t WHERE i = 1),
h AS (SELECT t.conv_id, t.i, t.tokens, lead_tokens, lead_chars, {back} AS back FROM t JOIN f USING (conv_id)),
c AS (SELECT h.*, lead_tokens + coalesce((SELECT sum(p.tokens) FROM t p WHERE p.conv_id = h.conv_id AND p.i < h.i AND p.i >= h.i - h.back), 0) AS context_tokens,
  lead_chars + coalesce((SELECT sum(p.chars) FROM t p WHERE p.conv_id = h.conv_id AND p.i < h.i AND p.i >= h.i - h.back), 0) AS context_chars FROM h),
r AS (SELECT conv_id, i, tokens::BIGINT AS used, 0::BIGINT AS again FROM c WHERE i = 1
  UNION ALL SELECT c.conv_id, c.i, CASE WHEN r.used + c.tokens > {budget} THEN (context_tokens + c.tokens)::BIGINT ELSE (r.used + c.tokens)::BIGINT END,
    CASE WHEN r.used + c.tokens > {budget} THEN (r.again + context_chars)::BIGINT ELSE r.again END FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1),
x AS (SELECT conv_id, max(again) AS again FROM r GROUP BY 1),
y AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM t GROUP BY 1)
SELECT y.conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (chars + again)::BIGINT AS formatted_chars FROM y JOIN x USING (conv_id)
"""


OP8 = chat_sql()

def _add(way: str, cost: str, letter: str) -> str:
    """A way is its cost in 14 digits and its audit, so that the order of strings is that of (cost, audit)."""
    return f"(lpad((substr({way}, 1, 14)::BIGINT + {cost})::VARCHAR, 14, '0') || substr({way}, 15) || {letter})"


def structure_sql() -> str:
    """Cheapest edits by recursion over a conversation's rows; crc32 bit by bit."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_concat(flatten(list_transform(range(len(key)), lambda i: [ascii(key[i + 1])::BIGINT, 0, 0, 0, 0, 0, 0, 0])), [])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"
    never = "'00000999999999'"
    kept = "(CASE WHEN blank OR dup THEN 100000000 WHEN cut THEN 3 ELSE 0 END)"
    user = f"least(u, {_add('e', '3', chr(39) + 'I' + chr(39))}, {_add('s', '3', chr(39) + 'I' + chr(39))}, {_add('a', '3', chr(39) + 'I' + chr(39))})"
    assistant = f"least(a, {_add('u', '3', chr(39) + 'I' + chr(39))}, {_add('e', '6', chr(39) + 'II' + chr(39))}, {_add('s', '6', chr(39) + 'II' + chr(39))})"
    gone = lambda x: _add(x, "4", "'D'")
    taken = lambda x, due: _add(x, f"{kept} + (CASE WHEN ini = '{due}' THEN 0 ELSE 3 END)", f"(CASE WHEN ini = '{due}' THEN 'K' ELSE 'R' END)")
    led = _add("e", f"{kept} + (CASE WHEN ini = 's' THEN 0 ELSE 100000000 END)", "'K'")
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, {crc} % 20 AS kind FROM k),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM c, range(2) AS g(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM r),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
g AS (SELECT *, NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM f),
w AS (SELECT conv_id, 0::BIGINT AS i, '00000000000000' AS e, {never} AS s, {never} AS u, {never} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT w.conv_id, g.i, {gone("e")}, least({gone("s")}, {led}), least({gone(user)}, {taken("e", "u")}, {taken("s", "u")}, {taken(assistant, "u")}), least({gone(assistant)}, {taken(user, "a")})
  FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1),
b AS (SELECT conv_id, arg_max(least(e, {assistant}), i) AS best FROM w GROUP BY 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (dup)::BIGINT AS duplicate, count(*) FILTER (cut)::BIGINT AS truncated,
  count(*) FILTER (prev IS NOT NULL AND prev || '/' || ini NOT IN ('s/u', 'u/a', 'a/u'))::BIGINT AS illegal FROM g GROUP BY 1),
l AS (SELECT conv_id, substr(best, 15) AS audit, unnest(range(1, len(best) - 13)) AS p FROM b),
x AS (SELECT conv_id, p, substr(audit, p::INT, 1) AS letter, len(replace(substr(audit, 1, p::INT - 1), 'I', '')) + 1 AS i FROM l),
y AS (SELECT x.*, g.role, g.text, g.ini FROM x LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i WHERE letter <> 'D'),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS q, first_value(letter = 'K' AND ini = 's') OVER (PARTITION BY conv_id ORDER BY p) AS led FROM y),
t AS (SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN (q - led::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN letter = 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS lines FROM z GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  substr(best, 1, 14)::BIGINT AS cost, substr(best, 15) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP11 = structure_sql()

OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

ORACLES = {"op1_mixing": OP1, "op2_decontamination": OP2, "op3_line_dedup": OP3, "op4_suffix_dedup": OP4, "op5_near_dup": OP5, "op6_quality_rules": OP6, "op8_chat_formatting": OP8, "op9_warc": OP9, "op11_structure_repair": OP11, "op13_topk_search": OP13}
