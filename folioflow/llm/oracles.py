"""DuckDB's SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from folioflow.llm.licenses import license_sql

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def reach_sql(links: str, nodes: str) -> str:
    """Common table expressions up to component(node, component_id) from links(a, b), both ways, and nodes(node)."""
    return f"""reach AS (SELECT node AS a, node AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b),
component AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)"""


def windows_sql(size: int = 13) -> str:
    """op5: the smallest document of each window, then the words that windows of others cover."""
    return f"""WITH worded AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(len(ws) - {size - 1})) AS s, unnest(list_transform(range(len(ws) - {size - 1}), lambda i: array_to_string(ws[i + 1:i + {size}], ' '))) AS w
  FROM worded WHERE len(ws) >= {size}),
least AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + {size})) AS p FROM windows JOIN least USING (w) WHERE low < doc_id),
flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM worded),
kept AS (SELECT f.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY f.p) FILTER (c.p IS NULL) AS t FROM flat f LEFT JOIN covered c ON c.doc_id = f.doc_id AND c.p = f.p GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM worded w LEFT JOIN kept k USING (doc_id)"""


def shingles_sql(size: int = 4, percent: int = 85) -> str:
    """op6: shared shingles of all pairs that share one, then what is reachable."""
    return f"""WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= {size} THEN list_distinct(list_transform(range(len(ws) - {size - 1}), lambda i: array_to_string(ws[i + 1:i + {size}], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM worded),
flat AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
nodes AS (SELECT doc_id AS node FROM sets), {reach_sql("links", "nodes")}
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id FROM sets JOIN component ON node = doc_id"""


_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def products_sql(k: int = 20) -> str:
    """op7: all products of queries and candidates."""
    return f"""WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_GOOD}),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores QUALIFY rank <= {k}"""


def shards_sql(shards: int = 16, slack: float = 0.01) -> str:
    """op9: prefix sums over the order of digests; groups over the slack are cut by rows. CRC-32 by its definition:
    a table from the reversed polynomial, then one step per byte."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: {bit}) AS c FROM range(256) r(i))),
coded AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
hexed AS (SELECT doc_id, x, strlen(x) AS n, hex(encode(x)) AS h FROM coded),
summed AS (SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, md5(x) AS digest,
    xor(list_reduce(list_concat([4294967295], list_transform(range(n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM hexed, crcs),
placed AS (SELECT *, row_number() OVER w - 1 AS pos, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM summed WINDOW w AS (ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING)),
grouped AS (SELECT *, min(before) OVER (PARTITION BY digest) AS b0, sum(size) OVER (PARTITION BY digest) AS bytes FROM placed),
cut AS (SELECT *, CASE WHEN bytes <= {slack} * total / {shards} THEN 2 * b0 + bytes ELSE 2 * before + size END * {shards} // (2 * total) AS shard FROM grouped)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(pos - min(pos) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut"""


def cosines_sql(least: float = 0.98) -> str:
    """op10: all pairs of a label."""
    return f"""WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {least}),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
nodes AS (SELECT vec_id AS node FROM embeddings), {reach_sql("links", "nodes")}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON node = vec_id LEFT JOIN counts ON counts.a = vec_id"""


def runs_sql(exponent: int = 4, least: int = 6) -> str:
    """op11: words q apart that are the same, joined to stretches; of equal stretches the smallest q."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: {bit}) AS c FROM range(256) r(i))),
worded AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, {_WORDS.format("text")} AS ws FROM documents),
hashed AS (SELECT doc_id, ws, len(ws) AS n, xor(list_reduce(list_concat([4294967295], list_transform(range(len(s)), lambda i: CAST(ascii(s[i + 1]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM worded, crcs),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
planned AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
planted AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM planned),
flat AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM planted),
equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND {exponent} * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal)
  GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({least}, {exponent} * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
covered AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT f.doc_id, string_agg(w, ' ' ORDER BY f.i) FILTER (c.i IS NULL) AS t FROM flat f LEFT JOIN covered c ON c.doc_id = f.doc_id AND c.i = f.i GROUP BY f.doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS t,
  first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best FROM runs GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def repair_sql() -> str:
    """op12: from the last row to the first, the least (cost, audit, text) of each state."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    line = "chr(10)"

    def then(letter: str, cost: str, rest: str, role: str | None = None, text: str = "''") -> str:
        out = f"{rest}.o" if role is None else f"concat({role}, ':', {text}, CASE WHEN {rest}.e THEN '' ELSE {line} END, {rest}.o)"
        return f"{{'c': {rest}.c + {cost}, 't': '{letter}' || {rest}.t, 'e': {f'{rest}.e' if role is None else 'false'}, 'o': {out}}}"

    never = "{'c': 1000000000, 't': '', 'e': true, 'o': ''}"
    end = "{'c': 0, 't': '', 'e': true, 'o': ''}"
    maybe = lambda test, arc: f"CASE WHEN {test} THEN {arc} ELSE {never} END"
    drop = {x: then("D", "3", x) for x in "nsua"}
    reuser, reasst = (then("R", "2 + cut", x, f"'{r}'", "text") for x, r in (("u", "user"), ("a", "assistant")))
    keep = {x: then("K", "cut", x, "role", "text") for x in "sua"}
    to_user = f"{maybe('free AND i = $$u$$', keep['u'])}, {maybe('free', reuser)}"
    states = {
        "n": f"least({drop['n']}, {maybe('free AND i = $$s$$', keep['s'])}, {to_user})",
        "s": f"least({drop['s']}, {to_user})",
        "u": f"least({drop['u']}, {maybe('free AND i = $$a$$', keep['a'])}, {maybe('free', reasst)})",
        "a": f"least({drop['a']}, {to_user})",
    }
    insert = {x: then("I", "2", y, f"'{r}'") for x, y, r in (("n", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user"))}

    def closed(rows: str) -> str:
        """Rows may be inserted: between u and a once, then before both."""
        both = f"SELECT * REPLACE (least(u, {insert['u']}) AS u, least(a, {insert['a']}) AS a) FROM ({rows})"
        return f"SELECT * REPLACE (least(n, {insert['n']}) AS n, least(s, {insert['s']}) AS s) FROM ({both})"

    return f"""WITH RECURSIVE crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: {bit}) AS c FROM range(256) r(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS x FROM conversations),
coded AS (SELECT named.*, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x)), lambda i: CAST(ascii(x[i + 1]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM named, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
placed AS (SELECT *, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, row_number() OVER w AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lead(left(role, 1)) OVER w AS after
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
judged AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
costed AS (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM judged),
best(conv_id, pos, n, s, u, a) AS (SELECT conv_id, pos, n, s, u, a FROM ({closed(f"SELECT conv_id, max(pos) + 1 AS pos, {end} AS n, {never} AS s, {never} AS u, {end} AS a FROM costed GROUP BY conv_id")})
  UNION ALL SELECT conv_id, pos, n, s, u, a FROM ({closed(f"SELECT b.conv_id, r.pos, {states['n']} AS n, {states['s']} AS s, {states['u']} AS u, {states['a']} AS a FROM best b JOIN costed r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1")})),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND concat(i, after) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT d.conv_id, {", ".join(f"CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  CAST(coalesce(b.n.c, 0) AS BIGINT) AS cost, coalesce(b.n.t, '') AS audit, sha256(coalesce(b.n.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id AND b.pos = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_sql(),
        "op5_repeated_windows": windows_sql(),
        "op6_shingle_join": shingles_sql(),
        "op7_inner_products": products_sql(),
        "op9_byte_shards": shards_sql(),
        "op10_near_vectors": cosines_sql(),
        "op11_periodic_runs": runs_sql(),
        "op12_conversation_repair": repair_sql(),
    }
