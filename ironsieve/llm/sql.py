"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[^\\x20\\x09-\\x0D]+"
# the smallest node that edges e (a, b) lead to
_REACH = """, both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON r.b = w.a),
 least AS (SELECT a, least(a, min(b)) AS component FROM reached GROUP BY a)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
 fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
 e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.98),
 n AS (SELECT a, count(*) AS n FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) GROUP BY a){_REACH}
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component, v.vec_id) AS component_id, coalesce(component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN least ON least.a = v.vec_id"""

# the longest fitting rule of k (host, path): k.v, k.rule
_RULES = "(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(v, rh, rp)"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _key(url: str) -> str:
    return f"{_host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"


def _plain(path: str) -> str:
    """An absolute path without dot segments."""
    fold = (
        f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({path}, '/')[2:], lambda x: [x])),"
        " lambda done, x: CASE WHEN x[1] = '..' THEN list_slice(done, 1, greatest(len(done) - 1, 0)) WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END)"
    )
    end = f"CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN [''] ELSE CAST([] AS VARCHAR[]) END"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?(?:/|$)') THEN '/' || array_to_string(list_concat({fold}, {end}), '/') ELSE {path} END"


def _resolved(base: str, target: str) -> str:
    """The absolute url of a link's target, null if it is of another scheme."""
    scheme = f"regexp_extract({base}, '(?s)^([^:/?#]*)://', 1)"
    root = f"({scheme} || '://' || {_host(base)})"
    folder = f"('/' || regexp_extract({_path(base)}, '(?s)^/(.*/)?', 1) || regexp_extract({target}, '(?s)^[^?#]*'))"
    rest = f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)"
    return (
        f"CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target} WHEN starts_with({target}, '//') THEN {scheme} || ':' || {target}"
        f" WHEN starts_with({target}, '/') THEN {root} || {_plain(f"regexp_extract({target}, '(?s)^[^?#]*')")} || {rest} WHEN starts_with({target}, '?') THEN {root} || {_path(base)} || {target}"
        f" WHEN starts_with({target}, '#') THEN {base} WHEN {target} <> '' AND NOT regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {root} || {_plain(folder)} || {rest} END"
    )


_NAMED = """(?is)(?:\\bhref\\s*=|\\burl\\s*=)\\s*["'']?\\s*([^"''\\s>]+)"""
OP2 = f"""WITH RECURSIVE r AS (SELECT * FROM {_RULES}),
 tags AS (SELECT url, html, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
 named AS (SELECT url, regexp_extract(html, '(?is)<base\\b[^>]*?\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) AS base, replace(regexp_extract(tag, '{_NAMED}', 1), '&amp;', '&') AS target FROM tags
  WHERE regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b') OR regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
 based AS (SELECT url, coalesce({_resolved("url", "base")}, url) AS base, target FROM named),
 whole AS (SELECT url, {_resolved("base", "target")} AS target FROM based),
 e AS (SELECT DISTINCT {_key("url")} AS a, {_key("target")} AS b FROM whole WHERE contains(target, '://') AND {_key("url")} <> {_key("target")}){_REACH},
 h AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, CASE WHEN contains(url, '://') THEN {_key("url")} END AS key FROM pages),
 alias AS (SELECT a, component, {_host("('x://' || a)")} AS host, {_path("('x://' || a)")} AS path FROM least),
 told AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM (SELECT component, arg_max(v, length(rh || rp)) AS v FROM alias JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY component, a) GROUP BY 1),
 m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT h.page_id, h.host, h.path, rule, coalesce(m.v, told.v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id) LEFT JOIN least ON least.a = h.key LEFT JOIN told USING (component)"""

OP3 = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
 s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
 s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
 s2 AS (SELECT *, row_number() OVER u AS up, coalesce(sum(source_size) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still FROM s1 WINDOW u AS (ORDER BY source_size / w, place)),
 s3 AS (SELECT *, 3 * total - 4 * filled AS above FROM s2), f AS (SELECT min(up) AS up FROM s3 WHERE above * w < 4 * source_size * still),
 s AS (SELECT source, source_size, CASE WHEN (SELECT up FROM f) IS NULL OR s3.up < (SELECT up FROM f) THEN CAST(2 * source_size AS DOUBLE)
  ELSE CAST(w * (SELECT above FROM s3 x WHERE x.up = (SELECT up FROM f)) AS DOUBLE) / CAST(2 * (SELECT still FROM s3 x WHERE x.up = (SELECT up FROM f)) AS DOUBLE) END AS target FROM s3),
 p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END AS BIGINT) AS taken FROM p"""

OP7 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1), h AS (SELECT page_id, html, sha1(html) AS x FROM p)
SELECT h.page_id, CAST(octet_length(encode(h.html)) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN h.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN h.page_id <> first THEN first END AS refers_to, TRUE AS sound FROM h JOIN f ON h.html = f.html"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
 n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s), many AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1), y AS (SELECT x.* FROM x JOIN many USING (g)),
 c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM y p JOIN y q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)){_REACH}
SELECT n.doc_id, n.n AS n_shingles, coalesce(component, n.doc_id) AS component_id FROM n LEFT JOIN least ON least.a = n.doc_id"""

# four rounds, unrolled: nearest entry of every part (ties to the lower place), then floor of the means
def _assigned(k: int) -> str:
    return (
        f"d{k} AS (SELECT x.row, x.part, e.entry, sum((x.v - e.v) * (x.v - e.v)) AS d FROM x JOIN b{k} e ON e.part = x.part AND e.pos = x.pos GROUP BY ALL),"
        f" a{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)"
    )


def _moved(k: int) -> str:
    floor = "(sum(x.v) - (sum(x.v) % count(*) + count(*)) % count(*)) // count(*)"
    return (
        f"m{k} AS (SELECT x.part, a.entry, x.pos, CAST({floor} AS BIGINT) AS v FROM x JOIN a{k} a ON a.row = x.row AND a.part = x.part GROUP BY ALL),"
        f" b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry, pos))"
    )


OP12 = f"""WITH k AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
 u AS (SELECT row, len(v) // 4 AS step, unnest(range(0, len(v))) AS i, unnest(v) AS y FROM k),
 x AS MATERIALIZED (SELECT row, CAST(i // step AS INT) AS part, CAST(i % step AS INT) AS pos, CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT) AS v FROM u),
 b0 AS MATERIALIZED (SELECT part, CAST(row - 1 AS INT) AS entry, pos, v FROM x WHERE row <= 256),
 {", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(4))}, {_assigned(4)},
 t AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256 FROM k JOIN t USING (row)"""

# CRC-32 of the decimal digits of an integer, bit by bit
_BIT = "CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END"
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
    f" lambda s, c: list_reduce(list_prepend(xor(s, c), CAST(range(8) AS BIGINT[])), lambda z, i: {_BIT})), 4294967295)"
)
OP13 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 s AS (SELECT conv_id, turn, left(sha256(length(role) || ':' || role || text), 32) AS symbol, CAST(len(regexp_extract_all(text, '{_WORD}')) AS BIGINT) AS words FROM t),
 o AS (SELECT conv_id, list(symbol ORDER BY turn NULLS FIRST, symbol) AS own, list(words ORDER BY turn NULLS FIRST, symbol) AS own_words FROM s GROUP BY 1),
 h AS (SELECT *, CAST({_CRC} % 4 AS INT) AS h FROM o),
 r AS (SELECT h.conv_id, list_concat(coalesce(l.own[1:h], []), h.own[h + 1:]) AS turns, list_concat(coalesce(l.own_words[1:h], []), h.own_words[h + 1:]) AS words FROM h LEFT JOIN o l ON l.conv_id = h.conv_id - h.conv_id % 20),
 p AS MATERIALIZED (SELECT conv_id, d, sha256(array_to_string(turns[1:d], '')) AS key, CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
 n AS MATERIALIZED (SELECT key, min(up) AS up, min(d) AS depth, min(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256 FROM p GROUP BY 1),
 c AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
 b AS (SELECT a.key, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (c.up IS NULL) AS leaves FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.depth LEFT JOIN c ON c.up = n.key GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN b USING (key) LEFT JOIN c ON c.up = n.key LEFT JOIN n q ON q.key = n.up"""

SQL = {
    "op1_embedding_dedup": OP1,
    "op2_url_filter": OP2,
    "op3_source_mixing": OP3,
    "op7_warc_bundles": OP7,
    "op9_ngram_jaccard": OP9,
    "op12_vector_codes": OP12,
    "op13_conversation_trie": OP13,
}
