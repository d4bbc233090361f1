"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from liftwise.llm.license_scan import PHRASES, REACH, STRIDE, TEMPLATES
from liftwise.llm.secret_scan import BASE_RULES, RULES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


LICENSES = rf"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p(phrase, label) AS ({_values(PHRASES)}),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) AS spot FROM t, p),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY 1),
m(words, label, share) AS ({_values(TEMPLATES)}),
tm AS (SELECT list_distinct(string_split(words, ' ')) AS own, label, CAST(share AS DOUBLE) AS share FROM m),
b AS (SELECT doc_id, list_distinct(w[k + 1:k + {STRIDE + REACH}]) AS held FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS k FROM t)),
hit AS (SELECT doc_id, label, len(list_intersect(held, own))::DOUBLE / len(own) AS part, share, len(own) AS size FROM b, tm),
more AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(part) AS score FROM hit WHERE round(part * size) >= ceil(round(share * size, 9)) GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
 array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
 greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0 END, coalesce(score, 0)) AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""

NEAR_TEXT = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM t LEFT JOIN n USING (doc_id) JOIN least ON x = t.doc_id"""


def sharding(shards: list[str], size: int) -> str:
    """Slots are claimed in turns by a recursion with one step per slot."""
    names = ", ".join(f"'{s}'" for s in shards)

    def number(part: str) -> str:
        return f"('0x' || substr(md5(name || chr(1) || '{part}'), 1, 16))::UBIGINT"

    return f"""
WITH RECURSIVE shards AS (SELECT i, [{names}][i + 1] AS name FROM range({len(shards)}) r(i)),
prefs AS (SELECT list(({number('offset')} % {size})::BIGINT ORDER BY i) AS a, list(({number('skip')} % {size - 1} + 1)::BIGINT ORDER BY i) AS s FROM shards),
fill(step, free, spots, slot, owner) AS (
  SELECT 0::BIGINT, list_transform(range({size}), lambda x: true), a, NULL::BIGINT, NULL::BIGINT FROM prefs
  UNION ALL
  SELECT step + 1, list_concat(free[1:pick], [false], free[pick + 2:{size}]), list_concat(spots[1:turn], [pick], spots[turn + 2:{len(shards)}]), pick, turn
  FROM (SELECT step, free, spots, turn, list_filter(list_transform(range({size}), lambda j: (spots[turn + 1] + j * s[turn + 1]) % {size}), lambda x: free[x + 1])[1] AS pick
        FROM (SELECT step, free, spots, step % {len(shards)} AS turn, s FROM fill, prefs WHERE step < {size})))
SELECT d.doc_id, p.slot, [{names}][f.owner + 1] AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT) % {size} AS slot FROM documents) p
JOIN documents d ON d.doc_id = p.doc_id JOIN (SELECT slot, owner FROM fill WHERE slot IS NOT NULL) f ON f.slot = p.slot"""


def _rule_rows() -> str:
    """(ord, kind, pattern, group, least); the value part is the last plain group of a pattern that marks one."""
    rows = []
    for i, rule in enumerate(RULES):
        pattern = rule.pattern.replace("(?<value>", "(")
        rows.append((i, rule.kind, pattern.replace("'", "''"), int("(?<value>" in rule.pattern), rule.least))
    return _values(rows)


SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
r(ord, kind, pattern, grp, least) AS ({_rule_rows()}),
m AS (SELECT rid, ord, kind, pattern, grp, least, regexp_extract_all(x, pattern) AS ms, string_split_regex(x, pattern) AS gaps FROM t, r),
e AS (SELECT rid, ord, kind, pattern, grp, least, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS hit, unnest(gaps[1:len(ms)]) AS gap FROM m),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, ord ORDER BY i) AS fin FROM e),
k AS (SELECT rid, ord, kind, (fin - length(hit))::BIGINT AS start, concat_ws(':', kind, (fin - length(hit))::BIGINT, fin::BIGINT) AS span FROM p
  WHERE length(CASE WHEN grp > 0 THEN regexp_extract(hit, pattern, 1) ELSE hit END) >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM k GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)"""

#: CRC-32 of a column's ASCII text, from its table of 256 remainders (polynomial EDB88320).
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(256) r(i))"""
_CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _part(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", f"({n_chars})", "text")) + ")"


MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("n_chars")} AS leaf,
  {_leaf("CASE WHEN " + _CRC.format("doc_id::VARCHAR") + " % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END")} AS now FROM documents, {_CRC_TABLE} c),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv(tree, lev, idx, h, n) AS (SELECT tree, 0, idx, leaf, n FROM o UNION ALL
  SELECT tree, lev + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, lev, idx // 2),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
top(lev, idx, h, n) AS (SELECT 0, idx, h, n FROM s UNION ALL
  SELECT lev + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lev, idx // 2),
up(tree, leaf_idx, lev, idx, n, now, proof) AS (SELECT tree, idx, 0, idx, n, now, '' FROM o UNION ALL
  SELECT u.tree, u.leaf_idx, u.lev + 1, u.idx // 2, (u.n + 1) // 2, sha256(CASE WHEN u.idx % 2 = 1 THEN b.h || u.now ELSE u.now || coalesce(b.h, '') END), u.proof || coalesce(b.h, '')
  FROM up u LEFT JOIN lv b ON b.tree = u.tree AND b.lev = u.lev AND b.idx = xor(u.idx, 1) WHERE u.n > 1),
over(tree, leaf_idx, lev, idx, n, now, proof) AS (SELECT u.tree, u.leaf_idx, 0, s.idx, s.n, u.now, u.proof FROM up u JOIN s ON s.tree = u.tree WHERE u.n = 1 UNION ALL
  SELECT u.tree, u.leaf_idx, u.lev + 1, u.idx // 2, (u.n + 1) // 2, sha256(CASE WHEN u.idx % 2 = 1 THEN b.h || u.now ELSE u.now || coalesce(b.h, '') END), u.proof || coalesce(b.h, '')
  FROM over u LEFT JOIN top b ON b.lev = u.lev AND b.idx = xor(u.idx, 1) WHERE u.n > 1)
SELECT o.doc_id, o.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.now AS folded_root, f.now = r.h AS verified
FROM o JOIN s ON s.tree = o.tree JOIN (SELECT h FROM top WHERE n = 1) r ON true JOIN over f ON f.tree = o.tree AND f.leaf_idx = o.idx AND f.n = 1"""

NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, o.rid AS other, list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * o.c[i]))::BIGINT AS score
  FROM v a JOIN v o ON a.rid <> o.rid AND len(a.c) = len(o.c) WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10"""
