"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from taskloom.llm.queries import MIXTURE, TOPICS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _values(shares: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in shares.items())


def _op1() -> str:
    """Raking in a recursive query, for all shares to keep at once: each step scales one margin after the other by window sums, then caps the cells."""
    m = MIXTURE
    named = {n: ", ".join(f"'{k}'" for k in s if k != "*") for n, s in m.targets.items()}
    cell = {n: f"CASE WHEN {n} IN ({named[n]}) THEN {n} ELSE '*' END" for n in m.targets}
    # What a column's targets don't name keeps its share; a category without tokens leaves its share to the others.
    goals = "".join(
        f", h_{n} AS (SELECT c_{n} AS k, sum(t) / (SELECT sum(t) FROM cells) AS had FROM cells GROUP BY 1)"
        f", o_{n} AS (SELECT {'0' if '*' in s else f"coalesce((SELECT had FROM h_{n} WHERE k = '*'), 0)"} AS rest)"
        f", t_{n} AS (SELECT k, v / sum(v) OVER () * (1 - rest) AS v FROM (VALUES {_values(s)}) AS x(k, v), o_{n} WHERE k IN (SELECT k FROM h_{n} WHERE had > 0)"
        f" UNION ALL SELECT '*', rest FROM o_{n} WHERE rest > 0)"
        for n, s in m.targets.items()
    )
    inner = "r"
    for n in m.targets:
        inner = (
            f"(SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY j, c_{n}) > 0 THEN w * coalesce((SELECT v FROM t_{n} WHERE k = c_{n}), 0)"
            f" / sum(w) OVER (PARTITION BY j, c_{n}) ELSE 0 END AS w) FROM {inner})"
        )
    miss = " UNION ALL ".join(f"SELECT j, abs(sum(w) - coalesce((SELECT v FROM t_{n} WHERE k = c_{n}), 0)) AS e FROM f GROUP BY j, c_{n}" for n in m.targets)
    cs = ", ".join(f"c_{n}" for n in m.targets)
    told = "'prose'"
    for name, pattern in reversed(TOPICS.items()):
        told = f"CASE WHEN regexp_matches(coalesce(text, ''), '{pattern}') THEN '{name}' ELSE {told} END"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, {told} AS topic,
    CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents),
e AS (SELECT *, {", ".join(f"{c} AS c_{n}" for n, c in cell.items())} FROM d),
cells AS (SELECT {", ".join(f"c_{n}" for n in m.targets)}, CAST(sum(n_tokens) AS DOUBLE) AS t FROM e GROUP BY ALL)
{goals},
r AS (
  SELECT 0 AS i, j, {m.keep} * pow({m.fall}, j) AS keep, cells.*, t / (SELECT sum(t) FROM cells) AS w, 1.0::DOUBLE AS q FROM cells, range({m.tries}) AS x(j)
  UNION ALL
  SELECT i + 1, j, keep, {", ".join(f"c_{n}" for n in m.targets)}, t, least(w * q, cap), CASE WHEN least(w * q, cap) > 0 THEN w * q / least(w * q, cap) ELSE 1 END
  FROM (SELECT *, t / (SELECT sum(t) FROM cells) / keep AS cap FROM {inner}) WHERE i < {m.sweeps}),
f AS (SELECT *, CASE WHEN t > 0 THEN w * (SELECT sum(t) FROM cells) / t ELSE 0 END AS ratio FROM r WHERE i = {m.sweeps}),
g AS (SELECT j, max(e) AS e FROM ({miss}) GROUP BY j),
b AS (SELECT coalesce((SELECT min(j) FROM g WHERE e <= {m.tolerance!r}), (SELECT arg_min(j, e) FROM g)) AS j),
f2 AS (SELECT f.*, w * keep * (SELECT sum(t) FROM cells) AS want FROM f JOIN b USING (j)),
-- How many tokens a cell gives up to each range of the draw; the nearest to what its weight calls for stands.
u AS (SELECT *, CAST(('0x' || md5('{m.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12]) AS BIGINT) / {16**12}.0::DOUBLE AS u FROM e),
v AS (SELECT {cs}, CAST(floor(u * {m.bins}) AS BIGINT) + 1 AS k, CAST(sum(n_tokens) AS DOUBLE) AS n FROM u GROUP BY ALL),
y AS (SELECT {cs}, k, sum(n) OVER (PARTITION BY {cs} ORDER BY k) AS got FROM v UNION ALL SELECT {cs}, 0, 0 FROM cells),
p AS (SELECT {cs}, any_value(ratio) AS ratio, arg_min(k, struct_pack(a := abs(got - want), b := k)) / {m.bins}.0::DOUBLE AS p FROM y JOIN f2 USING ({cs}) GROUP BY {cs})
SELECT doc_id, source, lang, topic, n_tokens, round(ratio, 6) AS weight, round(p, 6) AS probability FROM u JOIN p USING ({cs}) WHERE u < p
"""


def _leads(count: int) -> str:
    """The words from here on, joined by spaces; null where there are fewer."""
    return " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER w" for j in range(1, count)]])


_SPLIT = rf"""
t AS (SELECT doc_id, {{text}} AS text FROM documents),
d AS (SELECT doc_id, {_WORDS} AS ws FROM t),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d)"""

#: Links by shared shingles of every pair, then all that each document reaches.
_OP3 = f"""
WITH RECURSIVE {_SPLIT.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, {_leads(4)} AS s FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3) WHERE s IS NOT NULL),
n AS (SELECT doc_id, count(s.s) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u),
k AS (SELECT u AS doc_id, count(*) AS n_links FROM e GROUP BY u)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, coalesce(any_value(n_links), 0) AS n_links FROM r JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY doc_id, n
"""

_OP7 = f"""
WITH {_SPLIT.format(text="text")},
g AS (SELECT doc_id, k, {_leads(13)} AS s FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
m AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM g WHERE s IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM m WHERE least < doc_id),
o AS (SELECT doc_id, count(*) AS n_words, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE c.k IS NULL) AS kept
  FROM x LEFT JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

_OP10 = r"""
WITH bits AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) AS x(n))),
c AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT)),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)::BIGINT])), 4294967295::UBIGINT) AS crc,
  md5('17:' || md5(coalesce(text, ''))) AS g, md5('17:' || doc_id) AS d FROM documents, bits),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY g, d) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1) / (2 * n)::DOUBLE, source, d) - 1 AS pos FROM r)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST((pos * 8 + 7) // total AS INTEGER) AS shard, pos - ((pos * 8 + 7) // total) * total // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o
"""

_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_mix_to_targets": _op1(),
    "op2_top_k": _OP2,
    "op3_jaccard_join": _OP3,
    "op7_substring_dedup": _OP7,
    "op10_stratified_shards": _OP10,
}
