"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from voxframe.llm.quality import EDGES, STOP_WORDS

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_EDGES = EDGES.replace("'", "''")
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP10 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, unnest(generate_series(1, len(words) - 2)) AS p, words FROM t WHERE len(words) >= 3),
n AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p], words[p + 1], words[p + 2]) AS c FROM g),
rep AS (SELECT rid, count(DISTINCT q) AS n_repeat
        FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM n WHERE c >= 2) GROUP BY rid),
f AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda w: trim(lower(w), '{_EDGES}') IN ({_STOPS}))) AS n_stop_words,
         length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals,
         length(text) - length(replace(text, '!!', '!')) AS n_shouts
  FROM t LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
       AND (n_words = 0 OR word_chars BETWEEN 2 * n_words AND 15 * n_words)
       AND (n_words = 0 OR 4 * n_symbols <= n_words)
       AND (n_words = 0 OR 25 * n_stop_words >= n_words)
       AND (word_chars = 0 OR 10 * n_letters >= 6 * word_chars)
       AND (n_letters = 0 OR 10 * n_capitals <= 4 * n_letters)
       AND (n_words = 0 OR 4 * n_shouts <= n_words)
       AND (n_lines = 0 OR 10 * n_dup_lines <= 4 * n_lines) AS kept
FROM v
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w,
             1.5 * sum(source_size) OVER () AS budget FROM s),
-- a level of water is right when what the capped and the open take at it is the budget
l AS (SELECT a.source, (any_value(a.budget) - sum(CASE WHEN 2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w
                 OR (2.0 * b.source_size / b.w = 2.0 * a.source_size / a.w AND b.r < a.r)
                 THEN 2.0 * b.source_size ELSE 0.0 END))
             / sum(CASE WHEN 2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w
                 OR (2.0 * b.source_size / b.w = 2.0 * a.source_size / a.w AND b.r < a.r)
                 THEN 0.0 ELSE b.w END) AS level, any_value(2.0 * a.source_size / a.w) AS ratio
      FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM w) a,
           (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM w) b GROUP BY a.source),
f AS (SELECT max(level) AS level FROM l WHERE ratio >= level),
t AS (SELECT source, source_size,
             CASE WHEN f.level IS NULL THEN 2.0 * source_size ELSE least(2.0 * source_size, f.level * w) END AS target
      FROM w, f),
x AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

_SAID = "'</s>[INST] ok [/INST]'"


def _escaped(col: str) -> str:
    from voxframe.llm.chat import CONTROL

    out = f"replace({col}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP9 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
o AS (SELECT *, row_number() OVER w AS nr, lag(role) OVER w IS NOT DISTINCT FROM role AS more
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text)),
a AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr) AS told,
             coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '') AS loss,
             sum(length({_escaped('text')}) + CASE WHEN more THEN 11 ELSE 12 + length({_escaped('role')}) + 10 + 10 END) AS chars
      FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM a
"""

_ROUND = """
p{n} AS (SELECT rid, arg_min(c, (far, c)) AS c, min(far) AS far
         FROM (SELECT v.rid, k.c, sum((v.x - k.x) * (v.x - k.x)) AS far FROM v JOIN k{n} k USING (d) GROUP BY v.rid, k.c)
         GROUP BY rid)"""

_MOVED = """,
m{n} AS (SELECT p.c, v.d, sum(v.x) AS s, count(*) AS n FROM p{n} p JOIN v USING (rid) GROUP BY p.c, v.d),
k{next} AS (SELECT k.c, k.d, CASE WHEN n IS NULL THEN k.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
            FROM k{n} k LEFT JOIN m{n} m ON m.c = k.c AND m.d = k.d),"""

OP11 = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
           WHERE len(embedding) = 64
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
v AS MATERIALIZED (SELECT rid, d, CAST(floor(256 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x
                   FROM (SELECT rid, embedding, unnest(generate_series(1, 64)) AS d FROM e)),
h AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM e),
k0 AS (SELECT h.c, v.d, v.x FROM h JOIN v USING (rid) WHERE h.c < 40),""" + "".join(
    _ROUND.format(n=n) + _MOVED.format(n=n, next=n + 1) for n in range(5)) + _ROUND.format(n=5) + """
SELECT e.vec_id, CAST(p.c AS INTEGER) AS cluster, CAST(p.far AS BIGINT) AS distance,
       CAST(sum(p.far) OVER (PARTITION BY p.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(p.far) OVER () AS BIGINT) AS inertia, s.sha AS centroid_sha256
FROM p5 p JOIN e USING (rid)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM k5 GROUP BY c) s USING (c)
"""

OP12 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id ASC NULLS LAST)
"""

ORACLES = {"op4_mixing": OP4, "op9_chat": OP9, "op10_quality": OP10, "op11_centroids": OP11, "op12_exact_dedup": OP12}
