"""The adapter views in DuckDB's dialect, used to build oracle SQL.

``with_views(sql, *names)`` prefixes ``sql`` with the CTEs it needs (and the
ones those depend on), so each oracle string runs on the bare driver views.
"""

from __future__ import annotations

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "utt": ((), """SELECT doc_id, concat('docs#wavs/', lang, '/', doc_id) AS audio_unique_name,
       concat('wavs/', lang, '/', doc_id, '.wav') AS audio_file, text, lang AS language, source AS speaker_name,
       n_chars AS text_length, n_chars * 1300 AS audio_length, 22050 AS sample_rate FROM documents"""),
    "listing": ((), "SELECT concat('wavs/', lang, '/', doc_id, '.wav') AS path FROM documents WHERE doc_id % 7 <> 0"),
    "manifest": ((), """SELECT doc_id AS line_no, concat('wavs/', lang, '/', doc_id, '|',
       replace(replace(text, '|', ' '), chr(10), ' '), '|', lang, '|', source) AS line FROM documents"""),
    "clip_len": ((), """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-',
       CAST(round(l_extendedprice * 100) AS BIGINT)) AS clip_id, l_orderkey, l_linenumber,
       concat('spk', l_suppkey) AS speaker_name, concat(l_returnflag, l_linestatus) AS language,
       l_quantity / 2 AS duration_s, CASE WHEN l_discount < 0.02 THEN 'valid' ELSE 'train' END AS split
       FROM lineitem"""),
    "sig": ((), """SELECT user_id AS clip_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, ts,
       CASE WHEN event_type IN ('error', 'click') THEN -1 ELSE 1 END * least(value, CAST(500 AS DOUBLE))
       / CAST(500 AS DOUBLE) AS amp FROM events"""),
    "word_tokens": ((), """SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS pos, w[i] AS word FROM (
       SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (
       SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w
       FROM conversations)) WHERE w[i] <> ''"""),
    "words": (("word_tokens",), """SELECT conv_id, turn, pos, word, start_ch * CAST(0.06 AS DOUBLE) AS start_s,
       (start_ch + length(word)) * CAST(0.06 AS DOUBLE) AS end_s FROM (
       SELECT conv_id, turn, pos, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id
       ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ch FROM word_tokens) w"""),
    "dvec": ((), """SELECT concat('clip#', vec_id) AS clip_key, concat('spk', label) AS name, vec_id,
       CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"""),
    "frames": ((), """SELECT clip_id, frame, CAST(i - 1 AS BIGINT) AS bin, CAST(embedding[i] AS DOUBLE) AS value FROM (
       SELECT CAST(label AS BIGINT) AS clip_id,
       CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding,
       unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""),
    "votes": ((), """SELECT d.source AS client_id, d.doc_id, concat(d.doc_id, '.mp3') AS path, d.text AS sentence,
       d.doc_id % 3 AS up_votes, CAST(coalesce(1 - l.quality, 0) AS BIGINT) AS down_votes,
       d.n_chars / CAST(17 AS DOUBLE) AS duration_s
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "bench": ((), """SELECT lang AS language, doc_id, text AS generated_sentence, n_chars AS sentence_char_length,
       2 + doc_id * 7 % 69 AS target_length, concat('emotion', doc_id % 15) AS emotion,
       concat('industry', doc_id % 9) AS industry, doc_id % 10 = 0 AS use_complex_words,
       'female' AS gender, 'sales_service' AS scenario_type FROM documents"""),
    "synthlog": ((), """SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
       value / 100 AS proc_s, 1 + event_id % 10 AS audio_s FROM events"""),
}


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        for d in VIEW_SQL[n][0]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <views>, <extra> <sql>``; ``extra`` are query-local CTEs, in order."""
    parts = [f"{n} AS ({VIEW_SQL[n][1]})" for n in _closure(names)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    if not parts:
        return sql
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
