"""Text-benchmark analytics queries (2.11, first half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import analyze as AN
from voxframe.operators.select import flt_votes, word_count
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import U, WC

DIMS = ["language", "emotion", "industry", "use_complex_words"]
METRICS = {"chars": "sentence_char_length", "words": "actual_word_count"}
STAT_COLS = ["mean", "std", "min"] + [AN.pname(p) for p in AN.PERCENTILES] + ["max"]
B_SQL = f"SELECT *, {WC('generated_sentence')} AS actual_word_count FROM bench"


def _bench(spark, sf):
    b = V.bench(spark, sf)
    return b.withColumn("actual_word_count", word_count("generated_sentence"))


def desc_sql(c: str, prefix: str = "") -> str:
    parts = [f"count({c}) AS {prefix}count", f"avg({c}) AS {prefix}mean", f"stddev_samp({c}) AS {prefix}std",
             f"CAST(min({c}) AS DOUBLE) AS {prefix}min"]
    parts += [f"quantile_cont({c}, {p}) AS {prefix}{AN.pname(p)}" for p in AN.PERCENTILES]
    parts.append(f"CAST(max({c}) AS DOUBLE) AS {prefix}max")
    return ", ".join(parts)


LONG_SQL = ("x AS (SELECT language, emotion, industry, use_complex_words, 'chars' AS metric, sentence_char_length AS value FROM b "
            "UNION ALL SELECT language, emotion, industry, use_complex_words, 'words', actual_word_count FROM b)")


@register("anl_totals", oracle(f"""
WITH b AS ({B_SQL}) SELECT count(*) AS total_sentences, sum(actual_word_count) AS total_words,
  sum(sentence_char_length) AS total_characters, sum(actual_word_count) / 8400.0 AS estimated_speech_hours FROM b""",
                               "bench", rnd=("estimated_speech_hours",)))
def _anl_totals(spark, sf):
    return AN.totals(_bench(spark, sf), "actual_word_count", "sentence_char_length")


@register("anl_describe", oracle(f"""
WITH b AS ({B_SQL}), {LONG_SQL}
SELECT metric, {desc_sql('value')} FROM x GROUP BY metric""", "bench", rnd=STAT_COLS))
def _anl_describe(spark, sf):
    return AN.describe(_bench(spark, sf), METRICS)


DESC_BY_SQL = f"""
WITH b AS ({B_SQL}), {LONG_SQL},
d AS (SELECT metric, {desc_sql('value')},
  CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(emotion) = 0 THEN 'emotion'
    WHEN grouping(industry) = 0 THEN 'industry' WHEN grouping(use_complex_words) = 0 THEN 'use_complex_words' ELSE 'overall' END AS dimension,
  CASE WHEN grouping(language) = 0 THEN CAST(language AS VARCHAR) WHEN grouping(emotion) = 0 THEN CAST(emotion AS VARCHAR)
    WHEN grouping(industry) = 0 THEN CAST(industry AS VARCHAR) WHEN grouping(use_complex_words) = 0 THEN CAST(use_complex_words AS VARCHAR)
    END AS group_value
FROM x GROUP BY GROUPING SETS ((metric, language), (metric, emotion), (metric, industry), (metric, use_complex_words), (metric)))"""


@register("anl_describe_by", oracle(DESC_BY_SQL + "\nSELECT * FROM d", "bench", rnd=STAT_COLS))
def _anl_describe_by(spark, sf):
    return AN.describe_by(_bench(spark, sf), METRICS, DIMS)


@register("anl_length_accuracy", oracle(f"""
WITH b AS ({B_SQL}), d AS (SELECT actual_word_count - target_length AS d FROM b)
SELECT avg(d) AS mean_difference, stddev_samp(d) AS std_difference, avg(CAST(abs(d) <= 3 AS DOUBLE)) AS accuracy_rate,
  sum(CAST(abs(d) <= 3 AS BIGINT)) AS accuracy_count, {desc_sql('d', 'diff_')} FROM d""", "bench",
                                        rnd=["mean_difference", "std_difference", "accuracy_rate"] + ["diff_" + c for c in STAT_COLS]))
def _anl_length_accuracy(spark, sf):
    return AN.length_accuracy(_bench(spark, sf), "actual_word_count", "target_length")


@register("anl_corr", oracle(f"""
WITH b AS ({B_SQL}) SELECT corr(sentence_char_length, actual_word_count) AS char_length_vs_word_count,
  corr(target_length, actual_word_count) AS target_vs_actual_length FROM b""", "bench",
                             rnd=("char_length_vs_word_count", "target_vs_actual_length")))
def _anl_corr(spark, sf):
    return AN.correlations(_bench(spark, sf), "sentence_char_length", "actual_word_count", "target_length")


COUNT_COLS = ["language", "emotion", "industry", "use_complex_words", "scenario_type", "gender"]
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM bench" for c in COUNT_COLS)


@register("anl_counts", oracle(f"SELECT \"column\", value, count(*) AS n FROM ({COUNTS_SQL}) GROUP BY ALL", "bench"))
def _anl_counts(spark, sf):
    return AN.value_counts(V.bench(spark, sf), COUNT_COLS)


@register("anl_top3", oracle(f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (
  SELECT "column", value, count(*) AS n FROM ({COUNTS_SQL}) GROUP BY ALL)) WHERE rank <= 3""", "bench"))
def _anl_top3(spark, sf):
    return AN.top_values(AN.value_counts(V.bench(spark, sf), COUNT_COLS), 3)


@register("anl_summary", oracle(f"""
WITH b AS ({B_SQL}), {LONG_SQL}, s AS (SELECT metric, avg(value) AS mean, quantile_cont(value, 0.5) AS med, stddev_samp(value) AS std
  FROM x GROUP BY metric),
t AS (SELECT CAST(count(*) AS DOUBLE) AS total_sentences, CAST(sum(actual_word_count) AS DOUBLE) AS total_words,
  CAST(sum(sentence_char_length) AS DOUBLE) AS total_characters, round(sum(actual_word_count) / 8400.0, 4) AS estimated_speech_hours,
  round(avg(CAST(abs(actual_word_count - target_length) <= 3 AS DOUBLE)), 4) AS target_accuracy_rate,
  round(corr(sentence_char_length, actual_word_count), 4) AS char_word_correlation FROM b),
w AS (SELECT t.*, round(c.mean, 2) AS mean_char_length, round(c.med, 2) AS median_char_length, round(c.std, 2) AS std_char_length,
  round(wd.mean, 2) AS mean_word_count, round(wd.med, 2) AS median_word_count, round(wd.std, 2) AS std_word_count
  FROM t, (SELECT * FROM s WHERE metric = 'chars') c, (SELECT * FROM s WHERE metric = 'words') wd)
SELECT metric, value FROM (UNPIVOT w ON total_sentences, total_words, total_characters, estimated_speech_hours, mean_char_length,
  median_char_length, std_char_length, mean_word_count, median_word_count, std_word_count, target_accuracy_rate,
  char_word_correlation INTO NAME metric VALUE value)""", "bench", rnd=("value",)))
def _anl_summary(spark, sf):
    b = _bench(spark, sf)
    return AN.summary_table(spark, AN.totals(b, "actual_word_count", "sentence_char_length"), AN.describe(b, METRICS),
                            AN.length_accuracy(b, "actual_word_count", "target_length"),
                            AN.correlations(b, "sentence_char_length", "actual_word_count", "target_length"))


PSTATS = ["min"] + [AN.pname(p) for p in AN.PERCENTILES] + ["max"]


@register("anl_percentiles_long", oracle(DESC_BY_SQL + f"""
, l AS (SELECT CASE WHEN metric = 'chars' THEN 'character_length' ELSE 'word_count' END AS category, 'language' AS subcategory,
  group_value AS item, {', '.join(PSTATS)} FROM d WHERE dimension = 'language')
SELECT category, subcategory, item, percentile, value FROM (UNPIVOT l ON {', '.join(PSTATS)} INTO NAME percentile VALUE value)""",
                                         "bench", rnd=("value",)))
def _anl_percentiles_long(spark, sf):
    return AN.percentiles_long(AN.describe_by(_bench(spark, sf), METRICS, DIMS), "language")


def _list(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


@register("anl_params", oracle(f"""
WITH b AS ({B_SQL}), p AS (SELECT language, CAST(floor(floor(2100 / avg(actual_word_count)) / 25) AS BIGINT) + 1 AS calls
  FROM b GROUP BY 1),
i AS (SELECT language, unnest(range(0, calls * 25)) AS i FROM p),
k AS (SELECT language, i, concat_ws(':', language, CAST(i AS VARCHAR)) AS k FROM i),
z AS (SELECT *, sqrt(-2.0 * ln(1.0 - {U(0, 'k')})) * cos(2.0 * 3.141592653589793 * {U(1, 'k')}) AS z FROM k)
SELECT language, i, greatest(2, least(70, CAST(trunc(25.0 + 15.0 * z) AS BIGINT))) AS target_length,
  list_element({_list(AN.EMOTIONS)}, CAST(floor({U(2, 'k')} * 15) + 1 AS INTEGER)) AS emotion,
  list_element({_list(AN.INDUSTRIES)}, CAST(floor({U(3, 'k')} * 9) + 1 AS INTEGER)) AS industry,
  {U(4, 'k')} < 0.1 AS use_complex,
  list_element({_list(AN.CUSTOMER_TYPES)}, CAST(floor({U(5, 'k')} * 3) + 1 AS INTEGER)) AS customer_type FROM z""", "bench"))
def _anl_params(spark, sf):
    b = _bench(spark, sf)
    plan = b.groupBy("language").agg(F.avg("actual_word_count").alias("avg_len")).withColumn(
        "calls", (F.floor(F.floor(F.lit(2100.0) / F.col("avg_len")) / 25) + 1).cast("long"))
    return AN.generation_params(spark, plan, "language", "calls")


RESP_SQL = ("SELECT doc_id, concat('```json', chr(10), '{\"sentences\": ', to_json(string_split(text, chr(10))), "
            "CASE WHEN doc_id % 9 = 0 THEN '' ELSE '}' END, chr(10), '```') AS resp FROM documents")


@register("anl_parse_generated", oracle(f"""
WITH r AS ({RESP_SQL}),
b AS (SELECT doc_id, regexp_extract(trim(regexp_replace(resp, '```(json|plaintext|text)?', '', 'g')), '(?s)\\{{.*\\}}', 0) AS body FROM r),
p AS (SELECT doc_id, from_json(body, '{{"sentences": ["VARCHAR"]}}').sentences AS s FROM b WHERE body <> '' AND json_valid(body)),
e AS (SELECT doc_id, unnest(range(0, len(s))) AS i, s FROM p)
SELECT doc_id, i, s[i + 1] AS sentence, {WC('s[i + 1]')} AS actual_word_count, CAST(length(s[i + 1]) AS BIGINT) AS sentence_char_length
FROM e WHERE s[i + 1] IS NOT NULL AND trim(regexp_replace(s[i + 1], '\\s+', ' ', 'g')) <> ''"""))
def _anl_parse_generated(spark, sf):
    d = V.table(spark, sf, "documents")
    resp = d.select("doc_id", F.concat(F.lit('```json\n{"sentences": '), F.to_json(F.split("text", "\n")),
                                       F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.lit("}")),
                                       F.lit("\n```")).alias("resp"))
    x = AN.parse_generated(resp, "resp", ["doc_id"])
    return x.select("doc_id", "i", "sentence", word_count("sentence").alias("actual_word_count"),
                    F.length("sentence").cast("long").alias("sentence_char_length"))


@register("anl_speech_rate", oracle(f"""
SELECT client_id, avg({WC('sentence')} / duration_s * 60) AS speech_rate FROM votes WHERE down_votes = 0 AND up_votes > 0
GROUP BY 1""", "votes", rnd=("speech_rate",)))
def _anl_speech_rate(spark, sf):
    v = flt_votes(V.votes(spark, sf))
    return v.groupBy("client_id").agg(F.avg(word_count("sentence") / F.col("duration_s") * 60).alias("speech_rate"))


@register("anl_avg_total_hours", oracle("""
SELECT client_id, avg(duration_s) AS avg_duration, avg(duration_s) * count(*) / 3600.0 AS total_hours FROM votes
WHERE down_votes = 0 AND up_votes > 0 GROUP BY 1""", "votes", rnd=("avg_duration", "total_hours")))
def _anl_avg_total_hours(spark, sf):
    v = flt_votes(V.votes(spark, sf))
    return v.groupBy("client_id").agg(F.avg("duration_s").alias("avg_duration"),
                                      (F.avg("duration_s") * F.count(F.lit(1)) / 3600.0).alias("total_hours"))


@register("anl_files_per_lang", oracle("""
SELECT split_part(concat(language, '_', split, '_', clip_id, '.wav'), '_', 1) AS lang, count(*) AS n FROM clip_len GROUP BY 1""",
                                       "clip_len"))
def _anl_files_per_lang(spark, sf):
    c = V.clip_len(spark, sf).select(F.concat_ws("_", "language", "split", F.concat("clip_id", F.lit(".wav"))).alias("f"))
    return c.groupBy(F.split_part("f", F.lit("_"), F.lit(1)).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
