"""Alignment and segmentation queries (2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import align as AL
from voxframe.operators import text as TX
from voxframe.plans.registry import oracle, register

ORDER = ["turn", "pos"]
EN_RULES = TX.by_language_rules("en")


def _audio_end(w):
    return w.groupBy("conv_id").agg((F.max("end_s") + 0.5).alias("audio_end"))


def _sents(spark, sf):
    w = V.words(spark, sf)
    s = AL.sentence_table(w, "conv_id", ORDER, "start_s", "end_s", _audio_end(w))
    return s.withColumn("text", TX.to_col(EN_RULES, F.col("text")))


SENT_SQL = f"""x AS (SELECT *, CAST(regexp_matches(word, '[!.?]$') AS INTEGER) AS e,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS word_idx FROM words),
y AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id,
  lag(end_s) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS prev_end,
  lead(start_s) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS next_start FROM x),
ae AS (SELECT conv_id, max(end_s) + 0.5 AS audio_end FROM words GROUP BY 1),
z AS (SELECT y.*, CASE WHEN word_idx = 0 THEN greatest(start_s - 0.2, 0.0) ELSE greatest(start_s - 0.2, (prev_end + start_s) / 2) END AS s0,
  least((end_s + coalesce(next_start, ae.audio_end)) / 2, end_s + 0.2) AS e0 FROM y JOIN ae USING (conv_id)),
st AS (SELECT conv_id, sent_id, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS text,
  arg_min(s0, word_idx) AS start_s, arg_max(e0, word_idx) AS end_s, arg_max(e, word_idx) AS closed FROM z GROUP BY 1, 2),
s AS (SELECT conv_id, sent_id, n_words, {TX.to_sql(EN_RULES, 'text')} AS text, start_s, end_s FROM st WHERE closed = 1)"""


@register("aln_sentences", oracle(f"WITH {SENT_SQL} SELECT conv_id, sent_id, n_words, text FROM s", "words"))
def _aln_sentences(spark, sf):
    return _sents(spark, sf).select("conv_id", "sent_id", "n_words", "text")


@register("aln_boundaries", oracle(f"WITH {SENT_SQL} SELECT conv_id, sent_id, start_s, end_s FROM s", "words",
                                   rnd=("start_s", "end_s")))
def _aln_boundaries(spark, sf):
    return _sents(spark, sf).select("conv_id", "sent_id", "start_s", "end_s")


@register("aln_drop_short", oracle(f"""
WITH {SENT_SQL} SELECT conv_id, sent_id, CAST(floor(end_s * 22050) - floor(start_s * 22050) AS BIGINT) AS n_samples,
  concat('wavs/conv', conv_id, '_', lpad(CAST(sent_id AS VARCHAR), 8, '0'), '.wav') AS audio_file FROM s
WHERE floor(end_s * 22050) - floor(start_s * 22050) >= 22050 / 3""", "words"))
def _aln_drop_short(spark, sf):
    k = AL.keep_long_cuts(_sents(spark, sf), 22050, F.concat(F.lit("conv"), F.col("conv_id")))
    return k.select("conv_id", "sent_id", "n_samples", "audio_file")


@register("aln_total_audio", oracle("SELECT sum(audio_end) AS total_audio_s FROM (SELECT max(end_s) + 0.5 AS audio_end FROM words GROUP BY conv_id)",
                                    "words", rnd=("total_audio_s",)))
def _aln_total_audio(spark, sf):
    return _audio_end(V.words(spark, sf)).agg(F.sum("audio_end").alias("total_audio_s"))


ATT_SQL = """a0 AS (SELECT clip_id, frame, bin AS token, value FROM frames WHERE bin < 16),
am AS (SELECT clip_id, frame, max(value) AS m FROM a0 GROUP BY 1, 2),
ae AS (SELECT a0.clip_id, a0.frame, a0.token, exp(a0.value - am.m) AS e FROM a0 JOIN am USING (clip_id, frame)),
att AS (SELECT clip_id, frame, token, e / sum(e) OVER (PARTITION BY clip_id, frame) AS p FROM ae)"""

DUR_SQL = ATT_SQL + """,
best AS (SELECT clip_id, frame, arg_max(token, (p, -token)) AS token FROM att GROUP BY 1, 2),
cnt AS (SELECT clip_id, token, count(*) AS c FROM best GROUP BY 1, 2),
nfr AS (SELECT clip_id, count(*) AS n_frames FROM best GROUP BY 1),
tk AS (SELECT clip_id, n_frames, unnest(range(0, 16)) AS token FROM nfr),
d0 AS (SELECT tk.clip_id, tk.token, tk.n_frames, coalesce(cnt.c, 1) AS dur FROM tk LEFT JOIN cnt USING (clip_id, token)),
d1 AS (SELECT *, sum(dur) OVER (PARTITION BY clip_id) - n_frames AS extra,
  row_number() OVER (PARTITION BY clip_id ORDER BY dur DESC, token) AS rk FROM d0),
durs AS (SELECT clip_id, token, CAST(CASE WHEN rk <= extra THEN dur - 1 ELSE dur END AS BIGINT) AS dur FROM d1)"""


def _att(spark, sf):
    return AL.attention(V.frames(spark, sf), 16)


def _durs(spark, sf):
    return AL.durations_from_attention(_att(spark, sf), 16)


@register("aln_durations", oracle(f"WITH {DUR_SQL} SELECT * FROM durs", "frames"))
def _aln_durations(spark, sf):
    return _durs(spark, sf)


@register("aln_round_dur", oracle("""
SELECT clip_id, frame, bin, round_even(CASE WHEN (exp(value * 10) - 1) < 1 THEN 1.0 ELSE exp(value * 10) - 1 END, 0) AS dur
FROM frames WHERE bin < 16""", "frames", rnd=("dur",)))
def _aln_round_dur(spark, sf):
    f = V.frames(spark, sf).where(F.col("bin") < 16)
    return f.select("clip_id", "frame", "bin", AL.round_durations(F.col("value") * 10).alias("dur"))


SPAN_SQL = """sp AS (SELECT clip_id, token, dur, sum(dur) OVER (PARTITION BY clip_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS "end"
  FROM durs), sp2 AS (SELECT *, "end" - dur AS start FROM sp)"""


@register("aln_avg_over_dur", oracle(f"""
WITH {DUR_SQL}, {SPAN_SQL},
v AS (SELECT clip_id, frame, CASE WHEN value > 0 THEN value ELSE 0.0 END AS v FROM frames WHERE bin = 16),
g AS (SELECT sp2.clip_id, sp2.token, sum(v.v) AS s, count(CASE WHEN v.v <> 0 THEN 1 END) AS n FROM sp2
  JOIN v ON v.clip_id = sp2.clip_id AND v.frame >= sp2.start AND v.frame <= sp2."end" - 1 WHERE sp2.dur > 0 GROUP BY 1, 2)
SELECT sp2.clip_id, sp2.token, CASE WHEN coalesce(g.n, 0) = 0 THEN 0.0 ELSE g.s / g.n END AS avg
FROM sp2 LEFT JOIN g USING (clip_id, token)""", "frames", rnd=("avg",)))
def _aln_avg_over_dur(spark, sf):
    f = V.frames(spark, sf).where(F.col("bin") == 16)
    vals = f.select("clip_id", "frame", F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(0.0)).alias("v"))
    return AL.avg_over_durations(vals, _durs(spark, sf))


@register("aln_expand", oracle(f"""
WITH {DUR_SQL}, {SPAN_SQL}
SELECT clip_id, token, unnest(range(CAST(start AS BIGINT), CAST("end" AS BIGINT))) AS frame FROM sp2 WHERE dur > 0""", "frames"))
def _aln_expand(spark, sf):
    return AL.expand(_durs(spark, sf))


@register("aln_mask", oracle("""
WITH l AS (SELECT clip_id, count(DISTINCT frame) AS n FROM frames GROUP BY 1)
SELECT clip_id, unnest(range(0, (SELECT max(n) FROM l))) AS idx, NULL AS valid FROM l""".replace(
    "NULL AS valid FROM l", "n FROM l").join(["SELECT clip_id, idx, idx < n AS valid FROM (", ")"]), "frames"))
def _aln_mask(spark, sf):
    lens = V.frames(spark, sf).groupBy("clip_id").agg(F.count_distinct("frame").alias("n"))
    return AL.length_mask(lens)


@register("aln_diagonal_score", oracle(f"""
WITH {ATT_SQL}, m AS (SELECT clip_id, token, max(p) AS m FROM att GROUP BY 1, 2)
SELECT avg(s) AS diagonal_score FROM (SELECT clip_id, avg(m) AS s FROM m GROUP BY 1)""", "frames", rnd=("diagonal_score",)))
def _aln_diagonal_score(spark, sf):
    return AL.diagonal_score(_att(spark, sf))


@register("aln_entropy", oracle(f"""
WITH {ATT_SQL}, h AS (SELECT clip_id, frame, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM att GROUP BY 1, 2)
SELECT avg(h) / ln(16) AS entropy FROM h""", "frames", rnd=("entropy",)))
def _aln_entropy(spark, sf):
    return AL.entropy_score(_att(spark, sf), 16)


@register("aln_guided_score", oracle(f"""
WITH {ATT_SQL}, x AS (SELECT *, max(frame) OVER (PARTITION BY clip_id) + 1 AS nf, max(token) OVER (PARTITION BY clip_id) + 1 AS nt FROM att)
SELECT avg((1.0 - exp(-pow(token / nt - frame / nf, 2) / (2 * 0.4 * 0.4))) * p) AS guided_score FROM x""", "frames",
                                     rnd=("guided_score",)))
def _aln_guided_score(spark, sf):
    return AL.guided_score(_att(spark, sf))


def _gap_input(spark, sf):
    w = V.words(spark, sf)
    x = AL.sentences(w, "conv_id", ORDER)
    x = x.select("conv_id", "word_idx", F.when((F.col("pos") % 3 != 1) | (F.col("word_idx") == 0),
                                               F.floor(F.col("start_s") * 100)).cast("long").alias("a"))
    tot = _audio_end(w).select("conv_id", F.floor(F.col("audio_end") * 100).cast("long").alias("orig_len"))
    return x, tot


@register("aln_fill_gaps", oracle("""
WITH x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS word_idx,
  CASE WHEN pos % 3 <> 1 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) = 1 THEN CAST(floor(start_s * 100) AS BIGINT) END AS a
  FROM words),
t AS (SELECT conv_id, CAST(floor((max(end_s) + 0.5) * 100) AS BIGINT) AS orig_len FROM words GROUP BY 1),
y AS (SELECT x.*, t.orig_len, count(*) OVER (PARTITION BY conv_id) AS cnt,
  max(CASE WHEN a IS NOT NULL THEN word_idx END) OVER (PARTITION BY conv_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
  last_value(a IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
  min(CASE WHEN a IS NOT NULL THEN word_idx END) OVER (PARTITION BY conv_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni,
  first_value(a IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv
  FROM x JOIN t USING (conv_id))
SELECT conv_id, word_idx, CAST(CASE WHEN a IS NOT NULL THEN a ELSE
  floor((word_idx - pi) * (coalesce(nv, orig_len) - pv) / (coalesce(ni, cnt) - pi)) + pv END AS BIGINT) AS aligned FROM y""", "words"))
def _aln_fill_gaps(spark, sf):
    x, tot = _gap_input(spark, sf)
    return AL.fill_gaps(x, "conv_id", "word_idx", "a", tot)


@register("aln_redact", oracle("""
WITH t AS (SELECT conv_id, turn, string_agg(CASE WHEN pos % 5 = 2 THEN concat('[', word, ']') ELSE word END, ' ' ORDER BY pos) AS tx
  FROM words GROUP BY 1, 2),
p AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(tx, '\\[|\\]'), lambda x: length(x)) AS l FROM t),
iv AS (SELECT conv_id, turn, i, l[i] AS len, coalesce(list_sum(l[1:i - 1]), 0) AS s FROM (
  SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM p) WHERE i % 2 = 1)
SELECT conv_id, turn, count(*) AS n_intervals, sum(10 * (greatest(0, s + len - 1) - s)) AS kept_samples FROM iv GROUP BY 1, 2""",
                              "words"))
def _aln_redact(spark, sf):
    w = V.words(spark, sf)
    tok = F.when(F.col("pos") % 5 == 2, F.concat(F.lit("["), "word", F.lit("]"))).otherwise(F.col("word"))
    t = w.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", tok.alias("t")))).alias("_a"))
    t = t.select("conv_id", "turn", F.array_join(F.transform("_a", lambda s: s["t"]), " ").alias("tx"))
    iv = t.select("conv_id", "turn", F.explode(AL.redaction_spans(F.col("tx"))).alias("iv"))
    return iv.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_intervals"),
                                             F.sum(10 * (F.col("iv.stop") - F.col("iv.start"))).cast("long").alias("kept_samples"))
