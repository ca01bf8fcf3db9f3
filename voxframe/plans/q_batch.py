"""Batching (2.5) and segments (2.5) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.functions.core import global_position
from voxframe.operators import batch as BT
from voxframe.operators import segment as SG
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import H, U

KEY = "audio_unique_name"


@register("bat_perfect", oracle(f"""
WITH c AS (SELECT language, row_number() OVER (ORDER BY language) - 1 AS ci FROM (SELECT DISTINCT language FROM clip_len)),
nc AS (SELECT count(*) AS nc FROM c),
mc AS (SELECT min(n) AS mc FROM (SELECT language, count(*) AS n FROM clip_len GROUP BY 1)),
p AS (SELECT 12 // nc AS rpb, mc FROM nc, mc),
q AS (SELECT rpb, mc AS rounds FROM p),
r AS (SELECT clip_id, language, row_number() OVER (PARTITION BY language ORDER BY {H(0, 'clip_id')}, clip_id) AS rd FROM clip_len)
SELECT r.clip_id, r.language, (rd - 1) // q.rpb AS batch, ((rd - 1) % q.rpb) * (SELECT nc FROM nc) + c.ci AS slot
FROM r JOIN c USING (language), q WHERE rd <= q.rounds""", "clip_len"))
def _bat_perfect(spark, sf):
    c = V.clip_len(spark, sf).select("clip_id", "language")
    return BT.perfect_batches(c, "clip_id", "language", batch_size=12)


@register("bat_bucket", oracle(f"""
WITH p AS (SELECT audio_unique_name, audio_length, row_number() OVER (ORDER BY {H(0, 'audio_unique_name')}, audio_unique_name) AS p FROM utt),
b AS (SELECT *, (p - 1) // least(800, (SELECT count(*) FROM utt)) AS bucket FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY audio_length, audio_unique_name) AS r FROM b),
t AS (SELECT audio_unique_name, bucket, (r - 1) // 8 AS batch, (r - 1) % 8 + 1 AS in_batch FROM r)
SELECT *, dense_rank() OVER (PARTITION BY bucket ORDER BY {H(1, "concat_ws(':', CAST(bucket AS VARCHAR), CAST(batch AS VARCHAR))")}, batch)
  AS batch_order FROM t""", "utt"))
def _bat_bucket(spark, sf):
    u = V.utt(spark, sf).select(KEY, "audio_length")
    return BT.bucket_batches(u, KEY, "audio_length", 8).drop("audio_length")


@register("bat_group_shuffle", oracle(f"""
WITH p AS (SELECT audio_unique_name, row_number() OVER (ORDER BY audio_length, audio_unique_name) AS pos FROM utt),
g AS (SELECT *, (pos - 1) // 16 AS grp FROM p)
SELECT audio_unique_name, pos, CASE WHEN grp < (SELECT count(*) // 16 FROM utt)
  THEN grp * 16 + row_number() OVER (PARTITION BY grp ORDER BY {H(0, 'audio_unique_name')}, audio_unique_name) ELSE pos END AS new_pos
FROM g""", "utt"))
def _bat_group_shuffle(spark, sf):
    u = V.utt(spark, sf).select(KEY, "audio_length")
    p = global_position(u, ["audio_length", KEY]).drop("audio_length")
    return BT.group_shuffle(p, "pos", 16, KEY)


@register("bat_shard", oracle("""
WITH p AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS p0 FROM clip_len),
n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7) AS BIGINT) * 7 AS total FROM clip_len),
a AS (SELECT clip_id, p0 FROM p UNION ALL SELECT clip_id, p0 + n FROM p, n WHERE p0 < total - n)
SELECT clip_id, p0 % 7 AS shard, p0 // 7 AS index FROM a""", "clip_len"))
def _bat_shard(spark, sf):
    p = global_position(V.clip_len(spark, sf).select("clip_id"), ["clip_id"])
    return BT.shard(p, "pos", 7).drop("pos")


WORDS_SQL = "list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: length(x))"


def _word_ids(u):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return F.transform(words, lambda w: F.length(w))


def _batched_ids(spark, sf):
    u = V.utt(spark, sf).select("doc_id", "text", "text_length")
    p = global_position(u, ["doc_id"])
    return p.withColumn("batch", F.floor((F.col("pos") - 1) / 8).cast("long")) \
            .withColumn("ids", _word_ids(u)).withColumn("n_ids", F.size("ids"))


_PAD_BASE = f"""
WITH p AS (SELECT doc_id, text_length, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch, {WORDS_SQL} AS ids FROM utt),
q AS (SELECT *, len(ids) AS n_ids FROM p),
w AS (SELECT *, CAST(ceil(max(n_ids) OVER (PARTITION BY batch) / 4) * 4 AS BIGINT) AS width FROM q)"""


@register("bat_pad", oracle(_PAD_BASE + """
SELECT doc_id, batch, width, list_sum(ids) AS pad_sum, width - n_ids AS n_zero FROM w""", "utt"))
def _bat_pad(spark, sf):
    x = _batched_ids(spark, sf)
    x = x.withColumn("width", BT.padded_width(F.col("n_ids"), "batch", 4))
    x = x.withColumn("padded", BT.pad_array(F.col("ids"), F.col("width")))
    return x.select("doc_id", "batch", F.size("padded").cast("long").alias("width"),
                    F.aggregate("padded", F.lit(0).cast("long"), lambda a, b: a + b).alias("pad_sum"),
                    F.size(F.filter("padded", lambda v: v == 0)).cast("long").alias("n_zero"))


@register("bat_stop_targets", oracle(_PAD_BASE + """
SELECT doc_id, width, width - n_ids + 1 AS n_ones FROM w""", "utt"))
def _bat_stop_targets(spark, sf):
    x = _batched_ids(spark, sf)
    x = x.withColumn("width", BT.padded_width(F.col("n_ids"), "batch", 4))
    st = BT.stop_targets(F.col("n_ids"), F.col("width"))
    return x.select("doc_id", F.size(st).cast("long").alias("width"),
                    F.size(F.filter(st, lambda v: v == 1)).cast("long").alias("n_ones"))


@register("bat_rel_lengths", oracle("""
WITH p AS (SELECT doc_id, text_length, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM utt)
SELECT doc_id, batch, text_length / max(text_length) OVER (PARTITION BY batch) AS rel FROM p""", "utt", rnd=("rel",)))
def _bat_rel_lengths(spark, sf):
    x = _batched_ids(spark, sf)
    return x.select("doc_id", "batch", BT.relative_lengths("text_length", "batch").alias("rel"))


@register("bat_pairing", oracle(f"""
WITH a AS (SELECT audio_unique_name, row_number() OVER (ORDER BY audio_unique_name) AS r FROM utt),
b AS (SELECT audio_unique_name AS partner, row_number() OVER (ORDER BY {H(0, 'audio_unique_name')}, audio_unique_name) AS r FROM utt)
SELECT a.audio_unique_name, b.partner FROM a JOIN b USING (r)""", "utt"))
def _bat_pairing(spark, sf):
    return BT.pairing(V.utt(spark, sf).select(KEY), KEY)


# ------------------------------------------------------------------ segments

_LENS = "l AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY 1)"


def _seg_sql(bounds: str, cols: str, shift: int = 0) -> str:
    return f"""
WITH {_LENS}, b AS ({bounds})
SELECT {cols}, sum(CASE WHEN s.idx >= b.seg_start + {shift} AND s.idx < b.seg_end + {shift} THEN s.amp END) AS seg_sum,
  count(CASE WHEN s.idx >= b.seg_start + {shift} AND s.idx < b.seg_end + {shift} THEN 1 END) AS seg_n
FROM b JOIN sig s USING (clip_id) GROUP BY ALL"""


def _with_stats(sig, bounds, cols, shift=0):
    st = SG.segment_stats(sig, bounds, shift=shift)
    b = bounds.withColumnRenamed("start", "seg_start").withColumnRenamed("end", "seg_end")
    return b.select(*cols).join(st, on="clip_id")


@register("seg_prompt", oracle(_seg_sql(f"""
SELECT clip_id, n, seg_len, seg_start, seg_start + seg_len AS seg_end, 12 AS padded_len FROM (
  SELECT clip_id, n, seg_len, CAST(floor({U(1, 'clip_id')} * (n - seg_len + 1)) AS BIGINT) AS seg_start FROM (
  SELECT clip_id, n, CAST(CASE WHEN n - want < 0 THEN floor(n / 2) ELSE want END AS BIGINT) AS seg_len FROM (
  SELECT clip_id, n, CAST(4 + floor({U(0, 'clip_id')} * 9) AS BIGINT) AS want FROM l)))""",
    "b.clip_id, b.n, b.seg_len, b.seg_start, b.seg_end, b.padded_len"), "sig", rnd=("seg_sum",)))
def _seg_prompt(spark, sf):
    s = V.sig(spark, sf)
    b = SG.prompt_bounds(SG.clip_lengths(s), 4, 12, is_eval=False)
    return _with_stats(s, b, ["clip_id", "n", "seg_len", "seg_start", "seg_end", "padded_len"])


@register("seg_random", oracle(_seg_sql(f"""
SELECT clip_id, mel_start, mel_start * 2 AS seg_start, mel_start * 2 + 6 AS seg_end FROM (
  SELECT clip_id, CAST(floor({U(0, 'clip_id')} * (n // 2 - 3 + 1)) AS BIGINT) AS mel_start FROM l WHERE n // 2 - 3 >= 0)""",
    "b.clip_id, b.mel_start, b.seg_start, b.seg_end"), "sig", rnd=("seg_sum",)))
def _seg_random(spark, sf):
    s = V.sig(spark, sf)
    b = SG.random_window(SG.clip_lengths(s), hop=2, frames=3)
    return _with_stats(s, b, ["clip_id", "mel_start", "seg_start", "seg_end"])


@register("seg_crop", oracle(_seg_sql(f"""
SELECT clip_id, seg_start, seg_start + 5 AS seg_end FROM (
  SELECT clip_id, CAST(floor({U(0, 'clip_id')} * (n - 5 + 1)) AS BIGINT) AS seg_start FROM l WHERE n >= 5)""",
    "b.clip_id, b.seg_start, b.seg_end"), "sig", rnd=("seg_sum",)))
def _seg_crop(spark, sf):
    s = V.sig(spark, sf)
    b = SG.random_crop(SG.clip_lengths(s), 5)
    return _with_stats(s, b, ["clip_id", "seg_start", "seg_end"])


@register("seg_pad_short", oracle(f"""
WITH {_LENS}
SELECT clip_id, idx, amp FROM sig
UNION ALL SELECT clip_id, CAST(unnest(range(n, 12)) AS BIGINT) AS idx, 0.0 AS amp FROM l WHERE n < 12""", "sig", rnd=("amp",)))
def _seg_pad_short(spark, sf):
    s = V.sig(spark, sf)
    return SG.pad_short(s, SG.clip_lengths(s), 12)


@register("seg_chunks", oracle("""
WITH t AS (SELECT clip_id, CAST(least(floor(duration_s * 22050), 661500) AS BIGINT) AS t FROM clip_len),
c AS (SELECT clip_id, t, unnest(range(0, t, 132300)) AS start FROM t WHERE t > 0)
SELECT clip_id, start, least(132300, t - start) AS n_samples, start // 132300 AS chunk FROM c
WHERE least(132300, t - start) >= 22050 * 0.33""", "clip_len"))
def _seg_chunks(spark, sf):
    return SG.chunks(V.clip_len(spark, sf), "duration_s", 22050, 30.0, 6.0)


@register("seg_shift", oracle(f"""
WITH {_LENS}, b AS (SELECT clip_id, mel_offset, mel_offset + 1 AS seg_start, mel_offset + 5 AS seg_end FROM (
  SELECT clip_id, CAST(floor({U(0, 'clip_id')} * (n - 8)) AS BIGINT) AS mel_offset FROM l WHERE n - 8 > 0))
SELECT b.clip_id, b.mel_offset, b.seg_start,
  sum(CASE WHEN s.idx >= seg_start AND s.idx < seg_end THEN s.amp END) AS in_sum,
  sum(CASE WHEN s.idx >= seg_start + 1 AND s.idx < seg_end + 1 THEN s.amp END) AS tgt_sum
FROM b JOIN sig s USING (clip_id) GROUP BY ALL""", "sig", rnd=("in_sum", "tgt_sum")))
def _seg_shift(spark, sf):
    s = V.sig(spark, sf)
    b = SG.shift_offsets(SG.clip_lengths(s), seq_len=4, hop=1, pad=1)
    a = SG.segment_stats(s, b, out="in_sum").drop("in_n")
    t = SG.segment_stats(s, b, shift=1, out="tgt_sum").drop("tgt_n")
    return b.select("clip_id", "mel_offset", F.col("start").alias("seg_start")).join(a, "clip_id").join(t, "clip_id")


@register("seg_hop_pad", oracle("""
WITH l AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY 1), p AS (SELECT clip_id, n, (n // 4 + 1) * 4 - n AS p FROM l)
SELECT clip_id, n, p AS pad_right_1, p // 2 AS pad_left_2, p // 2 + p % 2 AS pad_right_2, n + p AS padded_len FROM p""", "sig"))
def _seg_hop_pad(spark, sf):
    lens = SG.clip_lengths(V.sig(spark, sf))
    _, r1 = SG.hop_padding(F.col("n"), 4, False)
    l2, r2 = SG.hop_padding(F.col("n"), 4, True)
    return lens.select("clip_id", "n", r1.alias("pad_right_1"), l2.alias("pad_left_2"), r2.alias("pad_right_2"),
                       (F.col("n") + r1).alias("padded_len"))


@register("seg_multiple", oracle("""
WITH l AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY 1)
SELECT clip_id, count(*) AS kept_n, sum(amp) AS kept_sum FROM sig JOIN l USING (clip_id) WHERE idx < n - n % 4 GROUP BY 1""",
                                 "sig", rnd=("kept_sum",)))
def _seg_multiple(spark, sf):
    s = V.sig(spark, sf)
    k = SG.cut_to_multiple(s, SG.clip_lengths(s), 4)
    return k.groupBy("clip_id").agg(F.count(F.lit(1)).alias("kept_n"), F.sum("amp").alias("kept_sum"))


@register("bat_perfect_subset")
def _bat_perfect_subset(spark, sf):
    """Rows-only: class-balanced batches over a seeded class subset per batch."""
    u = V.utt(spark, sf).select(KEY, "speaker_name")
    return BT.perfect_subset_batches(u, KEY, "speaker_name", batch_size=8, classes_per_batch=4)
