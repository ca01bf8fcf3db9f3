"""Splits (2.3), filters / sorts / budgets (2.4), balancing, weights, draws (2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.functions.core import global_position
from voxframe.operators import balance as B
from voxframe.operators import select as S
from voxframe.operators import split as SP
from voxframe.operators.text import script_of
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import D, H, U, WC

LIM = dict(min_text=20, max_text=20000, min_audio=50000, max_audio=20_000_000)
LIM_SQL = "text_length BETWEEN 20 AND 20000 AND audio_length BETWEEN 50000 AND 20000000"
KEY = "audio_unique_name"

# ---------------------------------------------------------------- 2.3 splits


@register("split_size", oracle(f"""
SELECT 'frac' AS config, count(*) AS n, CAST(floor(count(*) * {D(0.01)}) AS BIGINT) AS k FROM utt
UNION ALL SELECT 'frac_cap', count(*), least(256, CAST(floor(count(*) * {D(0.1)}) AS BIGINT)) FROM utt
UNION ALL SELECT 'cap_per_dataset', count(*), least(256 // 2, CAST(floor(count(*) * {D(0.1)}) AS BIGINT)) FROM utt
UNION ALL SELECT 'absolute', count(*), 25 FROM utt""", "utt"))
def _split_size(spark, sf):
    u = V.utt(spark, sf)
    n = u.agg(F.count(F.lit(1))).scalar()
    rows = [("frac", SP.eval_size(u, 0.01)), ("frac_cap", SP.eval_size(u, 0.1, 256)),
            ("cap_per_dataset", SP.eval_size(u, 0.1, 256 // 2)), ("absolute", SP.eval_size(u, 25))]
    one = spark.range(1)
    out = None
    for name, k in rows:
        r = one.select(F.lit(name).alias("config"), n.alias("n"), k.alias("k"))
        out = r if out is None else out.unionByName(r)
    return out


@register("split_holdout", oracle(f"""
SELECT clip_id, CASE WHEN row_number() OVER (ORDER BY {H(0, 'clip_id')}, clip_id)
  <= (SELECT CAST(floor(count(*) * {D(0.01)}) AS BIGINT) FROM clip_len) THEN 'eval' ELSE 'train' END AS split
FROM clip_len""", "clip_len"))
def _split_holdout(spark, sf):
    return SP.split_holdout(V.clip_len(spark, sf).select("clip_id"), "clip_id", size=0.01)


@register("split_by_speaker", oracle(f"""
WITH b AS (SELECT audio_unique_name AS k, speaker_name, {H(0, 'audio_unique_name')} AS h FROM utt),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker_name ORDER BY h, k) AS rs FROM b),
c AS (SELECT k, row_number() OVER (ORDER BY h, k) AS g FROM r WHERE rs > 1)
SELECT r.k AS audio_unique_name, r.speaker_name,
  CASE WHEN c.g <= (SELECT least(256, CAST(floor(count(*) * {D(0.1)}) AS BIGINT)) FROM b) THEN 'eval' ELSE 'train' END AS split
FROM r LEFT JOIN c ON r.k = c.k""", "utt"))
def _split_by_speaker(spark, sf):
    u = V.utt(spark, sf).select(KEY, "speaker_name")
    return SP.split_by_speaker(u, KEY, "speaker_name", size=0.1, cap=256)


@register("split_fraction", oracle(f"""
WITH s AS (SELECT audio_unique_name, audio_file, CASE WHEN row_number() OVER (ORDER BY {H(0, 'audio_unique_name')}, audio_unique_name)
  <= (SELECT CAST(floor(count(*) * {D(0.15)}) AS BIGINT) FROM utt) THEN 'eval' ELSE 'train' END AS split FROM utt)
SELECT audio_unique_name, audio_file, split, row_number() OVER (PARTITION BY split ORDER BY audio_file, audio_unique_name) AS pos FROM s""",
                                          "utt"))
def _split_fraction(spark, sf):
    u = V.utt(spark, sf).select(KEY, "audio_file")
    return SP.split_fraction(u, KEY, "audio_file", 0.15)


PREFIXED = "concat(CASE doc_id % 3 WHEN 0 THEN 'train_' WHEN 1 THEN 'valid_' ELSE 'x_' END, doc_id, '.wav')"


@register("split_by_prefix", oracle(f"""
SELECT doc_id, CASE WHEN starts_with(f, 'train_') THEN 'train' WHEN starts_with(f, 'valid_') THEN 'eval' ELSE 'other' END AS split
FROM (SELECT doc_id, string_split(concat('wavs/', {PREFIXED}), '/')[-1] AS f FROM documents)"""))
def _split_by_prefix(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("wavs/"), F.expr(PREFIXED)).alias("p"))
    return SP.split_by_prefix(d, "p").select("doc_id", "split")


@register("split_vocoder", oracle(f"""
SELECT path, CASE WHEN row_number() OVER (ORDER BY {H(0, 'path')}, path) <= 10 THEN 'eval' ELSE 'train' END AS split FROM listing""",
                                  "listing"))
def _split_vocoder(spark, sf):
    return SP.split_holdout(V.listing(spark, sf), "path", size=10)


@register("split_native", oracle("SELECT clip_id, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS split FROM clip_len",
                                 "clip_len"))
def _split_native(spark, sf):
    return SP.split_native(V.clip_len(spark, sf).select("clip_id", F.col("split").alias("src")), "src").drop("src")


# ------------------------------------------------- 2.4 filters, sorts, budgets


@register("flt_length", oracle(f"SELECT audio_unique_name, text_length, audio_length FROM utt WHERE {LIM_SQL}", "utt"))
def _flt_length(spark, sf):
    return S.flt_length(V.utt(spark, sf), **LIM).select(KEY, "text_length", "audio_length")


@register("len_stats", oracle(f"""
SELECT max(text_length) FILTER (WHERE k) AS max_text_len, min(text_length) FILTER (WHERE k) AS min_text_len,
  avg(text_length) FILTER (WHERE k) AS avg_text_len, max(audio_length) FILTER (WHERE k) AS max_audio_len,
  min(audio_length) FILTER (WHERE k) AS min_audio_len, avg(audio_length) FILTER (WHERE k) AS avg_audio_len,
  count(*) FILTER (WHERE NOT k) AS n_discarded, count(*) FILTER (WHERE k) AS n_kept
FROM (SELECT *, coalesce({LIM_SQL}, false) AS k FROM utt)""", "utt", rnd=("avg_text_len", "avg_audio_len")))
def _len_stats(spark, sf):
    return S.len_stats(V.utt(spark, sf), **LIM)


@register("srt_length", oracle("SELECT clip_id, duration_s, row_number() OVER (ORDER BY duration_s, clip_id) AS pos FROM clip_len",
                               "clip_len", rnd=("duration_s",)))
def _srt_length(spark, sf):
    return S.srt_length(V.clip_len(spark, sf).select("clip_id", "duration_s"), "duration_s", "clip_id")


@register("srt_longest_first", oracle(f"""
WITH f AS (SELECT audio_unique_name, audio_length FROM utt WHERE {LIM_SQL}),
r AS (SELECT *, row_number() OVER (ORDER BY audio_length, audio_unique_name) AS rn FROM f)
SELECT audio_unique_name, audio_length, CASE WHEN rn = (SELECT count(*) FROM f) THEN 1 WHEN rn = 1 THEN (SELECT count(*) FROM f)
  ELSE rn END AS pos FROM r""", "utt"))
def _srt_longest_first(spark, sf):
    f = S.flt_length(V.utt(spark, sf), **LIM).select(KEY, "audio_length")
    return S.srt_longest_first(f, "audio_length", KEY)


@register("srt_batch_desc", oracle("""
WITH p AS (SELECT audio_unique_name, text_length, row_number() OVER (ORDER BY audio_length, audio_unique_name) AS pos FROM utt),
b AS (SELECT *, (pos - 1) // 16 AS batch FROM p)
SELECT audio_unique_name, text_length, pos, batch,
  row_number() OVER (PARTITION BY batch ORDER BY text_length DESC, audio_unique_name) AS in_batch FROM b""", "utt"))
def _srt_batch_desc(spark, sf):
    u = V.utt(spark, sf).select(KEY, "text_length", "audio_length")
    p = S.srt_length(u, "audio_length", KEY).drop("audio_length")
    return S.srt_batch_desc(p, "pos", 16, "text_length", KEY)


@register("flt_digits", oracle("SELECT audio_unique_name FROM utt WHERE NOT regexp_matches(text, '\\p{Nd}')", "utt"))
def _flt_digits(spark, sf):
    return S.flt_digits(V.utt(spark, sf)).select(KEY)


UNK_RE = r"[^\p{L}\p{N}\p{P}\p{Zs}\n\t]"


@register("flt_clip_train", oracle(f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text'
  WHEN regexp_matches(text, '{UNK_RE}') THEN 'unknown_token' WHEN audio_length < sample_rate * {D(0.2)} THEN 'too_short'
  WHEN audio_length > 10000000 THEN 'too_long' WHEN text_length > 5000 THEN 'too_many_tokens' ELSE 'ok' END AS reason FROM utt)
GROUP BY reason""", "utt"))
def _flt_clip_train(spark, sf):
    u = V.utt(spark, sf)
    r = S.clip_train_reason(F.col("audio_length"), F.col("sample_rate"), F.col("text_length"), F.col("text"),
                            10_000_000, 5000, F.col("text").rlike(UNK_RE))
    return u.select(r.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("flt_clip_codec", oracle("SELECT clip_id FROM clip_len WHERE duration_s >= 0.5 AND duration_s <= 20", "clip_len"))
def _flt_clip_codec(spark, sf):
    return S.flt_clip_codec(V.clip_len(spark, sf), "duration_s", 0.5, 20.0).select("clip_id")


@register("flt_min_class", oracle("""
SELECT clip_id, speaker_name FROM clip_len WHERE speaker_name IN (SELECT speaker_name FROM clip_len GROUP BY 1 HAVING count(*) >= 60)
  AND duration_s - 5 > 0""", "clip_len"))
def _flt_min_class(spark, sf):
    c = V.clip_len(spark, sf).select("clip_id", "speaker_name", "duration_s")
    return S.flt_min_class(c, "speaker_name", "duration_s", 60, 5).select("clip_id", "speaker_name")


@register("flt_votes", oracle("SELECT client_id, doc_id, path FROM votes WHERE down_votes = 0 AND up_votes > 0", "votes"))
def _flt_votes(spark, sf):
    return S.flt_votes(V.votes(spark, sf)).select("client_id", "doc_id", "path")


@register("top_speakers", oracle("""
SELECT client_id, count(*) AS n FROM votes WHERE down_votes = 0 AND up_votes > 0 GROUP BY 1 ORDER BY n DESC, client_id LIMIT 10""",
                                 "votes"))
def _top_speakers(spark, sf):
    return S.top_k_counts(S.flt_votes(V.votes(spark, sf)), "client_id", 10)


@register("sample_per_speaker", oracle(f"""
SELECT client_id, doc_id FROM (SELECT client_id, doc_id, row_number() OVER (PARTITION BY client_id ORDER BY {H(0, 'doc_id')}, doc_id) AS r
FROM votes WHERE down_votes = 0 AND up_votes > 0) WHERE r <= 5""", "votes"))
def _sample_per_speaker(spark, sf):
    v = S.flt_votes(V.votes(spark, sf)).select("client_id", "doc_id")
    return S.sample_per_group(v, "client_id", "doc_id", 5)


@register("tail_hours", oracle("""
WITH v AS (SELECT * FROM votes WHERE down_votes = 0 AND up_votes > 0),
t AS (SELECT client_id FROM v GROUP BY 1 ORDER BY count(*) DESC, client_id LIMIT 1),
s AS (SELECT v.* FROM v JOIN t USING (client_id))
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM s)
WHERE r <= (SELECT round_even(1800 / avg(duration_s), 0) FROM s)""", "votes"))
def _tail_hours(spark, sf):
    v = S.flt_votes(V.votes(spark, sf))
    top = S.top_k_counts(v, "client_id", 1).select("client_id")
    s = v.join(top, "client_id", "left_semi").select("doc_id", "duration_s")
    return S.tail_by_hours(s, "doc_id", "duration_s", 0.5).select("doc_id")


@register("ref_longest_text", oracle("""
SELECT language, audio_file AS ref_audio, nw AS max_words FROM (SELECT language, audio_file, len(string_split(text, ' ')) AS nw,
  row_number() OVER (PARTITION BY language ORDER BY len(string_split(text, ' ')) DESC, doc_id) AS r FROM utt) WHERE r = 1""", "utt"))
def _ref_longest_text(spark, sf):
    return S.ref_longest_text(V.utt(spark, sf), "language", "text", "audio_file", "doc_id")


CAP_T = 50000


CAP_SQL_STOP = "(c + prev >= {T} OR (c + prev + duration_s > {T} AND {T} - c - prev < 10))"


@register("cap_hours", oracle(f"""
WITH e AS (SELECT clip_id, language, duration_s, l_orderkey, l_linenumber, split FROM clip_len WHERE duration_s >= 0.5),
r AS (SELECT *, row_number() OVER w AS p, coalesce(sum(duration_s) OVER (PARTITION BY language, split
  ORDER BY l_orderkey, l_linenumber, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM e WINDOW w AS (PARTITION BY language, split ORDER BY l_orderkey, l_linenumber, clip_id)),
r0 AS (SELECT *, 0.0 AS c FROM r WHERE split = 'train'),
s0 AS (SELECT language, min(p) AS stop FROM r0 WHERE {CAP_SQL_STOP.format(T=CAP_T)} GROUP BY 1),
k0 AS (SELECT r0.* FROM r0 LEFT JOIN s0 USING (language) WHERE s0.stop IS NULL OR r0.p < s0.stop),
a0 AS (SELECT language, sum(duration_s) AS c FROM k0 GROUP BY 1),
r1 AS (SELECT r.*, coalesce(a0.c, 0.0) AS c FROM r LEFT JOIN a0 USING (language) WHERE split = 'valid'),
s1 AS (SELECT language, min(p) AS stop FROM r1 WHERE {CAP_SQL_STOP.format(T=CAP_T)} GROUP BY 1),
k1 AS (SELECT r1.* FROM r1 LEFT JOIN s1 USING (language) WHERE s1.stop IS NULL OR r1.p < s1.stop)
SELECT clip_id, language, split FROM k0 UNION ALL SELECT clip_id, language, split FROM k1""", "clip_len"))
def _cap_hours(spark, sf):
    c = V.clip_len(spark, sf).select("clip_id", "language", "duration_s", "l_orderkey", "l_linenumber", "split")
    return S.cap_hours(c, "language", ["l_orderkey", "l_linenumber", "clip_id"], "duration_s", target_s=CAP_T,
                       split="split", split_order=["train", "valid"]).select("clip_id", "language", "split")


@register("cap_words", oracle(f"""
WITH w AS (SELECT doc_id, language, {WC('generated_sentence')} AS words FROM bench),
r AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY language ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS prev FROM w)
SELECT doc_id, language, words, CAST(prev + words AS DOUBLE) AS cum FROM r WHERE prev < 2100""", "bench", rnd=("cum",)))
def _cap_words(spark, sf):
    b = V.bench(spark, sf).select("doc_id", "language", S.word_count("generated_sentence").alias("words"))
    return S.cap_running(b, "language", ["doc_id"], "words", 2100)


@register("plan_calls", oracle(f"""
SELECT language, avg_len, CAST(floor(floor(8400 * {D(0.25)} / avg_len) / 25) AS BIGINT) + 1 AS calls
FROM (SELECT language, avg({WC('generated_sentence')}) AS avg_len FROM bench GROUP BY 1)""", "bench", rnd=("avg_len",)))
def _plan_calls(spark, sf):
    b = V.bench(spark, sf)
    a = b.groupBy("language").agg(F.avg(S.word_count("generated_sentence")).alias("avg_len"))
    words = int(8400 * 0.25)
    return a.withColumn("calls", (F.floor(F.floor(F.lit(float(words)) / F.col("avg_len")) / 25) + 1).cast("long"))


# --------------------------------------------- 2.5 balancing, weights, draws


@register("bal_language_info", oracle("SELECT language, count(*) AS n FROM clip_len GROUP BY ROLLUP (language)", "clip_len"))
def _bal_language_info(spark, sf):
    return B.language_info(V.clip_len(spark, sf), "language")


def _bal_sql(bsize: int, tail: str) -> str:
    return oracle(f"""
WITH c AS (SELECT language, count(*) AS n FROM utt GROUP BY language),
p AS (SELECT greatest(1, {bsize} // (SELECT count(*) FROM c)) AS spl, (SELECT min(n) FROM c) AS mn),
r AS (SELECT audio_unique_name, audio_file, text, language, row_number() OVER (PARTITION BY language
  ORDER BY {H(0, 'audio_unique_name')}, audio_unique_name) AS rp FROM utt),
x AS (SELECT r.*, (rp - 1) // p.spl AS batch_id, (rp - 1) % p.spl AS lang_slot, p.mn // p.spl AS nb FROM r, p),
y AS (SELECT audio_unique_name, audio_file, text, language, batch_id, lang_slot, row_number() OVER (PARTITION BY batch_id
  ORDER BY {H(1, 'audio_unique_name')}, audio_unique_name) AS in_batch FROM x WHERE batch_id < nb)
{tail}""", "utt")


@register("bal_language_batches", _bal_sql(8, "SELECT audio_unique_name, language, batch_id, lang_slot, in_batch FROM y"))
def _bal_language_batches(spark, sf):
    u = V.utt(spark, sf).select(KEY, "language")
    return B.language_batches(u, KEY, "language", batch_size=8)


@register("bal_batch_peek", _bal_sql(16, "SELECT audio_unique_name, language, batch_id, in_batch FROM y WHERE batch_id = 3"))
def _bal_batch_peek(spark, sf):
    u = V.utt(spark, sf).select(KEY, "language")
    return B.language_batches(u, KEY, "language", batch_size=16).where("batch_id = 3").drop("lang_slot")


@register("bal_batch_report", _bal_sql(8, """SELECT batch_id, language, CASE WHEN regexp_matches(text, '[\\x{0D00}-\\x{0D7F}]') THEN 'Malayalam'
  WHEN regexp_matches(text, '[\\x{0B80}-\\x{0BFF}]') THEN 'Tamil' WHEN regexp_matches(text, '[\\x{0C80}-\\x{0CFF}]') THEN 'Kannada'
  WHEN regexp_matches(text, '[\\x{0C00}-\\x{0C7F}]') THEN 'Telugu' ELSE 'Other' END AS script, count(*) AS n, min(audio_file) AS first_file
FROM y GROUP BY ALL"""))
def _bal_batch_report(spark, sf):
    u = V.utt(spark, sf).select(KEY, "language", "audio_file", "text")
    b = B.language_batches(u, KEY, "language", batch_size=8)
    return B.batch_report(b, "language", script_of(F.col("text")), "audio_file")


def _w_sql(attr: str) -> str:
    return oracle(f"""
WITH c AS (SELECT {attr}, count(*) AS n FROM utt GROUP BY 1), nm AS (SELECT sqrt(sum(1.0 / n)) AS z FROM c)
SELECT u.audio_unique_name, (1.0 / c.n) / nm.z AS weight FROM utt u JOIN c USING ({attr}), nm""", "utt", rnd=("weight",))


@register("w_language", _w_sql("language"))
def _w_language(spark, sf):
    return B.attribute_weights(V.utt(spark, sf).select(KEY, "language"), "language").select(KEY, "weight")


@register("w_speaker", _w_sql("speaker_name"))
def _w_speaker(spark, sf):
    return B.attribute_weights(V.utt(spark, sf).select(KEY, "speaker_name"), "speaker_name").select(KEY, "weight")


MULT_SQL = "1.0 + CAST(substr(speaker_name, 4) AS BIGINT) % 4 * 0.5"


@register("w_attribute", oracle(f"""
WITH c AS (SELECT speaker_name, count(*) AS n FROM utt GROUP BY 1), nm AS (SELECT sqrt(sum(1.0 / n)) AS z FROM c),
m AS (SELECT DISTINCT speaker_name, CAST({MULT_SQL} AS DOUBLE) AS mult FROM utt)
SELECT u.audio_unique_name, (1.0 / c.n) / nm.z * m.mult AS weight FROM utt u JOIN c USING (speaker_name) JOIN m USING (speaker_name), nm""",
                                "utt", rnd=("weight",)))
def _w_attribute(spark, sf):
    u = V.utt(spark, sf).select(KEY, "speaker_name")
    mult = u.select("speaker_name").distinct().withColumn(
        "mult", (1.0 + F.substring("speaker_name", 4, 100).cast("long") % 4 * 0.5).cast("double"))
    return B.attribute_weights(u, "speaker_name", multipliers=mult).select(KEY, "weight")


@register("w_length", oracle("""
WITH mm AS (SELECT floor(min(audio_length)) AS mn, floor(max(audio_length)) AS mx FROM utt),
s AS (SELECT mn, CAST(floor((mx - mn) / 10) AS BIGINT) + 1 AS step FROM mm),
b AS (SELECT audio_unique_name, CAST(greatest(0, ceil((audio_length - s.mn) / s.step) - 1) AS BIGINT) AS length_bucket FROM utt, s),
c AS (SELECT length_bucket, count(*) AS n FROM b GROUP BY 1), nm AS (SELECT sqrt(sum(1.0 / n)) AS z FROM c)
SELECT b.audio_unique_name, b.length_bucket, (1.0 / c.n) / nm.z AS weight FROM b JOIN c USING (length_bucket), nm""",
                             "utt", rnd=("weight",)))
def _w_length(spark, sf):
    return B.length_weights(V.utt(spark, sf).select(KEY, "audio_length"), "audio_length").select(KEY, "length_bucket", "weight")


@register("w_combined", oracle("""
WITH c1 AS (SELECT language, count(*) AS n FROM utt GROUP BY 1), z1 AS (SELECT sqrt(sum(1.0 / n)) AS z FROM c1),
c2 AS (SELECT speaker_name, count(*) AS n FROM utt GROUP BY 1), z2 AS (SELECT sqrt(sum(1.0 / n)) AS z FROM c2)
SELECT u.audio_unique_name, 1.0 * ((1.0 / c1.n) / z1.z) + 0.5 * ((1.0 / c2.n) / z2.z) AS weight
FROM utt u JOIN c1 USING (language) JOIN c2 USING (speaker_name), z1, z2""", "utt", rnd=("weight",)))
def _w_combined(spark, sf):
    u = V.utt(spark, sf).select(KEY, "language", "speaker_name")
    return B.combined_weights(u, KEY, [("language", 1.0), ("speaker_name", 0.5)]).select(KEY, "weight")


@register("smp_weighted", oracle(f"""
WITH c AS (SELECT language, count(*) AS n FROM utt GROUP BY 1), nm AS (SELECT sqrt(sum(1.0 / n)) AS z FROM c),
w AS (SELECT u.audio_unique_name, (1.0 / c.n) / nm.z AS weight FROM utt u JOIN c USING (language), nm),
cs AS (SELECT audio_unique_name, weight, sum(weight) OVER (ORDER BY audio_unique_name ROWS UNBOUNDED PRECEDING) AS hi FROM w),
t AS (SELECT sum(weight) AS tot FROM w),
iv AS (SELECT audio_unique_name, (hi - weight) / tot AS lo, hi / tot AS hi FROM cs, t),
d AS (SELECT range AS draw_id, {U(0, 'range')} AS u FROM (SELECT unnest(range((SELECT count(*) FROM utt))) AS range))
SELECT d.draw_id, iv.audio_unique_name FROM d JOIN iv ON d.u >= iv.lo AND d.u < iv.hi""", "utt"))
def _smp_weighted(spark, sf):
    w = B.attribute_weights(V.utt(spark, sf).select(KEY, "language"), "language").select(KEY, "weight")
    return B.weighted_draws(spark, w, KEY, "weight")


@register("smp_lang_uniform", oracle(f"""
WITH l AS (SELECT language, row_number() OVER (ORDER BY language) - 1 AS li FROM (SELECT DISTINCT language FROM utt)),
c AS (SELECT language, count(*) AS n FROM utt GROUP BY 1),
d AS (SELECT range AS draw_id, CAST(floor({U(0, 'range')} * (SELECT count(*) FROM l)) AS BIGINT) AS li FROM (SELECT unnest(range((SELECT count(*) FROM utt))) AS range)),
d2 AS (SELECT d.draw_id, l.language, CAST(1 + floor({U(1, 'd.draw_id')} * c.n) AS BIGINT) AS p FROM d JOIN l USING (li) JOIN c USING (language)),
x AS (SELECT audio_unique_name, language, row_number() OVER (PARTITION BY language ORDER BY audio_unique_name) AS p FROM utt)
SELECT d2.draw_id, d2.language, x.audio_unique_name FROM d2 JOIN x USING (language, p)""", "utt"))
def _smp_lang_uniform(spark, sf):
    return B.language_uniform_draws(spark, V.utt(spark, sf).select(KEY, "language"), KEY, "language")


@register("smp_subset", oracle("""
WITH p AS (SELECT audio_unique_name, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM utt),
ix AS (SELECT doc_id AS p, row_number() OVER (ORDER BY doc_id DESC) AS list_pos FROM labels)
SELECT ix.list_pos, p.audio_unique_name FROM ix JOIN p USING (p)""", "utt"))
def _smp_subset(spark, sf):
    u = global_position(V.utt(spark, sf).select(KEY, "doc_id"), ["doc_id"], out="p").withColumn("p", F.col("p") - 1)
    ix = global_position(V.table(spark, sf, "labels").select(F.col("doc_id").alias("p")), [F.col("p").desc()],
                         out="list_pos")
    return ix.join(u, on="p").select("list_pos", KEY)


@register("smp_sorted", oracle("SELECT audio_unique_name, row_number() OVER (ORDER BY text_length, audio_unique_name) AS pos FROM utt",
                               "utt"))
def _smp_sorted(spark, sf):
    return global_position(V.utt(spark, sf).select(KEY, "text_length"), ["text_length", KEY]).select(KEY, "pos")
