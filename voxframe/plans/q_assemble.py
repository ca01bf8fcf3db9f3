"""Corpus assembly queries (2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import assemble as A
from voxframe.plans.registry import oracle, register

KEY = "audio_unique_name"


@register("asm_extra_keys", oracle("""
SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE language END, 'xx') AS language,
  concat('docs#', regexp_replace(substr(concat('/data/docs/', audio_file), length('/data/docs') + 2), '\\.[^./]*$', '')) AS audio_unique_name
FROM utt""", "utt"))
def _asm_extra_keys(spark, sf):
    u = V.utt(spark, sf).select("doc_id", F.concat(F.lit("/data/docs/"), "audio_file").alias("audio_file"),
                                F.lit("/data/docs").alias("root_path"),
                                F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("language")).alias("language"))
    return A.extra_keys(u, "docs", "xx").select("doc_id", "language", KEY)


@register("asm_union_datasets", oracle("""
SELECT 'a' AS dataset, audio_unique_name, speaker_name, language FROM utt WHERE language IN ('en', 'fr')
UNION ALL SELECT 'b', audio_unique_name, NULL, language FROM utt WHERE language NOT IN ('en', 'fr')""", "utt"))
def _asm_union_datasets(spark, sf):
    u = V.utt(spark, sf)
    a = u.where(F.col("language").isin("en", "fr")).select(KEY, "speaker_name", "language")
    b = u.where(~F.col("language").isin("en", "fr")).select("language", KEY)
    return A.union_datasets([("a", a), ("b", b)]).select("dataset", KEY, "speaker_name", "language")


@register("asm_ignored_speakers", oracle("SELECT audio_unique_name FROM utt WHERE speaker_name NOT IN ('src0', 'src5')", "utt"))
def _asm_ignored_speakers(spark, sf):
    ign = spark.createDataFrame([("src0",), ("src5",)], "speaker_name string")
    return A.drop_ignored(V.utt(spark, sf), ign).select(KEY)


@register("asm_missing_audio", oracle("SELECT audio_unique_name FROM utt WHERE audio_file IN (SELECT path FROM listing)",
                                      "utt", "listing"))
def _asm_missing_audio(spark, sf):
    return A.keep_existing(V.utt(spark, sf), V.listing(spark, sf)).select(KEY)


@register("asm_require_audio", oracle("""
SELECT count(*) AS n_total, count(*) FILTER (WHERE audio_file NOT IN (SELECT path FROM listing)) AS n_missing,
  count(*) FILTER (WHERE audio_file NOT IN (SELECT path FROM listing)) = 0 AS passes FROM utt""", "utt", "listing"))
def _asm_require_audio(spark, sf):
    u = V.utt(spark, sf)
    miss = A.missing_files(u, V.listing(spark, sf)).agg(F.count(F.lit(1))).scalar()
    return u.agg(F.count(F.lit(1)).alias("n_total")).select("n_total", miss.alias("n_missing"),
                                                             (miss == 0).alias("passes"))


@register("asm_column_check", oracle("""
WITH l AS (SELECT doc_id, concat('wavs/', doc_id, '|', replace(text, chr(10), ' '), '|', lang) AS line FROM documents),
f AS (SELECT doc_id, CAST(len(string_split(line, '|')) AS BIGINT) AS n_fields FROM l)
SELECT doc_id, n_fields, (SELECT n_fields FROM f ORDER BY doc_id LIMIT 1) AS expected FROM f
WHERE n_fields <> (SELECT n_fields FROM f ORDER BY doc_id LIMIT 1)"""))
def _asm_column_check(spark, sf):
    d = V.table(spark, sf, "documents")
    lines = d.select("doc_id", F.concat(F.lit("wavs/"), "doc_id", F.lit("|"),
                                        F.regexp_replace("text", "\n", " "), F.lit("|"), "lang").alias("line"))
    return A.field_count_check(lines, "line", "doc_id")


@register("asm_attach_alignment", oracle("""
WITH ix AS (SELECT path AS wav, trim(concat('attn/', replace(path, '.wav', '.npy'), ' ')) AS npy FROM listing)
SELECT u.audio_unique_name, ix.npy AS alignment_file, ix.npy IS NULL AS missing FROM utt u LEFT JOIN ix ON u.audio_file = ix.wav""",
                                         "utt", "listing"))
def _asm_attach_alignment(spark, sf):
    ix = V.listing(spark, sf).select(F.col("path").alias("audio_file"),
                                     F.trim(F.concat(F.lit("attn/"), F.replace("path", F.lit(".wav"), F.lit(".npy")),
                                                     F.lit(" "))).alias("alignment_file"))
    j = V.utt(spark, sf).join(ix, on="audio_file", how="left")
    return j.select(KEY, "alignment_file", F.col("alignment_file").isNull().alias("missing"))


FEATS = "SELECT concat('feats/', lang, '/', doc_id, '.npy') AS feat FROM documents WHERE doc_id % 5 <> 0"


@register("asm_pair_features", oracle(f"""
WITH w AS (SELECT regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem, path FROM listing),
f AS (SELECT regexp_replace(string_split(feat, '/')[-1], '\\.[^.]*$', '') AS stem, feat FROM ({FEATS}))
SELECT coalesce(w.stem, f.stem) AS stem, w.path, f.feat, CASE WHEN w.path IS NULL THEN 'missing_path'
  WHEN f.feat IS NULL THEN 'missing_feat' ELSE 'ok' END AS status FROM w FULL OUTER JOIN f ON w.stem = f.stem""", "listing"))
def _asm_pair_features(spark, sf):
    feats = V.table(spark, sf, "documents").where(F.col("doc_id") % 5 != 0).select(
        F.concat(F.lit("feats/"), "lang", F.lit("/"), "doc_id", F.lit(".npy")).alias("feat"))
    return A.pair_by_stem(V.listing(spark, sf), "path", feats, "feat")


@register("asm_triple_features", oracle("""
WITH w AS (SELECT regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem, path FROM listing),
l AS (SELECT CAST(doc_id AS VARCHAR) AS stem, concat('latents/', doc_id, '.pth') AS latent FROM documents WHERE doc_id % 3 <> 0),
s AS (SELECT CAST(doc_id AS VARCHAR) AS stem, concat('spk/', doc_id, '.pth') AS spk FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(w.stem, l.stem, s.stem) AS stem, w.path, l.latent, s.spk
FROM w FULL OUTER JOIN l ON w.stem = l.stem FULL OUTER JOIN s ON coalesce(w.stem, l.stem) = s.stem""", "listing"))
def _asm_triple_features(spark, sf):
    d = V.table(spark, sf, "documents")
    w = V.listing(spark, sf).select(A.stem(F.col("path")).alias("stem"), "path")
    lat = d.where(F.col("doc_id") % 3 != 0).select(F.col("doc_id").cast("string").alias("stem"),
                                                   F.concat(F.lit("latents/"), "doc_id", F.lit(".pth")).alias("latent"))
    spk = d.where(F.col("doc_id") % 4 != 0).select(F.col("doc_id").cast("string").alias("stem"),
                                                   F.concat(F.lit("spk/"), "doc_id", F.lit(".pth")).alias("spk"))
    return w.join(lat, "stem", "full_outer").join(spk, "stem", "full_outer")


@register("asm_id_map", oracle("""
SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS id FROM (
  SELECT DISTINCT 'speaker' AS kind, speaker_name AS name FROM utt UNION ALL SELECT DISTINCT 'language', language FROM utt
  UNION ALL SELECT DISTINCT 'emotion', emotion FROM bench)""", "utt", "bench"))
def _asm_id_map(spark, sf):
    u = V.utt(spark, sf)
    parts = [A.id_map(u, "speaker_name").withColumn("kind", F.lit("speaker")),
             A.id_map(u, "language").withColumn("kind", F.lit("language")),
             A.id_map(V.bench(spark, sf), "emotion").withColumn("kind", F.lit("emotion"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "name", "id")


@register("asm_apply_ids", oracle("""
WITH s AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT speaker_name AS name FROM utt)),
l AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT language AS name FROM utt))
SELECT u.audio_unique_name, s.id AS speaker_id, l.id AS language_id FROM utt u JOIN s ON u.speaker_name = s.name
JOIN l ON u.language = l.name""", "utt"))
def _asm_apply_ids(spark, sf):
    u = V.utt(spark, sf)
    x = A.apply_ids(u, "speaker_name", A.id_map(u, "speaker_name"), "speaker_id")
    x = A.apply_ids(x, "language", A.id_map(u, "language"), "language_id")
    return x.select(KEY, "speaker_id", "language_id")


@register("asm_apply_dvec", oracle("""
SELECT u.audio_unique_name, d.name AS dvec_name, CAST(len(d.embedding) AS BIGINT) AS dim, d.embedding[1] AS first_value
FROM utt u JOIN dvec d ON concat('clip#', u.doc_id) = d.clip_key""", "utt", "dvec", rnd=("first_value",)))
def _asm_apply_dvec(spark, sf):
    u = V.utt(spark, sf).select(KEY, F.concat(F.lit("clip#"), "doc_id").alias("clip_key"))
    d = V.dvec(spark, sf)
    j = u.join(d, on="clip_key")
    return j.select(KEY, F.col("name").alias("dvec_name"), F.size("embedding").cast("long").alias("dim"),
                    F.element_at("embedding", 1).alias("first_value"))


@register("asm_speaker_subset_check", oracle("""
SELECT DISTINCT speaker_name FROM utt WHERE speaker_name NOT IN (SELECT speaker_name FROM utt WHERE doc_id % 20 < 15)""", "utt"))
def _asm_speaker_subset_check(spark, sf):
    u = V.utt(spark, sf)
    return A.new_names(u, u.where(F.col("doc_id") % 20 < 15), "speaker_name")


@register("asm_reference_choice", oracle("""
SELECT audio_unique_name, coalesce(CASE WHEN doc_id % 2 = 0 THEN concat('refs/', doc_id, '.wav') END, audio_file) AS cond_file FROM utt""",
                                         "utt"))
def _asm_reference_choice(spark, sf):
    u = V.utt(spark, sf).withColumn("ref_file", F.when(F.col("doc_id") % 2 == 0,
                                                       F.concat(F.lit("refs/"), "doc_id", F.lit(".wav"))))
    return u.select(KEY, F.coalesce("ref_file", "audio_file").alias("cond_file"))


@register("asm_safe_filename", oracle("""
SELECT audio_unique_name, replace(replace(to_base64(encode(audio_unique_name)), '+', '-'), '/', '_') AS safe_name, true AS round_trip
FROM utt""", "utt"))
def _asm_safe_filename(spark, sf):
    u = V.utt(spark, sf).select(KEY).withColumn("safe_name", A.safe_filename(F.col(KEY)))
    return u.withColumn("round_trip", A.from_safe_filename(F.col("safe_name")) == F.col(KEY))


@register("asm_label_time_join", oracle("""
WITH e AS (SELECT conv_id, max(end_s) AS e FROM words GROUP BY 1),
p AS (SELECT conv_id, unnest(range(0, CAST(floor(e * 100) AS BIGINT) + 1, 50)) AS idx FROM e)
SELECT p.conv_id, p.idx, w.turn, w.pos, w.word FROM p JOIN words w ON p.conv_id = w.conv_id
  AND p.idx >= w.start_s * 100 AND p.idx <= w.end_s * 100""", "words"))
def _asm_label_time_join(spark, sf):
    """Samples at every fiftieth of the 100 a second. Sample number and word
    bounds are whole numbers of fifties: the sample is at or after the bound's
    ceiling, or before its floor, just as with the bound itself."""
    from voxframe.functions.core import range_join
    every = 50
    w = V.words(spark, sf).withColumn("lo", F.ceil(F.col("start_s") * 100)).withColumn("hi", F.floor(F.col("end_s") * 100))
    e = w.groupBy("conv_id").agg(F.max("hi").alias("e"))
    p = e.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"e div {every}"))).alias("n"))
    r = w.select("conv_id", "turn", "pos", "word", F.expr(f"(lo + {every - 1}) div {every}").alias("first"), F.expr(f"hi div {every}").alias("last"))
    j = range_join(p, r, "n", "first", "last", keys=["conv_id"])
    return j.select("conv_id", (F.col("n") * every).alias("idx"), "turn", "pos", "word")
