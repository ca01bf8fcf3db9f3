"""Source layout queries (2.1): each layout's manifest lines are derived from
the ``documents`` table (one line per document, header rows where the
layout has one), then parsed by the spec engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.plans.registry import oracle, register
from voxframe.sources import files as FS
from voxframe.sources.manifest import parse_lines, parse_sql
from voxframe.streaming.jobs import workdir

IGNORED = ["src0", "src5", "0", "5"]
T = "translate(text, concat('|', chr(9), chr(13), chr(10), ','), '     ')"
SP = "replace(source, 'src', '')"

# line writers: one expression text valid in both Spark SQL and DuckDB
WRITERS = {
    "cml_tts": ("wav_filename|wav_filesize|transcript|client_id",
                f"concat('wavs/', lang, '/', doc_id, '.wav|', n_chars * 2, '|', {T}, '|', source)"),
    "coqui": ("audio_file|text|speaker_name|language|ref_file",
              f"concat('wavs/', lang, '/', doc_id, '.wav|', {T}, '|', source, '|', lang, '|refs/', doc_id, '.wav')"),
    "tweb": (None, f"concat(doc_id, chr(9), {T})"),
    "mozilla": (None, f"concat(' ', {T}, ' | ', doc_id, '.wav ')"),
    "mozilla_de": (None, f"concat(source, '_', doc_id, '.wav|', {T}, ' ')"),
    "mailabs": (None, f"concat(doc_id, '|', {T}, ' ')"),
    "ljspeech": (None, f"concat('LJ', doc_id, '|', {T}, '|', lower({T}))"),
    "ljspeech_test": (None, f"concat('LJ', doc_id, '|', {T}, '|', lower({T}))"),
    "thorsten": (None, f"concat('T', doc_id, '|', {T})"),
    "ruslan": (None, f"concat('R', doc_id, '|', {T})"),
    "css10": (None, f"concat(lang, '/', doc_id, '.wav|', {T}, '|', n_chars)"),
    "nancy": (None, f"concat('( nancy', doc_id, ' \"', {T}, '\" )')"),
    "common_voice": (None, f"concat(source, chr(9), 'cv_', doc_id, '.mp3', chr(9), {T}, chr(9), doc_id % 3)"),
    "libri_tts": (None, f"concat({SP}, '_', doc_id % 50, '_', doc_id, chr(9), {T}, chr(9), lower({T}))"),
    "custom_turkish": (None, f"concat(' t', doc_id, ' |', {T}, ' ')"),
    "brspeech": ("wav_filename|filesize|transcript|speaker_id", f"concat('wavs/', doc_id, '.wav|', n_chars, '|', {T}, '|', source)"),
    "mls": (None, f"concat({SP}, '_', doc_id % 50, '_', doc_id, chr(9), {T})"),
    "emotion": ("file_path,speaker_id,emotion_id", "concat('wavs/', doc_id, '.wav,', source, ',', 'emo', doc_id % 5)"),
    "baker": (None, f"concat(doc_id, '.wav|', {T}, CASE WHEN doc_id % 11 = 0 THEN '|x' ELSE '' END)"),
    "kokoro": (None, f"concat('K', doc_id, '|', {T}, '|', {T})"),
    "kss": (None, f"concat(lang, '/', doc_id, '.wav|', {T}, '|', lower({T}), '|', n_chars)"),
    "bel_tts": (None, f"concat('wavs/', doc_id, '.wav|', {T})"),
}
PATHS = {"mailabs": ("concat('/data/mailabs/', lang, '/by_book/', CASE WHEN doc_id % 10 = 9 THEN 'mix' WHEN doc_id % 2 = 0 "
                     "THEN 'female' ELSE 'male' END, '/', source, '/book', doc_id % 3, '/metadata.csv')")}
ROOT = "/data/{}"


def lines_sql(name: str) -> str:
    header, row = WRITERS[name]
    fp = PATHS.get(name, "CAST(NULL AS VARCHAR)")
    body = f"SELECT doc_id AS line_no, {row} AS line, {fp} AS file_path FROM documents"
    if header:
        body = f"SELECT -1 AS line_no, '{header}' AS line, CAST(NULL AS VARCHAR) AS file_path UNION ALL " + body
    return body


def lines_df(spark, sf, name: str):
    header, row = WRITERS[name]
    d = V.table(spark, sf, "documents")
    fp = F.expr(PATHS[name]) if name in PATHS else F.lit(None).cast("string")
    x = d.select(F.col("doc_id").alias("line_no"), F.expr(row).alias("line"), fp.alias("file_path"))
    if header:
        h = spark.range(1).select(F.lit(-1).cast("long").alias("line_no"), F.lit(header).alias("line"),
                                  F.lit(None).cast("string").alias("file_path"))
        x = h.unionByName(x)
    return x


def _src_query(name: str):
    from voxframe.sources.specs import SPECS
    spec = SPECS[name]
    root = ROOT.format(name)
    if spec.get("exists"):
        sql = (f"WITH lines AS ({lines_sql(name)}), p0 AS ({parse_sql(name, root, 'lines', IGNORED)}), "
               f"lst AS (SELECT audio_file AS path FROM p0 WHERE line_no % 7 <> 0) "
               f"{parse_sql(name, root, 'lines', IGNORED, listing='lst')}")
    else:
        sql = f"WITH lines AS ({lines_sql(name)}) {parse_sql(name, root, 'lines', IGNORED)}"

    @register(f"src_{name}", oracle(sql))
    def _q(spark, sf):
        ln = lines_df(spark, sf, name)
        if spec.get("exists"):
            p0 = parse_lines(ln, name, root, IGNORED)
            lst = p0.where(F.col("line_no") % 7 != 0).select(F.col("audio_file").alias("path"))
            return parse_lines(ln, name, root, IGNORED, listing=lst)
        if spec.get("require_all"):
            lst = parse_lines(ln, name, root).select(F.col("audio_file").alias("path"))
            return parse_lines(ln, name, root, IGNORED, listing=lst)
        return parse_lines(ln, name, root, IGNORED)


for _n in WRITERS:
    _src_query(_n)


# ---- one file per clip -----------------------------------------------------------

FILE_PATHS = {
    "vctk": "concat('/data/vctk/txt/', CASE WHEN doc_id % 17 = 0 THEN 'p280' ELSE source END, '/', source, '_', doc_id, '.txt')",
    "vctk_old": "concat('/data/vctk_old/txt/', source, '/', source, '_', doc_id, '.txt')",
    "open_bible": "concat('/data/open_bible/', CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'train' END, '/', source, '/', doc_id, '.txt')",
}


def _files_df(spark, sf, name):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.expr(FILE_PATHS[name]).alias("path"), F.col("text").alias("content"))


def _per_file_sql(name):
    from voxframe.sources.specs import SPECS
    spec = SPECS[name]
    root = ROOT.format(name)
    rx = spec["path_re"].replace("'", "''")
    if spec.get("split_dir"):
        ids = f"regexp_extract(path, '{rx}', 1) AS _split, regexp_extract(path, '{rx}', 2) AS _spk, regexp_extract(path, '{rx}', 3) AS _fid"
    else:
        ids = f"regexp_extract(path, '{rx}', 1) AS _spk, regexp_extract(path, '{rx}', 2) AS _fid"
    mic = ""
    if "mic" in spec:
        forced = " ".join(f"WHEN _spk = '{k}' THEN '_{v}'" for k, v in spec.get("mic_forced", {}).items())
        mic = f", CASE {forced} ELSE '_{spec['mic']}' END AS _mic"
    audio = " || ".join(f"'{root}'" if p[0] == "root" else f"'{p[1]}'" if p[0] == "lit" else f"_{p[1]}" for p in spec["audio"])
    spk = " || ".join(f"'{p[1]}'" if p[0] == "lit" else f"_{p[1]}" for p in spec["speaker"])
    digits = "WHERE NOT regexp_matches(text, '\\p{Nd}')" if spec.get("drop_digits") else ""
    base = f"""SELECT path, text, {audio} AS audio_file, {spk} AS speaker_name, _spk AS _raw FROM (
  SELECT *, replace(string_split(content, chr(10))[1], chr(10), '') AS text{mic} FROM (SELECT path, content, {ids} FROM files)) {digits}"""
    ig = ", ".join(f"'{s}'" for s in IGNORED)
    q = f"SELECT path, text, audio_file, speaker_name, '{root}' AS root_path FROM ({base}) WHERE _raw NOT IN ({ig})"
    if spec.get("exists"):
        q += " AND audio_file IN (SELECT path FROM lst)"
    return q, base


def _per_file_query(name):
    from voxframe.sources.specs import SPECS
    spec = SPECS[name]
    root = ROOT.format(name)
    q, base = _per_file_sql(name)
    files = f"SELECT doc_id, {FILE_PATHS[name]} AS path, text AS content FROM documents"
    extra = f", lst AS (SELECT audio_file AS path FROM ({base.replace('FROM files', 'FROM files')}) b JOIN files USING (path) WHERE files.doc_id % 7 <> 0)" \
        if spec.get("exists") else ""

    @register(f"src_{name}", oracle(f"WITH files AS ({files}){extra} {q}"))
    def _q(spark, sf):
        f = _files_df(spark, sf, name)
        lst = None
        if spec.get("exists"):
            p0 = FS.parse_per_file(f.drop("doc_id"), name, root)
            lst = p0.join(f.select("path", "doc_id"), "path").where(F.col("doc_id") % 7 != 0).select(
                F.col("audio_file").alias("path"))
        return FS.parse_per_file(f.drop("doc_id"), name, root, IGNORED, listing=lst)


for _n in FILE_PATHS:
    _per_file_query(_n)


@register("src_synpaflex", oracle("""
WITH w AS (SELECT concat('/data/synpaflex/', CASE WHEN doc_id % 2 = 0 THEN 'wav/' ELSE 'book/' END, doc_id, '.wav') AS audio_file, doc_id, text FROM documents),
t AS (SELECT CASE WHEN doc_id % 2 = 0 THEN concat('/data/synpaflex/txt/', doc_id, '.txt') ELSE concat('/data/synpaflex/book/txt/', doc_id, '.txt') END AS txt_path,
  string_split(text, chr(10))[1] AS text FROM documents WHERE doc_id % 9 <> 0)
SELECT t.text, w.audio_file, 'synpaflex' AS speaker_name, '/data/synpaflex' AS root_path FROM w JOIN t ON t.txt_path =
  CASE WHEN contains(w.audio_file, '/wav/') THEN replace(w.audio_file, 'wav', 'txt')
  ELSE concat(regexp_replace(w.audio_file, '/[^/]*$', ''), '/txt/', replace(string_split(w.audio_file, '/')[-1], '.wav', '.txt')) END"""))
def _src_synpaflex(spark, sf):
    d = V.table(spark, sf, "documents")
    wavs = d.select(F.concat(F.lit("/data/synpaflex/"), F.when(F.col("doc_id") % 2 == 0, "wav/").otherwise("book/"),
                             "doc_id", F.lit(".wav")).alias("path"))
    txts = d.where(F.col("doc_id") % 9 != 0).select(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/data/synpaflex/txt/"), "doc_id", F.lit(".txt")))
        .otherwise(F.concat(F.lit("/data/synpaflex/book/txt/"), "doc_id", F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"))
    return FS.synpaflex_pairs(wavs, txts, "/data/synpaflex")


VOX_PATH = "concat('/data/vox{n}/wav/id', 10000 + doc_id % 40, '/vid', doc_id % 7, '/', doc_id, '.wav')"


def _vox_query(n):
    @register(f"src_voxceleb{n}", oracle(f"""
SELECT NULL AS text, p AS audio_file, concat('voxcel{n}_', string_split(p, '/')[-3]) AS speaker_name,
  starts_with(string_split(p, '/')[-3], 'id') AS valid_speaker, (SELECT count(*) FROM documents) >= {148000 if n == 1 else 1000000} AS enough
FROM (SELECT {VOX_PATH.format(n=n)} AS p FROM documents)"""))
    def _q(spark, sf):
        lst = V.table(spark, sf, "documents").select(F.expr(VOX_PATH.format(n=n)).alias("path"))
        return FS.voxceleb_items(lst, str(n))


for _n in (1, 2):
    _vox_query(_n)


SAM_ROOT = "/data/sam"


@register("src_sam_accenture", oracle(f"""
SELECT text, concat('{SAM_ROOT}/vo_voice_quality_transformation/sam', doc_id, '.wav') AS audio_file, 'sam_accenture' AS speaker_name,
  '{SAM_ROOT}' AS root_path FROM documents WHERE doc_id % 7 <> 0"""))
def _src_sam_accenture(spark, sf):
    """XML files with one ``fileid`` element a document; every seventh has no audio."""
    d = V.table(spark, sf, "documents")
    path = f"{workdir(spark, 'sam')}/voice_over_recordings"
    (d.select(F.concat(F.lit("sam"), "doc_id").alias("_id"), F.col("text").alias("_VALUE")).write.format("xml")
     .option("rootTag", "files").option("rowTag", "fileid").save(path))
    listing = d.where(F.col("doc_id") % 7 != 0).select(
        F.concat(F.lit(f"{SAM_ROOT}/vo_voice_quality_transformation/sam"), "doc_id", F.lit(".wav")).alias("path"))
    return FS.sam_items(spark, path, SAM_ROOT, listing)


@register("src_voxceleb_index", oracle(f"""
WITH l AS (SELECT {VOX_PATH.format(n=1)} AS path, n_chars * 10 AS len FROM documents),
s AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS speaker_id FROM (SELECT DISTINCT string_split(path, '/')[-3] AS name FROM l))
SELECT l.path AS wav_filename, l.len AS wav_length_ms, s.speaker_id, s.name AS speaker_name FROM l JOIN s ON string_split(l.path, '/')[-3] = s.name"""))
def _src_voxceleb_index(spark, sf):
    lst = V.table(spark, sf, "documents").select(F.expr(VOX_PATH.format(n=1)).alias("path"), (F.col("n_chars") * 10).alias("len"))
    return FS.voxceleb_index(lst, "len")


@register("src_asr_segments", oracle("SELECT conv_id, turn AS seg, pos AS word_idx, word, start_s AS start, end_s AS \"end\" FROM words",
                                     "words", rnd=("start", "end")))
def _src_asr_segments(spark, sf):
    w = V.words(spark, sf)
    segs = w.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "word", F.col("start_s").alias("start"), F.col("end_s").alias("end")))).alias("ws"))
    per = segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.transform("ws", lambda t: F.struct(t["word"].alias("word"), t["start"].alias("start"),
                                                     t["end"].alias("end"))).alias("words")))).alias("segments"))
    js = per.select("conv_id", F.to_json(F.struct(F.transform("segments", lambda s: F.struct(s["words"].alias("words")))
                                                  .alias("segments"))).alias("json"))
    return FS.asr_words(js, "conv_id")


@register("src_embedding_file", oracle("""
SELECT clip_key, name, CAST(len(embedding) AS BIGINT) AS dim, embedding[1] AS e_first FROM dvec""", "dvec", rnd=("e_first",)))
def _src_embedding_file(spark, sf):
    d = V.dvec(spark, sf).withColumn("f", F.floor(F.col("vec_id") / 50))
    files = d.groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("clip_key", F.struct("name", "embedding")))).alias("m"))
    js = files.select(F.to_json("m").alias("json"))
    e = FS.embedding_file(js)
    return e.select("clip_key", "name", F.size("embedding").cast("long").alias("dim"), F.element_at("embedding", 1).alias("e_first"))


@register("src_voices", oracle("""
SELECT voice, CAST(count(*) AS BIGINT) AS n_clips, min(path) AS first_clip FROM (
  SELECT source AS voice, concat('voices/', source, '/', doc_id, '.wav') AS path FROM documents) GROUP BY 1"""))
def _src_voices(spark, sf):
    lst = V.table(spark, sf, "documents").select(F.concat(F.lit("voices/"), "source", F.lit("/"), "doc_id", F.lit(".wav")).alias("path"))
    v = FS.voices(lst)
    return v.select("voice", F.size("clips").cast("long").alias("n_clips"), F.element_at("clips", 1).alias("first_clip"))
