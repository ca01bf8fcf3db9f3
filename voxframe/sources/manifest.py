"""One reader for every manifest layout.

``read_manifest(spark, path, spec)`` reads the files as text lines (with
their source path from ``_metadata.file_path``), then ``parse_lines`` turns
lines into utterance rows with column expressions only - split, element
access, templates, regex path parts - plus joins for ignored speakers and
file existence. ``parse_sql`` renders the same spec as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.core import global_position, join_same
from voxframe.operators.text import WS
from voxframe.sources.specs import SPECS

FIELDS = ["text", "audio_file", "speaker_name", "emotion_name", "ref_file", "language"]


def read_manifest(spark: SparkSession, path: str, spec_name: str, root: str, **kw) -> DataFrame:
    spec = SPECS[spec_name]
    r = spark.read.option("encoding", spec.get("encoding", "UTF-8")).option("lineSep", "\n").text(path)
    lines = r.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"),
                     F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("block_start"))
    return parse_lines(lines, spec_name, root, **kw)


# ------------------------------------------------------------ Spark rendering

def _ops(c: Column, ops) -> Column:
    for op in ops:
        if op == "trim":
            c = F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
        elif op == "nospace":
            c = F.replace(c, F.lit(" "), F.lit(""))
        elif op == "mp3wav":
            c = F.replace(c, F.lit(".mp3"), F.lit(".wav"))
        elif op == "upto_us":
            c = F.split_part(c, F.lit("_"), F.lit(1))
        elif op == "chapter":
            c = F.split_part(c, F.lit("_"), F.lit(2))
        else:
            raise ValueError(op)
    return c


def _part(p, root: str, ctx: dict) -> Column:
    k = p[0]
    if k == "lit":
        return F.lit(p[1])
    if k == "root":
        return F.lit(root)
    if k == "col":
        return _ops(F.try_element_at(F.col("_cols"), F.lit(p[1] + 1)), p[2:])
    if k == "name":
        return _ops(F.try_element_at(F.col("_cols"), ctx["pos"][p[1]]), p[2:])
    if k == "path_re":
        return F.nullif(F.regexp_extract("file_path", p[1], p[2]), F.lit(""))
    if k == "path_dir":
        return F.regexp_replace("file_path", "/[^/]*$", "")
    if k == "field":
        return F.col(f"_{p[1]}")
    raise ValueError(k)


def _template(parts, root, ctx) -> Column:
    return F.concat(*[_part(p, root, ctx) for p in parts])


def parse_lines(lines: DataFrame, spec_name: str, root: str, ignored: Sequence[str] = (),
                listing: DataFrame | None = None) -> DataFrame:
    """``lines(line_no, line[, file_path])`` -> utterance rows of the layout. Layouts
    with a header read column names from the first line of each file."""
    spec = SPECS[spec_name]
    x = lines if "file_path" in lines.columns else lines.withColumn("file_path", F.lit(None).cast("string"))
    if spec.get("nancy"):
        return _nancy(x, spec, root)
    if spec.get("strip_line"):
        x = x.withColumn("line", F.regexp_replace("line", f"^{WS}+|{WS}+$", ""))
    if spec.get("skip_prefix"):
        x = x.where(~F.col("line").startswith(spec["skip_prefix"]))
    sep = spec["sep"]
    x = x.withColumn("_cols", F.split("line", re.escape(sep), -1))
    ctx: dict = {"pos": {}}
    if spec.get("header"):
        # every file has a header of its own: its first line, whichever split that came in
        start = F.col("block_start") if "block_start" in x.columns else F.lit(0)
        heads = x.groupBy("file_path").agg(
            F.min_by(F.struct("_cols", "line_no"), F.struct(start, F.col("line_no"))).alias("_head"))
        # one row a file, of which the driver holds the listing anyway; all lines of one file would meet in one task
        x = join_same(x, F.broadcast(heads), ["file_path"])
        names = F.col("_head._cols")
        for f in ("text", "audio", "speaker", "ref", "language", "emotion"):
            for p in spec.get(f, []):
                if p[0] == "name":
                    ctx["pos"][p[1]] = F.array_position(names, F.lit(p[1])).cast("int")
        x = x.where(F.col("line_no") != F.col("_head.line_no"))
    if spec.get("exact_fields"):
        x = x.where(F.size("_cols") == spec["exact_fields"])
    out = {
        "text": _template(spec["text"], root, ctx) if "text" in spec else F.lit(None).cast("string"),
        "audio_file": _template(spec["audio"], root, ctx),
        "emotion_name": (_template(spec["emotion"], root, ctx) if "emotion" in spec
                         else F.lit(spec.get("emotion_default")).cast("string")),
        "ref_file": (F.coalesce(_template(spec["ref"], root, ctx), F.lit(spec.get("ref_default"))) if "ref" in spec
                     else F.lit(None).cast("string")),
        "language": _template(spec["language"], root, ctx) if "language" in spec else F.lit(None).cast("string"),
    }
    if "speaker_const" in spec:
        spk = F.lit(spec["speaker_const"])
    elif "speaker" in spec:
        spk = _template(spec["speaker"], root, ctx)
        if "speaker_default" in spec:
            spk = F.coalesce(spk, F.lit(spec["speaker_default"]))
    else:
        spk = F.lit(None).cast("string")
    raw = _template(spec["raw_speaker"], root, ctx) if "raw_speaker" in spec else spk
    y = x.select("line_no", *[v.alias(k) for k, v in out.items()], spk.alias("speaker_name"), raw.alias("_raw"))
    if "speaker_by_line_pair" in spec:
        y = global_position(y, ["line_no"], out="_p")
        y = y.withColumn("speaker_name", F.concat(F.lit(spec["speaker_by_line_pair"]),
                                                  (1 + F.floor((F.col("_p") - 1) / 2)).cast("string"))).drop("_p")
    if spec.get("require_speaker"):
        y = y.where(F.col("speaker_name").isNotNull())
    if ignored and spec.get("ignore_on"):
        col = "_raw" if spec["ignore_on"] == "raw_speaker" else "speaker_name"
        ig = lines.sparkSession.createDataFrame([(s,) for s in ignored], f"{col} string")
        y = y.join(F.broadcast(ig), on=col, how="left_anti")  # a handful of names
    if listing is not None and spec.get("exists"):
        y = y.join(listing.select(F.col("path").alias("audio_file")).distinct(), on="audio_file", how="left_semi")
    y = y.withColumn("root_path", F.lit(root))
    if listing is not None and spec.get("require_all"):
        y = require_listed(y, listing)
    return y.select("line_no", *FIELDS, "root_path")


def require_listed(items: DataFrame, listing: DataFrame) -> DataFrame:
    """``items`` whose audio all exists; a file that is not listed fails the job."""
    have = listing.select(F.col("path").alias("audio_file")).distinct().withColumn("_listed", F.lit(True))
    j = items.join(have, on="audio_file", how="left")
    missing = F.raise_error(F.concat(F.lit("audio file does not exist: "), F.coalesce("audio_file", F.lit("null"))))
    ok = F.when(F.col("_listed"), F.col("audio_file")).otherwise(missing.cast("string"))
    return j.withColumn("audio_file", ok).select(*items.columns)


def _nancy(x: DataFrame, spec: dict, root: str) -> DataFrame:
    """``( id "text" )``: id is the second whitespace token, text sits between
    the first quote and the character before the last quote."""
    line = F.col("line")
    p1 = F.instr(line, '"')
    p2 = F.length(line) - F.instr(F.reverse(line), '"') + 1
    text = F.substring(line, p1 + 1, F.greatest(p2 - 2 - p1, F.lit(0)))
    uid = F.element_at(F.split(F.regexp_replace(line, f"^{WS}+", ""), f"{WS}+"), 2)
    return x.select("line_no", text.alias("text"), F.concat(F.lit(root), F.lit(spec["audio_prefix"]), uid, F.lit(".wav")).alias("audio_file"),
                    F.lit(spec["speaker_const"]).alias("speaker_name"), F.lit(None).cast("string").alias("emotion_name"),
                    F.lit(None).cast("string").alias("ref_file"), F.lit(None).cast("string").alias("language"),
                    F.lit(root).alias("root_path"))


# ------------------------------------------------------------ SQL rendering

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ops_sql(e: str, ops) -> str:
    for op in ops:
        if op == "trim":
            e = f"regexp_replace({e}, {_q(f'^{WS}+|{WS}+$')}, '', 'g')"
        elif op == "nospace":
            e = f"replace({e}, ' ', '')"
        elif op == "mp3wav":
            e = f"replace({e}, '.mp3', '.wav')"
        elif op == "upto_us":
            e = f"split_part({e}, '_', 1)"
        elif op == "chapter":
            e = f"split_part({e}, '_', 2)"
    return e


def _part_sql(p, root: str) -> str:
    k = p[0]
    if k == "lit":
        return _q(p[1])
    if k == "root":
        return _q(root)
    if k == "col":
        return _ops_sql(f"cols[{p[1] + 1}]", p[2:])
    if k == "name":
        return _ops_sql(f"cols[list_position(hdr.names, {_q(p[1])})]", p[2:])
    if k == "path_re":
        return f"nullif(regexp_extract(file_path, {_q(p[1])}, {p[2]}), '')"
    if k == "path_dir":
        return "regexp_replace(file_path, '/[^/]*$', '')"
    raise ValueError(k)


def _template_sql(parts, root) -> str:
    # ``||`` is NULL if any part is NULL, like Spark's concat
    return "(" + " || ".join(_part_sql(p, root) for p in parts) + ")" if len(parts) > 1 else _part_sql(parts[0], root)


def parse_sql(spec_name: str, root: str, lines: str = "lines", ignored: Sequence[str] = (), listing: str | None = None) -> str:
    """SQL text of ``parse_lines`` over a relation ``lines(line_no, line, file_path)``."""
    spec = SPECS[spec_name]
    if spec.get("nancy"):
        return f"""SELECT line_no, substring(line, p1 + 1, greatest(p2 - 2 - p1, 0)) AS text,
  concat({_q(root)}, {_q(spec['audio_prefix'])}, string_split(regexp_replace(regexp_replace(line, {_q(f'^{WS}+')}, '', 'g'), {_q(f'{WS}+')}, ' ', 'g'), ' ')[2], '.wav') AS audio_file,
  {_q(spec['speaker_const'])} AS speaker_name, NULL AS emotion_name, NULL AS ref_file, NULL AS language, {_q(root)} AS root_path
FROM (SELECT *, instr(line, '"') AS p1, length(line) - instr(reverse(line), '"') + 1 AS p2 FROM {lines})"""
    src = lines
    base = "line"
    if spec.get("strip_line"):
        base = f"regexp_replace(line, {_q(f'^{WS}+|{WS}+$')}, '', 'g')"
    where = []
    if spec.get("skip_prefix"):
        where.append(f"NOT starts_with({base}, {_q(spec['skip_prefix'])})")
    hdr_join = ""
    if spec.get("header"):
        hdr_join = (f", (SELECT string_split(line, {_q(spec['sep'])}) AS names, line_no AS first FROM {lines} "
                    f"ORDER BY line_no LIMIT 1) hdr")
        where.append("line_no > hdr.first")
    if spec.get("exact_fields"):
        where.append(f"len(string_split({base}, {_q(spec['sep'])})) = {spec['exact_fields']}")
    inner = (f"SELECT *, string_split({base}, {_q(spec['sep'])}) AS cols FROM {src}"
             + (" WHERE " + " AND ".join(w for w in where if "hdr" not in w) if any("hdr" not in w for w in where) else ""))
    hdr_where = " AND ".join(w for w in where if "hdr" in w)
    text = _template_sql(spec["text"], root) if "text" in spec else "NULL"
    audio = _template_sql(spec["audio"], root)
    emo = _template_sql(spec["emotion"], root) if "emotion" in spec else (
        _q(spec["emotion_default"]) if spec.get("emotion_default") else "NULL")
    ref = f"coalesce({_template_sql(spec['ref'], root)}, {_q(spec['ref_default'])})" if "ref" in spec else "NULL"
    lang = _template_sql(spec["language"], root) if "language" in spec else "NULL"
    if "speaker_const" in spec:
        spk = _q(spec["speaker_const"])
    elif "speaker" in spec:
        spk = _template_sql(spec["speaker"], root)
        if "speaker_default" in spec:
            spk = f"coalesce({spk}, {_q(spec['speaker_default'])})"
    else:
        spk = "NULL"
    raw = _template_sql(spec["raw_speaker"], root) if "raw_speaker" in spec else spk
    if "speaker_by_line_pair" in spec:
        spk = f"({_q(spec['speaker_by_line_pair'])} || CAST(1 + (row_number() OVER (ORDER BY line_no) - 1) // 2 AS VARCHAR))"
    sel = (f"SELECT line_no, {text} AS text, {audio} AS audio_file, {spk} AS speaker_name, {emo} AS emotion_name, "
           f"{ref} AS ref_file, {lang} AS language, {raw} AS _raw FROM ({inner}) x{hdr_join}"
           + (f" WHERE {hdr_where}" if hdr_where else ""))
    conds = []
    if spec.get("require_speaker"):
        conds.append("speaker_name IS NOT NULL")
    if ignored and spec.get("ignore_on"):
        col = "_raw" if spec["ignore_on"] == "raw_speaker" else "speaker_name"
        conds.append(f"({col} IS NULL OR {col} NOT IN ({', '.join(_q(s) for s in ignored)}))")
    if listing and spec.get("exists"):
        conds.append(f"audio_file IN (SELECT path FROM {listing})")
    out = (f"SELECT line_no, text, audio_file, speaker_name, emotion_name, ref_file, language, {_q(root)} AS root_path "
           f"FROM ({sel}) y")
    if conds:
        out += " WHERE " + " AND ".join(conds)
    return out
