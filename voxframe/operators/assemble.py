"""Corpus assembly: keys, unions, anti/semi joins against file listings,
stem pairing, id maps and lookups.

Lookups against small dimension tables (ignored speakers, id maps) are
broadcast; their size is bounded by the number of speakers / languages, not
by the number of clips. Joins against listings and feature stores are
regular equi-joins on the file key and are left to AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.core import global_position


def extra_keys(df: DataFrame, dataset: str, language: str | None, path: str = "audio_file",
               root: str = "root_path") -> DataFrame:
    """``language`` (row value, else the dataset's) and ``dataset#relpath-without-ext``."""
    rel = F.when(F.col(path).startswith(F.concat(F.col(root), F.lit("/"))),
                 F.expr(f"substring({path}, length({root}) + 2)")).otherwise(F.col(path))
    stem = F.regexp_replace(rel, r"\.[^./]*$", "")
    lang = F.coalesce(F.col("language"), F.lit(language)) if "language" in df.columns else F.lit(language)
    return df.withColumn("language", lang).withColumn(
        "audio_unique_name", F.concat(F.lit(dataset), F.lit("#"), stem))


def union_datasets(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of per-dataset tables by column name; missing columns become null."""
    out = None
    for name, df in parts:
        d = df.withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def drop_ignored(df: DataFrame, speakers: DataFrame, col: str = "speaker_name") -> DataFrame:
    """``left_anti`` against the (small, broadcast) ignored-speaker list."""
    return df.join(speakers.select(col).distinct(), on=col, how="left_anti")


def keep_existing(df: DataFrame, listing: DataFrame, path: str = "audio_file", lpath: str = "path") -> DataFrame:
    return df.join(listing.select(F.col(lpath).alias(path)).distinct(), on=path, how="left_semi")


def missing_files(df: DataFrame, listing: DataFrame, path: str = "audio_file", lpath: str = "path") -> DataFrame:
    return df.join(listing.select(F.col(lpath).alias(path)).distinct(), on=path, how="left_anti")


def require_audio(df: DataFrame, listing: DataFrame, path: str = "audio_file") -> DataFrame:
    """Pass ``df`` through, failing the job if any file is missing."""
    n_missing = missing_files(df, listing, path).agg(F.count(F.lit(1))).scalar()
    return df.where(F.assert_true(n_missing == 0, "missing audio files").isNull())


def field_count_check(lines: DataFrame, line: str, order: str, sep: str = "|") -> DataFrame:
    """Lines whose field count differs from the first line's."""
    nf = F.size(F.split(F.col(line), "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)).cast("long")
    first = lines.agg(F.min_by(nf, F.col(order))).scalar()
    return lines.select(order, nf.alias("n_fields")).where(F.col("n_fields") != first) \
        .withColumn("expected", first.cast("long"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pair_by_stem(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Full outer pairing on file stem; ``status`` reports one-sided stems."""
    x = a.select(stem(F.col(a_col)).alias("stem"), F.col(a_col))
    y = b.select(stem(F.col(b_col)).alias("stem"), F.col(b_col))
    j = x.join(y, on="stem", how="full_outer")
    st = (F.when(F.col(a_col).isNull(), f"missing_{a_col}")
          .when(F.col(b_col).isNull(), f"missing_{b_col}").otherwise("ok"))
    return j.withColumn("status", st)


def id_map(df: DataFrame, col: str, out: str = "id") -> DataFrame:
    """Sorted distinct names -> 0..n-1 (speakers, languages, emotions)."""
    d = df.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    return global_position(d, ["name"], out=out).withColumn(out, F.col(out) - 1)


def apply_ids(df: DataFrame, col: str, ids: DataFrame, out: str) -> DataFrame:
    return df.join(ids.select(F.col("name").alias(col), F.col("id").alias(out)), on=col, how="left")


def new_names(new: DataFrame, old: DataFrame, col: str) -> DataFrame:
    """Names in ``new`` that the restored map lacks (must be empty)."""
    return new.select(col).distinct().join(old.select(col).distinct(), on=col, how="left_anti")


def safe_filename(key: Column) -> Column:
    """URL-safe base64 of the UTF-8 key: reversible and path-safe."""
    return F.translate(F.base64(F.encode(key, "UTF-8")), "+/", "-_")


def from_safe_filename(name: Column) -> Column:
    return F.decode(F.unbase64(F.translate(name, "-_", "+/")), "UTF-8")
