"""The reference's own training-data pipeline, end to end, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import balance as B
from voxframe.operators import select as S
from voxframe.operators import split as SP
from voxframe.operators.text import script_of

KEY = "audio_unique_name"


def flagship(spark: SparkSession, sf_dir: str, batch_size: int = 8) -> DataFrame:
    u = V.utt(spark, sf_dir)
    kept = S.flt_length(u, min_text=20, max_text=20000, min_audio=50000, max_audio=20_000_000)
    # the text is wide and only its script is asked for at the end
    slim = kept.select(KEY, "speaker_name", "language", "audio_file", script_of(F.col("text")).alias("script"))
    split = SP.split_by_speaker(slim, KEY, "speaker_name", size=0.1, cap=256)
    train = split.where(F.col("split") == "train")
    batched = B.language_batches(train, KEY, "language", batch_size=batch_size)
    return B.batch_report(batched, "language", F.col("script"), "audio_file")
