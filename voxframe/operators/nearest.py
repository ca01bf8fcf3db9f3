"""Most similar centroid of every vector, exactly, without the full matrix.

Centroids lie in cells around pivots, which are centroids themselves. On the
unit sphere the chord is a metric, so with a vector's distances to the pivots
the triangle inequality rules out whole cells, and inside a cell all centroids
whose own distance to the pivot differs by more than the bound. What is left is
an equi-join on the cell with that comparison behind it; the products taken are
the rows of that join. The pivots are of a bounded number, the only vectors
that the driver and every task see; an index of few pivots is slower, never wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.core import join_same, md5_key, same_keys, written
from voxframe.operators.embed import centroid_sums, dot, norm

#: Bound on the pivots, whatever the number of names.
PIVOTS = 256
#: Chords are square roots of sums rounded at 1e-16: what differs by less is kept.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length at unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def _usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has a direction: ``dim`` finite components, not all zero."""
    n = norm(F.col(vector))
    return df.where((F.size(vector) == dim) & (n > 0) & (n < float("inf")))


def candidates(store: DataFrame, sums: DataFrame, pivots: int = PIVOTS, seed: int = 0) -> DataFrame:
    """``clip_key, embedding, c_name, c_sum, c_n``: for every vector of ``store``
    a set of other names' centroids that holds all its most similar ones."""
    usable = sums.where(norm(F.col("c_sum")) > 0)
    chosen = usable.orderBy(md5_key(seed, "c_name"), "c_name").limit(pivots).select("c_name", "c_sum").collect()
    cols = {f: store.schema[f].dataType.simpleString() for f in ("clip_key", "name", "embedding")}
    of = usable.schema["c_name"].dataType.simpleString()
    if not chosen:
        empty = ", ".join(f"{c} {cols[c]}" for c in ("clip_key", "embedding"))
        return store.sparkSession.createDataFrame([], f"{empty}, c_name {of}, c_sum array<double>, c_n long")
    dim = max(len(r["c_sum"]) for r in chosen)
    chosen = [r for r in chosen if len(r["c_sum"]) == dim]
    at = np.array([r["c_sum"] for r in chosen], dtype=np.float64)
    at /= np.sqrt((at * at).sum(1, keepdims=True))
    names = [r["c_name"] for r in chosen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _chords(_matrix(b.column("c_sum")), at)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                                 names=[*b.schema.names, "cell", "c_far"])

    members = _usable(usable, "c_sum", dim).select("c_name", "c_sum", "c_n").mapInArrow(
        place, f"c_name {of}, c_sum array<double>, c_n long, cell int, c_far double")
    low, high = np.full(len(at), np.inf), np.full(len(at), -np.inf)
    for r in members.groupBy("cell").agg(F.min("c_far").alias("low"), F.max("c_far").alias("high")).collect():  # a row per pivot
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _chords(_matrix(b.column("embedding")), at)
            others = d.copy()
            own = pc.index_in(b.column("name"), pa.array(names, b.column("name").type)).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(~np.isnan(own.astype(np.float64)))
            others[mine, own[mine].astype(np.int64)] = np.inf
            bound = others.min(1) + SLACK  # some other centroid is as near as that
            row, cell = np.nonzero(np.maximum(d - high, low - d) <= bound[:, None])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("clip_key").take(take), b.column("name").take(take), b.column("embedding").take(take),
                 pa.array(cell.astype(np.int32)), pa.array(d[row, cell]), pa.array(bound[row])],
                names=["clip_key", "name", "embedding", "cell", "far", "bound"])

    asked = _usable(store, "embedding", dim).select("clip_key", "name", "embedding").mapInArrow(
        ask, ", ".join(f"{c} {t}" for c, t in cols.items()) + ", cell int, far double, bound double")
    near = (F.abs(asked["far"] - members["c_far"]) <= asked["bound"]) & ~asked["name"].eqNullSafe(members["c_name"])
    j = asked.join(members, (asked["cell"] == members["cell"]) & near)
    return j.select("clip_key", "embedding", "c_name", "c_sum", "c_n")


def nearest_names(store: DataFrame, floor: float = 1e-6, pivots: int = PIVOTS, salts: int = 16) -> DataFrame:
    """``clip_key, name, own_cos, other_cos, pred`` of every vector: its cosine
    with its name's centroid (the mean without the vector itself), the greatest
    with another name's (null where there is no other), and the name of the most
    similar of all.

    The values are those of ``cosine_matrix``: floored, also where there is no
    cosine (zero vectors, the only vector of a name); ties go to the greatest
    name, and where nothing exceeds the floor all names tie. Null is a name,
    the smallest. ``clip_key`` is unique. Sums are written to the shared folder.
    """
    sums, _ = written(centroid_sums(store), "centroid-sums")
    c = candidates(store, sums, pivots)
    mean = F.transform("c_sum", lambda s: s / F.col("c_n"))
    c = c.withColumn("_c", mean).withColumn(
        "cos", F.try_divide(dot(F.col("embedding"), F.col("_c")), norm(F.col("embedding")) * norm(F.col("_c"))))
    best = c.groupBy("clip_key").agg(F.max(F.struct("cos", "c_name")).alias("_best")).select(
        F.col("clip_key").alias("_key"), "_best")

    salted = store.select("clip_key", "name", "embedding").withColumn("_salt", F.pmod(F.xxhash64("clip_key"), F.lit(salts)).cast("int"))
    mine = sums.select(F.col("c_name").alias("name"), "c_sum", "c_n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    x = join_same(salted, mine, ["name", "_salt"])  # a name's vectors lie in ``salts`` tasks or more
    x = x.withColumn("_c", F.zip_with("c_sum", "embedding", lambda s, v: F.try_divide(s - v, F.col("c_n") - 1)))
    own = F.try_divide(dot(F.col("embedding"), F.col("_c")), norm(F.col("embedding")) * norm(F.col("_c")))
    x = x.select("clip_key", "name", F.greatest(own, F.lit(floor)).alias("own_cos"))
    x = x.join(best, same_keys(x, best, [("clip_key", "_key")]), "left").drop("_key")

    many = sums.agg(F.count(F.lit(1))).scalar()
    last = sums.agg(F.max("c_name")).scalar()
    other = F.when(many > 1, F.greatest(F.col("_best.cos"), F.lit(floor)))
    x = x.withColumn("other_cos", other)
    of_two = F.greatest(F.struct(F.col("own_cos").alias("cos"), F.col("name").alias("c_name")),
                        F.struct(F.coalesce("other_cos", F.lit(floor)).alias("cos"), F.col("_best.c_name").alias("c_name")))
    pred = F.when(F.greatest("own_cos", F.coalesce("other_cos", F.lit(floor))) > floor, of_two["c_name"]).otherwise(last)
    return x.select("clip_key", "name", "own_cos", "other_cos", pred.alias("pred"))


def contrast_loss(nearest: DataFrame, w: float = 10.0, b: float = -5.0) -> DataFrame:
    """``1 - sigmoid(s_own) + max sigmoid(s_other)`` with ``s = w*cos + b``, ``w > 0``:
    the most similar other name has the greatest sigmoid, so the rest is not asked."""
    if w <= 0:
        raise ValueError("w must be positive")

    def sig(cos: str):
        return 1.0 / (1.0 + F.exp(-(F.lit(w) * F.col(cos) + F.lit(b))))

    return nearest.select("clip_key", "name", (1.0 - sig("own_cos") + sig("other_cos")).alias("contrast_loss"))
