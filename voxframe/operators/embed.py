"""Speaker / clip embedding stores: upserts, unions, lookups, means,
normalisation, GE2E similarity and losses, accuracy, codebook assignment.

Vectors are ``array<double>`` columns. Element-wise work stays in
higher-order functions (one projection); per-name means go through
``posexplode`` + ``groupBy(name, dim)``, a hash aggregate with map-side
combine, so a name with millions of clips never needs one task. Similarity
against centroids is an equi-join on a speaker *batch* id: each vector meets
at most ``batch_names`` centroids (as GE2E does per training batch), never
every speaker of the corpus. Codebook assignment is an Arrow-batched numpy
matrix product against a broadcast codebook of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.core import global_position, join_same, md5_key, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """``a`` at unit length; a zero vector stays one."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), x))


def upsert(old: DataFrame, new: DataFrame, key: str = "clip_key") -> DataFrame:
    """New rows replace old ones with the same key; the rest of the old store stays."""
    o = old.select(key, F.col("name").alias("_on"), F.col("embedding").alias("_oe"))
    n = new.select(key, F.col("name").alias("_nn"), F.col("embedding").alias("_ne"))
    j = o.join(n, on=key, how="full_outer")
    return j.select(key, F.coalesce("_nn", "_on").alias("name"), F.coalesce("_ne", "_oe").alias("embedding"),
                    F.when(F.col("_nn").isNotNull(), "new").otherwise("old").alias("source"))


def union_unique(stores: list[DataFrame], key: str = "clip_key") -> DataFrame:
    """Union of stores; a key present twice fails the job."""
    u = stores[0]
    for s in stores[1:]:
        u = u.unionByName(s)
    dups = u.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1))).scalar()
    return u.where(F.assert_true(dups == 0, "duplicate embedding keys").isNull())


def summary(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_embeddings"), F.count_distinct("name").alias("n_names"),
                     F.max(F.size("embedding")).cast("long").alias("dim"))


def long_form(store: DataFrame, keys=("clip_key", "name")) -> DataFrame:
    return store.select(*keys, F.posexplode("embedding").alias("dim", "x"))


def mean_by_name(store: DataFrame, num_samples: int | None = None, randomize: bool = False,
                 order: str = "vec_id", seed: int = 0) -> DataFrame:
    """Mean vector per name (long form ``name, dim, mean``); optionally of the
    first (or seeded random) ``num_samples`` vectors of each name."""
    s = store
    if num_samples is not None:
        from pyspark.sql import Window
        ordering = [md5_key(seed, F.col(order)), F.col(order)] if randomize else [F.col(order)]
        w = Window.partitionBy("name").orderBy(*ordering)  # planned as a window group limit
        s = s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= num_samples).drop("_r")
    return long_form(s).groupBy("name", "dim").agg(F.avg("x").alias("mean"))


def centroid_sums(store: DataFrame) -> DataFrame:
    """Per name: element-wise sum vector and count, rebuilt in dim order."""
    lf = store.select("name", F.posexplode("embedding").alias("dim", "x"))
    s = lf.groupBy("name", "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    g = s.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("_a"),
                                     F.max("n").alias("n"))
    return g.select(F.col("name").alias("c_name"), F.transform("_a", lambda t: t["s"]).alias("c_sum"),
                    F.col("n").alias("c_n"))


def cosine_matrix(store: DataFrame, batch_names: int = 64, salts: int = 64, floor: float = 1e-6) -> DataFrame:
    """GE2E similarity of every vector with every name's centroid; its own
    centroid is the mean without the vector itself. Floored at 1e-6, which is
    also the similarity where there is none: with a zero vector, and of the only
    vector of a name with its own centroid. Null is a name.

    The matrix itself is the result. Centroids lie in blocks of
    ``batch_names``, each block under ``salts`` keys; every vector meets every
    block under one key drawn from its own, so no task holds a block's row of
    the whole store.
    """
    cs = centroid_sums(store)
    at = global_position(cs.select("c_name"), ["c_name"], out="_r").withColumn(
        "batch", F.floor((F.col("_r") - 1) / batch_names).cast("long")).drop("_r")
    cs = join_same(cs, at, ["c_name"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    last = at.agg(F.max("batch")).scalar()
    x = store.withColumn("salt", F.pmod(F.xxhash64("clip_key"), F.lit(salts)).cast("int"))
    x = x.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0).cast("long")))))
    j = x.join(cs, on=["batch", "salt"])
    own = F.col("c_name").eqNullSafe(F.col("name"))
    cent = F.when(own, F.zip_with("c_sum", "embedding", lambda s, v: F.try_divide(s - v, F.col("c_n") - 1))) \
        .otherwise(F.transform("c_sum", lambda s: s / F.col("c_n")))
    j = j.withColumn("_c", cent)
    cos = F.try_divide(dot(F.col("embedding"), F.col("_c")), norm(F.col("embedding")) * norm(F.col("_c")))
    return j.select("clip_key", "name", "c_name", F.greatest(cos, F.lit(floor)).alias("cos"))


def ge2e_losses(cos: DataFrame, w: float = 10.0, b: float = -5.0) -> DataFrame:
    """Per vector: softmax loss ``-log softmax(s)[own]`` and contrast loss
    ``1 - sigmoid(s_own) + max sigmoid(s_other)``, with ``s = w*cos + b``. A
    cosine is at most 1, so ``|w| + b`` is the shift that keeps the sum of
    exponentials in range, and no logits are gathered."""
    s = cos.withColumn("s", F.lit(w) * F.col("cos") + F.lit(b))
    own = F.col("c_name").eqNullSafe(F.col("name"))
    top = abs(w) + b
    g = s.groupBy("clip_key", "name").agg(
        F.max(F.when(own, F.col("s"))).alias("s_own"),
        F.max(F.when(~own, F.col("s"))).alias("s_other_max"),
        F.sum(F.exp(F.col("s") - top)).alias("_sum"))
    lse = F.lit(top) + F.log("_sum")
    sig = lambda v: 1.0 / (1.0 + F.exp(-v))
    return g.select("clip_key", "name", (lse - F.col("s_own")).alias("softmax_loss"),
                    (1.0 - sig(F.col("s_own")) + sig(F.col("s_other_max"))).alias("contrast_loss"))


def centroid_accuracy(cos: DataFrame) -> DataFrame:
    """``accuracy`` of the most similar centroid of a whole similarity matrix."""
    return accuracy(cos.groupBy("clip_key", "name").agg(F.max_by("c_name", F.struct("cos", F.col("c_name"))).alias("pred")))


def accuracy(pred: DataFrame) -> DataFrame:
    """Accuracy of ``pred`` per class (``name``) and the macro mean (``class``
    null). A null label fails the job."""
    per, _ = written(pred.groupBy(F.col("name").alias("class")).agg(
        F.avg((F.col("pred") == F.col("name")).cast("double")).alias("accuracy")), "class-accuracy")  # a row per class, used three times
    nulls = per.where(F.col("class").isNull()).agg(F.count(F.lit(1))).scalar()
    macro = per.agg(F.avg("accuracy").alias("accuracy")).select(F.lit(None).cast("string").alias("class"), "accuracy")
    out = per.unionByName(macro)
    return out.where(F.assert_true(nulls == 0, "null class label").isNull())


def nearest_code(vectors: DataFrame, codebook: DataFrame, key: str = "vec_id", max_codes: int = 1 << 20, tile: int = 1024) -> DataFrame:
    """Nearest code by squared distance ``|x|^2 - 2 x.e + |e|^2``.

    The codebook is checked to be at most ``max_codes`` rows, collected once
    and shipped to the tasks; vectors stream through ``mapInPandas`` in Arrow
    batches, and products are taken in tiles of bounded size.
    """
    n = codebook.count()
    if n > max_codes:
        raise ValueError(f"codebook of {n} codes exceeds {max_codes}")
    rows = codebook.orderBy("code").select("code", "embedding").collect()
    codes = np.array([r["code"] for r in rows], dtype=np.int64)
    emb = np.array([r["embedding"] for r in rows], dtype=np.float64)
    e2 = (emb ** 2).sum(1)

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            best, dist = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            for a in range(0, len(x), tile):
                rows = x[a:a + tile]
                x2 = (rows ** 2).sum(1, keepdims=True)
                for c in range(0, len(emb), tile):
                    d = x2 - 2.0 * rows @ emb[c:c + tile].T + e2[None, c:c + tile]
                    i = d.argmin(1)  # first minimum: lowest code on ties
                    low = d[np.arange(len(i)), i]
                    better = low < dist[a:a + tile]
                    best[a:a + tile][better], dist[a:a + tile][better] = (i + c)[better], low[better]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "code": codes[best], "dist": dist})

    return vectors.select(key, "embedding").mapInPandas(assign, f"{key} long, code long, dist double")


def code_usage(assigned: DataFrame, codebook: DataFrame, hi: float = 0.9, lo: float = 0.01) -> DataFrame:
    total = assigned.agg(F.count(F.lit(1))).scalar()
    c = assigned.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    x = codebook.select("code").join(c, on="code", how="left").fillna(0, subset=["n"])
    share = F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0))  # of no vector, no code has a share
    return x.select("code", "n", share.alias("share"), ((share > hi) | (share < lo)).alias("flagged"))
