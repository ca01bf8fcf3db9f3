"""Embedding store queries (2.9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import embed as EM
from voxframe.operators import nearest as NN
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import H

LONG = "lf AS (SELECT clip_key, name, vec_id, dim, embedding[dim + 1] AS x FROM (SELECT *, unnest(range(0, len(embedding))) AS dim FROM dvec))"


def _stats(df):
    return df.select("clip_key", "name", F.size("embedding").cast("long").alias("dim"),
                     F.element_at("embedding", 1).alias("e_first"),
                     F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v).alias("e_sum"))


STATS_SQL = "CAST(len(embedding) AS BIGINT) AS dim, embedding[1] AS e_first, list_sum(embedding) AS e_sum"


@register("emb_upsert", oracle("""
WITH o AS (SELECT clip_key, name, embedding FROM dvec WHERE vec_id % 3 = 0),
n AS (SELECT clip_key, concat('new_', name) AS name, embedding FROM dvec WHERE vec_id % 2 = 0)
SELECT coalesce(n.clip_key, o.clip_key) AS clip_key, coalesce(n.name, o.name) AS name,
  CASE WHEN n.name IS NOT NULL THEN 'new' ELSE 'old' END AS source, coalesce(n.embedding, o.embedding)[1] AS e_first
FROM o FULL OUTER JOIN n ON o.clip_key = n.clip_key""", "dvec", rnd=("e_first",)))
def _emb_upsert(spark, sf):
    d = V.dvec(spark, sf)
    old = d.where(F.col("vec_id") % 3 == 0)
    new = d.where(F.col("vec_id") % 2 == 0).withColumn("name", F.concat(F.lit("new_"), "name"))
    u = EM.upsert(old, new)
    return u.select("clip_key", "name", "source", F.element_at("embedding", 1).alias("e_first"))


@register("emb_union_unique", oracle("SELECT clip_key, name FROM dvec", "dvec"))
def _emb_union_unique(spark, sf):
    d = V.dvec(spark, sf)
    return EM.union_unique([d.where(F.col("vec_id") % 2 == 0), d.where(F.col("vec_id") % 2 == 1)]).select("clip_key", "name")


@register("emb_summary", oracle("""
SELECT count(*) AS n_embeddings, count(DISTINCT name) AS n_names, CAST(max(len(embedding)) AS BIGINT) AS dim FROM dvec""", "dvec"))
def _emb_summary(spark, sf):
    return EM.summary(V.dvec(spark, sf))


@register("emb_by_clip", oracle(f"""
SELECT clip_key, name, {STATS_SQL} FROM dvec WHERE clip_key IN (SELECT concat('clip#', doc_id) FROM labels)""",
                                "dvec", rnd=("e_first", "e_sum")))
def _emb_by_clip(spark, sf):
    keys = V.table(spark, sf, "labels").select(F.concat(F.lit("clip#"), "doc_id").alias("clip_key"))
    return _stats(V.dvec(spark, sf).join(keys, "clip_key", "left_semi"))


@register("emb_by_name", oracle("""
SELECT name, count(*) AS n_vectors, sum(embedding[1]) AS first_sum FROM dvec GROUP BY name""", "dvec", rnd=("first_sum",)))
def _emb_by_name(spark, sf):
    return V.dvec(spark, sf).groupBy("name").agg(
        F.count("embedding").alias("n_vectors"),
        F.coalesce(F.sum(F.element_at("embedding", 1)), F.lit(0.0)).alias("first_sum"))


@register("emb_mean", oracle(f"""
WITH {LONG}, r AS (SELECT *, dense_rank() OVER (PARTITION BY name ORDER BY vec_id) AS r FROM lf)
SELECT name, dim, avg(x) AS mean FROM r WHERE r <= 5 GROUP BY name, dim""", "dvec", rnd=("mean",)))
def _emb_mean(spark, sf):
    return EM.mean_by_name(V.dvec(spark, sf), num_samples=5)


@register("emb_mean_clips", oracle(f"""
WITH {LONG} SELECT name, dim, avg(x) AS mean FROM lf WHERE clip_key IN (SELECT concat('clip#', doc_id) FROM labels) GROUP BY name, dim""",
                                   "dvec", rnd=("mean",)))
def _emb_mean_clips(spark, sf):
    """Means over the listed reference clips of each voice: those that are labelled."""
    listed = V.table(spark, sf, "labels").select(F.concat(F.lit("clip#"), "doc_id").alias("clip_key"))
    return EM.mean_by_name(V.dvec(spark, sf).join(listed, "clip_key", "left_semi"))


@register("emb_random", oracle(f"SELECT clip_key, name FROM dvec ORDER BY {H(0, 'clip_key')}, clip_key LIMIT 1", "dvec"))
def _emb_random(spark, sf):
    from voxframe.functions.core import md5_key
    return V.dvec(spark, sf).orderBy(md5_key(0, "clip_key"), "clip_key").limit(1).select("clip_key", "name")


@register("emb_l2norm", oracle("""
SELECT clip_key, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS norm_after, e[1] AS e_first FROM (
  SELECT clip_key, list_transform(embedding, lambda v: v / sqrt(list_sum(list_transform(embedding, lambda w: w * w)))) AS e FROM dvec)""",
                               "dvec", rnd=("norm_after", "e_first")))
def _emb_l2norm(spark, sf):
    x = V.dvec(spark, sf).select("clip_key", EM.l2_normalise(F.col("embedding")).alias("e"))
    return x.select("clip_key", EM.norm(F.col("e")).alias("norm_after"), F.element_at("e", 1).alias("e_first"))


COS_SQL = f"""{LONG},
cs AS (SELECT name AS c_name, dim, sum(x) AS s, count(*) AS n FROM lf GROUP BY 1, 2),
j AS (SELECT lf.clip_key, lf.name, cs.c_name, lf.x,
  CASE WHEN cs.c_name = lf.name THEN (cs.s - lf.x) / (cs.n - 1) ELSE cs.s / cs.n END AS c FROM lf JOIN cs ON lf.dim = cs.dim),
cos AS (SELECT clip_key, name, c_name, greatest(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 1e-6) AS cos FROM j GROUP BY ALL)"""


@register("emb_cos_matrix", oracle(f"WITH {COS_SQL} SELECT * FROM cos", "dvec", rnd=("cos",)))
def _emb_cos_matrix(spark, sf):
    return EM.cosine_matrix(V.dvec(spark, sf))


LOSS_SQL = f"""WITH {COS_SQL},
s AS (SELECT *, 10.0 * cos - 5.0 AS s FROM cos),
g AS (SELECT clip_key, max(s) FILTER (WHERE c_name = name) AS s_own, max(s) AS s_max,
  max(s) FILTER (WHERE c_name <> name) AS s_other FROM s GROUP BY 1),
l0 AS (SELECT s.clip_key, ln(sum(exp(s.s - g.s_max))) AS lsum FROM s JOIN g USING (clip_key) GROUP BY 1),
l AS (SELECT g.clip_key, g.s_max + l0.lsum - g.s_own AS softmax_loss,
  1.0 - 1.0 / (1.0 + exp(-g.s_own)) + 1.0 / (1.0 + exp(-g.s_other)) AS contrast_loss FROM g JOIN l0 USING (clip_key))"""


@register("emb_softmax_loss", oracle(LOSS_SQL + "\nSELECT avg(softmax_loss) AS softmax_loss FROM l", "dvec", rnd=("softmax_loss",)))
def _emb_softmax_loss(spark, sf):
    return EM.ge2e_losses(EM.cosine_matrix(V.dvec(spark, sf))).agg(F.avg("softmax_loss").alias("softmax_loss"))


@register("emb_contrast_loss", oracle(LOSS_SQL + "\nSELECT avg(contrast_loss) AS contrast_loss FROM l", "dvec", rnd=("contrast_loss",)))
def _emb_contrast_loss(spark, sf):
    return NN.contrast_loss(NN.nearest_names(V.dvec(spark, sf))).agg(F.avg("contrast_loss").alias("contrast_loss"))


@register("emb_accuracy", oracle(f"""
WITH {COS_SQL},
p AS (SELECT clip_key, name, arg_max(c_name, (cos, c_name)) AS pred FROM cos GROUP BY 1, 2),
a AS (SELECT name AS class, avg(CAST(pred = name AS DOUBLE)) AS accuracy FROM p GROUP BY 1)
SELECT class, accuracy FROM a UNION ALL SELECT NULL, avg(accuracy) FROM a""", "dvec", rnd=("accuracy",)))
def _emb_accuracy(spark, sf):
    return EM.accuracy(NN.nearest_names(V.dvec(spark, sf)))


CODE_SQL = f"""{LONG},
cb AS (SELECT vec_id AS code, dim, x AS e FROM lf WHERE vec_id < 32),
d AS (SELECT lf.vec_id, cb.code, sum(lf.x * lf.x) - 2 * sum(lf.x * cb.e) + sum(cb.e * cb.e) AS dist
  FROM lf JOIN cb ON lf.dim = cb.dim GROUP BY 1, 2),
a AS (SELECT vec_id, arg_min(code, (dist, code)) AS code, greatest(min(dist), 0.0) AS dist FROM d GROUP BY 1)"""


def _codes(spark, sf):
    d = V.dvec(spark, sf)
    cb = d.where(F.col("vec_id") < 32).select(F.col("vec_id").alias("code"), "embedding")
    return EM.nearest_code(d, cb), cb


@register("emb_codebook", oracle(f"WITH {CODE_SQL} SELECT * FROM a", "dvec", rnd=("dist",)))
def _emb_codebook(spark, sf):
    a, _ = _codes(spark, sf)
    return a.withColumn("dist", F.greatest("dist", F.lit(0.0)))


@register("emb_code_usage", oracle(f"""
WITH {CODE_SQL}, c AS (SELECT code, count(*) AS n FROM a GROUP BY 1),
k AS (SELECT DISTINCT vec_id AS code FROM dvec WHERE vec_id < 32)
SELECT k.code, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (SELECT count(*) FROM a) AS share,
  coalesce(c.n, 0) / (SELECT count(*) FROM a) > 0.9 OR coalesce(c.n, 0) / (SELECT count(*) FROM a) < 0.01 AS flagged
FROM k LEFT JOIN c ON k.code = c.code""", "dvec", rnd=("share",)))
def _emb_code_usage(spark, sf):
    a, cb = _codes(spark, sf)
    return EM.code_usage(a, cb)


def text_embedder(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in user model: 64-bin character-code histogram, unit length."""
    for pdf in it:
        vecs = []
        for t in pdf["text"].fillna(""):
            h = np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % 64, minlength=64).astype(np.float64)
            n = np.linalg.norm(h)
            vecs.append((h / n if n else h).tolist())
        yield pd.DataFrame({"clip_key": pdf["clip_key"], "embedding": vecs})


@register("emb_compute", oracle("""
SELECT concat('clip#', doc_id) AS clip_key, source AS name, CASE WHEN v.clip_key IS NULL THEN 'computed' ELSE 'reused' END AS origin,
  CAST(coalesce(len(v.embedding), 64) AS BIGINT) AS dim FROM documents d LEFT JOIN dvec v ON v.clip_key = concat('clip#', doc_id)""", "dvec"))
def _emb_compute(spark, sf):
    """Reuse stored vectors, embed only the gaps with a model in mapInPandas."""
    docs = V.table(spark, sf, "documents").select(F.concat(F.lit("clip#"), "doc_id").alias("clip_key"),
                                                  F.col("source").alias("name"), "text")
    old = V.dvec(spark, sf).select("clip_key", F.col("embedding").alias("old_embedding"))
    j = docs.join(old, "clip_key", "left")
    have = j.where(F.col("old_embedding").isNotNull()).select("clip_key", "name", F.col("old_embedding").alias("embedding"),
                                                              F.lit("reused").alias("origin"))
    gaps = j.where(F.col("old_embedding").isNull()).select("clip_key", "name", "text")
    new = gaps.select("clip_key", "text").mapInPandas(text_embedder, "clip_key string, embedding array<double>")
    new = new.join(gaps.select("clip_key", "name"), "clip_key").withColumn("origin", F.lit("computed"))
    out = have.unionByName(new.select("clip_key", "name", "embedding", "origin"))
    return out.select("clip_key", "name", "origin", F.size("embedding").cast("long").alias("dim"))
