"""Centroid clustering by Walsh-Hadamard progressive search, in whole numbers.

Vectors become integers, floor(SCALE * x), and go through the Walsh-Hadamard
transform, which multiplies every squared distance by the number of components
and leaves it exact. Coefficients are kept in order of sequency (sign changes):
the first few hold the coarse shape. A vector is compared with all centroids on
the first coefficient; the one that looks best is finished at once and bounds
the rest. Differences are then added band by band, coarse to fine, and a
centroid whose part is already strictly greater than the bound is dropped. Those
left at the end have all coefficients added, so ties are true ties and go to
the smaller number.

The transform is linear: sums of a cluster are taken over coefficients and
transformed back, so rounds read nothing but the coefficients. A task sends one
row of sums per cluster and limb (32 bits of a sum of any length); the driver
sees ``k`` centroids, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import staged

DIM = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = 2
#: Components below this size, and all that follows from them, fit in 64 bits.
NARROW = 1 << 24
#: Ends of the bands in which coefficients are added.
BANDS = (1, 2, 4, 8, 16, 32, 64)
_SLICE = 2048
_LIMB = 32


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows of DIM components, natural order."""
    half = 1
    while half < DIM:
        x = x.reshape(len(x), DIM // (2 * half), 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), DIM)
        half *= 2
    return x


def _by_sequency() -> np.ndarray:
    """Natural positions in ascending order of sign changes."""
    signs = transformed(np.eye(DIM, dtype=np.int64))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


ORDER = _by_sequency()


def coefficients(x: np.ndarray) -> np.ndarray:
    return transformed(x)[:, ORDER]


def components_of(c: np.ndarray) -> np.ndarray:
    """The vectors of which ``c`` are the coefficients (exact)."""
    natural = np.empty_like(c)
    natural[:, ORDER] = c
    return transformed(natural) // DIM


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python's where they are wide."""
    y = np.floor(x * SCALE)
    if not len(y) or np.abs(y).max() < NARROW:
        return y.astype(np.int64)
    return np.array([[int(np.floor(v * SCALE)) if abs(v) < 2.0 ** 900 else int(v) * SCALE for v in row]
                     for row in x.tolist()], object).reshape(x.shape)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest row of ``c`` for every row of ``v`` (ties: the
    smaller number) and the squared distance, both given as coefficients."""
    who, far = [], []
    for at in range(0, len(v), _SLICE):
        x = v[at:at + _SLICE]
        part = (x[:, None, 0] - c[None, :, 0]) ** 2
        guess = part.argmin(axis=1)
        bound = ((x - c[guess]) ** 2).sum(axis=1)
        row, cent = np.nonzero((part <= bound[:, None]).astype(bool))
        part = part[row, cent]
        for lo, hi in zip(BANDS, BANDS[1:], strict=False):
            part = part + ((x[row, lo:hi] - c[cent, lo:hi]) ** 2).sum(axis=1)
            left = (part <= bound[row]).astype(bool)
            row, cent, part = row[left], cent[left], part[left]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # every row keeps its guess
        least = np.minimum.reduceat(part, first)
        best = np.flatnonzero((part == least[row]).astype(bool))
        _, one = np.unique(row[best], return_index=True)
        who.append(cent[best[one]])
        far.append(least // DIM)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(far)


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, coefficients) of a batch: those in 64 bits, then the wide ones."""
    wide = b.column("wide")
    narrow = np.flatnonzero(wide.is_null().to_numpy(zero_copy_only=False))
    if len(narrow):
        flat = b.column("coefs").take(pa.array(narrow)).flatten().to_numpy(zero_copy_only=False)
        yield narrow, flat.reshape(-1, DIM)
    if len(narrow) < b.num_rows:
        rest = np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False))
        yield rest, np.array([[int(n) for n in wide[i].as_py().split(",")] for i in rest.tolist()], object).reshape(-1, DIM)


def _as_one(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if both fit."""
    if v.dtype == object or c.dtype == object:
        return v.astype(object), c.astype(object)
    return v, c


def _packed(rows: list[list[int]]) -> np.ndarray:
    """Coefficients of centroids as an array, in 64 bits if narrow."""
    wide = any(abs(n) >= NARROW * DIM for r in rows for n in r)
    return np.array(rows, object if wide else np.int64).reshape(-1, DIM)


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, coefs, wide`` of the rows whose embedding has DIM components,
    none null or non-finite. ``coefs`` are longs; where a component is NARROW or
    wider ``wide`` holds the coefficients as text instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            c = np.zeros((len(x), DIM), np.int64)
            wide: list[str | None] = [None] * len(x)
            is_wide = (np.abs(np.floor(x * SCALE)) >= NARROW).any(axis=1)
            c[~is_wide] = coefficients(whole_numbers(x[~is_wide]))
            for i in np.flatnonzero(is_wide).tolist():
                wide[i] = ",".join(map(str, coefficients(whole_numbers(x[i:i + 1]).astype(object))[0]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, DIM), pa.int32()), pa.array(c.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(wide, pa.string())], names=["vec_id", "coefs", "wide"])

    kind = table.schema[vec_id].dataType.simpleString()
    x = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.filter((F.size("x") == DIM) & ~bad).mapInArrow(run, f"vec_id {kind}, coefs array<bigint>, wide string")


def first_centroids(vecs: DataFrame, k: int, seed: int) -> np.ndarray:
    """Coefficients of the ``k`` vectors with the least SHA-256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = vecs.orderBy(key, "wide", "coefs").limit(k).collect()
    return _packed([[int(n) for n in r.wide.split(",")] if r.wide else list(r.coefs) for r in top])


def _limbs(sums: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(limb, its values) of integers of any length; only the last is signed."""
    n = 0
    while True:
        if (abs(sums) < 1 << _LIMB).all():
            yield n, [int(s) for s in sums]
            return
        yield n, [int(s) for s in sums & ((1 << _LIMB) - 1)]
        sums, n = sums >> _LIMB, n + 1


def _sums(c: np.ndarray):
    """Rows of (cluster, limb, members, sums of coefficients) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, members = np.zeros((len(c), DIM), object), [0] * len(c)
        for b in batches:
            for _, v in _read(b):
                who, _ = nearest(*_as_one(v, c))
                for j in np.unique(who).tolist():
                    own = v[who == j]
                    total[j] += own.sum(axis=0).astype(object)
                    members[j] += len(own)
        rows = [(j, limb, n if limb == 0 else 0, s) for j, n in enumerate(members) if n for limb, s in _limbs(total[j])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
            names=["cluster", "limb", "n", "sums"])

    return run, "cluster int, limb int, n bigint, sums array<bigint>"


def next_centroids(vecs: DataFrame, c: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its mean."""
    parts = vecs.select("coefs", "wide").mapInArrow(*_sums(c))
    got = parts.groupBy("cluster", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)]).collect()
    rows = components_of(c.astype(object)).tolist()
    sums, n = {}, {}
    for r in got:
        n[r.cluster] = n.get(r.cluster, 0) + r.n
        own = sums.setdefault(r.cluster, [0] * DIM)
        for i in range(DIM):
            own[i] += r[f"s{i}"] << (_LIMB * r.limb)
    for j, own in sums.items():
        rows[j] = [int(s) // n[j] for s in components_of(np.array([own], object))[0]]
    return _packed(coefficients(np.array(rows, object).reshape(-1, DIM)).tolist())


def assigned(vecs: DataFrame, c: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, v in _read(b):
                who, far = nearest(*_as_one(v, c))
                far = pa.array([int(d) if d < 1 << 63 else None for d in far], pa.int64()) if far.dtype == object else pa.array(far)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(who, pa.int32()), far],
                                                 names=["vec_id", "cluster", "distance"])

    kind = vecs.schema["vec_id"].dataType.simpleString()
    return vecs.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``
    per kept row of ``table``.

    Rows whose embedding is null, of another length, or holds a null or a
    non-finite component are left out. Repeated rows each count. Centroids start
    as the ``k`` rows of least hash (equal hashes, that is equal ids, by their
    vectors); with fewer rows there are fewer. Null ids hash as an empty id. Ties
    go to the smaller number, and an empty cluster keeps its centroid.
    Components of any size are exact; a distance or sum beyond a long is null.
    Other columns are not read; an empty table gives no rows.
    """
    vecs = staged(vectors(table, vec_id, embedding), "vectors")
    c = first_centroids(vecs, k, seed)
    for _ in range(rounds if len(c) else 0):
        c = next_centroids(vecs, c)
    out = staged(assigned(vecs, c), "assigned")
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(exact.alias("s")).collect()}  # at most k rows
    whole = None if None in sums.values() else int(sum(sums.values()))
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in components_of(c.astype(object)).tolist()]
    about = out.sparkSession.createDataFrame(
        [(j, fits(s), fits(whole), names[j]) for j, s in sums.items()],
        T.StructType.fromDDL("_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return out.join(F.broadcast(about), out["cluster"] == about["_cluster"]).drop("_cluster")
