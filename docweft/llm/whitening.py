"""PCA whitening of vectors: Chan's merge of centred moments, eigh on the driver, a second pass that verifies.

1. A component c becomes the whole number z = floor(scale * c), and x = z + shift. A row's z
   are packed into bytes (smallest type that holds them, zeros at the end cut off), so that equal
   vectors are equal bytes. The fit list is every distinct vector once; copies are merged in
   the task that reads them before they move, so a hot vector doesn't make a hot task.
2. Each partition of the fit list has its count n, its exact sums S and its scatter, centred on
   its own mean before multiplying. Two partitions are merged by Chan's formula,
   scatter = A + B + (n_a * n_b / n) * d d^T with d the difference of the means, which is
   taken from the exact sums; a treeReduce merges all of them. A partition passes on width**2 numbers.
3. The driver takes eigenvalues e and unit eigenvectors of V = scatter / n.
4. A second pass over the fit list merges the moments of the whitened vectors in the same way;
   ``identity_error`` is the largest absolute entry of their covariance minus the identity.

Everything is centred as (n*z - S) / n with an exact numerator, so the large constant in x costs no digit.

Left out: null vectors, vectors with null or non-finite components. Vectors of unequal length
are filled up with components of 0. A component beyond 64 bits after scaling counts as the nearest
number of 64 bits; a ``deviation`` beyond 64 bits is null. Components whose
eigenvalue is below 1e-12 of the largest have none to divide by: their ``whitened`` is null and they have no part in
``identity_error``; so have all where only one distinct vector is left (``explained`` is null then). A null vec_id is
carried along; repeated rows are rows of their own in the result and one in the fit. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import fresh
from .workspace import Workspace

KINDS, LEAST, RANK = ("i1", "i2", "i4", "i8"), -(1 << 63), 1e-12


class Moments(NamedTuple):
    """Count, sums (Python's whole numbers, or doubles) and centred scatter."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    def padded(self, width: int) -> Moments:
        more = width - len(self.sums)
        return self if more <= 0 else Moments(self.n, np.concatenate([self.sums, np.zeros(more, int).astype(self.sums.dtype)]), np.pad(self.scatter, (0, more)))


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula."""
    width = max(len(a.sums), len(b.sums))
    a, b = a.padded(width), b.padded(width)
    if not a.n or not b.n:
        return a if a.n else b
    d = ((b.sums * a.n - a.sums * b.n) / (a.n * b.n)).astype(float)
    return Moments(a.n + b.n, a.sums + b.sums, a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / (a.n + b.n)))


NOTHING = Moments(0, np.zeros(0, object), np.zeros((0, 0)))


def times_n_less(z: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * z - sums, exactly: 64 bits where they hold it, whole numbers of Python elsewhere."""
    most = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    return n * z - sums.astype(np.int64) if most < 1 << 63 else n * z.astype(object) - sums


def moments(z: np.ndarray) -> Moments:
    """Of the rows of a matrix of whole numbers (sums exact) or of doubles."""
    n = len(z)
    if z.dtype.kind == "f":
        sums = z.sum(0)
        centred = z - sums / n
    else:
        near = abs(int(z.max(initial=0))) < 1 << 31 and abs(int(z.min(initial=0))) < 1 << 31
        sums = z.sum(0).astype(object) if near else z.astype(object).sum(0)
        centred = (times_n_less(z, n, sums) / n).astype(float)
    return Moments(n, sums, centred.T @ centred)


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(numbers of the rows that take part, matrices of z): rows of one length side by side, in the order of the first."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    flat = pc.cast(lists.flatten(), pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    rows, found = [], []
    for k in np.unique(lengths[lengths >= 0]):
        own = np.flatnonzero(lengths == k)
        c = values[(ends[own] - k)[:, None] + np.arange(k)]
        whole = np.isfinite(c).all(1)
        with np.errstate(over="ignore"):
            z = np.floor(c[whole] * scale)
        low, high = z < LEAST, z >= -LEAST
        z = np.where(low | high, 0, z).astype(np.int64)
        z[low], z[high] = LEAST, -LEAST - 1
        rows.append(own[whole])
        found.append(z)
    return (np.concatenate(rows) if rows else np.zeros(0, int)), found


def packed(z: np.ndarray) -> list[bytes]:
    """A row's bytes: its type and its numbers, without zeros at the end."""
    if not z.shape[1]:
        return [b"\0"] * len(z)
    low, high = z.min(1), z.max(1)
    kind = sum((low < -(1 << s)) | (high >= 1 << s) for s in (7, 15, 31)).astype(int)
    last = np.where((z != 0).any(1), z.shape[1] - (z != 0)[:, ::-1].argmax(1), 0)
    forms = [z.astype(f"<{k}") if (kind == i).any() else None for i, k in enumerate(KINDS)]
    return [bytes([k]) + forms[k][i, :n].tobytes() for i, (k, n) in enumerate(zip(kind.tolist(), last.tolist(), strict=True))]


def unpacked(rows: list[bytes], width: int = 0) -> np.ndarray:
    each = [np.frombuffer(r, f"<{KINDS[r[0]]}", offset=1) for r in rows]
    out = np.zeros((len(each), max([width, *map(len, each)])), np.int64)
    for i, r in enumerate(each):
        out[i, : len(r)] = r
    return out


def _moments_of(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """Moments of all rows of the fit list, merged in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NOTHING
        for b in batches:
            if b.num_rows:
                own = merged(own, moments(of(unpacked(b.column("key").to_pylist()))))
        exact = own.sums.dtype == object
        yield pa.RecordBatch.from_pydict({"n": [own.n], "exact": [[str(s) for s in own.sums] if exact else None], "sums": [None if exact else own.sums.tolist()], "scatter": [own.scatter.tobytes()]}, schema=pa.schema([("n", pa.int64()), ("exact", pa.list_(pa.string())), ("sums", pa.list_(pa.float64())), ("scatter", pa.binary())]))

    def read(r) -> Moments:
        sums = np.array([int(s) for s in r["exact"]], object) if r["exact"] is not None else np.array(r["sums"], float)
        return Moments(r["n"], sums, np.frombuffer(bytes(r["scatter"])).reshape(len(sums), len(sums)))

    states = fit.mapInArrow(local, "n bigint, exact array<string>, sums array<double>, scatter binary").rdd.map(read)
    # a table without files has no partition, hence nothing to reduce
    return states.treeReduce(merged) if states.getNumPartitions() else NOTHING


class Model(NamedTuple):
    n: int
    sums: np.ndarray  # of z
    axes: np.ndarray  # one column a component, divided by the root of its eigenvalue; NaN where there is none
    explained: list[float | None]
    identity_error: float | None


def _axes(m: Moments, most: int) -> tuple[np.ndarray, list[float | None]]:
    v = m.scatter / m.n
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    trace = float(np.trace(v))
    usable = e > RANK * max(e.max(initial=0), 0)
    return np.where(usable, u / np.sqrt(np.where(usable, e, 1)), np.nan), [float(max(x, 0) / trace) if trace else None for x in e]


def _whiten(z: np.ndarray, n: int, sums: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whitened rows, n * z - sums)."""
    z = np.pad(z, ((0, 0), (0, len(sums) - z.shape[1])))
    d = times_n_less(z, n, sums)
    return (d / n).astype(float) @ axes, d


def fit(keys: DataFrame, components: int = 16) -> Model | None:
    """The model of a list of distinct packed vectors; None where it is empty."""
    m = _moments_of(keys, lambda z: z)
    if not m.n:
        return None
    axes, explained = _axes(m, components)
    usable = ~np.isnan(axes).any(0)
    n, sums, good = m.n, m.sums, axes[:, usable]
    error = None
    if usable.any():
        w = _moments_of(keys, lambda z: _whiten(z, n, sums, good)[0])
        error = float(np.abs(w.scatter / w.n - np.eye(len(w.sums))).max())
    return Model(n, sums, axes, explained, error)


def _squares(d: np.ndarray) -> list[int | None]:
    most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0)))) if d.size else 0
    if most * most * max(1, d.shape[1]) < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(1).tolist()
    out = [sum(int(x) ** 2 for x in r) for r in d]
    return [x if x < 1 << 63 else None for x in out]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every vector that takes part."""
    spark, named = vectors.sparkSession, vectors.schema[vec_id].dataType.simpleString()
    work = Workspace(spark, "whitening")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [k for z in quantised(b.column("v"), scale)[1] for k in packed(z)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.binary())})

    distinct = work.keep(rows.select("v").mapInArrow(keys, "key binary").distinct(), "fit", batch=4096)
    model = fit(distinct, components)
    out_schema = f"vec_id {named}, deviation bigint, whitened array<double>"
    if model is None:
        return _long(spark.createDataFrame([], out_schema), [], None, None)
    n, sums, axes = model.n, model.sums, model.axes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = quantised(b.column("v"), scale)
            done = [_whiten(z, n, sums, axes) for z in found]
            if len(at):
                flat = np.concatenate([w for w, _ in done]).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, axes.shape[1], dtype=np.int32) if axes.shape[1] else np.zeros(len(at) + 1, np.int32), pa.array(flat, from_pandas=True))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array([s for _, d in done for s in _squares(d)], pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return _long(rows.mapInArrow(apply, out_schema), model.explained, n, model.identity_error)


def _long(rows: DataFrame, explained: list[float | None], n: int | None, error: float | None) -> DataFrame:
    """One row per vector and component."""
    share = F.array(*[F.lit(x).cast("double") for x in explained]) if explained else F.array().cast("array<double>")
    (at,) = fresh(rows, "at")
    flat = rows.select("vec_id", "deviation", F.posexplode("whitened").alias(at, "whitened"))
    return flat.select("vec_id", (F.col(at) + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col(at)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
