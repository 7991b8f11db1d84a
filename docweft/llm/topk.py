"""Exact top-k search by inner product over integer vectors, with block-at-a-time pruning.

Rows are put into parts by ranges of their ids. Inside a part neighbours are made alike
and ranges of ``BLOCK`` rows are its blocks. A block keeps the largest and the smallest value of every term (component) and a
forward index, the rows' values side by side. For a query a block's bound is the sum
over terms of query * largest or query * smallest, whichever is more. Blocks are taken
in order of falling bounds and scored through their forward index, until the next
bound is below the k-th best score so far (a bound equal to it is still scored,
because a tie can go to a smaller id). Each part gives its k best per query; the best
of those are the result.

Query rows are packed in chunks, chunks meet parts by an equi-join on the part; no
chunk or part grows with the input. Arithmetic is exact: float64 products where all
sums stay below 2**53, whole numbers of Python otherwise (scores outside 64 bits are
cut to its limits). A component that leaves 64 bits when scaled counts as the nearest number of 64 bits.

Left out: null ids, null vectors, vectors with null or non-finite components. Vectors
of unequal length are padded with zeros. A query has no rows of its own id among its
results. Ties go to the smaller id; repeated rows are results of their own. With
fewer than k candidates all are returned; an empty table gives no rows. Other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

BLOCK, PART, CHUNK = 64, 8192, 2048


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")))


def _pack(rows: list) -> tuple[str, int, bytes]:
    """(type, width, bytes) of rows of whole numbers, in the smallest type that holds them."""
    out = np.zeros((len(rows), max(1, *map(len, rows))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    high, low = int(out.max(initial=0)), int(out.min(initial=0))
    kind = next(k for k in ("i2", "i4", "i8") if -(1 << (8 * int(k[1]) - 1)) <= low and high < 1 << (8 * int(k[1]) - 1))
    return kind, out.shape[1], out.astype(kind).tobytes()


def _unpack(kind: str, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def ranges(rows: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of rows in which neighbours are alike: halved at the median of the widest component until a block is left."""
    todo, done = [np.arange(len(rows))], []
    while todo:
        own = todo.pop()
        if len(own) <= block:
            done.append(own)
            continue
        half = -(-len(own) // (2 * block)) * block
        by = rows[own][:, rows[own].std(0).argmax()] if rows.shape[1] else own
        order = own[np.argsort(by, kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, int)


def search_part(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK, stride: int = 4):
    """(query row, id, score) of the k best of one part for each query, and the number of blocks scored."""
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = _padded(rows, width), _padded(queries, width)
    order = ranges(rows, block)
    ids, rows = ids[order], rows[order]
    top = max(1, abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * max(1, abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))) * max(1, width)
    kind = np.float64 if top < 1 << 53 else object
    rows, queries = rows.astype(kind), queries.astype(kind)
    starts = np.arange(0, len(rows), block)
    high = np.array([rows[s : s + block].max(0) for s in starts], kind)
    low = np.array([rows[s : s + block].min(0) for s in starts], kind)
    zero = np.zeros_like(queries)
    bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    found, scored, limit = [], 0, (1 << 63) - 1
    for q, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
        best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
        falling = np.argsort(-bounds[q], kind="stable")
        for first in range(0, len(falling), stride):
            if len(best_s) == k and bounds[q][falling[first]] < best_s[-1]:
                break
            at = (starts[falling[first : first + stride], None] + np.arange(block)).ravel()
            at = at[at < len(rows)]
            scored += -(-len(at) // block)
            s, i = rows[at] @ query, ids[at]
            fits = i != own
            if len(best_s) == k:
                fits &= s >= best_s[-1]
            s, i = np.concatenate([best_s, s[fits]]), np.concatenate([best_i, i[fits]])
            best = np.lexsort((i, -s))[:k] if kind is np.float64 else sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k]  # noqa: B023
            best_s, best_i = s[best], i[best]
        found += [(q, int(i), max(-limit - 1, min(limit, int(s)))) for i, s in zip(best_i, best_s, strict=True)]
    return found, scored


def _packed(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows in n ranges of (vec_id, row), each packed to one row; repeated ids don't make a range longer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, vs = [], []
        for b in batches:
            ids += list(b["vec_id"])
            vs += list(b["v"])
        if ids:
            kind, width, data = _pack(vs)
            yield pd.DataFrame({key: [TaskContext.get().partitionId()], f"{key}_ids": [np.array(ids, np.int64).tobytes()], f"{key}_kind": [kind], f"{key}_width": [width], f"{key}_data": [data]})

    return rows.repartitionByRange(n, "vec_id", "row").select("vec_id", "v").mapInPandas(run, f"{key} bigint, {key}_ids binary, {key}_kind string, {key}_width int, {key}_data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, part: int = PART, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Queries are the rows for which ``is_query`` holds, candidates all rows of other ids."""
    work = Workspace(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = work.keep(rows.filter("vec_id is not null and v is not null").select("*", F.monotonically_increasing_id().alias("row")), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).first()
    parts, chunks = max(1, -(-size["n"] // part)), max(1, -(-(size["q"] or 0) // chunk))
    docs = work.keep(_packed(rows, parts, "part"), "parts")
    # queries of one id and vector have one result
    asks = work.keep(_packed(rows.filter("asks").dropDuplicates(["vec_id", "v"]), chunks, "chunk"), "chunks")
    # the stated queries against all rows, block by block: each chunk is dealt to every part by the part's number
    last = docs.agg(F.max("part")).first()[0] or 0  # the ranges that were made, which needn't be as many as were asked for
    sent = asks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("part"))
    # about one pair to a task, since a pair is the unit of work and of memory
    pairs = sent.join(docs, "part").repartition(max(1, min((last + 1) * chunks, 20_000)), "chunk", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                asked = np.frombuffer(r.chunk_ids, np.int64)
                found, _ = search_part(np.frombuffer(r.part_ids, np.int64), _unpack(r.part_kind, r.part_width, r.part_data), asked, _unpack(r.chunk_kind, r.chunk_width, r.chunk_data), k, block)
                yield pd.DataFrame([(r.chunk, q, asked[q], i, s) for q, i, s in found], columns=["chunk", "place", "query_id", "vec_id", "score"])

    local = pairs.mapInPandas(run, "chunk bigint, place int, query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("chunk", "place").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
