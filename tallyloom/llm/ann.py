"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

A vector's code is the signs of 64 rotated components; the rotation is learned on a bounded sample (principal axes, then iterative
quantisation). Codes are cut into four substrings of 16 bits, each with an index of its own. Two codes within a radius r differ by
at most r div 4 bits in one substring at least, so probing each index within that distance meets every code within r; those are
ranked again by the vectors themselves. Where fewer than k codes lie within the radius, it is widened until k do.

Largest inner product is nearest direction once each vector has one more component that brings it to the greatest length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import spread

BITS, PARTS = 64, 4
#: Vectors that the rotation and the radius are learned on, at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
ROUNDS = 30
#: Share of a sample's true neighbours that the radius has to hold.
HELD = 0.93
INDEX_BLOCK, QUERY_BLOCK, STEP = 1 << 15, 1 << 12, 64
TIES = 1e-9


@dataclass(frozen=True)
class Codes:
    """What is learned: a projection to BITS components, the greatest length, and the radius."""

    projection: np.ndarray
    longest: float
    radius: int

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        more = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return self._signs(np.c_[x, more])

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._signs(np.c_[x / np.sqrt((x * x).sum(1))[:, None], np.zeros(len(x))])

    def _signs(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.projection > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def learn(x: np.ndarray, longest: float, k: int) -> Codes:
    """Fit the rotation so that signs lose little of the projected vectors, and the radius on the sample's own neighbours."""
    unit = x / longest
    lifted = np.c_[unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(1)))]
    lifted /= np.sqrt((lifted * lifted).sum(1))[:, None]
    rng = np.random.default_rng(0)
    _, axes = np.linalg.eigh(lifted.T @ lifted)
    axes = axes[:, ::-1][:, :BITS]
    if axes.shape[1] < BITS:  # few components: several rotations of them side by side
        axes = np.concatenate([axes @ np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0] for _ in range(-(-BITS // axes.shape[1]))], axis=1)[:, :BITS]
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    flat = lifted @ axes
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    codes = Codes(axes @ turn, longest, BITS)
    ask = x[:SAMPLE_QUERIES]
    near = ask @ x.T
    near[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    apart = np.bitwise_count(codes.of_queries(ask)[:, None] ^ codes.of_rows(x)[best])
    return Codes(codes.projection, longest, int(np.quantile(apart, HELD, method="higher")) if apart.size else BITS)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null or zero, all components finite, of the table's usual length."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.col("vec_id").isNotNull())
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    values = flat.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def fit(rows: DataFrame, k: int) -> Codes | None:
    """Learn codes on SAMPLE_ROWS usable vectors; the greatest length is taken over all. None for an empty table."""
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("m")).first()["m"]
    if longest is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    return learn(np.array([r["v"] for r in sample]), longest, k)


def with_codes(rows: DataFrame, codes: Codes, queries: bool = False) -> DataFrame:
    """(vec_id, v) to (vec_id, v, code): the index's rows, or those of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                code = (codes.of_queries if queries else codes.of_rows)(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.view(np.int64))], names=["vec_id", "v", "code"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, code long")


def retrieve(index: np.ndarray, asked: np.ndarray, radius: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (first query, query number, row): every code within the radius of each query; a wider one where fewer than k are."""
    parts = index.view(np.uint16).reshape(-1, PARTS)
    tables = [np.unique(parts[:, j], return_inverse=True) for j in range(PARTS)]
    for first in range(0, len(asked), STEP):
        some = asked[first : first + STEP]
        keys = some.view(np.uint16).reshape(-1, PARTS)
        met = np.zeros((len(some), len(index)), bool)
        for j, (values, place) in enumerate(tables):
            met |= (np.bitwise_count(values ^ keys[:, j, None]) <= radius // PARTS)[:, place]
        query, row = np.nonzero(met)
        near = np.bitwise_count(index[row] ^ some[query]) <= radius
        query, row = query[near], row[near]
        few = np.flatnonzero(np.bincount(query, minlength=len(some)) < min(k + 1, len(index)))  # one more: the query itself may be there
        if len(few):
            apart = np.bitwise_count(index ^ some[few, None])
            wide = np.sort(apart, axis=1)[:, min(k, len(index) - 1)]
            more, hit = np.nonzero(apart <= wide[:, None])
            keep = ~np.isin(query, few)
            query, row = np.r_[query[keep], few[more]], np.r_[row[keep], hit]
        yield first, query, row


def _best(codes: Codes, k: int):
    """For one block of rows and one block of queries: each query's k nearest of the rows that the index retrieves."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, x, index = rows["vec_id"].to_numpy(), _matrix(rows["v"]), rows["code"].to_numpy().view(np.uint64)
            asked, q = queries["vec_id"].to_numpy(), _matrix(queries["v"])
            for first, query, row in retrieve(index, queries["code"].to_numpy().view(np.uint64), codes.radius, k):
                query = query + first
                other = ids[row] != asked[query]
                query, row = query[other], row[other]
                near = np.einsum("ij,ij->i", q[query], x[row])
                order = np.lexsort((-near, query))
                query, row, near = query[order], row[order], near[order]
                start = np.searchsorted(query, query, "left")
                rank = np.arange(len(query)) - start
                last = np.minimum(start + k - 1, np.searchsorted(query, query, "right") - 1)
                keep = (rank < k) | (near >= near[last] - TIES)
                query, row = query[keep], row[keep]
                # the measure itself, summed in one order for all, so that like vectors get like numbers
                score = np.zeros(len(query))
                for d in range(x.shape[1]):
                    score += q[query, d] * x[row, d]
                order = np.lexsort((ids[row], -score, query))
                query, row, score = query[order], row[order], score[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
                for into, what in zip(found, (asked[query[keep]], ids[row[keep]], score[keep]), strict=True):
                    into.append(what)
        columns = [np.concatenate(f) if f else np.zeros(0) for f in found]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    return run


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """Each query's k nearest rows by inner product: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    ``is_query``: condition on vec_id. A row of the query's own id is no candidate. Vectors that are null, zero, not finite, of an
    unusual length or without an id take no part. Rows and queries meet block by block, of a fixed number of rows each; a block of
    rows gives k rows for a query. Repeated rows of an id may be found more than once. An empty table gives no rows.
    """
    rows = usable(vectors)
    codes = fit(rows, k)
    result = "query_id long, rank int, vec_id long, score double"
    if codes is None:
        return rows.sparkSession.createDataFrame([], result)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks = max(-(-counts["n"] // INDEX_BLOCK), min(spread(rows.sparkSession), -(-counts["n"] // 2048)))
    asks = max(1, -(-counts["q"] // QUERY_BLOCK))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = with_codes(rows, codes).select("vec_id", "v", "code", mine(blocks).alias("block"), each(asks).alias("ask"))
    queries = with_codes(rows.where(is_query), codes, queries=True).select("vec_id", "v", "code", each(blocks).alias("block"), mine(asks).alias("ask"))
    met = index.groupBy("block", "ask").cogroup(queries.groupBy("block", "ask")).applyInArrow(_best(codes, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
