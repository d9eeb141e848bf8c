"""A stored index for keyword and vector search: built once, updated by bucket, searched without its texts.

Chunks lie in buckets by the content that they are cut from. Inside a bucket they are taken together in segments of bounded
size, each an index of its own, so that building needs no shuffle but the one that deals the texts out:

* ``postings``: of each segment, cells of chunks of like length (one scope each); of each cell and term, one row with the
  chunks that hold it, and what bounds their scores: the greatest count and the least length. A common term is many rows.
* ``vectors``: of each segment, cells of neighbouring vectors, with their centre and the widest angle to it.

A keyword search reads the bounds of the asked terms, adds them up per query and cell, scores the best cells of each query for a
first idea of its k-th score, and then those cells whose bound reaches it. A vector search sends blocks of queries, bounded in bytes,
to where the cells lie; a cell is skipped for all queries whose k-th score it cannot reach by the triangle inequality of angles.
Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.retrieval import B, K1, RRF_CONSTANT, Scorer, rerank, terms
from tallyloom.operators.store import Store, bucket_of
from tallyloom.session import cut_lineage, spread

SEGMENT_CHUNKS, CELL_CHUNKS, CELL_VECTORS = 8192, 512, 128
#: Cells that each query is scored on first
FIRST_CELLS = 3
#: Terms of queries, and bytes of queries' vectors, that go to all tasks at a time
QUERY_TERMS, QUERY_BYTES = 1 << 19, 16 << 20
#: Rows of hits that go to all tasks to get their texts there
FEW_ROWS = 1 << 18
#: Scores are rounded to six digits; a cell is skipped if its bound is below the k-th score by more than the rounding
SLACK = 2e-6

SCHEMAS = {
    "chunks": "unit string, pos int, chunk_id long, chunk_text string, n_terms int, vec array<double>, scope string, path string",
    "postings": "term string, scope string, cell long, n long, max_tf int, min_terms int, ids array<long>, tfs array<int>, sizes array<int>",
    "vectors": "scope string, cell long, n int, dim int, centre array<double>, angle double, ids array<long>, matrix binary",
    "totals": "scope string, n_chunks long, n_terms long",
}
_POSTINGS = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("scope", pa.string()), ("cell", pa.int64()), ("n", pa.int64()), ("max_tf", pa.int32()), ("min_terms", pa.int32()),
                       ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])
_VECTORS = pa.schema([("bucket", pa.int32()), ("scope", pa.string()), ("cell", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("angle", pa.float64()),
                      ("ids", pa.list_(pa.int64())), ("matrix", pa.binary())])


def common(scope: str = "scope") -> Column:
    """A null scope is the common one."""
    return F.coalesce(F.col(scope), F.lit(""))


def visible(rows: DataFrame, scope: str | None) -> DataFrame:
    """Rows of a scope and the common ones; all rows without a scope."""
    return rows if scope is None else rows.where(F.col("scope").isin("", scope))


# ---- building -----------------------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one bucket, at most SEGMENT_CHUNKS at a time; the bucket is the first column."""
    held, size, bucket = [], 0, None

    def done():
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        buckets = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, len(buckets)]
        for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
            while a < z:
                if held and (buckets[a] != bucket or size >= SEGMENT_CHUNKS):
                    yield done()
                    held, size = [], 0
                to = min(z, a + SEGMENT_CHUNKS - size)
                held.append(batch.slice(a, to - a))
                size, bucket, a = size + to - a, buckets[a], to
    if held:
        yield done()


def _cells(keys: list[np.ndarray], order: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in ``order``, which goes by these keys first, cut into cells of ``size`` rows that agree in them."""
    sorted_keys = [k[order] for k in keys]
    cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])) + 1
    return [part[i : i + size] for part in np.split(order, cuts) for i in range(0, len(part), size)]


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, scope, chunk_id, terms) to postings."""
    for segment in _segments(batches):
        bucket, scopes, ids = segment.column(0)[0].as_py(), segment.column(1).to_numpy(), segment.column(2).to_numpy()
        lists = segment.column(3).chunk(0)
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            continue
        # a segment's rows go by term
        order = pc.sort_indices(coded.dictionary)
        words, codes = coded.dictionary.take(order), np.argsort(order.to_numpy())[coded.indices.to_numpy()]
        chunk = np.repeat(np.arange(len(ids)), sizes)
        cell_of, cell_scope, cell_id = np.empty(len(ids), np.int64), [], []
        for c, rows in enumerate(_cells([scopes], np.lexsort((ids, sizes, scopes.astype(str))), CELL_CHUNKS)):
            cell_of[rows] = c
            cell_scope.append(scopes[rows[0]])
            cell_id.append(int(ids[rows].min()))
        n_cells = len(cell_id)
        # one entry per term, cell and chunk, in this order
        place = (codes * n_cells + cell_of[chunk]) * len(ids) + chunk
        entry, tf = np.unique(place, return_counts=True)
        row, at = entry // len(ids), entry % len(ids)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        offsets = pa.array(np.r_[starts, len(row)], pa.int32())
        term, cell = row[starts] // n_cells, row[starts] % n_cells
        as_list = lambda v, kind: pa.ListArray.from_arrays(offsets, pa.array(v, kind))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(starts), bucket), pa.int32()), words.take(pa.array(term)), pa.array(np.array(cell_scope, object)[cell], pa.string()), pa.array(np.array(cell_id)[cell], pa.int64()),
                pa.array(np.diff(np.r_[starts, len(row)]), pa.int64()), pa.array(np.maximum.reduceat(tf, starts), pa.int32()), pa.array(np.minimum.reduceat(sizes[at], starts), pa.int32()),
                as_list(ids[at], pa.int64()), as_list(tf, pa.int32()), as_list(sizes[at], pa.int32()),
            ],
            schema=_POSTINGS,
        )


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _near(m: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A number for each row of unit vectors, alike for neighbours: the nearest of some centres, found among the rows themselves."""
    n = max(1, len(m) // CELL_VECTORS)
    centres = m[np.linspace(0, len(m) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        centres = unit(sums)
    return (m @ centres.T).argmax(1)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, scope, chunk_id, vec) to cells of neighbouring unit vectors. Vectors of one length only are put together."""
    for segment in _segments(batches):
        bucket, scopes, ids = segment.column(0)[0].as_py(), segment.column(1).to_numpy(), segment.column(2).to_numpy()
        lists = segment.column(3).chunk(0)
        sizes, values, starts = np.asarray(lists.value_lengths()), lists.flatten().to_numpy(), np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        made = []
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            m = unit(values[starts[rows][:, None] + np.arange(dim)].astype(np.float64))
            near = _near(m)
            for part in _cells([scopes[rows], near], np.lexsort((ids[rows], near, scopes[rows].astype(str))), CELL_VECTORS):
                inside = m[part]
                centre = unit(inside.sum(0, keepdims=True))[0]
                angle = float(np.arccos(np.clip(inside @ centre, -1, 1)).max()) if centre.any() and np.abs(inside).sum(1).all() else np.pi
                made.append({"bucket": bucket, "scope": scopes[rows[part[0]]], "cell": int(ids[rows[part]].min()), "n": len(part), "dim": dim, "centre": centre, "angle": angle,
                             "ids": ids[rows[part]], "matrix": np.ascontiguousarray(inside).tobytes()})
        yield pa.RecordBatch.from_pylist(made, schema=_VECTORS)


class SearchIndex:
    """Chunks, postings and vectors in one folder. Opening it reads nothing."""

    def __init__(self, spark: SparkSession, folder: str, n_buckets: int = 16, more: dict[str, str] | None = None):
        self.store = Store(spark, folder, SCHEMAS | (more or {}), n_buckets)

    def write(self, chunks: DataFrame) -> None:
        """Write the whole index from rows (unit, pos, chunk_id, chunk_text, vec, scope, path).

        A chunk without a text has no postings, one without a vector no place among the vectors. A null scope is the common one.
        """
        self.store.refresh()
        version = self.store.versions()[0] + 1
        self.write_buckets(chunks, version)
        self.store.commit(version, dict.fromkeys(SCHEMAS, list(range(self.store.n_buckets))))

    def write_buckets(self, chunks: DataFrame, version: int) -> None:
        """Write all rows of some buckets as part of a version to come."""
        store = self.store
        n = store.n_buckets
        rows = chunks.select(
            "unit", F.col("pos").cast("int").alias("pos"), "chunk_id", "chunk_text", F.greatest(F.lit(0), F.size(terms(F.col("chunk_text")))).alias("n_terms"),
            F.col("vec").cast("array<double>").alias("vec"), common().alias("scope"), "path", bucket_of(F.col("unit"), n).alias("bucket"))
        # a bucket is several tasks, more if there are more shuffle partitions
        parts = -(-spread(store.spark) // (4 * n))
        piece = F.col("bucket") * parts + F.pmod(F.xxhash64("unit"), F.lit(parts)).cast("int")
        kept = store.write("chunks", rows.repartitionById(n * parts, piece).sortWithinPartitions("bucket", "chunk_id"), version)
        listed = kept.where("n_terms > 0").select("bucket", "scope", "chunk_id", terms(F.col("chunk_text")).alias("t"))
        store.write("postings", listed.mapInArrow(_invert, f"bucket int, {SCHEMAS['postings']}"), version)
        store.write("vectors", kept.where("size(vec) > 0").select("bucket", "scope", "chunk_id", "vec").mapInArrow(_group, f"bucket int, {SCHEMAS['vectors']}"), version)
        per = kept.groupBy("bucket", "scope").agg(F.count_if(F.col("chunk_text").isNotNull()).alias("n_chunks"), F.sum("n_terms").cast("long").alias("n_terms"))
        store.write("totals", per.coalesce(1), version)

    def exists(self) -> bool:
        return self.store.versions()[0] > 0

    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def terms(self) -> DataFrame:
        """Each term's chunks, occurrences and longest chunk, over all scopes."""
        rows = self.store.read("postings")
        return rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.expr("aggregate(tfs, 0L, (a, x) -> a + x)")).alias("cf"), F.max(F.array_max("sizes")).alias("longest"))

    # ---- keyword search

    def keyword(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        """Best k chunks by BM25 for queries (q_id, q_text): q_id, chunk_id, bucket, score, rank. A query without a text has no hits."""
        parts = []
        for asked in self._asked(queries):
            cells, block = self._bounds(asked, k, scope)
            first = cut_lineage(self._scores(cells.where(F.col("nth") <= FIRST_CELLS), block, scope))
            kth = self._kth(first, k)
            parts += [first, self._scores(self._rest(cells, kth), block, scope)]
        return top(union(parts), k, "score", "rank")

    def keyword_share(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        """What a keyword search skips: per query the cells that hold an asked term, and how many of them have to be scored."""
        parts = []
        for asked in self._asked(queries):
            cells, block = self._bounds(asked, k, scope)
            first = cells.where(F.col("nth") <= FIRST_CELLS)
            kth = self._kth(self._scores(first, block, scope), k)
            opened = first.select("q_id").unionByName(self._rest(cells, kth).select("q_id")).groupBy("q_id").agg(F.count(F.lit(1)).alias("n_scored"))
            parts.append(cells.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_cells")).join(opened, "q_id"))
        return union(parts)

    def _asked(self, queries: DataFrame) -> Iterator[pa.Table]:
        """The terms of the queries (q_id, term), a block at a time; only one block is on the driver."""
        listed = queries.select("q_id", F.array_distinct(terms(F.col("q_text"))).alias("t")).where("size(t) > 0")
        n_terms = listed.agg(F.sum(F.size("t"))).first()[0] or 0
        n_blocks = max(1, -(-n_terms // QUERY_TERMS))
        for block in range(n_blocks):
            part = listed.where(F.pmod(F.xxhash64("q_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else listed
            yield part.select("q_id", F.explode("t").alias("term")).toArrow()

    def _bounds(self, asked: pa.Table, k: int, scope: str | None) -> tuple[DataFrame, _Block]:
        """What is known before a posting is opened: (q_id, bucket, cell, bound, nth), the best cell of a query first; and the queries' weights."""
        spark = self.store.spark
        totals = visible(self.store.read("totals"), scope).agg(F.sum("n_chunks"), F.sum("n_terms")).first()
        n_all = totals[0] or 0
        avg_len = totals[1] / n_all if n_all and totals[1] else 1.0
        wanted = spark.createDataFrame(asked.to_pandas()) if len(asked) else spark.createDataFrame([], "q_id long, term string")
        heads = visible(self.store.read("postings"), scope).select("bucket", "term", "cell", "n", "max_tf", "min_terms")
        # a block's terms are bounded and the postings are not, so the terms go to where the postings lie
        seen_in = heads.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        rarity = F.greatest(F.log((F.lit(n_all) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        # as many rows as the block has terms
        rated = seen_in.select("term", rarity.alias("idf")).toArrow().join(asked, "term", join_type="inner") if len(asked) else asked.append_column("idf", pa.array([], pa.float64()))
        weights = spark.createDataFrame(rated.select(["q_id", "term", "idf"]).to_pandas()) if len(rated) else spark.createDataFrame([], "q_id long, term string, idf double")
        bound = F.sum(F.col("idf") * saturated("max_tf", "min_terms", avg_len)).alias("bound")
        cells = heads.join(F.broadcast(weights), "term").groupBy("q_id", "bucket", "cell").agg(bound)
        nth = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("bound"), "cell"))
        return cut_lineage(cells.withColumn("nth", nth)), _Block(rated, avg_len, k)

    @staticmethod
    def _kth(first: DataFrame, k: int) -> DataFrame:
        """The k-th score of each query as far as it is known."""
        return top(first, k, "score", "rank").where(F.col("rank") == k).select("q_id", F.col("score").alias("kth"))

    @staticmethod
    def _rest(cells: DataFrame, kth: DataFrame) -> DataFrame:
        """Cells not scored yet whose bound reaches the k-th score."""
        return cells.where(F.col("nth") > FIRST_CELLS).join(kth, "q_id", "left").where(f"kth IS NULL OR bound >= kth - {SLACK}")

    def _scores(self, cells: DataFrame, block: _Block, scope: str | None) -> DataFrame:
        """The k best chunks of each (q_id, bucket, cell): the postings of a cell and the queries that want it meet, a cell at a time."""
        # the block's terms: at most QUERY_TERMS of them
        asked = self.store.spark.createDataFrame([(w,) for w in block.weights], "term string")
        postings = visible(self.store.read("postings"), scope).select("bucket", "term", "cell", "ids", "tfs", "sizes")
        # of the cells there is one for some hundred chunks: both are looked up where the postings lie, and only what is left is dealt out
        opened = F.broadcast(cells.select("bucket", "cell").distinct())
        met = postings.join(F.broadcast(asked), "term", "left_semi").join(opened, ["bucket", "cell"], "left_semi")
        return met.groupBy("bucket", "cell").cogroup(cells.select("bucket", "cell", "q_id").groupBy("bucket", "cell")).applyInArrow(lambda p, w: block.score(p, w), "q_id long, chunk_id long, bucket int, score double")

    # ---- vector search

    def nearest(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        """Best k chunks by cosine for queries (q_id, q_vec): q_id, chunk_id, bucket, score, rank. A query without a vector has no hits."""
        return top(self._nearest(queries, k, scope, False), k, "score", "rank")

    def nearest_share(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        """What a vector search compares and skips: n_compared, n_skipped (pairs of query and chunk)."""
        counted = self._nearest(queries, k, scope, True)
        return counted.agg(F.sum("q_id").alias("n_compared"), F.sum("chunk_id").alias("n_skipped"))

    def _nearest(self, queries: DataFrame, k: int, scope: str | None, counts: bool) -> DataFrame:
        cells = visible(self.store.read("vectors"), scope).select("bucket", "cell", "n", "dim", "centre", "angle", "ids", "matrix")
        asked = queries.where("size(q_vec) > 0").select("q_id", F.col("q_vec").cast("array<double>").alias("q_vec"))
        held = asked.agg(F.sum(F.size("q_vec") * 8 + 8)).first()[0] or 0
        n_blocks = max(1, -(-held // QUERY_BYTES))
        parts = []
        for block in range(n_blocks):
            # one block of queries at a time is on the driver; the cells stay where they are
            got = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(n_blocks)) == block).toArrow() if n_blocks > 1 else asked.toArrow()
            parts.append(cells.mapInArrow(_search(got, k, counts), "q_id long, chunk_id long, bucket int, score double"))
        return union(parts)

    # ---- both

    def hybrid(self, queries: DataFrame, k: int, *, scope: str | None = None, pool: int = 50, scorer: Scorer | None = None) -> DataFrame:
        """Keyword and vector search fused; with a scorer, the best 20 rows of each query are reordered by it. Columns as ``retrieval.hybrid_query``, and bucket."""
        near = self.nearest(queries.select("q_id", "q_vec"), pool, scope)
        both = near.unionByName(self.keyword(queries.select("q_id", "q_text"), pool, scope))
        place = F.round(F.sum(1.0 / (RRF_CONSTANT + F.col("rank"))), 9)
        pooled = both.groupBy("q_id", "chunk_id", "bucket").agg(place.alias("fused"), F.count(F.lit(1)).alias("n_lists"))
        fused = top(pooled, k if scorer is None else 20, "fused", "place")
        if scorer is None:
            return fused
        full = self.with_texts(fused.join(queries.select("q_id", "q_text"), "q_id"))
        return rerank(full, scorer, k).drop("q_text", "chunk_text")

    def with_texts(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows (bucket, chunk_id) with the text of their chunk, or other columns of it: k rows a query are looked up, no text is searched.

        Up to FEW_ROWS rows go to where the texts lie; were they more, the texts would be dealt out instead.
        """
        return few(rows, FEW_ROWS).join(self.chunks().select("bucket", "chunk_id", *(columns or ("chunk_text",))), ["bucket", "chunk_id"])


class _Block:
    """The weights of a block of queries, by term, and how a cell is scored by them."""

    def __init__(self, rated: pa.Table, avg_len: float, k: int):
        self.avg_len, self.k, self.weights = avg_len, k, {}
        for q_id, term, idf in zip(rated.column("q_id").to_pylist(), rated.column("term").to_pylist(), rated.column("idf").to_pylist()):
            self.weights.setdefault(term, []).append((q_id, idf))

    def score(self, postings: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(postings) or not len(wanted):
            return _HITS.empty_table()
        bucket = postings.column("bucket")[0].as_py()
        lists = [postings.column(c).combine_chunks() for c in ("ids", "tfs", "sizes")]
        ids, tfs, sizes = (np.asarray(v.flatten()) for v in lists)
        ends = np.r_[0, np.cumsum(np.asarray(lists[0].value_lengths()))]
        part = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * sizes / self.avg_len))
        chunk, at = np.unique(ids, return_inverse=True)
        rows = {q: i for i, q in enumerate(sorted(wanted.column("q_id").to_pylist()))}
        score = np.zeros((len(rows), len(chunk)))
        for i, term in enumerate(postings.column("term").to_pylist()):
            mine = [(rows[q], idf) for q, idf in self.weights[term] if q in rows]
            if mine:
                inside = slice(ends[i], ends[i + 1])
                row, idf = zip(*mine)
                score[np.array(row)[:, None], at[inside]] += np.array(idf)[:, None] * part[inside]
        score = np.round(score, 6)
        n = min(self.k, len(chunk))
        # equal scores are cut by id, and the chunks are in this order
        best = np.argsort(-score, axis=1, kind="stable")[:, :n]
        found = np.take_along_axis(score, best, 1)
        hit = found > 0
        q_ids = np.broadcast_to(np.array(list(rows))[:, None], best.shape)
        return pa.Table.from_arrays([pa.array(q_ids[hit]), pa.array(chunk[best][hit]), pa.array(np.full(hit.sum(), bucket, np.int32)), pa.array(found[hit])], schema=_HITS)


def union(parts: list[DataFrame]) -> DataFrame:
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def few(rows: DataFrame, most: int) -> DataFrame:
    """Rows for one side of a join: evaluated once, and sent to all tasks if there are ``most`` of them or fewer."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def saturated(tf: str, size: str, avg_len: float) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.lit(float(avg_len))))


def top(scored: DataFrame, k: int, score: str, rank: str) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


_HITS = pa.schema([("q_id", pa.int64()), ("chunk_id", pa.int64()), ("bucket", pa.int32()), ("score", pa.float64())])


def _search(asked: pa.Table, k: int, counts: bool):
    """The task of a vector search: cells to the k best rows of each query, as far as this task's cells go."""
    lists = asked.column("q_vec").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids = asked.column("q_id").to_numpy()
    sizes, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    starts = np.r_[0, np.cumsum(sizes)][:-1].astype(np.int64)
    by_dim = {}
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        by_dim[dim] = rows, unit(values[starts[rows][:, None] + np.arange(dim)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf)
        found, place = np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int32)
        compared = skipped = 0
        for batch in batches:
            heads = batch.select(["bucket", "n", "dim", "centre", "angle"]).to_pylist()
            # cells that may hold the nearest rows come first
            reach = []
            for i, h in enumerate(heads):
                if h["dim"] in by_dim:
                    rows, q = by_dim[h["dim"]]
                    gap = np.maximum(0, np.arccos(np.clip(q @ np.array(h["centre"]), -1, 1)) - h["angle"])
                    reach.append((float(gap.mean()), i, rows, q, np.cos(gap)))
                else:
                    skipped += h["n"] * len(ids)
            for _, i, rows, q, bound in sorted(reach, key=lambda r: r[:2]):
                open_ones = np.flatnonzero(bound >= best[rows, -1] - SLACK)
                n = heads[i]["n"]
                skipped += n * (len(ids) - len(open_ones))
                compared += n * len(open_ones)
                if not len(open_ones):
                    continue
                m = np.frombuffer(batch.column("matrix")[i].as_buffer(), np.float64).reshape(n, -1)
                chunk = np.asarray(batch.column("ids")[i].values)
                at = rows[open_ones]
                score = np.concatenate([best[at], np.round(q[open_ones] @ m.T, 6)], 1)
                name = np.concatenate([found[at], np.broadcast_to(chunk, (len(at), n))], 1)
                where = np.concatenate([place[at], np.full((len(at), n), heads[i]["bucket"], np.int32)], 1)
                order = np.lexsort((name, -score), axis=1)[:, :k]
                best[at], found[at], place[at] = (np.take_along_axis(v, order, 1) for v in (score, name, where))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([compared]), pa.array([skipped]), pa.array([0], pa.int32()), pa.array([0.0])], schema=_HITS)
            return
        hit = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[hit]), pa.array(found[hit]), pa.array(place[hit]), pa.array(best[hit])], schema=_HITS)

    return run
