"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Queries of one pass over the candidates, queries and candidates that are scored at once, and bins into which a round cuts a range.
QUERIES_PER_PASS, AT_ONCE, BINS = 16_384, 2048, 256


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors as floor(scale * x), x as double; those that are null or hold a null or a number that is not finite are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` numbers as doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    for i, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        out[i, :n] = flat[s : s + n]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part.column(0).to_numpy(), _matrix(part.column(1), width)


def _one_pass(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, reach: int, width: int) -> DataFrame:
    """Top k of a bounded block of queries. rows: (id, v) of all candidates."""
    spark = rows.sparkSession
    low = np.full(len(ids), -reach, np.int64)  # each kth score is in low..low+size-1
    size = 1
    while size < 2 * reach + 1:
        size *= BINS
    need = np.full(len(ids), k, np.int64)  # how many are still to be found at or under low+size-1
    sent = spark.sparkContext.broadcast((ids, vectors.T.copy()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(queries, ids of candidates, scores of all these pairs), a square of the matrix at a time."""
        own, q = sent.value
        for cand_ids, cand in _blocks(batches, width):
            for at in range(0, len(own), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                s = (cand @ q[:, part]).T.astype(np.int64)
                s[own[part, None] == cand_ids[None, :]] = np.iinfo(np.int64).min
                yield part, cand_ids, s

    def count(lows: np.ndarray, span: int, needs: np.ndarray):
        step = span // BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = np.zeros((len(lows), BINS), np.int64)
            for part, _, s in scored(batches):
                bins = (s - lows[part, None]) // step
                inside = (bins >= 0) & (bins < BINS)
                flat = (bins + np.arange(len(s))[:, None] * BINS)[inside]
                hist[part] += np.bincount(flat, minlength=len(s) * BINS).reshape(-1, BINS)
            # bins under the one in which this task alone has enough can't hold the kth value
            above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
            q, b = np.nonzero((hist > 0) & (above < needs[:, None]))
            yield pa.record_batch([pa.array(q), pa.array(b), pa.array(hist[q, b])], names=["q", "b", "n"])

        return run

    while size > 1:
        step = size // BINS
        got = rows.mapInArrow(count(low, size, need), "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toPandas()  # k rows a query at most, about
        hist = np.zeros((len(ids), BINS), np.int64)
        hist[got.q.to_numpy(np.int64), got.b.to_numpy(np.int64)] = got.n
        upto = np.cumsum(hist[:, ::-1], axis=1)  # from the highest bin down
        found = upto[:, -1] >= need
        at = np.where(found, BINS - 1 - (upto >= need[:, None]).argmax(axis=1), 0)
        above = upto[np.arange(len(ids)), BINS - 1 - at] - hist[np.arange(len(ids)), at]
        low = low + at * step
        need = np.where(found, need - above, need)
        size = step
    limit, ties = low, np.maximum(need, 0)  # all over the limit, and the `ties` smallest ids of those at it

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        level: list[np.ndarray] = [np.empty(0, np.int64)] * len(limit)
        for part, i, s in scored(batches):
            q, j = np.nonzero(s > limit[part, None])
            over.append((q + part.start, i[j], s[q, j]))
            q, j = np.nonzero(s == limit[part, None])
            for one in np.unique(q):
                at = one + part.start
                level[at] = np.sort(np.concatenate([level[at], i[j[q == one]]]))[: ties[at]]
        n = [len(x) for x in level]
        q = np.concatenate([*[o[0] for o in over], np.repeat(np.arange(len(limit)), n)]).astype(np.int64)
        i = np.concatenate([*[o[1] for o in over], *level]).astype(np.int64)
        s = np.concatenate([*[o[2] for o in over], np.repeat(limit, n)]).astype(np.int64)
        yield pa.record_batch([pa.array(sent.value[0][q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(chosen, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of highest integer inner product for each query, ties to the smaller id.

    Components become floor(scale * x). Every pass takes a block of queries to all candidates; each
    round counts, for each query, the scores in equal bins of the range that holds its kth score,
    and goes on in the bin that holds it, until the bin is one score wide; a last round takes what is
    over that score, and of those at it the smallest ids. A task sends at most about k rows a query
    and round; no list of candidates is gathered, and none is cut. A block's rows are written when it
    is done, and all are ranked together at the end.

    Result: query_id, rank (from 1), vec_id, score; fewer rows if there are fewer candidates. Rows of
    the query's own id are not its candidates; other rows that share an id are each a candidate, and
    queries that share an id share their k best pairs. Vectors that are null or hold a null or a
    number that is not finite, and null ids, take no part; shorter vectors count as ending in zeros;
    other columns are not read; empty tables give no rows. Scores must stay under 2**53.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    asked = stored(whole_vectors(queries, id_col, vector_col, scale), "topk-queries")
    facts = rows.unionByName(asked).agg(F.max(F.size("v")).alias("width"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))).alias("most")).first()
    width = max(1, facts.width or 0)
    reach = width * int(facts.most or 0) ** 2
    if reach >= 1 << 53:
        raise ValueError("scores can pass 2**53; use a smaller scale")
    blocks = -(-asked.count() // QUERIES_PER_PASS)
    found: list[DataFrame] = []
    for block in range(blocks):
        dealt = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block
        part = asked.where(dealt).orderBy("id", "v").collect()  # about QUERIES_PER_PASS rows
        if not part:
            continue
        ids = np.array([r.id for r in part], np.int64)
        q = np.zeros((len(part), width))
        for i, r in enumerate(part):
            q[i, : len(r.v)] = r.v
        found.append(stored(_one_pass(rows, ids, q, k, reach, width), "topk-found"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = spark.read.schema(found[0].schema).parquet(*(f.stored_at for f in found))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
