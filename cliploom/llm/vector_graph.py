"""Embedding near-dedup on a robust-pruned flat graph, built on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.shared import stored

from .components import components

#: Vectors on which centres are fitted, and vectors of the audit (about; chosen by a hash).
SAMPLE, AUDIT = 32_768, 1024
#: The size that shards should have, the size over which one is cut into blocks, and the most centres.
SHARD, BLOCK, CENTRES = 1024, 2048, 4096
#: Nearest and random candidates of a node, edges that pruning keeps, how much longer a detour may be, and the list of the greedy search.
NEAR, RANDOM, DEGREE, DETOUR, LIST, STEP = 48, 16, 24, 1.2, 24, 4
#: Queries that a task searches at once, and (query, node) pairs whose neighbours it looks at at once.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 512, 1 << 15


class Groups(NamedTuple):
    """rows: vec_id, n_links, component_id; recall: share of links that the audit found, at the overlap that was used."""

    rows: DataFrame
    recall: float
    overlap: int


def with_units(rows: DataFrame, width: int) -> DataFrame:
    """(id, label, u) of (id, label, v): vectors at length one, shorter ones ended by zeros.

    u is null if the vector is null, zero or holds a null or a number that is not finite. Squares neither
    overflow nor vanish.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            n = len(v)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            sizes = np.nan_to_num(pc.list_value_length(v).to_numpy(zero_copy_only=False)).astype(np.int64)
            row = np.repeat(np.arange(n), sizes)
            x = np.zeros((n, width))
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            bad = ~np.isfinite(x).all(axis=1)
            x[bad] = 0
            most = np.abs(x).max(axis=1)
            bad |= most == 0
            x /= np.where(bad, 1, most)[:, None]
            x /= np.where(bad, 1, np.linalg.norm(x, axis=1))[:, None]
            ends = pa.array(np.append(0, np.cumsum(np.where(bad, 0, width))).astype(np.int32))
            u = pa.ListArray.from_arrays(ends, pa.array(x[~bad].ravel()), mask=pa.array(bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), u], names=["id", "label", "u"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(run, f"{kinds}, u array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(5)
    centres = sample[np.sort(rng.permutation(len(sample))[:k])].copy()
    for _ in range(rounds if len(centres) > 1 else 0):
        own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        some, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts)
        norms = np.linalg.norm(sums, axis=1)
        centres[some[norms > 0]] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Robust pruning: of each node's candidates (-1: none), the nearest stays and takes out those that it is DETOUR times nearer to than the node is; and so on. Rows are padded with -1."""
    sims = np.where(cand >= 0, np.einsum("ij,ikj->ik", x[nodes], x[cand]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    alive = (cand >= 0) & (cand != nodes[:, None])
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]  # equal candidates have equal places, but for ties, which do no harm
    between = x[cand] @ x[cand].transpose(0, 2, 1)
    out = np.full((len(nodes), DEGREE), -1, np.int64)
    rows = np.arange(len(nodes))
    for i in range(DEGREE):
        first = alive.argmax(axis=1)
        have = alive[rows, first]
        out[have, i] = cand[have, first[have]]
        alive &= ~(have[:, None] & (DETOUR**2 * (1 - between[rows, first]) <= 1 - sims))
        alive[rows, first] = False
    return out


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each connected part."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _reached(edges: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        to = np.unique(edges[front])
        front = to[(to >= 0) & ~seen[to]]
        seen[front] = True
    return seen


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency of unit vectors, rows padded with -1: every node can be reached from the medoid."""
    n = len(x)
    rng = np.random.default_rng(7)
    near = min(NEAR, n - 1)
    edges = np.full((n, DEGREE), -1, np.int64)
    if n > 1:
        chunks = [np.arange(i, min(n, i + 256)) for i in range(0, n, 256)]
        for at in chunks:
            sims = x[at] @ x.T
            sims[np.arange(len(at)), at] = -np.inf
            cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
            edges[at] = _prune(x, at, np.hstack([cand, rng.integers(0, n, (len(at), RANDOM))]))
        # each edge is offered to its other end, too, and both ends choose again
        src, dst = np.repeat(np.arange(n), DEGREE)[edges.ravel() >= 0], edges.ravel()[edges.ravel() >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", x[src], x[dst]), dst))
        src, dst = src[order], dst[order]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        back = np.full((n, NEAR), -1, np.int64)
        few = rank < NEAR
        back[dst[few], rank[few]] = src[few]
        edges = np.vstack([_prune(x, at, np.hstack([edges[at], back[at]])) for at in chunks])
    start = _medoid(x)
    while not (seen := _reached(edges, start)).all():
        s, d = np.nonzero(edges >= 0)[0], edges[edges >= 0]
        part = _labels(n, s, d)
        out, inn = np.flatnonzero(~seen), np.flatnonzero(seen)
        sims = x[out] @ x[inn].T
        best = sims.argmax(axis=1)
        order = np.argsort(-sims[np.arange(len(out)), best], kind="stable")
        _, firsts = np.unique(part[out[order]], return_index=True)  # one way into each part that is cut off
        add = np.full((n, len(firsts)), -1, np.int64)
        for j, i in enumerate(order[firsts]):
            add[inn[best[i]], j] = out[i]
        edges = np.hstack([edges, add[:, (add >= 0).any(axis=0)]])
        wide = np.sort(edges, axis=1)[:, ::-1]
        edges = wide[:, : max(1, int((wide >= 0).sum(axis=1).max()))]
    return edges


def range_search(queries: np.ndarray, x: np.ndarray, edges: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all nodes found with a similarity of at least `least`.

    Greedy search with a list of LIST nodes goes from the medoid towards each query; every node
    in range that it meets is expanded as well, however long the list of these grows.
    """
    n, start = len(x), _medoid(x)
    found_q, found_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(queries), QUERIES_AT_ONCE):
        q = queries[begin : begin + QUERIES_AT_ONCE]
        m = len(q)
        seen, expanded = np.zeros(m * n, bool), np.zeros(m * n, bool)
        best, best_sim = np.full((m, LIST), -1, np.int64), np.full((m, LIST), -np.inf)
        pending = np.empty(0, np.int64)  # keys query * n + node of nodes in range that are to be expanded
        new = np.arange(m) * n + start
        while True:
            if len(new):
                seen[new] = True
                qi, xi = np.divmod(new, n)
                sims = np.einsum("ij,ij->i", q[qi], x[xi])
                near = sims >= least
                found_q.append(qi[near] + begin)
                found_x.append(xi[near])
                pending = np.concatenate([pending, new[near]])
                order = np.lexsort((-sims, qi))
                qi, xi, sims = qi[order], xi[order], sims[order]
                rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
                few = rank < LIST
                some, place = np.unique(qi[few], return_inverse=True)
                pool, pool_sim = np.full((len(some), 2 * LIST), -1, np.int64), np.full((len(some), 2 * LIST), -np.inf)
                pool[:, :LIST], pool_sim[:, :LIST] = best[some], best_sim[some]
                pool[place, LIST + rank[few]], pool_sim[place, LIST + rank[few]] = xi[few], sims[few]
                order = np.argsort(-pool_sim, axis=1, kind="stable")[:, :LIST]
                best[some], best_sim[some] = np.take_along_axis(pool, order, 1), np.take_along_axis(pool_sim, order, 1)
            keys = np.arange(m)[:, None] * n + best
            fresh = (best >= 0) & ~expanded[np.where(best >= 0, keys, 0)]
            fresh &= np.cumsum(fresh, axis=1) <= STEP
            now, pending = pending[:PAIRS_AT_ONCE], pending[PAIRS_AT_ONCE:]
            front = np.concatenate([keys[fresh], now])
            front = np.unique(front[~expanded[front]])
            if not len(front):
                if len(pending):
                    new = np.empty(0, np.int64)
                    continue
                break
            expanded[front] = True
            qi, xi = np.divmod(front, n)
            to = edges[xi]
            to = (qi[:, None] * n + to)[to >= 0]
            new = np.unique(to[~seen[to]])
    return np.concatenate(found_q), np.concatenate(found_x)


def _local_edges(nodes: np.ndarray, lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Adjacency lists of node ids as places among `nodes`, which ascend; neighbours that are elsewhere are left out."""
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    to = lists.flatten().to_numpy()
    src = np.repeat(np.arange(len(nodes)), sizes)
    place = np.minimum(np.searchsorted(nodes, to), len(nodes) - 1)
    here = nodes[place] == to
    src, place = src[here], place[here]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((len(nodes), max(1, int(rank.max(initial=0)) + 1)), -1, np.int64)
    out[src, rank] = place
    return out


def _graphs(table: pa.Table) -> pa.Table:
    nodes, x = table["node"].to_numpy(), _matrix(table["u"])
    order = np.argsort(nodes)
    nodes, edges = nodes[order], build_graph(x[order])
    ends = np.append(0, np.cumsum((edges >= 0).sum(axis=1))).astype(np.int32)
    return pa.table([pa.array(nodes), pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes[edges[edges >= 0]]))], names=["node", "near"])


def _searched(least: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, low, high = (k.as_py() for k in key[1:])
        table = table.take(pa.array(np.lexsort((table["node"].to_numpy(), table["b"].to_numpy()))))
        nodes, x, mult, homes, block = table["node"].to_numpy(), _matrix(table["u"]), table["mult"].to_numpy(), _matrix(table["shards"]), table["b"].to_numpy()
        cut = int(np.searchsorted(block, low, side="right"))
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if low == high:
            a, b = range_search(x, x, _local_edges(nodes, table["near"]), least)
        elif 0 < cut < len(nodes):  # each block's vectors search the other block
            for own, other in ((slice(0, cut), slice(cut, len(nodes))), (slice(cut, len(nodes)), slice(0, cut))):
                edges = _local_edges(nodes[other], table["near"].slice(other.start, other.stop - other.start))
                q, y = range_search(x[own], x[other], edges, least)
                a, b = np.append(a, q + own.start), np.append(b, y + other.start)
        keys = np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
        a, b = np.divmod(keys, len(nodes))
        a, b = a[a != b], b[a != b]
        # a pair that several shards hold counts in the first of them
        here = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 20):
            part = slice(at, at + (1 << 20))
            ha, hb = homes[a[part]], homes[b[part]]
            common = np.where((ha[:, :, None] == hb[:, None, :]).any(axis=2), ha, np.iinfo(ha.dtype).max).min(axis=1)
            here[part] = common == shard
        low_of = _labels(len(nodes), a, b)
        ca, cb = a[here], b[here]
        links = np.bincount(ca, weights=mult[cb], minlength=len(nodes)) + np.bincount(cb, weights=mult[ca], minlength=len(nodes))
        pairs = np.bincount(ca, minlength=len(nodes)) + np.bincount(cb, minlength=len(nodes))
        some = np.unique(np.concatenate([a, b]))
        return pa.table([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(pairs[some].astype(np.int64)), pa.array(nodes[low_of[some]])], names=["node", "links", "pairs", "root"])

    return run


def _dealt(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """Nodes with the ascending numbers of their `overlap` nearest centres, once for each: node, label, u, mult, shards, shard, b, blocks."""
    sent = nodes.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            sims = _matrix(batch.column(2)) @ c.T
            top = np.sort(np.argpartition(-sims, overlap - 1, axis=1)[:, :overlap], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, overlap, dtype=np.int32)), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "shards"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    near = nodes.mapInArrow(nearest, f"{schema}, shards array<int>").withColumn("shard", F.explode("shards"))
    sizes = near.groupBy("label", "shard").agg(F.count("*").alias("size"))
    near = near.join(sizes, ["label", "shard"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    return near.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("size")


def _links(nodes: DataFrame, centres: np.ndarray, overlap: int, least: float) -> DataFrame:
    """(node, links, pairs, root) of each shard: links counted with copies and without, and the smallest node that it is joined to there."""
    dealt = stored(_dealt(nodes.select("node", "label", "u", "mult"), centres, overlap), "graph-shards")
    graphs = dealt.select("label", "shard", "b", "node", "u").groupBy("label", "shard", "b").applyInArrow(_graphs, "node long, near array<bigint>")
    union = stored(graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-edges")  # `overlap` lists each
    pairs = dealt.join(union, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"low": F.least("b", "other"), "high": F.greatest("b", "other")}).drop("other", "blocks")
    return stored(pairs.groupBy("label", "shard", "low", "high").applyInArrow(_searched(least), "node long, links long, pairs long, root long"), "graph-links")


def _audit(nodes: DataFrame, n: int, found: DataFrame, least: float) -> float:
    """Recall of found links over about AUDIT nodes against a comparison with all nodes: the lower of the shares over links and over nodes that have any."""
    share = F.pmod(F.xxhash64("u", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, AUDIT / max(n, 1)))
    sample = nodes.where(share).select("node", "label", "u").collect()
    if not sample:
        return 1.0
    sent = nodes.sparkSession.sparkContext.broadcast((np.array([r.node for r in sample]), np.array([r.label for r in sample]), np.array([r.u for r in sample])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = sent.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            own, mine = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
            total += ((x @ _matrix(batch.column(2)).T >= least) & (labels[:, None] == mine[None, :]) & (ids[:, None] != own[None, :])).sum(axis=1)
        yield pa.record_batch([pa.array(ids), pa.array(total)], names=["node", "links"])

    true = {r.node: r.n for r in nodes.select("node", "label", "u").mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("n")).collect()}
    # as many rows as the sample
    got = {r.node: r.n for r in found.join(F.broadcast(nodes.where(share).select("node")), "node").groupBy("node").agg(F.sum("pairs").alias("n")).collect()}
    have = [(min(got.get(i, 0), n), n) for i, n in true.items() if n]
    if not have:
        return 1.0
    return min(sum(g for g, _ in have) / sum(n for _, n in have), sum(g / n for g, n in have) / len(have))


def near_groups(vectors: DataFrame, least: float = 0.93, overlap: int = 3, least_recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Groups:
    """Links between vectors of one label with a cosine of at least `least`, as counts and components.

    Equal directions of one label are one node, with the number of its copies. Every node lies in the
    shards of its `overlap` nearest centres, which are fitted on a bounded sample (SAMPLE); shards over
    BLOCK nodes are dealt into blocks. Each block gets a robust-pruned graph; a node's adjacency lists from all
    its shards are united. Range-expanding greedy search from the medoids then finds links inside each
    shard, block against block; each similarity is computed in doubles. A pair that several shards hold counts in the first one,
    so links are counted without writing pairs: a task gives one row a node, with a count and the smallest node that it
    is joined to. Recall is audited on about AUDIT nodes against all; under least_recall all is done
    again with twice the overlap, up to all centres.

    rows: one for each row of vectors: vec_id, n_links, component_id (smallest vec_id reachable). Null
    labels or ids, and vectors that are null, zero, empty or hold a null or a number that is not finite,
    have no links and are their own component. Shorter vectors count as ending in zeros. Rows that share an
    id are each a vector. Other columns are not read. An empty table gives no rows.
    """
    width = max(1, vectors.agg(F.max(F.size(vector_col))).first()[0] or 1)
    vector = F.when(F.col(id_col).isNotNull() & F.col(label_col).isNotNull(), F.col(vector_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    rows = stored(with_units(rows, width), "graph-rows")
    nodes = rows.where(F.col("u").isNotNull()).groupBy("label", "u").agg(F.min("id").alias("first"), F.count("*").alias("mult"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "graph-nodes")
    sizes = nodes.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    share = min(1.0, SAMPLE / max(1, sizes.n))
    sample = np.array([r.u for r in nodes.where(F.pmod(F.xxhash64("u"), F.lit(1 << 30)) < int((1 << 30) * share)).select("u").orderBy(F.xxhash64("u"), "u").collect()]).reshape(-1, width)
    if not len(sample):
        sample = np.array([r.u for r in nodes.select("u").limit(1).collect()] or [[1.0] + [0.0] * (width - 1)])
    while True:
        k = max(1, min(CENTRES, len(sample), -(-overlap * sizes.most // SHARD)))
        overlap = min(overlap, k)
        found = _links(nodes, fit_centres(sample, k), overlap, least)
        recall = _audit(nodes, sizes.n, found, least)
        if recall >= least_recall or overlap == k:
            break
        overlap = min(k, 2 * overlap)
    parts = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    known = stored(known.select("label", "u", "first", "part", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "graph-known")
    lowest = known.groupBy("part").agg(F.min("first").alias("component_id"))
    known = known.join(lowest, "part").select(F.col("label").alias("k_label"), F.col("u").alias("k_u"), "n_links", "component_id")
    out = rows.join(known, (F.col("label") == F.col("k_label")) & (F.col("u") == F.col("k_u")), "left")
    return Groups(out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), recall, overlap)
