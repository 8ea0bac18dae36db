"""Similarity of embeddings against a reference table of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import placed
from .shared import stored

#: References that are broadcast at once, and in how many blocks at most; beyond that they are dealt among executors.
BLOCK, BROADCAST_BLOCKS = 4096, 4
#: Pivots at most, references that each should stand for, and vectors that meet one unit of references in one task.
PIVOTS, EACH, VECTORS = 4096, 1024, 16_384
#: Room for rounding where angles are compared.
SLACK = 1e-6
BEST = "struct<sim:double,ref_order:int,trigger_name:string>"


def _whole(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("ref_embedding").isNotNull()).select("ref_order", "trigger_name", "ref_embedding")


def _few(refs: DataFrame) -> list[tuple[np.ndarray, list]] | None:
    """References in order, BLOCK at a time; None if there are more than BROADCAST_BLOCKS blocks."""
    rows = _whole(refs).orderBy("ref_order", "trigger_name").limit(BLOCK * BROADCAST_BLOCKS + 1).collect()
    if len(rows) > BLOCK * BROADCAST_BLOCKS:
        return None
    return [_block(rows[at : at + BLOCK]) for at in range(0, len(rows), BLOCK)]


def _block(rows: list) -> tuple[np.ndarray, list]:
    return np.array([r.ref_embedding for r in rows], np.float32), [(r.trigger_name, r.ref_order) for r in rows]


def _similarities(vectors: pd.Series, matrix: np.ndarray) -> np.ndarray:
    """Rows of cosine similarities; -2 for a null vector. Vectors are of unit length."""
    have = vectors.notna().to_numpy()
    out = np.full((len(vectors), len(matrix)), -2.0)
    if have.any():
        out[have] = np.stack(vectors[have].to_numpy()).astype(np.float64) @ matrix.T.astype(np.float64)
    return out


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Dealt:
    """References in units of at most BLOCK: those whose nearest pivot is the same, with the largest angle to it.

    Pivots are references themselves, chosen by a hash. Of a vector at angle a to a pivot no reference
    of a unit of radius r is nearer than a - r, by the triangle inequality on the sphere.
    """

    def __init__(self, refs: DataFrame) -> None:
        spark = refs.sparkSession
        rows = stored(placed(_whole(refs), [F.col("ref_order"), F.col("trigger_name")]), "references")
        n = rows.count()
        share = min(1.0, min(PIVOTS, -(-n // EACH)) / n)
        chosen = rows.where(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("ref_embedding", "trigger_name").orderBy("trigger_name").limit(2 * PIVOTS).collect()
        chosen = chosen or rows.select("ref_embedding").limit(1).collect()
        self.pivots = np.array([r.ref_embedding for r in chosen], np.float64)
        sent = spark.sparkContext.broadcast(self.pivots)  # at most 2 * PIVOTS vectors

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a = _angles(_flat(batch.column(2)), sent.value)
                at = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(a[np.arange(len(at)), at])], names=[*batch.schema.names, "pivot", "angle"])

        near = rows.mapInArrow(nearest, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "pivot int", "angle double"]))
        near = placed(near, [F.col("place")], ["pivot"], "inside").withColumn("part", F.floor((F.col("inside") - 1) / BLOCK).cast("int"))
        self.refs = stored(near.select("ref_order", "trigger_name", "ref_embedding", "place", "pivot", "part", "angle"), "reference-units")
        units = self.refs.groupBy("pivot", "part").agg(F.max("angle").alias("r")).orderBy("pivot", "part").collect()  # a row for up to BLOCK references
        self.units = [(u.pivot, u.part, u.r) for u in units]

    def ask(self, rows: DataFrame, column: str, reach: Callable[[np.ndarray], np.ndarray], extra: list[str], step: Callable, shape: str) -> DataFrame:
        """step(ids, vectors, extra columns, references) for the parts of rows that meet each unit in reach.

        rows: (id, column, *extra). reach: of angles to all pivots, the largest angle that still matters to each vector.
        Vectors go only to units that can hold such references. A unit that many vectors ask for is
        copied, so that each task gets about VECTORS of them.
        """
        spark = rows.sparkSession
        sent = spark.sparkContext.broadcast((self.pivots, np.array([u[0] for u in self.units]), np.array([u[2] for u in self.units])))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, of, radius = sent.value
            for big in batches:
                for at in range(0, big.num_rows, 1024):
                    batch = big.slice(at, 1024)
                    a = _angles(_flat(batch.column(1)), pivots)
                    row, unit = np.nonzero(a[:, of] - radius <= reach(a)[:, None] + SLACK)
                    out = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(unit.astype(np.int32))], names=[*batch.schema.names, "unit"])

        asked = rows.where(F.col(column).isNotNull()).select("id", F.col(column).alias("v"), *extra)
        shape_in = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields), "unit int"])
        asked = stored(asked.mapInArrow(deal, shape_in), "asked-units")
        copies = asked.groupBy("unit").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("copies"))
        asked = asked.join(copies, "unit").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
        numbered = spark.createDataFrame([(i, p, b) for i, (p, b, _) in enumerate(self.units)], "unit int, pivot int, part int")
        sides = self.refs.join(numbered, ["pivot", "part"]).join(copies, "unit").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        sides = sides.select("unit", "copy", "ref_order", "trigger_name", "ref_embedding", "place")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("place")
            refs = _flat(right["ref_embedding"])
            if not left.num_rows:  # a copy to which no vector fell
                return step(np.zeros(1, np.int64), refs[:1], {c: [None] for c in extra}, refs, right["ref_order"].to_pylist(), right["trigger_name"].to_pylist()).slice(0, 0)
            return step(left["id"].to_numpy(), _flat(left["v"]), {c: left[c].to_pylist() for c in extra}, refs, right["ref_order"].to_pylist(), right["trigger_name"].to_pylist())

        return asked.groupBy("unit", "copy").cogroup(sides.groupBy("unit", "copy")).applyInArrow(meet, shape)


def _in_blocks(df: DataFrame, blocks: list, out: str, start: Column, step: Callable, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """df with the column `out`: merge() of start and of step(block) for every block of a few references."""
    result = df.withColumn(out, start)
    for block in blocks:
        result = result.withColumn(out, merge(F.col(out), step(df.sparkSession.sparkContext.broadcast(block))))
    return result


def _by_units(df: DataFrame, column: str, refs: DataFrame, extra: dict[str, Column], reach: Callable, step: Callable, shape: str, merge: Column, out: str, none: Column) -> DataFrame:
    """df with `out` where references are dealt: rows are written once, asked for, and given what merge makes of all answers (id, found)."""
    rows = stored(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("id")), "asking")
    asked = rows.select("id", F.col("row")[column].alias("v"), *[F.col("row")[c].alias(n) for n, c in extra.items()])
    found = Dealt(refs).ask(asked, "v", reach, list(extra), step, shape).groupBy("id").agg(merge.alias("_found"))
    return rows.join(found, "id", "left").select("row.*", F.coalesce("_found", none).alias(out))


def with_best_reference(df: DataFrame, column: str, refs: DataFrame, out: str) -> DataFrame:
    """df with struct(sim, ref_order, trigger_name) of the most similar reference; of equal ones the last; null without references or vector.

    A few references are broadcast. More are dealt in units, and a vector asks only units that may hold a nearer one than its nearest pivot.
    """
    blocks = _few(refs)
    if blocks is None:

        def best_of(ids, x, _, matrix, orders, names) -> pa.Table:
            sims = x @ matrix.T
            at = sims.shape[1] - 1 - sims[:, ::-1].argmax(axis=1)
            return pa.table([pa.array(ids), pa.array(sims[np.arange(len(ids)), at]), pa.array([orders[i] for i in at], pa.int32()), pa.array([names[i] for i in at], pa.string())], names=["id", "sim", "ref_order", "trigger_name"])

        most = F.max(F.struct("sim", "ref_order", "trigger_name"))
        return _by_units(df, column, refs, {}, lambda a: a.min(axis=1), best_of, "id long, sim double, ref_order int, trigger_name string", most, out, F.lit(None).cast(BEST))

    def step(block) -> Column:
        @F.pandas_udf("sim double, ref_order int, trigger_name string")
        def best(v: pd.Series) -> pd.DataFrame:
            matrix, names = block.value
            sims = _similarities(v, matrix)
            at = sims.shape[1] - 1 - sims[:, ::-1].argmax(axis=1)
            return pd.DataFrame({"sim": sims[np.arange(len(v)), at], "ref_order": [names[i][1] for i in at], "trigger_name": [names[i][0] for i in at]})

        return F.when(F.col(column).isNotNull(), best(F.col(column)))

    return _in_blocks(df, blocks, out, F.lit(None).cast(BEST), step, F.greatest)


def with_references_over(df: DataFrame, column: str, refs: DataFrame, threshold: float, out: str) -> DataFrame:
    """df with array<struct(trigger_name, sim)> of all references at least `threshold` similar, in order."""
    kind = "array<struct<trigger_name:string,sim:double>>"
    blocks = _few(refs)
    if blocks is None:

        def all_over(ids, x, _, matrix, orders, names) -> pa.Table:
            sims = x @ matrix.T
            row, col = np.nonzero(sims >= threshold)
            return pa.table([pa.array(ids[row]), pa.array([orders[i] for i in col], pa.int32()), pa.array([names[i] for i in col], pa.string()), pa.array(sims[row, col])], names=["id", "ref_order", "trigger_name", "sim"])

        limit = float(np.arccos(np.clip(threshold, -1, 1)))
        merge = F.transform(F.array_sort(F.collect_list(F.struct("ref_order", "trigger_name", "sim"))), lambda x: F.struct(x["trigger_name"].alias("trigger_name"), x["sim"].alias("sim")))
        return _by_units(df, column, refs, {}, lambda a: np.full(len(a), limit), all_over, "id long, ref_order int, trigger_name string, sim double", merge, out, F.array().cast(kind))

    def step(block) -> Column:
        @F.pandas_udf(kind)
        def over(v: pd.Series) -> pd.Series:
            matrix, names = block.value
            return pd.Series([[{"trigger_name": names[i][0], "sim": row[i]} for i in np.flatnonzero(row >= threshold)] for row in _similarities(v, matrix)])

        return over(F.col(column))

    return _in_blocks(df, blocks, out, F.array().cast(kind), step, F.concat)


def _two(d: np.ndarray, names: list[str], favoured: list, bonus: float) -> list[list[dict]]:
    """The two smallest distances of each row, of equal ones the first name; names in order. Favoured ones are `bonus` nearer."""
    columns: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        columns.setdefault(name, []).append(i)
    for row, some in enumerate(favoured):
        for name in set(some) if some is not None else ():
            d[row, columns.get(name, [])] -= bonus
    found: list[list[dict]] = [[] for _ in range(len(d))]
    for _ in range(min(2, len(names))):
        at = d.argmin(axis=1)
        for row, i in enumerate(at):
            found[row].append({"d": d[row, i], "name": names[i]})
        d[np.arange(len(d)), at] = np.inf
    return found


def with_two_nearest(df: DataFrame, column: str, favoured: str, refs: DataFrame, bonus: float, out: str) -> DataFrame:
    """df with the two nearest references, array<struct(d, name)>: distance 1 - similarity, `bonus` less for names in `favoured`."""
    kind = "array<struct<d:double,name:string>>"
    blocks = _few(refs)
    first_two = lambda a: F.slice(F.array_sort(a), 1, 2)
    if blocks is None:

        def two_of(ids, x, extra, matrix, _, names) -> pa.Table:
            order = sorted(range(len(names)), key=lambda i: names[i])
            found = _two(1 - x @ matrix[order].T, [names[i] for i in order], extra["near"], bonus)
            return pa.table([pa.array(ids), pa.array(found, pa.list_(pa.struct([("d", pa.float64()), ("name", pa.string())])))], names=["id", "two"])

        def reach(a: np.ndarray) -> np.ndarray:
            # two pivots are no farther than the second smallest angle, and a bonus can make up for so much more
            second = np.partition(a, 1, axis=1)[:, 1] if a.shape[1] > 1 else np.full(len(a), np.pi)
            return np.arccos(np.clip(np.cos(second) - bonus, -1, 1))

        merge = first_two(F.flatten(F.collect_list("two")))
        return _by_units(df, column, refs, {"near": favoured}, reach, two_of, f"id long, two {kind}", merge, out, F.array().cast(kind))

    def step(block) -> Column:
        @F.pandas_udf(kind)
        def two(v: pd.Series, near: pd.Series) -> pd.Series:
            matrix, names = block.value
            order = sorted(range(len(names)), key=lambda i: names[i][0])
            return pd.Series(_two(1 - _similarities(v, matrix[order]), [names[i][0] for i in order], list(near), bonus))

        return two(F.col(column), F.col(favoured))

    return _in_blocks(df, blocks, out, F.array().cast(kind), step, lambda a, b: first_two(F.concat(a, b)))
