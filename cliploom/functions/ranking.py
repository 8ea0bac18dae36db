"""Places in a global order, or in the order of each group, without a window that one task works through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .shared import stored


def _steps(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls equal nulls."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def placed(df: DataFrame, order: list[Column], group: list[str] | None = None, out: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in ascending `order`, nulls first, among all rows or those of its group.

    The rows are range partitioned by group and order, so that a group that holds most rows lies in
    many partitions; each partition numbers its rows as they pass and is written once; the driver
    adds up one row a partition, and its first group's places start where the partitions before ended.
    Rows that tie in everything are told apart by where they were read. Nulls form a group and come
    first. `out` must be no column of df; an empty table gives an empty one.
    """
    group = group or []
    keys = [f"_g{i}" for i in range(len(group))]
    values = [F.col(f"`{g}`").alias(k) for g, k in zip(group, keys, strict=True)] + [o.alias(f"_o{i}") for i, o in enumerate(order)]
    plain = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("_row"), *values, F.monotonically_increasing_id().alias("_tie"))
    sort = [F.asc_nulls_first(c) for c in plain.columns[1:]]
    ranged = plain.repartitionByRange(*sort).sortWithinPartitions(*sort).select("_row", *keys)
    schema = StructType([*ranged.schema.fields, *(StructField(n, t) for n, t in (("_local", LongType()), ("_part", IntegerType()), ("_first", BooleanType()), ("_last", BooleanType())))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # the row before
        local, first = 0, True
        for batch, last in _one_on(batches):
            n = batch.num_rows
            new = np.zeros(n, bool)
            for k in range(1, 1 + len(keys)):
                new[1:] |= _steps(batch.column(k))
            if held is not None and keys:
                new[0] = any(held.column(k)[0].as_py() != batch.column(k)[0].as_py() for k in range(1, 1 + len(keys)))
            at = np.arange(n)
            starts = np.maximum.accumulate(np.where(new, at, -1))
            places = np.where(starts < 0, at + local + 1, at - starts + 1)
            firsts = first & (starts < 0)
            ends = np.zeros(n, bool)
            ends[-1] = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(np.full(n, part, np.int32)), pa.array(firsts), pa.array(ends)], names=[*batch.schema.names, "_local", "_part", "_first", "_last"])
            local, first, held = int(places[-1]), bool(firsts[-1]), batch.slice(n - 1)

    rows = stored(ranged.mapInArrow(number, schema), "places")
    head = rows.where("_last").select("_part", "_local", "_first", *keys).orderBy("_part").collect()  # one row a partition
    heads = {r._part: [r[k] for k in keys] for r in rows.where("_first and _local = 1").select("_part", *keys).collect()}
    carry, before, total = [], None, 0
    for r in head:
        add = total if before is not None and heads[r._part] == before else 0
        carry.append((r._part, add))
        total = r._local + (add if r._first else 0)
        before = [r[k] for k in keys]
    starts = df.sparkSession.createDataFrame([c for c in carry if c[1]], "_part int, _add long")
    whole = rows.join(F.broadcast(starts), "_part", "left")  # at most one row a partition
    place = F.col("_local") + F.when(F.col("_first"), F.coalesce("_add", F.lit(0))).otherwise(0)
    return whole.select("_row.*", place.cast("long").alias(out))


def _one_on(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches with rows, each with whether it is the last."""
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield before, False
            before = batch
    if before is not None:
        yield before, True
