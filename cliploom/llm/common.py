"""Shared pieces: work tables, gapless numbering without hot partitions, word keys, names that clash with none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.shared import discard, stored, work_tables

__all__ = ["BLANKS", "BLANKS_SQL", "discard", "fresh", "mixed", "running_total", "split_words", "stored", "text_slices", "work_tables"]

#: The white space of all contracts here: space and U+0009..U+000D.
BLANKS = b" \t\n\x0b\x0c\r"
BLANKS_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts as (ends, places, words): text i has the places ends[i-1]..ends[i], each a place in the list of distinct words.

    Words are runs of characters outside U+0020 and U+0009..U+000D; null texts have none.
    """
    texts = pa.concat_arrays([texts]).cast(pa.large_string())  # a slice would keep its offset, which the cast handles wrongly
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    ends = cut.offsets.to_numpy()[1:]
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    places = coded.indices.to_numpy()
    first = int(cut.offsets[0].as_py())
    ends = ends - first
    if b"" in words:  # what blanks at the ends of a text leave
        real = places != words.index(b"")
        ends = np.append(0, np.cumsum(real))[ends]
        places = places[real]
    return ends, places, words


def text_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with up to `most` bytes of text; one longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def running_total(df: DataFrame, group: list[str], order: list[str], weight: Column, out: str, spread_by: Column, buckets: int) -> DataFrame:
    """Column `out`: the sum of `weight` over the rows before this one in its group.

    A group may hold most rows, so it is dealt into buckets by a hash; each bucket is summed in
    order, and starts where the buckets before it end. The order of a group is therefore
    (bucket, order), the same in every run. The table of bucket totals has at most
    groups x buckets rows. Group columns hold no nulls.
    """
    rows = df.withColumns({"_rt_w": weight.cast("long"), "_rt_b": F.pmod(F.xxhash64(spread_by), F.lit(buckets))})
    keys = [*group, "_rt_b"]
    totals = rows.groupBy(*keys).agg(F.sum("_rt_w").alias("_rt_sum"))
    before = Window.partitionBy(*group).orderBy("_rt_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_rt_sum").over(before), F.lit(0)).alias("_rt_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum("_rt_w").over(inside), F.lit(0)))
    return rows.join(starts, keys).withColumn(out, F.col(out) + F.col("_rt_start")).drop("_rt_w", "_rt_start", "_rt_b")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
