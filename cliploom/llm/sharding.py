"""Sharding: a minimax contiguous partition of atomic text groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, stored

FIRST_BITS, MORE_BITS = 12, 8


def _cuts(ends: np.ndarray, single: np.ndarray | None, capacity: int, shards: int) -> list[int]:
    """Where the greedy fill of each shard ends. ends: running sizes of the cells.

    Without `single` cells are atomic; with it, cells of more than one group can be cut anywhere.
    """
    at, out = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        full = int(ends[i - 1]) if i else 0
        if single is not None and i < len(ends) and not single[i]:
            full = at + capacity
        at = max(at, full)
        out.append(at)
    return out


def _smallest(ends: np.ndarray, single: np.ndarray | None, shards: int) -> int:
    total = int(ends[-1])
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        if _cuts(ends, single, mid, shards)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int, key: str = "key", size: str = "bytes") -> tuple[int, list[int]]:
    """Smallest capacity, and the last key of each shard but the last, over groups ordered by a 64-bit key.

    The driver holds a histogram of the key range (2**12 cells at first) and never the groups. Cells
    taken as atomic give a capacity that surely suffices, cells taken as divisible one that is surely
    needed; only cells in which a cut can lie between the two are split further, by 2**8. When none
    is left, the greedy fill over cells is the one over groups.
    """
    shift = 64 - FIRST_BITS
    first = groups.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()
    cells = sorted((r.cell << shift, (r.cell << shift) + (1 << shift) - 1, int(r.bytes), r.n) for r in first)
    if not cells:
        return 0, []
    while True:
        ends = np.cumsum(np.array([c[2] for c in cells], dtype=np.int64))
        single = np.array([c[3] == 1 for c in cells])
        low, high = _smallest(ends, single, shards), _smallest(ends, None, shards)
        spans = list(zip(_cuts(ends, None, low, shards), _cuts(ends, single, high, shards)))[:-1]
        begins = ends - np.array([c[2] for c in cells])
        wide = [i for i, c in enumerate(cells) if c[3] > 1 and any(begins[i] < b and ends[i] > a for a, b in spans)]
        if not wide or shift == 0:
            break
        finest = max(shift - MORE_BITS, 0)
        near = F.shiftright(key, shift).isin([cells[i][0] >> shift for i in wide if cells[i][1] - cells[i][0] == (1 << shift) - 1])
        again = groups.where(near).groupBy(F.shiftright(key, finest).alias("cell")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()
        if not again:
            shift = finest
            continue
        gone = {cells[i][0] for i in wide if cells[i][1] - cells[i][0] == (1 << shift) - 1}
        cells = sorted([c for c in cells if c[0] not in gone] + [(r.cell << finest, (r.cell << finest) + (1 << finest) - 1, int(r.bytes), r.n) for r in again])
        shift = finest
    last = []
    for cut in _cuts(ends, None, high, shards)[:-1]:
        i = int(np.searchsorted(ends, cut, side="right")) - 1
        last.append(cells[i][1] if i >= 0 else -(1 << 63))
    return high, last


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """Put every row into one of `shards` shards so that the largest shard is as small as it can be.

    Groups of equal texts (null counts as empty) are atomic and are ordered by a 64-bit hash of the
    text; shards are runs of that order. The smallest feasible capacity is found by binary search
    with a greedy check. A row's size is its UTF-8 bytes plus 1. Slots number the rows of a shard
    from 0 without gaps; the numbering is dealt over hash buckets, so a shard is never one task.

    Result: id_col, size, text_crc32, shard, slot. Repeated rows each get a slot of their own; null
    ids are kept; an empty table gives an empty result; a table with fewer groups than shards leaves
    shards empty. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("_sh_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-rows")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    _, last = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for key in last:
        shard = shard + (F.col("key") > F.lit(key)).cast("int")
    total = groups.agg(F.sum("n")).first()[0] or 0
    placed = running_total(rows.withColumn("shard", shard.cast("int")), ["shard"], ["_sh_id", "key"], F.lit(1), "slot", F.struct("_sh_id", "key"), max(32, total // rows_per_bucket))
    return placed.select(F.col("_sh_id").alias(id_col), "size", "text_crc32", "shard", "slot")
