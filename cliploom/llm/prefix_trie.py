"""Prefix trie of conversations by ROLLUP over positional turn-id columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.ranking import placed
from cliploom.functions.shared import stored

#: Columns of the first block and the most of a later one, which doubles from block to block.
FIRST_BLOCK, LARGEST_BLOCK = 8, 32
#: Members whose ids lie in one span of this width are joined to one string before they meet the rest of their node.
ID_SPAN = 4096
#: Bytes of a turn id: a hash of role and text, then the text's length.
ID_BYTES = 20
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over role and text, then 4 bytes of the text's length in UTF-8. Null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(both, 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, tid): turns numbered from 1 in the order of turn (null first), role and text. Rows without a conversation are none."""
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.xxhash64(text).alias("hash"), turn_id(F.col(role), F.col(text)).alias("tid"))
    return placed(rows, [F.col("turn"), F.col("role"), F.col("hash"), F.col("tid")], ["conv"], "pos").select("conv", "pos", "tid")


def _blocks(turns: DataFrame, convs: DataFrame, start: int, width: int) -> DataFrame:
    """One row a conversation of convs: its turns start+1..start+width as columns t1..t<width>, null past its end."""
    inside = turns.where((F.col("pos") > start) & (F.col("pos") <= start + width))
    cols = [F.max(F.when(F.col("pos") == start + i, F.col("tid"))).alias(f"t{i}") for i in range(1, width + 1)]
    return convs.join(inside.groupBy("conv").agg(*cols), "conv", "left")


def _path(width: int) -> Column:
    """The turn ids of a row, one after the other: nulls are at the end only."""
    return F.concat(*[F.coalesce(F.col(f"t{i}"), F.lit(b"")) for i in range(1, width + 1)])


def _depth(level: Column, width: int) -> Column:
    """How many of the columns a row of the rollup kept: grouping_id has a bit set for each one that it dropped."""
    return F.lit(width) - F.bit_count(level)


def _rollup(rows: DataFrame, width: int, *aggregates: str) -> DataFrame:
    """Aggregates of every prefix of t1..t<width> under each entry node, with its depth and path.

    A conversation that ends earlier has nulls past its end, which the rollup groups as values, too; such
    groups are no prefixes and go.
    """
    cols = ", ".join(f"t{i}" for i in range(1, width + 1))
    spark = rows.sparkSession
    out = spark.sql(f"SELECT entry, {cols}, grouping_id() AS level, {', '.join(aggregates)} FROM {{rows}} GROUP BY entry, ROLLUP ({cols})", rows=rows)
    out = out.withColumns({"d": _depth(F.col("level"), width).cast("int"), "path": _path(width)})
    return out.where(F.octet_length("path") == F.col("d") * ID_BYTES).drop("level", *[f"t{i}" for i in range(1, width + 1)])


def _columns(nodes: DataFrame, width: int) -> list[Column]:
    """Positional columns of a path again."""
    return [F.when(F.col("d") >= i, F.expr(f"substring(path, {1 + (i - 1) * ID_BYTES}, {ID_BYTES})")).alias(f"t{i}") for i in range(1, width + 1)]


def _last_bytes(path: Column) -> Column:
    """Bytes of the last text of a path."""
    return F.conv(F.hex(F.substring(path, -4, 4)), 16, 10).cast("long")


def ends_hashes(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys with `ends_sha256`: SHA-256 of the members' decimal ids, ascending and joined by commas.

    Ids of a span of ID_SPAN are joined first, at most ID_SPAN of them; a node's spans then pass one task
    in order, and the hash takes them one by one, so that no task holds a node's members.
    """
    # spans below zero come first, and floor keeps each span in order
    spans = members.groupBy(*keys, F.floor(F.col(member) / ID_SPAN).alias("_span")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda x: x.cast("string")), ",").alias("_ids"))
    ordered = spans.repartition(*keys).sortWithinPartitions(*keys, "_span").select(*keys, "_ids")
    schema = ", ".join(f"`{k}` {members.schema[k].dataType.simpleString()}" for k in keys) + ", ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out: list[tuple] = []
        types: list[pa.DataType] = []
        for batch in batches:
            types = [*batch.schema.types[:-1], pa.string()]
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 4096:
                yield _batch(out, types)
                out = []
        if now is not None:
            out.append((*now, sha.hexdigest()))
        if out:
            yield _batch(out, types)

    def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*keys, "ends_sha256"])

    return ordered.mapInArrow(run, schema)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations.

    convs: (conv), each once and not null; turns: (conv, pos, tid) with pos from 1 without gaps.
    Result: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens (subtree sum of (n_convs - 1) times the bytes of a node's last text), and
    ends_sha256 over the members that end at the node. Depth and smallest member name a node.

    A block of turn-id columns is aggregated by one ROLLUP for all its prefixes. Conversations that share
    the node at a block's end with others go on in the next block, keyed by that node; of those that are
    alone there, the rest is a chain and needs no aggregation. A second ROLLUP over the nodes, from the last block to
    the first, adds up subtrees; a block's totals ride on the node where it was entered. Both aggregate
    before they shuffle, so a hot prefix is no hot task. No conversations: no nodes.
    """
    turns = stored(turns, "trie-turns")
    convs = stored(convs.join(turns.groupBy("conv").agg(F.max("pos").alias("length")), "conv", "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long")), "trie-convs")
    live = convs.select("conv", "length", F.lit(None).cast("long").alias("entry"))
    blocks: list[tuple[int, int, DataFrame]] = []
    ends, chains = [], []
    start, width = 0, FIRST_BLOCK
    while True:
        rows = stored(_blocks(turns, live, start, width), f"trie-block-{start}")
        nodes = stored(_rollup(rows, width, "min(conv) AS conv_id", "count(*) AS n_convs", "max(length) AS longest"), f"trie-nodes-{start}")
        blocks.append((start, width, nodes))
        placed_rows = rows.select("conv", "length", "entry", _path(width).alias("path"))
        ends.append(placed_rows.where(F.col("length").between(start + (start > 0), start + width)).select(F.lit(start).alias("start"), F.col("entry").alias("e_entry"), F.col("path").alias("e_path"), "conv"))
        deep = nodes.where((F.col("d") == width) & (F.col("longest") > start + width)).select(F.col("entry").alias("n_entry"), F.col("path").alias("n_path"), F.col("conv_id").alias("node"), F.col("n_convs"))
        more = placed_rows.where(F.col("length") > start + width).join(deep, F.col("entry").eqNullSafe(F.col("n_entry")) & (F.col("path") == F.col("n_path"))).select("conv", "length", F.col("node").alias("entry"), "n_convs")
        more = stored(more, f"trie-on-{start}")
        start, width = start + width, min(2 * width, LARGEST_BLOCK)
        chains.append(more.where("n_convs = 1").select("conv", "length", F.lit(start).alias("chain")))
        live = more.where("n_convs > 1").select("conv", "length", "entry")
        if live.isEmpty():
            break

    below: DataFrame | None = None
    done: list[DataFrame] = []
    for start, width, nodes in reversed(blocks):
        mine = nodes.withColumn("bytes", F.when(F.col("d") > 0, _last_bytes(F.col("path"))).otherwise(0))
        # the row without columns stands for the node where the block is entered, which is the root or a node of the block before
        mine = mine.where((F.col("d") > 0) | F.lit(start == 0))
        own = mine.select("*", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("longest") == F.col("d") + start).cast("long").alias("leaf"), F.lit(0).cast("long").alias("under"))
        own = own.withColumn("chain", ((F.col("d") == width) & (F.col("longest") > start + width) & (F.col("n_convs") == 1)).cast("long"))
        if below is not None:
            own = own.join(below, (F.col("d") == width) & (F.col("conv_id") == F.col("b_entry")), "left")
            own = own.withColumns({"saved": F.col("saved") + F.coalesce("b_saved", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("b_leaves", F.lit(0)), "under": F.coalesce("b_children", F.lit(0))})
        own = own.withColumns({"leaf": F.col("leaf") + F.col("chain"), "under": F.col("under") + F.col("chain")})
        levels = [f"count(CASE WHEN d = {i} THEN 1 END) AS c{i}" for i in range(1, width + 1)]
        sums = _rollup(
            own.select("entry", "conv_id", F.col("d"), "n_convs", "saved", "leaf", "under", *_columns(own, width)),
            width, "min(conv_id) AS conv_id", "max(n_convs) AS n_convs", "sum(saved) AS saved_tokens", "sum(leaf) AS n_leaves", f"sum(CASE WHEN d = {width} THEN under END) AS at_end", *levels,
        )
        children = F.expr("CASE d " + " ".join(f"WHEN {i - 1} THEN c{i}" for i in range(1, width + 1)) + f" ELSE coalesce(at_end, 0) END")
        sums = stored(sums.select("entry", "d", "path", "conv_id", "n_convs", "saved_tokens", "n_leaves", children.alias("n_children")), f"trie-sums-{start}")
        below = sums.where("d = 0").select(F.col("entry").alias("b_entry"), F.col("saved_tokens").alias("b_saved"), F.col("n_leaves").alias("b_leaves"), F.col("n_children").alias("b_children"))
        kept = sums if start == 0 else sums.where("d > 0")
        up = kept.where("d > 0").select(F.col("entry").alias("p_entry"), F.col("path").alias("p_path"), F.col("conv_id").alias("p_conv"))
        over = F.when(F.col("d") > 1, F.expr(f"substring(path, 1, (d - 1) * {ID_BYTES})"))  # null at the top: no partner
        kept = kept.join(up, F.col("entry").eqNullSafe(F.col("p_entry")) & (over == F.col("p_path")), "left")
        if start == 0:
            root = sums.where("d = 0").select(F.col("conv_id").alias("root"), F.lit(1).alias("top"))  # one row
            kept = kept.join(F.broadcast(root), F.col("d") == F.col("top"), "left")
        else:
            kept = kept.withColumn("root", F.when(F.col("d") == 1, F.col("entry")))
        done.append(kept.select(F.lit(start).alias("start"), "entry", "path", "conv_id", (F.col("d") + start).cast("long").alias("depth"), F.coalesce("p_conv", "root").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))

    every_end = ends[0]
    for e in ends[1:]:
        every_end = every_end.unionAll(e)
    hashes = ends_hashes(every_end, ["start", "e_entry", "e_path"], "conv").withColumnsRenamed({"start": "e_start"})
    nodes = done[0]
    for n in done[1:]:
        nodes = nodes.unionAll(n)
    same = (F.col("start") == F.col("e_start")) & F.col("entry").eqNullSafe(F.col("e_entry")) & (F.col("path") == F.col("e_path"))
    shared = nodes.join(hashes, same, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    alone = chains[0]
    for c in chains[1:]:
        alone = alone.unionAll(c)
    last = F.col("pos") == F.col("length")
    chain = turns.select("conv", "pos").join(alone, "conv").where(F.col("pos") > F.col("chain")).select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return shared.unionAll(chain)


def spliced(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) of conversations rebuilt on the one that leads their family.

    Conversation c takes the first h turns of conversation c - c % family (all if it has fewer, none if
    it is not there), then its own turns after its first h; h is the unsigned CRC-32 of c in decimal
    modulo `most`. A conversation can end up without turns.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    lead = F.col("conv") - F.col("conv") % family
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    known = convs.select("conv", lead.alias("lead"), h.cast("long").alias("h")).join(convs.select(F.col("conv").alias("lead"), F.col("n").alias("lead_n")), "lead", "left")
    known = known.withColumn("took", F.least("h", F.coalesce("lead_n", F.lit(0).cast("long"))))
    heads = turns.where((F.col("conv") % family == 0) & (F.col("pos") < most)).select(F.col("conv").alias("lead"), "pos", "tid")
    taken = known.join(heads, "lead").where(F.col("pos") <= F.col("took")).select("conv", "pos", "tid")
    own = turns.join(known.select("conv", "h", "took"), "conv").where(F.col("pos") > F.col("h")).select("conv", (F.col("took") + F.col("pos") - F.col("h")).alias("pos"), "tid")
    return convs.select("conv"), taken.unionAll(own)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """trie() of the conversations rebuilt by spliced(). Nulls: a null turn comes first, a null role or text is empty, a null
    conv_id is no conversation. Repeated rows are turns each; turns of equal number follow role, then text by hash. Other
    columns are not read; an empty table has no nodes."""
    turns = stored(turns_of(conversations), "trie-input")
    return trie(*spliced(turns))
