"""Per-identity quotas: tables, rebalancing and intake.

The greedy walks never take all clips: clips of equal signature (identity set) differ only in order,
so of each signature only as many first clips are walked over as the walk could take. A walk reads its
clips batch by batch in their order, and keeps counts, or eight to sixteen bytes a clip that may leave.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.shared import stored


def quota_table(counts: DataFrame, identities: DataFrame, max_samples: int) -> DataFrame:
    """Quota of each identity (an equal share, the first ones in order one more), its count and what it lacks or has over.

    counts: (identity, n); identities: (identity). The table of identities is small and is ranked as a whole.
    """
    total = identities.agg(F.array_sort(F.collect_set("identity")).alias("all"))
    ranked = total.select(F.size("all").alias("_n"), F.posexplode("all").alias("_i", "identity"))
    quota = F.floor(F.lit(max_samples) / F.col("_n")) + (F.col("_i") < F.lit(max_samples) % F.col("_n")).cast("int")
    out = ranked.select("identity", quota.cast("bigint").alias("quota")).join(counts, "identity", "left").na.fill(0, ["n"])
    return out.withColumns({"over": F.greatest(F.lit(0), F.col("n") - F.col("quota")), "under": F.greatest(F.lit(0), F.col("quota") - F.col("n")), "met": F.col("n") >= F.col("quota")})


#: Rows that an intake may walk over.
WALK_ROWS = 100_000_000


def _one_walk(rows: DataFrame, walk: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], order: list, shape: str) -> DataFrame:
    """walk() over all rows in one order, batch after batch; signatures come as JSON in the column _key."""
    rows = rows.withColumn("_key", F.to_json("signature")).drop("signature")
    return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(walk, shape)


def _signatures(batch: pa.RecordBatch) -> list[tuple[str, ...]]:
    """Of each row; equal ones are one object."""
    keys = batch.column("_key").dictionary_encode()
    known = [tuple(json.loads(k)) for k in keys.dictionary.to_pylist()]
    return [known[i] for i in keys.indices.to_pylist()]


def _goes(signature: tuple[str, ...], counts: dict[str, int], quotas: dict[str, int]) -> bool:
    """Whether all identities are over their quotas; then the clip goes, and is counted no more."""
    if not all(counts[c] > quotas[c] for c in signature):
        return False
    for c in signature:
        counts[c] -= 1
    return True


def removals(clips: list[tuple[int, tuple[str, ...]]], counts: dict[str, int], quotas: dict[str, int]) -> list[int]:
    """Positions to remove from clips (position, identities), in order: those of largest excess first, none below its quota.

    Only identities with a quota can be over it. Of equal excess the first clips go.
    """
    counts, start, out = dict(counts), dict(counts), []
    over = {c for c, q in quotas.items() if start.get(c, 0) > q}
    able = [(max(start[c] - quotas[c] for c in s), at, s) for at, s in clips if s and over.issuperset(s)]
    for _, at, s in sorted(able, key=lambda x: (-x[0], x[1])):
        if _goes(s, counts, quotas):
            out.append(at)
    return out


def rebalance_over_quota(entries: DataFrame, quotas: DataFrame, order: str = "clip_id") -> DataFrame:
    """Clips to remove. entries: (clip_id, signature), `order` being their place in the manifest; quotas: (identity, quota).

    A clip is removed only while all its identities are over their quotas, so of a signature at most
    its smallest excess, and only its first clips, can go: no others are walked over.
    """
    seen = entries.select(F.explode("signature").alias("identity")).groupBy("identity").agg(F.count("*").alias("n"))
    table = {r.identity: (r.n, r.quota) for r in quotas.join(seen, "identity").collect()}  # the cast
    counts, limits = {c: n for c, (n, _) in table.items()}, {r: q for r, (_, q) in table.items()}
    excess = quotas.join(seen, "identity").select("identity", (F.col("n") - F.col("quota")).alias("x"))
    each = entries.where(F.size("signature") > 0).select("signature").distinct().withColumn("identity", F.explode("signature"))
    most = each.join(excess, "identity", "left").groupBy("signature").agg(F.min(F.coalesce("x", F.lit(0))).alias("most"), F.max("x").alias("_top"))
    place = F.row_number().over(Window.partitionBy("signature").orderBy(order))
    some = entries.join(most.where(F.col("most") > 0), "signature").withColumn("_rn", place).where(F.col("_rn") <= F.col("most"))

    def walk(batches):
        left = dict(counts)
        for batch in batches:
            goes = [_goes(x, left, limits) for x in _signatures(batch)]
            yield pa.record_batch([batch.column("_at").filter(pa.array(goes, pa.bool_()))], ["_at"])

    gone = _one_walk(some.select(F.col(order).cast("long").alias("_at"), "signature", "_top"), walk, [F.desc("_top"), "_at"], "_at long")
    return entries.join(gone, F.col(order) == F.col("_at"), "left_semi")


class Clips:
    """A queue of clips of one signature: ids that were there before, in order, then (turn, id) of those taken in."""

    __slots__ = ("at", "new", "old")

    def __init__(self) -> None:
        self.old, self.new, self.at = array("q"), array("q"), 0

    def __bool__(self) -> bool:
        return self.at < len(self.old) + len(self.new) // 2

    def first(self) -> tuple[int, ...]:
        if self.at < len(self.old):
            return 0, self.old[self.at]
        i = 2 * (self.at - len(self.old))
        return 1, self.new[i], self.new[i + 1]

    def pop(self) -> int:
        clip = self.first()[-1]
        self.at += 1
        return clip


class SetTrie:
    """Signatures by their sorted identities, each with a queue of clips; finds the smallest ones between two sets without a scan."""

    __slots__ = ("kids", "live", "queue")

    def __init__(self) -> None:
        self.kids: dict[str, SetTrie] = {}
        self.live = 0  # clips under here
        self.queue = Clips()

    def add(self, signature: tuple[str, ...], clip: int, turn: int | None = None) -> None:
        """A clip that was there before, or that came in its turn."""
        node = self
        node.live += 1
        for c in signature:
            if c not in node.kids:
                node.kids[c] = SetTrie()
            node = node.kids[c]
            node.live += 1
        if turn is None:
            node.queue.old.append(clip)
        else:
            node.queue.new.extend((turn, clip))

    def pop(self, signature: tuple[str, ...]) -> int:
        """The first clip of a signature, which has one; branches without clips go."""
        node, self.live = self, self.live - 1
        for c in signature:
            below = node.kids[c]
            below.live -= 1
            if not below.live:
                del node.kids[c]
            node = below
        return node.queue.pop()

    def smallest(self, inside: tuple[str, ...], held: set[str]) -> tuple[str, ...] | None:
        """Of the proper subsets of `inside` (sorted) that hold all of `held`, one with the fewest identities; of equal ones that whose first clip comes first."""
        # places in `inside` after which no identity that must be held is left
        last = max((i for i, c in enumerate(inside) if c in held), default=-1)
        level: list[tuple[SetTrie, int, tuple[str, ...]]] = [(self, -1, ())]
        for _ in range(len(inside) - 1):
            deeper, done = [], []
            for node, at, path in level:
                for i in range(at + 1, len(inside)):
                    kid = node.kids.get(inside[i])
                    if kid is not None:
                        way = (*path, inside[i])
                        deeper.append((kid, i, way))
                        if i >= last and kid.queue:
                            done.append((kid.queue.first(), way))
                    if inside[i] in held:
                        break  # it can't be passed over
            if done:
                return min(done)[1]
            level = deeper
        return None


class Intake:
    """The state of a walk over candidates: what each identity has, and the clips that can leave.

    The clip that leaves is the first of those with fewest identities; accepted clips come after all others.
    """

    def __init__(self, quotas: dict[str, int]) -> None:
        self.quotas, self.trie, self.turn = quotas, SetTrie(), 0
        self.counts: Counter = Counter()
        self.open_quotas = {c for c, q in quotas.items() if q > 0}

    def _count(self, signature: tuple[str, ...], n: int) -> None:
        for c in signature:
            self.counts[c] += n
            if c in self.quotas:
                (self.open_quotas.add if self.counts[c] < self.quotas[c] else self.open_quotas.discard)(c)

    def hold(self, signature: tuple[str, ...], n: int, ids: list[int]) -> None:
        """n clips that are there before the walk, of which the given ones can leave."""
        self._count(signature, n)
        mine = tuple(sorted(set(signature)))
        for i in ids:
            self.trie.add(mine, i)

    def offer(self, clip: int, signature: tuple[str, ...]) -> tuple[bool, int | None] | None:
        """(accepted, the clip that leaves for it); None once all quotas are met, which ends the walk."""
        if not self.open_quotas:
            return None
        self.turn += 1
        if not signature:
            return True, None
        mine = tuple(sorted(set(signature)))
        full = {c for c in mine if self.counts[c] >= self.quotas.get(c, 0)}
        if len(full) == len(mine):
            return False, None
        leaves = None
        if full:
            swap = self.trie.smallest(mine, full)
            if swap is None:
                return False, None
            leaves = self.trie.pop(swap)
            self._count(swap, -1)
        self.trie.add(mine, clip, self.turn)
        self._count(mine, 1)
        return True, leaves


def intake(candidates: list[tuple[int, tuple[str, ...]]], existing: dict[tuple[str, ...], tuple[int, list[int]]], quotas: dict[str, int]) -> list[tuple[int, bool, int | None]]:
    """Walk candidates (id, identities) in order: (id, accepted, id of the clip that leaves for it).

    existing: of each signature the number of its clips, and the ids of the first ones, all signatures'
    clips being ordered by their id, which is their place in the manifest.
    """
    walk, out = Intake(quotas), []
    for s, (n, ids) in existing.items():
        walk.hold(s, n, ids)
    for clip, s in candidates:
        said = walk.offer(clip, s)
        if said is None:
            break
        out.append((clip, *said))
    return out


def quota_intake(candidates: DataFrame, entries: DataFrame, quotas: DataFrame, max_samples: int) -> DataFrame:
    """Decision on each candidate (clip_id, pos, signature), in the order pos: accepted, and the clip that leaves for it (swapped).

    entries: (clip_id, signature), clip ids in the order of the manifest. A signature once refused stays
    refused, and at most max_samples clips are ever accepted, so the first max_samples + 1 candidates
    of a signature decide, and its first max_samples + 1 entries can leave; those without identities
    skip the gate and are all kept, as they change no count. All others are not accepted.
    """
    rank = F.row_number().over(Window.partitionBy("signature").orderBy("pos"))
    some = candidates.where(F.size("signature") > 0).withColumn("_rn", rank).where(F.col("_rn") <= max_samples + 1)
    size = F.count("*").over(Window.partitionBy("signature"))
    first = F.row_number().over(Window.partitionBy("signature").orderBy("clip_id"))
    held = entries.where(F.size("signature") > 0).withColumns({"n": size, "_rn": first}).where(F.col("_rn") <= max_samples + 1)
    limits = {r.identity: r.quota for r in quotas.select("identity", "quota").collect()}  # the cast
    none = F.lit(None).cast("long")
    rows = some.select(F.col("pos").cast("long").alias("pos"), F.col("clip_id").cast("long").alias("clip_id"), "signature", none.alias("n"))
    # a signature's first entry tells the number of all
    rows = rows.unionByName(held.select(none.alias("pos"), F.col("clip_id").cast("long").alias("clip_id"), "signature", F.when(F.col("_rn") == 1, F.col("n")).otherwise(0).alias("n")))
    rows = stored(rows, "walk")
    n = rows.count()
    if n > WALK_ROWS:
        raise ValueError(f"a walk over {n} rows does not fit one task (at most {WALK_ROWS}); lower the cap or the quotas")

    def walk(batches):
        state = Intake(limits)
        for batch in batches:
            said: list[tuple[int, bool, int | None]] = []
            for pos, clip, n, s in zip(batch.column("pos").to_pylist(), batch.column("clip_id").to_pylist(), batch.column("n").to_pylist(), _signatures(batch), strict=True):
                if pos is None:
                    state.hold(s, n, [clip])
                elif (answer := state.offer(clip, s)) is not None:
                    said.append((pos, *answer))
            columns = list(zip(*said, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["pos", "accepted", "swapped"])

    done = stored(_one_walk(rows, walk, [F.asc_nulls_first("pos"), "clip_id"], "pos long, accepted boolean, swapped long"), "intake")
    last = F.broadcast(done.agg(F.max("pos").alias("_last")).withColumn("_k", F.lit(1)))
    out = candidates.withColumn("_k", F.lit(1)).join(last, "_k", "left").drop("_k").join(done, "pos", "left")
    free = (F.size("signature") == 0) & (F.col("pos") <= F.coalesce("_last", F.col("pos")))
    return out.withColumn("accepted", F.coalesce("accepted", free)).drop("_last")


#: Identities that a clip may have beside its full ones, so that its subsets are looked up one by one.
FREE = 10


def swap_candidates(new: DataFrame, entries: DataFrame, quotas: DataFrame) -> DataFrame:
    """The existing signature that could make room for each new clip: the smallest proper subset that holds all its full identities.

    Both sides are joined by signature classes, never clip by clip: the subsets of a signature that
    hold its full identities are looked up as they are, at most 2**FREE of them; a signature with more identities
    meets those that hold the one of its full identities that is rarest among the existing ones. quotas: (identity, met).
    """
    full = F.broadcast(quotas.agg(F.sort_array(F.collect_list(F.when(F.col("met"), F.col("identity")))).alias("full")).withColumn("_k", F.lit(1)))
    fresh = new.select("signature").distinct().withColumn("_k", F.lit(1)).join(full, "_k").select("signature", F.array_intersect("signature", "full").alias("held"))
    fresh = fresh.where(F.size("held") > 0).withColumn("free", F.array_except("signature", "held"))
    old = entries.where(F.size("signature") > 0).select(F.array_sort(F.array_distinct("signature")).alias("old"), F.col("signature").alias("shown")).groupBy("old").agg(F.min("shown").alias("shown"))
    few = F.size("free") <= FREE
    # every number but the last is a choice among the free ones; the last one would be the whole signature
    chosen = F.transform(F.sequence(F.lit(0), F.expr("cast(shiftleft(1, size(free)) - 2 as int)")), lambda n: F.filter("free", lambda _, i: F.getbit(n, i) == 1))
    small = fresh.where(few & (F.size("free") > 0)).select("signature", F.explode(chosen).alias("_more"), "held").select("signature", F.array_sort(F.concat("held", "_more")).alias("old"))
    found = small.join(old, "old").select("signature", "old", "shown")
    large = fresh.where(~few)
    uses = old.select(F.explode("old").alias("member")).groupBy("member").agg(F.count("*").alias("n"))
    rarest = large.select("signature", "held", F.explode("held").alias("member")).join(uses, "member").groupBy("signature", "held").agg(F.min_by("member", F.struct("n", "member")).alias("member"))
    fits = (F.size(F.array_except("old", "signature")) == 0) & (F.size(F.array_except("signature", "old")) > 0) & (F.size(F.array_except("held", "old")) == 0)
    found = found.unionByName(rarest.join(old.withColumn("member", F.explode("old")), "member").where(fits).select("signature", "old", "shown"))
    best = found.groupBy("signature").agg(F.min_by("shown", F.struct(F.size("old"), "old")).alias("swap"))
    return new.join(best, "signature", "left")
