"""N-gram Jaccard join by vertical partitioning of the shingle order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, split_words, stored, text_slices
from .components import components

#: A shingle is a hash of 46 bits; the highest 6 choose its fragment, the others travel in 5 bytes.
FRAGMENT_BITS, LOW_BITS = 6, 40
FRAGMENTS = 1 << FRAGMENT_BITS
SPARE = np.uint64(64 - FRAGMENT_BITS - LOW_BITS)
#: Bits for a class in a fragment, which holds far fewer shingles than these can count.
OWNER_BITS = 24
#: Documents and bytes of text that a worker handles at a time, and shingles of a cell of a fragment, about.
CHUNK, CHUNK_BYTES, TOKENS_PER_CELL = 2000, 8 << 20, 1_000_000
#: Fragments of the order in which the overlap of a pair is counted.
PIECES = 8
#: Documents for which one task can hold all reports of one class.
DOCS_PER_SALT = 2_000_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

def _weights(n: int) -> np.ndarray:
    return np.resize(MULTIPLIERS, n) + np.arange(n, dtype=np.uint64) * np.uint64(2)


def shingle_sets(texts: pa.Array, words_each: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text: a hash of its words, another one to check it by, and the sorted hashes of its distinct shingles."""
    ends, places, words = split_words(texts, True)
    with np.errstate(over="ignore"):
        k = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))[places]
        total = np.zeros(max(0, len(k) - words_each + 1), np.uint64)
        for i, m in enumerate(_weights(words_each)):
            total += k[i : i + len(total)] * m
        total = mixed(total) >> SPARE
        sets, of, check, at = [], [], [], 0
        for to in ends.tolist():
            n, raw = to - at, k[at:to].tobytes()
            of.append(xxhash.xxh3_64_intdigest(raw, seed))
            check.append(xxhash.xxh64_intdigest(raw, 1))
            if n >= words_each:
                sets.append(_distinct(total[at : to - words_each + 1]))
            elif n:
                sets.append(mixed((k[at:to] * _weights(n)).sum(keepdims=True) + np.uint64(n)) >> SPARE)
            else:
                sets.append(k[:0])
            at = to
    return np.array(of, np.uint64), np.array(check, np.uint64), sets


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, CHUNK):
            yield from text_slices(big.slice(at, CHUNK), 1, CHUNK_BYTES)


def _five_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_nj_id"), F.col(text_col).cast("string").alias("_nj_text"))


def digests(docs: DataFrame, id_col: str, text_col: str, words_each: int, seed: int = 0) -> DataFrame:
    """(_nj_id, cls, chk, n): documents of equal words have one class, and one check; n is the size of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            of, check, sets = shingle_sets(batch.column(1), words_each, seed)
            yield pa.record_batch([batch.column(0), pa.array(of.view(np.int64)), pa.array(check.view(np.int64)), pa.array([len(s) for s in sets], pa.int64())], names=["_nj_id", "cls", "chk", "n"])

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"_nj_id {dict(rows.dtypes)['_nj_id']}, cls long, chk long, n long")


def _by_class(where: np.ndarray, tokens: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A row for each class: its tokens, `where` being the class's place in the list."""
    order = np.argsort(where, kind="stable")
    where, tokens = where[order], tokens[order]
    starts = np.flatnonzero(np.diff(where, prepend=-1))
    at = where[starts]
    offsets = np.append(starts, len(where)).astype(np.int32)
    return pa.record_batch([pa.array(classes[at]), pa.array(sizes[at]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64)))], names=["cls", "n", "tokens"])


def shared_shingles(docs: DataFrame, id_col: str, text_col: str, words_each: int, slices: int, seed: int = 0) -> DataFrame:
    """(cls, n, tokens): shingles that documents of another class have too, in parts for each class.

    The order of the shingles (by hash) is cut into fragments, and each fragment into `slices` cells (a power of two).
    A chunk of documents sends a shingle that several of its documents hold once to the fragment,
    as known to be shared, so that a passage of a third of all documents costs one entry a chunk;
    other shingles go there with their document.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() * 7919
        for batch in _chunks(batches):
            of, _, sets = shingle_sets(batch.column(1), words_each, seed)
            distinct = {c: s for c, s in zip(of.tolist(), sets, strict=True) if len(s)}
            if not distinct:
                continue
            chunk += 1
            classes = np.fromiter(distinct, np.uint64, len(distinct)).view(np.int64)
            sizes = np.array([len(s) for s in distinct.values()], np.int32)
            tokens = np.concatenate(list(distinct.values()))
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.diff(tokens, prepend=tokens[0] + np.uint64(1)) != 0
            starts = np.flatnonzero(first)
            runs = np.diff(np.append(starts, len(tokens)))
            many = np.repeat(runs > 1, runs)
            part, kind, cls, ns, idx, tok = [], [], [], [], [], []
            if many.any():
                part.append(FRAGMENTS * slices + chunk % 64)
                kind.append(1)
                used, inverse = np.unique(owner[many], return_inverse=True)
                cls.append(classes[used].tobytes())
                ns.append(sizes[used].tobytes())
                idx.append(inverse.astype(np.uint16).tobytes())
                tok.append(tokens[many].tobytes())
            send = first  # one entry for each distinct shingle; 65535 marks those known to be shared
            owner = np.where(many, np.uint16(65535), owner)[send]
            tokens = tokens[send]
            cells = FRAGMENTS * slices
            bounds = np.searchsorted(tokens, np.arange(1, cells, dtype=np.uint64) << np.uint64(LOW_BITS - slices.bit_length() + 1))
            for cell, (t, o) in enumerate(zip(np.split(tokens, bounds), np.split(owner, bounds), strict=True)):
                if len(t):
                    used, inverse = np.unique(o, return_inverse=True)
                    real = used[used != 65535]
                    part.append(cell)
                    kind.append(0)
                    cls.append(classes[real].tobytes())
                    ns.append(sizes[real].tobytes())
                    inverse = np.where(o == 65535, 65535, inverse)
                    idx.append(inverse.astype(np.uint16).tobytes())
                    tok.append(_five_bytes(t))
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in (cls, ns, idx, tok))], names=["part", "kind", "cls", "ns", "idx", "tok"])

    def fragment(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        classes = np.concatenate([np.frombuffer(p[2], np.int64) for p in parts])
        sizes = np.concatenate([np.frombuffer(p[3], np.int32) for p in parts])
        known, at, place = np.unique(classes, return_index=True, return_inverse=True)
        # shingle and class (from 1; 0 is the mark of shared ones) in one number, so that one sort in place orders both
        keys, base = [], 0
        for _, _, cls, _, idx, tok in parts:
            own = np.frombuffer(idx, np.uint16).astype(np.int64)
            mark = own == 65535
            own[mark] = 0
            own = place[own + base] + 1 if len(cls) else own
            own[mark] = 0
            keys.append(_from_five(tok) << np.uint64(OWNER_BITS) | own.astype(np.uint64))
            base += len(cls) // 8
        keys = _distinct(np.concatenate(keys))  # copies of one class in several chunks count once
        tokens = keys >> np.uint64(OWNER_BITS)
        owner = (keys & np.uint64((1 << OWNER_BITS) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        runs = np.diff(np.append(starts, len(tokens)))
        shared = np.repeat(runs > 1, runs) & (owner > 0)
        if shared.any():
            high = np.uint64(parts[0][0] // slices << LOW_BITS)
            yield _by_class(owner[shared] - 1, tokens[shared] | high, known, sizes[at].astype(np.int64))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                p = tuple(c[i].as_py() for c in batch.columns)
                if p[1]:
                    yield _by_class(np.frombuffer(p[4], np.uint16).astype(np.int64), np.frombuffer(p[5], np.uint64), np.frombuffer(p[2], np.int64), np.frombuffer(p[3], np.int32).astype(np.int64))
                    continue
                if p[0] != now:
                    if parts:
                        yield from fragment(parts)
                    now, parts = p[0], []
                parts.append(p)
        if parts:
            yield from fragment(parts)

    sent = _rows(docs, id_col, text_col).mapInArrow(emit, "part long, kind int, cls binary, ns binary, idx binary, tok binary")
    return sent.repartition(FRAGMENTS * slices, "part").sortWithinPartitions("part").mapInArrow(gather, "cls long, n long, tokens array<long>")


def similar(na: str, sa: str, nb: str, sb: str, percent: int):
    """Whether sets of na and nb shingles, of which sa and sb are not theirs alone, can be similar enough."""
    return F.least(sa, sb) * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def overlaps(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with their overlap: each fragment of the order counts its part of it, and the parts are added per pair.

    pieces: (id, piece, tokens), a row for each fragment of the order in which the document has a shared shingle.
    """
    left = pieces.select(F.col("id").alias("a"), "piece", F.col("tokens").alias("ta"))
    right = pieces.select(F.col("id").alias("b"), "piece", F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, ["b", "piece"])
    part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("part"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))


def links(counted: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are similar enough."""
    return counted.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of percent/100 or more.

    Words are runs of characters outside U+0020 and U+0009..U+000D, A-Z lower-cased; a text of fewer
    words than a shingle has one shingle, one without words none, and links with nothing. Documents
    of equal words form a class at once. Then:

    1. The order of all shingles is cut into fragments; each finds the shingles that two classes or
       more share. A class that shares under percent of its set can have no partner and leaves.
    2. What is left is ordered by document frequency; a pair that links has a common shingle among the
       first n - ceil(n * percent/100) + 1 of each, and both share enough of their sets with any other.
    3. In each such list the class with most of its set shared, its centre, is compared with all
       others, and what links is one component. Only pairs of classes that are in different components,
       but share a list, are left; all of these are compared, except where the overlaps with the centre
       prove that they share too little. No list is cut.
    4. The overlap of a pair is counted fragment by fragment and added up.

    Result: id_col, n_shingles, component_id (the smallest id reachable). Shingles are known by hashes
    of 46 bits, and classes by hashes of 64 bits, confirmed by a second one. Null texts are empty; a
    row with a null id has a null component and joins no group; repeated rows are each returned; other
    columns are not read; an empty table gives no rows.
    """
    chars = docs.select(F.sum(F.length(text_col))).first()[0] or 0
    slices = 1 << max(0, (chars // (6 * FRAGMENTS * TOKENS_PER_CELL)).bit_length())
    for seed in count():
        known = stored(digests(docs, id_col, text_col, words_each, seed), "join-digests")
        classes = known.where("n > 0").groupBy("cls", "n").agg(F.min("_nj_id").alias("id"), F.min("chk").alias("low"), F.max("chk").alias("high"))
        classes = stored(classes, "join-classes")
        if classes.where("low <> high").isEmpty():
            break
        discard(known, classes)  # different words met in one class: another seed keeps them apart
    classes = classes.where("id IS NOT NULL").select("cls", "n", "id")
    named = docs.where(F.col(id_col).isNotNull())
    parts = shared_shingles(named, id_col, text_col, words_each, slices, seed)
    whole = F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")
    salts = 1 + known.count() // DOCS_PER_SALT
    if salts > 1:  # a class of very many copies reports from as many chunks
        parts = parts.groupBy("cls", "n", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")).agg(whole)
    sets = parts.groupBy("cls", "n").agg(whole)
    sets = stored(sets.where(F.size("tokens") * 100 >= F.col("n") * percent).join(classes, ["cls", "n"]).select("id", "n", "tokens"), "join-sets")
    each = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    each = each.join(often, "token")
    ordered = each.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    ordered = stored(ordered.where(F.size("tokens") * 100 >= F.col("n") * percent), "join-ordered")
    discard(sets)
    alone = F.col("n") - F.size("tokens")
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    lists = stored(ordered.select("id", "n", F.size("tokens").cast("long").alias("s"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(head, F.lit(0)).cast("int"))).alias("pos", "t")).select("id", "n", "s", "pos", F.col("t.token").alias("token")), "join-lists")
    shift = FRAGMENT_BITS + LOW_BITS - PIECES.bit_length() + 1
    in_piece = lambda i: F.transform(F.filter("tokens", lambda t: F.shiftright(t["token"], shift) == i), lambda t: t["token"])
    pieces = ordered.select("id", F.posexplode(F.array(*[in_piece(i) for i in range(PIECES)])).alias("piece", "tokens"))
    pieces = stored(pieces.where(F.size("tokens") > 0), "join-pieces")
    discard(ordered)

    # tables of their own, so that both sides of a join are dealt anew and Spark can split a very common shingle
    centre = lists.groupBy("token").agg(F.min_by(F.struct("id", "n", "s"), F.struct(F.col("n") - F.col("s"), "id")).alias("c"), F.count("*").alias("m")).where("m > 1").select("token", F.col("c.id").alias("a"), F.col("c.n").alias("na"), F.col("c.s").alias("sa"))
    centre = stored(centre, "join-centres")
    near = lists.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")).join(centre, "token").where((F.col("a") != F.col("b")) & similar("na", "sa", "nb", "sb", percent))
    tested = stored(overlaps(near.select("a", "b", "na", "nb").distinct(), pieces), "join-tested")
    stars = stored(links(tested, percent), "join-stars")
    found = components(stars)
    lists = stored(lists.join(found, F.col("id") == F.col("node"), "left").select("token", "id", "n", "s", "pos", F.coalesce("component", "id").alias("comp")), "join-lists")
    split = stored(lists.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token"), "join-split")
    known_overlap = tested.select("a", F.col("b").alias("id"), "overlap")
    lists = lists.join(split, "token", "left_semi").join(centre.select("token", "a"), "token").join(known_overlap, ["a", "id"], "left")
    lists = stored(lists.withColumn("o", F.when(F.col("a") == F.col("id"), F.col("s")).otherwise(F.col("overlap"))), "join-split-lists")
    side = lambda x, y: lists.select("token", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"), (F.col("s") - F.col("pos")).alias(f"left{x}"), F.col("o").alias(f"o{x}"), F.col("comp").alias(y))
    # at the first shingle that two have in common, all they share is still to come in both orders;
    # and what they share is in the centre of their list, or in what each has beside it; nothing is known without both overlaps
    most = F.least("oa", "ob") + F.least(F.col("sa") - F.col("oa"), F.col("sb") - F.col("ob"))
    can = F.when(F.col("oa").isNull() | F.col("ob").isNull(), True).otherwise(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    rest = side("a", "ca").join(side("b", "cb"), "token").where((F.col("ca") < F.col("cb")) & similar("na", "lefta", "nb", "leftb", percent) & can)
    more = stored(links(overlaps(rest.select("a", "b", "na", "nb").distinct(), pieces), percent), "join-more")
    if not more.isEmpty():
        found = components(stars.union(more))
    member = classes.join(found, F.col("id") == F.col("node"), "left").select("cls", "n", F.coalesce("component", "id").alias("component_id"))
    # again a table of its own: a class of very many copies is then split between tasks
    out = known.join(stored(member, "join-members"), ["cls", "n"], "left")
    return out.select(F.col("_nj_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_nj_id").isNotNull(), F.coalesce("component_id", "_nj_id")).alias("component_id"))
