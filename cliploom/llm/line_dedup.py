"""Line dedup: two Bloom filters find suspects, an exact pass confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, discard, fresh, stored

#: Bits of one segment of a filter, bits for each line, and hash functions.
SEGMENT_BITS, BITS_PER_LINE, HASHES = 1 << 22, 12, 5
#: Lines of a segment, and what a hash that is sent there says: seen once in its batch, or in several documents of it; or, past
#: the filters, an id that holds such a repeated hash.
LINES_EACH = SEGMENT_BITS // BITS_PER_LINE
ONCE, AGAIN, KNOWN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key) - sum(0x80 <= b < 0xC0 for b in key) >= least)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def doc_keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in {line_key(x) for x in text.split(b"\n")} if _long_enough(k, least)}


def _places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its bits there (one row for each hash function)."""
    seg = (hashes >> np.uint64(32)) % np.uint64(segments)
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33) | np.uint64(1)
    return seg.astype(np.int64), np.stack([(a + np.uint64(i) * b) % np.uint64(SEGMENT_BITS) for i in range(HASHES)])


class _Pair:
    """Once-seen and twice-seen filter of one segment."""

    def __init__(self) -> None:
        self.once, self.twice = (np.zeros(SEGMENT_BITS, bool) for _ in range(2))

    def add(self, bits: np.ndarray, again: bool) -> None:
        """Mark hashes, each given once a call; `again` tells that they are known to be seen twice."""
        seen = bits if again else bits[:, self.once[bits].all(axis=0)]
        self.twice[seen.ravel()] = True
        self.once[bits.ravel()] = True

    def suspect(self, bits: np.ndarray) -> np.ndarray:
        return self.twice[bits].all(axis=0)


def suspects(docs: DataFrame, id_col: str, text_col: str, least: int, segments: int, tasks: int) -> DataFrame:
    """(_ld_id, _ld_h): the hashes of lines that may be in another document too.

    Hashes are dealt to segments with their ids, without the lines. The task that holds a segment
    fills its two filters from all of them and then returns those that the twice-seen filter has. A
    hash that several documents of one batch hold is known to be repeated: it goes to its segment
    once a batch, and its ids are passed on, so that a line of a third of all documents is no load
    for one task.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_ld_id"), F.col(text_col).cast("string").alias("_ld_text"))
    kind = dict(rows.dtypes)["_ld_id"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            of: dict[int, int] = {}
            more: list[tuple[int, int]] = []
            for i, text in enumerate(_texts(batch, "_ld_text")):
                for h in {xxhash.xxh3_64_intdigest(k) for k in doc_keys(text, least)}:
                    first = of.setdefault(h, i)
                    if first >= 0 and ids[first] != ids[i]:
                        more.append((first, h))
                        first = of[h] = -1
                    if first < 0:
                        more.append((i, h))
            turn += 1
            once = [(i, h) for h, i in of.items() if i >= 0]
            again = [h for h, i in of.items() if i < 0]
            out = []
            for state, owners, hashes in ((ONCE, [i for i, _ in once], [h for _, h in once]), (AGAIN, None, again), (KNOWN, [i for i, _ in more], [h for _, h in more])):
                h = np.array(hashes, np.uint64)
                if not len(h):
                    continue
                seg = np.full(len(h), turn % segments) if state == KNOWN else _places(h, segments)[0]
                order = np.argsort(seg, kind="stable")
                starts = np.flatnonzero(np.diff(seg[order], prepend=-1))
                for p in np.split(order, starts[1:]):
                    out.append((int(seg[p[0]]), state, [owners[j] for j in p] if owners else [], h[p].tobytes()))
            sizes = np.append(0, np.cumsum([len(o[2]) for o in out])).astype(np.int32)
            flat = batch.column(0).take(pa.array([i for o in out for i in o[2]], pa.int64()))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array([o[3] for o in out], pa.binary())], names=["seg", "state", "ids", "hashes"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pair, held = None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            for ids, h in held:
                hit = pair.suspect(_places(h, segments)[1])
                yield pa.record_batch([ids.filter(pa.array(hit)), pa.array(h[hit].view(np.int64))], names=["_ld_id", "_ld_h"])

        for batch in batches:
            for i, (seg, state) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if seg != now:
                    yield from out()
                    now, pair, held = seg, _Pair(), []
                h = np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                if state == KNOWN:
                    yield pa.record_batch([batch.column(2)[i].values, pa.array(h.view(np.int64))], names=["_ld_id", "_ld_h"])
                    continue
                pair.add(_places(h, segments)[1], state == AGAIN)
                if state == ONCE:
                    held.append((batch.column(2)[i].values, h))
        yield from out()

    sent = rows.mapInArrow(send, f"seg long, state int, ids array<{kind}>, hashes binary")
    return sent.repartition(tasks, "seg").sortWithinPartitions("seg").mapInArrow(judge, f"_ld_id {kind}, _ld_h long")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, lines_each: int = LINES_EACH) -> DataFrame:
    """(_ld_id, _ld_key) of every line key that a document has to give up, confirmed on the key itself."""
    spark = docs.sparkSession
    most = docs.select(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = 1 + most // lines_each
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), segments // 8)
    marks = suspects(docs, id_col, text_col, least, segments, tasks).groupBy("_ld_id").agg(F.collect_set("_ld_h").alias("_ld_hs"))
    marks = stored(marks, "line-marks")
    rows = docs.select(F.col(id_col).alias("_ld_id"), F.col(text_col).cast("string").alias("_ld_text"))
    kind = dict(rows.dtypes)["_ld_id"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            marked = batch.column(batch.schema.get_field_index("_ld_hs"))
            for i, text in enumerate(_texts(batch, "_ld_text")):
                hs = set(marked[i].values.to_numpy().view(np.uint64).tolist())
                own = [k for k in doc_keys(text, least) if xxhash.xxh3_64_intdigest(k) in hs]
                found += own
                at += [i] * len(own)
            ids = batch.column(batch.schema.get_field_index("_ld_id"))
            yield pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["_ld_id", "_ld_key"])

    lines = stored(rows.join(marks, "_ld_id").mapInArrow(keys, f"_ld_id {kind}, _ld_key binary"), "line-suspects")
    discard(marks)
    first = lines.groupBy("_ld_key").agg(F.min("_ld_id").alias("_ld_first"), F.max("_ld_id").alias("_ld_last"))
    # a table of its own, so that both sides of the join are dealt anew and Spark can split a very common line
    first = stored(first.where(F.col("_ld_first") != F.col("_ld_last")).drop("_ld_last"), "line-firsts")
    return lines.join(first, "_ld_key").where(F.col("_ld_id") != F.col("_ld_first")).select("_ld_id", "_ld_key")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, lines_each: int = LINES_EACH) -> DataFrame:
    """Docs with the text reduced to lines that no document of smaller id has, and two counts.

    A text is split at \\n (null or empty: one empty line). A line's key is the line without blanks
    at its ends and A-Z lower-cased. A key of at least `least` code points in two documents or more
    loses all its lines, except in the document of smallest id. Filters grow with the number of lines
    in segments of fixed size, each in one task; hashes of 8 bytes go there, whatever the size of the
    input, the lines of suspects alone are shuffled, and every suspect is confirmed by comparing keys.

    Result: the columns of docs with the text replaced (null becomes empty), then _n_lines and
    _n_dropped. Rows of one id count as one document and are all kept; rows with a null id keep all
    lines and count for no other document; the order of rows is not kept. Columns of docs may have any
    names; those called _n_lines or _n_dropped give way to the result's.
    """
    docs = docs.select([c for c in docs.columns if c.lower() not in ("_n_lines", "_n_dropped")])
    own_id, own_keys = fresh(docs, "_ld_id"), fresh(docs, "_ld_keys")
    drops = repeated_lines(docs, id_col, text_col, least, lines_each).groupBy(F.col("_ld_id").alias(own_id)).agg(F.collect_set("_ld_key").alias(own_keys))
    out = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.schema.get_field_index(own_keys)).to_pylist()
            texts, n, dropped = [], [], []
            for text, keys in zip(_texts(batch, text_col), gone, strict=True):
                lines = text.split(b"\n")
                if keys:
                    keys = set(keys)
                    kept = [x for x in lines if line_key(x) not in keys]
                    texts.append(b"\n".join(kept))
                    dropped.append(len(lines) - len(kept))
                else:
                    texts.append(text)
                    dropped.append(0)
                n.append(len(lines))
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            cols[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*cols.values(), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "_n_lines", "_n_dropped"])

    return docs.join(drops, F.col(id_col) == F.col(own_id), "left").drop(own_id).mapInArrow(cut, out)
