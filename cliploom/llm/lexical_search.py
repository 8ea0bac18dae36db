"""Ranked lexical search over documents, scored once for each class of equal bags."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.shared import stored

from .common import text_slices

#: Items and terms of one pass, which are broadcast, bytes of text tokenised at once, and pairs and postings that a task scores at once.
ITEMS_PER_PASS, TERMS_PER_PASS, TEXT_AT_ONCE, PAIRS_AT_ONCE, POSTINGS_AT_ONCE = 16_384, 1 << 20, 4 << 20, 1 << 21, 1 << 21

_KEEP = np.full(256, 32, np.uint8)  # what a byte becomes: separators a space, A-Z their small letters
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _KEEP[_lo:_hi] = np.arange(_lo, _hi)
_KEEP[65:91] = np.arange(97, 123)


def _spaced(texts: pa.Array) -> pa.LargeStringArray:
    """The texts with all separators turned to spaces and A-Z to small letters. Separators are ASCII, so bytes can be turned one by one."""
    texts = pa.concat_arrays([texts]).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    flat = _KEEP[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(np.ascontiguousarray(flat)))


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of all texts, in order, and the text of each. Null texts have none."""
    cut = pc.ascii_split_whitespace(_spaced(pc.fill_null(texts, "")))
    terms = cut.flatten()
    of = np.repeat(np.arange(len(cut)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(terms), 0)
    return of[real.to_numpy(zero_copy_only=False)], terms.filter(real)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in runs of bounded size as (number of the first, texts); one longer text comes in several pieces cut between terms."""
    batch = pa.record_batch([texts], names=["text"])
    at = 0
    for part in text_slices(batch, 0, TEXT_AT_ONCE):
        if part.num_rows > 1 or (pc.binary_length(part.column(0))[0].as_py() or 0) <= 2 * TEXT_AT_ONCE:
            yield at, part.column(0)
        else:
            raw, begin = _spaced(part.column(0))[0].as_py(), 0
            while begin < len(raw):
                end = begin + TEXT_AT_ONCE if begin + TEXT_AT_ONCE < len(raw) else len(raw)
                while end < len(raw) and raw[end] != " ":
                    end += 1
                yield at, pa.array([raw[begin:end]])
                begin = end
        at += part.num_rows


def bags(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of every document: number of terms, and those of the vocabulary by ascending number with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.large_string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        wide = max(1, len(words))
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for first, texts in _pieces(batch.column(1)):
                of, terms = _cut(texts)
                n[first : first + len(texts)] += np.bincount(of, minlength=len(texts))
                place = pc.fill_null(pc.index_in(terms, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = place >= 0
                key, count = np.unique((of[known] + first) * wide + place[known], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)  # pieces of one text add up
            tf = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            ends = np.searchsorted(key // wide, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key % wide).astype(np.int32), tf)]
            yield pa.record_batch([batch.column(0), pa.array(n), *lists], names=["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


class Asked(NamedTuple):
    """Items of one pass: their ids, and for each term of the vocabulary the items that hold it, with repeats."""

    ids: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray


def _asked(ids: list[int], counts: list[dict[str, int]]) -> tuple[Asked, list[str]]:
    vocabulary = sorted({t for c in counts for t in c})
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = sorted((place[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
    term, item, n = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [])))
    return Asked(np.array(ids, np.int64), np.searchsorted(term, np.arange(len(vocabulary) + 1)), item, n), vocabulary


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Asked, list[str]]]:
    """The items in blocks of at most ITEMS_PER_PASS items and about TERMS_PER_PASS terms, so that what a pass broadcasts is bounded."""
    ids: list[int] = []
    counts: list[dict[str, int]] = []
    held = 0
    for r in items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).orderBy("id").toLocalIterator():
        _, terms = _cut(pa.array([r.text], pa.large_string()))
        if not ids or ids[-1] != r.id:
            if len(ids) == ITEMS_PER_PASS or held > TERMS_PER_PASS:
                yield _asked(ids, counts)
                ids, counts, held = [], [], 0
            ids.append(r.id)
            counts.append({})
        for v in terms.value_counts().to_pylist():
            held += v["values"] not in counts[-1]
            counts[-1][v["values"]] = counts[-1].get(v["values"], 0) + v["counts"]
    if ids:
        yield _asked(ids, counts)


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each item the k highest scores, equal ones by smaller first."""
    order = np.lexsort((first, -score, item))
    item, score, first, cls = item[order], score[order], first[order], cls[order]
    begins = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.empty(0, np.int64)
    few = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item)))) < k
    return item[few], score[few], first[few], cls[few]


def _score_classes(classes: DataFrame, asked: Asked, weights: np.ndarray, k: int) -> DataFrame:
    """(item, score, first, cls): of the classes in each task the k best for each item. classes: cls, first, m, terms, tfs."""
    sent = classes.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = sent.value
        n_items = len(a.ids)
        each = max(1, PAIRS_AT_ONCE // n_items)
        best = tuple(np.empty(0, np.int64) for _ in range(4))
        least = np.ones(n_items, np.int64)  # what a class must reach: the item's kth score so far
        for batch in batches:
            cls, firsts, m = (batch.column(i).to_numpy() for i in range(3))
            terms, tfs = batch.column(3), batch.column(4)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            t, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            part = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))
            many = a.starts[t + 1] - a.starts[t]
            for begin in range(0, batch.num_rows, each):
                end = min(batch.num_rows, begin + each)
                at, last = np.searchsorted(of, [begin, end])
                total = np.zeros((end - begin) * n_items, np.int64)
                while at < last:  # postings of a bounded number of entries
                    upto = np.cumsum(many[at : min(last, at + POSTINGS_AT_ONCE)])
                    to = at + max(1, int(np.searchsorted(upto, POSTINGS_AT_ONCE, side="right")))
                    n = many[at:to]
                    place = np.repeat(a.starts[t[at:to]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                    np.add.at(total, np.repeat(of[at:to] - begin, n) * n_items + a.items[place], np.repeat(part[at:to], n) * a.repeats[place])
                    at = to
                total = total.reshape(-1, n_items)
                r, i = np.nonzero(total >= least)
                new = (i, total[r, i], firsts[begin + r], cls[begin + r])
                best = _best(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
                full = np.bincount(best[0], minlength=n_items) >= k
                low = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(low, best[0], best[1])
                least = np.where(full, low, 1)
        yield pa.record_batch([pa.array(a.ids[best[0]]), *(pa.array(x) for x in best[1:])], names=["item", "score", "first", "cls"])

    return classes.select("cls", "first", "m", "terms", "tfs").mapInArrow(run, "item long, score long, first long, cls long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score.

    Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
    Documents are cut down to the items' vocabulary; those with the same counts and the same length
    measure m are one class, found by a hash and verified by comparing the vectors. A class is scored
    once for all items. A document among the k best has its class among the k best, ordered by score and
    the class's smallest id, so tasks and then the whole keep k classes an item; of these classes the k
    smallest ids are looked up, and documents are ranked. Items come in passes of bounded size, which bounds what is broadcast; every pass reads all documents.

    A null text has no term; a document without terms counts nowhere. Rows that share an id are each a
    document. A null doc_id counts in the statistics and is never a result. Items of one id are one item
    with all their terms; a null item_id is none. Score ties go to the smaller doc_id. Other columns are
    not read. Empty tables and items without known terms give no rows.
    """
    spark = docs.sparkSession
    out: DataFrame | None = None
    for asked, vocabulary in _passes(items, item_col, item_text):
        found = _one_pass(docs.select(id_col, text_col), asked, vocabulary, k, b, id_col, text_col)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _one_pass(docs: DataFrame, asked: Asked, vocabulary: list[str], k: int, b: int, id_col: str, text_col: str) -> DataFrame:
    vectors = stored(bags(docs, vocabulary, id_col, text_col).where("n > 0"), "lex-bags")
    n_docs, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        df[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    m = F.expr(f"{100 - b}L + (({b}L * n * {n_docs}L) div {length}L)").alias("m")
    vector = ["h", "m", "terms", "tfs"]
    named = vectors.where(F.col("id").isNotNull() & (F.size("terms") > 0)).select("id", m, "terms", "tfs").withColumn("h", F.xxhash64("m", "terms", "tfs"))
    classes = stored(named.groupBy(*vector).agg(F.min("id").alias("first")).withColumn("cls", F.monotonically_increasing_id()), "lex-classes")
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    best = stored(_score_classes(classes, asked, weights, k).withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k).drop("r"), "lex-best")
    won = classes.join(best.select("cls").distinct(), "cls")
    inside = Window.partitionBy("cls").orderBy("id")
    members = named.join(won.select("cls", *vector), vector).select("cls", "id").withColumn("r", F.row_number().over(inside)).where(F.col("r") <= k).select("cls", "id")
    by_doc = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = best.select("item", "score", "cls").join(members, "cls").withColumn("rank", F.row_number().over(by_doc))
    return ranked.where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
