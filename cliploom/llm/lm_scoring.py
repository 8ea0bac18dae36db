"""LM scoring: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, split_words, stored, text_slices

#: Classes and members of a class. The first WORD_CLASSES hold the most frequent words, each a member; the others, chosen by a
#: word's ending, hold all other words, and their members are buckets that words share by their counts.
CLASSES, MEMBERS, WORD_CLASSES = 32, 32, 16
WORDS = WORD_CLASSES * MEMBERS
#: Contexts that have weights: the previous word, the previous two, and the one before the previous (skip).
FEATURES = 3
#: Hashed weight rows of a feature: at least and at most (151 MB of weights, what a task can hold), sqrt(tokens) between.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 17
#: Shards of a round at least, tokens of a shard for each weight row, parts in which weights are averaged.
LEAST_SHARDS, TOKENS_PER_ROW, PARTS = 8, 256, 256
#: How far a round goes along the mean of its shards' moves: each shard saw its share of the texts only, so the mean falls short.
OVER = 2.0
#: Bytes of text and tokens that a worker handles at once, and tokens of one gradient step.
CHUNK_BYTES, CHUNK_TOKENS, STEP = 8 << 20, 1 << 20, 8_192
#: Words whose counts go to every task; all other counts are joined.
FREQUENT, SLOTS = 131_072, 1 << 20
START, END = np.uint32(0xF00D1CE5), np.uint64(0x0E4D0FA11D0C5A3B)
EMPTY = -30.0


def token_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts, each text's words followed by an end; and how many each text has.

    A key is a hash of the lower-cased word; its low 4 bits tell the class of a rare word (from its
    ending) and the next 5 its bucket.
    """
    ends, places, words = split_words(texts, True)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) & ~15 | xxhash.xxh32_intdigest(w[-2:]) & 15 for w in words), np.uint64, len(words))
    return np.insert(known[places], ends, END), np.diff(ends, prepend=0) + 1


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_lm_id, _lm_deal, _lm_n, _lm_keys): the tokens of every whole text, written once for counting, training and scoring.

    _lm_deal, a hash of id and words, deals texts into rounds and shards of training in the same way
    whatever the layout of docs; only of many equal rows that meet in one task every 16 are dealt apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equal: dict[int, int] = {}
        for big in batches:
            for batch in text_slices(big, 2, CHUNK_BYTES):
                keys, n = token_keys(batch.column(2))
                ends = np.append(0, np.cumsum(n))
                raw = keys.tobytes()
                deal = []
                for a, b, h in zip((ends[:-1] * 8).tolist(), (ends[1:] * 8).tolist(), batch.column(1).to_pylist(), strict=True):
                    d = xxhash.xxh3_64_intdigest(raw[a:b], h & 0xFFFFFFFFFFFFFFFF)
                    times = equal[d] = equal.get(d, -1) + 1
                    deal.append(d ^ times // 16 * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    if len(equal) > 1_000_000:
                        equal.clear()
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 8), pa.py_buffer(raw)]).cast(pa.binary())
                deals = pa.array(np.array(deal, np.uint64).view(np.int64))
                yield pa.record_batch([batch.column(0), deals, pa.array(n), column], names=["_lm_id", "_lm_deal", "_lm_n", "_lm_keys"])

    rows = docs.select(F.col(id_col).alias("_lm_id"), F.xxhash64(F.col(id_col)).alias("_lm_hash"), F.col(text_col).cast("string").alias("_lm_text"))
    kind = dict(rows.dtypes)["_lm_id"]
    return stored(rows.mapInArrow(run, f"_lm_id {kind}, _lm_deal long, _lm_n long, _lm_keys binary"), "lm-tokens")


@dataclass
class Cells:
    """Which cell (class * MEMBERS + member) a word is in: frequent words have one of their own."""

    slot_key: np.ndarray  # low 32 bits of the frequent word in each of 2**16 slots
    slot_cell: np.ndarray
    keys: np.ndarray  # of each frequent word's cell: the whole key, and its count
    counts: np.ndarray

    @classmethod
    def of_words(cls, words: list[tuple[int, int]]) -> Cells:
        """words: (key, count), the most frequent first. Of words that meet in a slot the first has a cell."""
        out = cls(np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(WORDS, np.uint64), np.zeros(WORDS, np.int64))
        out.slot_cell[0] = WORDS  # where the key 0 of an empty slot belongs as a rare word
        used, n = set(), 0
        for key, count in words:
            slot = key >> 9 & 0xFFFF
            if slot in used or n == WORDS:
                continue
            used.add(slot)
            out.slot_key[slot], out.slot_cell[slot], out.keys[n], out.counts[n] = key & 0xFFFFFFFF, n, key, count
            n += 1
        return out

    def rare(self, k: np.ndarray) -> np.ndarray:
        return (WORD_CLASSES + (k & np.uint32(15)).astype(np.int64)) * MEMBERS + (k >> np.uint32(4) & np.uint32(31)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        slot = (k >> np.uint32(9) & np.uint32(0xFFFF)).astype(np.int64)
        return np.where(self.slot_key[slot] == k, self.slot_cell[slot], self.rare(k))


def contexts(k: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; START where a text has none."""
    one, two = np.empty_like(k), np.empty_like(k)
    one[1:], two[2:] = k[:-1], k[:-2]
    starts = np.cumsum(sizes) - sizes
    one[starts] = START
    two[starts] = START
    two[starts[sizes > 1] + 1] = START
    return one, two


def feature_rows(one: np.ndarray, two: np.ndarray, cls: np.ndarray, rows: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weight rows of each feature in the class softmax (of `rows`) and in the member softmax (of 2 * rows)."""
    with np.errstate(over="ignore"):
        a1, a3 = mixed(one.astype(np.uint64) + np.uint64(0x2545F491)), mixed(two.astype(np.uint64) + np.uint64(0x51ED270500000000))
        a2 = mixed(a1 + two.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = rows.bit_length() - 1
        small = np.uint16 if bits < 16 else np.uint32
        own = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        a = [(x >> np.uint64(64 - bits)).astype(small) for x in (a1, a2, a3)]
        b = [((x ^ own) * np.uint64(0x165667B19E3779F9) >> np.uint64(63 - bits)).astype(small if bits < 15 else np.uint32) for x in (a1, a2, a3)]
    return a, b


@dataclass
class Weights:
    """a, b: weights of each feature's rows in the class and the member softmax; a0, b0: those that always count."""

    a: list[np.ndarray]
    b: list[np.ndarray]
    a0: np.ndarray  # CLASSES
    b0: np.ndarray  # CLASSES x MEMBERS

    @property
    def rows(self) -> int:
        return len(self.a[0])

    def parts(self) -> list[np.ndarray]:
        return [*self.a, *self.b, self.a0, self.b0]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def moved(self, by: np.ndarray) -> Weights:
        out, at = [], 0
        for x in self.parts():
            out.append((x + by[at : at + x.size].reshape(x.shape)).astype(np.float32))
            at += x.size
        return Weights(out[:FEATURES], out[FEATURES : 2 * FEATURES], out[-2], out[-1])


def _logits(w: list[np.ndarray], rows: list[np.ndarray], always: np.ndarray) -> np.ndarray:
    """Scores less their highest."""
    s = np.take(w[0], rows[0], axis=0)
    for x, r in zip(w[1:], rows[1:], strict=True):
        s += np.take(x, r, axis=0)
    s += always
    s -= s.max(axis=1, keepdims=True)
    return s


def _log_softmax(w: list[np.ndarray], rows: list[np.ndarray], always: np.ndarray, target: np.ndarray) -> np.ndarray:
    s = _logits(w, rows, always)
    own = s[np.arange(len(target)), target]
    np.exp(s, out=s)
    return own - np.log(s.sum(axis=1))


def log_parts(w: Weights, k: np.ndarray, sizes: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context) * P(member | class, context) of each token."""
    one, two = contexts(k, sizes)
    out = np.empty(len(k))
    for at in range(0, len(k), STEP):
        p = slice(at, at + STEP)
        cls, member = cell[p] // MEMBERS, cell[p] % MEMBERS
        ra, rb = feature_rows(one[p], two[p], cls, w.rows)
        out[p] = _log_softmax(w.a, ra, w.a0, cls)
        out[p] += _log_softmax(w.b, rb, w.b0[cls], member)
    return out


class _Trainer:
    """Gradient steps (scaled for each weight row) on one shard's texts, from the weights that all shards share."""

    def __init__(self, w: Weights, cells: Cells, rate: float) -> None:
        self.w, self.cells, self.rate, self.seen = w.moved(np.zeros(len(w.flat()), np.float32)), cells, rate, 0
        self.square = [np.full(len(x) if x.ndim > 1 else 1, 1e-6) for x in self.w.parts()]
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def _sum_rows(self, w: np.ndarray, square: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        runs = np.diff(np.append(starts, len(rows)))
        at, many = rows[starts], runs > 1
        g = np.take(error, order[starts], axis=0)  # of rows that occur once; the others are summed
        if many.any():
            g[many] = np.add.reduceat(np.take(error, order[np.repeat(many, runs)], axis=0), np.cumsum(runs[many]) - runs[many], axis=0)
        s = square[at] + np.einsum("ij,ij->i", g, g) / (g.shape[1] * len(error) ** 2)
        square[at] = s
        g *= (self.rate / (len(error) * np.sqrt(s))).astype(np.float32)[:, None]
        w[at] -= g

    def _step(self, first: int, w: list[np.ndarray], rows: list[np.ndarray], always: np.ndarray, which: np.ndarray | None, target: np.ndarray) -> None:
        e = _logits(w, rows, always if which is None else always[which])
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(len(target)), target] -= 1
        for i, (x, r) in enumerate(zip(w, rows, strict=True)):
            self._sum_rows(x, self.square[first + i], r, e)
        last = self.square[2 * FEATURES + (which is not None)]
        if which is None:
            self._sum_rows(always[None], last, np.zeros(len(e), np.uint16), e)
        else:
            self._sum_rows(always, last, which.astype(np.uint16), e)

    def add(self, k: np.ndarray) -> None:
        """One text; texts are learned in lots that depend on their sizes alone."""
        self.held.append(k)
        self.waiting += len(k)
        if self.waiting >= CHUNK_TOKENS:
            self.learn()

    def learn(self) -> None:
        if not self.held:
            return
        k, sizes = np.concatenate(self.held), np.array([len(x) for x in self.held])
        self.held, self.waiting = [], 0
        one, two = contexts(k, sizes)
        cell = self.cells.find(k)
        for at in range(0, len(k), STEP):
            p = slice(at, at + STEP)
            cls, member = cell[p] // MEMBERS, cell[p] % MEMBERS
            ra, rb = feature_rows(one[p], two[p], cls, self.w.rows)
            self._step(0, self.w.a, ra, self.w.a0, None, cls)
            self._step(FEATURES, self.w.b, rb, self.w.b0, cls, member)
        self.seen += len(k)


@dataclass
class Model:
    """Trained weights, cells, and the counts that share a bucket's probability among its words."""

    w: Weights
    cells: Cells
    tokens: int
    types: int
    norm: np.ndarray  # of each cell: log10 of what its words' counts are divided by
    counts: DataFrame  # (h, c): every word of the training texts


def word_counts(tokens: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return k, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

        def out(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), 100_000):
                yield pa.record_batch([pa.array(k[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], names=["h", "c"])

        for batch in batches:
            for part in text_slices(batch, 0, 8 * CHUNK_TOKENS):
                held.append(np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64), return_counts=True))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield from out(*held[0])
                        held = []
        if held:
            yield from out(*merged())

    return tokens.select("_lm_keys").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _averaged(tokens: DataFrame, w: Weights, cells: Cells, rate: float, rounds: int, part: int, shards: int) -> Weights:
    """One round: every shard takes steps on its texts; each weight goes OVER times the mean move, by tokens, of the shards that moved it, in their order."""
    sent = tokens.sparkSession.sparkContext.broadcast((w, cells))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 1, 8 * CHUNK_TOKENS):
                ends = np.append(0, np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy() // 8)).astype(np.int64)
                k = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).astype(np.uint32)
                low = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends * 4), pa.py_buffer(k.tobytes())]).cast(pa.binary())
                deal = b.column(0).to_numpy().view(np.uint64)
                shard = pa.array((deal // np.uint64(rounds) % np.uint64(shards)).astype(np.int32))
                yield pa.record_batch([shard, b.column(0), low], names=["shard", "deal", "k"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cells = sent.value
        now, trainer = None, None

        def out() -> pa.RecordBatch:
            trainer.learn()
            moved = (trainer.w.flat() - w.flat()).astype(np.float16)
            pieces = [x.tobytes() for x in np.array_split(moved, PARTS)]
            return pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([now] * PARTS, pa.int32()), pa.array([trainer.seen] * PARTS, pa.int64()), pa.array(pieces, pa.binary())], names=["part", "shard", "n", "w"])

        for batch in batches:
            for shard, k in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if trainer:
                        yield out()
                    now, trainer = shard, _Trainer(w, cells, rate)
                trainer.add(np.frombuffer(k.as_buffer(), np.uint32))
        if trainer:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, _, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                moved = np.frombuffer(w, np.float16).astype(np.float64)
                got = sums.setdefault(part, [np.zeros(len(moved)), np.zeros(len(moved))])
                got[0] += n * (moved != 0)
                got[1] += n * moved
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([(w / np.maximum(n, 1)).astype(np.float32).tobytes() for n, w in sums.values()], pa.binary())], names=["part", "w"])

    dealt = tokens.where(F.expr(f"pmod(_lm_deal, {rounds})") == part).select("_lm_deal", "_lm_keys").mapInArrow(narrow, "shard int, deal long, k binary")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "deal", "k").select("shard", "k")
    moved = dealt.mapInArrow(train, "part int, shard int, n long, w binary").repartition(32, "part").sortWithinPartitions("part", "shard")
    got = moved.mapInArrow(add, "part int, w binary").collect()  # the weights, once
    sent.unpersist()
    return w.moved(np.float32(OVER) * np.concatenate([np.frombuffer(bytes(r.w), np.float32) for r in sorted(got, key=lambda r: r.part)])) if got else w


def fit_tokens(tokens: DataFrame, rounds: int = 2, rate: float = 0.35) -> Model:
    """Counts of all words, and weights from all texts of a token table: each text is used in one of `rounds` rounds.

    Hashed rows grow with the square root of the tokens and shards with the tokens, so that what a
    shard sends stays in proportion to what it reads.
    """
    counts = stored(word_counts(tokens), "lm-counts")
    low = F.col("h").bitwiseAND(F.lit(16 * MEMBERS - 1))
    per = counts.groupBy(low.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # 512 rows
    most = counts.orderBy(F.desc("c"), "h").limit(WORDS + WORDS // 8).collect()  # some more, as words can meet in a slot
    mask = (1 << 64) - 1
    cells = Cells.of_words([(r.h & mask, r.c) for r in most])
    n, v = np.zeros(CLASSES * MEMBERS, np.int64), np.zeros(CLASSES * MEMBERS, np.int64)
    for r in per:
        cell = (WORD_CLASSES + (r.b & 15)) * MEMBERS + (r.b >> 4)
        n[cell], v[cell] = r.n, r.v
    total, types = int(n.sum()), int(v.sum())
    own = cells.counts > 0
    from_cell = cells.rare(cells.keys[own].astype(np.uint32))
    np.subtract.at(n, from_cell, cells.counts[own])
    np.subtract.at(v, from_cell, 1)
    n[:WORDS] = cells.counts
    norm = np.log10(n + 0.5 * (v + 1))
    norm[:WORDS] = 0
    table = (n + 0.5).reshape(CLASSES, MEMBERS)
    table[:WORD_CLASSES][~own.reshape(WORD_CLASSES, MEMBERS)] = math.exp(EMPTY)
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (math.isqrt(total).bit_length() - 1))) if total else LEAST_ROWS
    w = Weights([np.zeros((rows, CLASSES), np.float32) for _ in range(FEATURES)], [np.zeros((2 * rows, MEMBERS), np.float32) for _ in range(FEATURES)], np.log(table.sum(axis=1)).astype(np.float32), np.log(table).astype(np.float32))
    shards = max(LEAST_SHARDS, -(-total // (rounds * TOKENS_PER_ROW * rows)))
    for i in range(rounds if total else 0):
        w = _averaged(tokens, w, cells, rate / (i + 1), rounds, i, shards)
    return Model(w, cells, total, types, norm, counts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = 0.35) -> Model:
    return fit_tokens(token_table(docs, id_col, text_col), rounds, rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """score_tokens() of docs; extra columns are not read."""
    return score_tokens(token_table(docs, id_col, text_col), model, id_col, frequent)


def score_tokens(tokens: DataFrame, model: Model, id_col: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """Base-10 log probability of every whole text, by a smoothed word model and by the trained one.

    Tokens are words (A-Z lower-cased) and one end. The model's probability of one of the WORDS most
    frequent words is that of its class, and of the word among the class's words, both from the
    hashed context features. Any other word backs off: the probability of its class and of its bucket
    there, both from the context, times its smoothed share of the bucket's counts (count + 1/2, with
    one unknown word a bucket). Counts of at most `frequent` words go to every task; those of all
    others are joined, so no vocabulary has to fit anywhere.

    Result: id_col, n_tokens, n_known, base_score, score; null and empty texts are one end; rows with
    a null id and repeated rows are each scored; without training text every word is unknown.
    """
    spark = tokens.sparkSession
    counts = model.counts
    sizes = {r.e: r.n for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, room = 64, frequent
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    top = counts.where(F.col("c") >= 2**least if least < 63 else F.lit(False)).orderBy(F.asc("c"), "h").toPandas()  # `frequent` rows at most
    key, val = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
    h, c = top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
    key[h >> np.uint64(44)], val[h >> np.uint64(44)] = h, c  # of words that meet in a slot the most frequent one stays
    sent = spark.sparkContext.broadcast((model.w, model.cells, model.norm, key, val))
    kind = dict(tokens.dtypes)["_lm_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cells, norm, key, val = sent.value
        uid = TaskContext.get().partitionId() << 34
        for big in batches:
            for batch in text_slices(big, 2, 8 * CHUNK_TOKENS):
                n = batch.column(1).to_numpy()
                keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
                k = keys.astype(np.uint32)
                cell = cells.find(k)
                other = np.flatnonzero(cell < WORDS)
                other = other[cells.keys[cell[other]] != keys[other]]
                cell[other] = cells.rare(k[other])
                doc = np.repeat(np.arange(len(n)), n)
                model_part = log_parts(w, k, n, cell) / np.log(10) - norm[cell]
                common = cell < WORDS
                slot = keys >> np.uint64(64 - SLOTS.bit_length() + 1)
                hit = ~common & (key[slot] == keys) & (val[slot] > 0)
                miss = ~(common | hit)
                logs = np.log10(val[slot[hit]] + 0.5)
                shared = np.bincount(doc[hit], logs, len(n))
                base = np.bincount(doc[common], np.log10(cells.counts[cell[common]] + 0.5), len(n)) + shared
                known = np.bincount(doc[~miss], minlength=len(n))
                whole = np.bincount(doc, model_part, len(n)) + shared
                order = np.lexsort((keys[miss], doc[miss]))
                d, x = doc[miss][order], keys[miss][order]
                first = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(x, prepend=np.uint64(0)) != 0)) if len(d) else np.empty(0, np.int64)
                tf = np.diff(np.append(first, len(d)))
                # the row of a document itself has a key of its own and no occurrences
                ids = np.arange(len(n)) + uid
                uid += len(n)
                with np.errstate(over="ignore"):
                    own = mixed(ids.astype(np.uint64) + np.uint64(0xABCDEF))
                pad = len(first)
                padded = lambda a, t, pad=pad: pa.concat_arrays([pa.array(a, t), pa.nulls(pad, t)])
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([ids, ids[d[first]]])),
                        pa.array(np.concatenate([own, x[first]]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(len(n), np.int64), tf])),
                        pa.concat_arrays([batch.column(0), pa.nulls(pad, batch.column(0).type)]),
                        padded(n, pa.int64()), padded(known, pa.int64()), padded(base, pa.float64()), padded(whole, pa.float64()),
                    ],
                    names=["uid", "h", "tf", "_lm_id", "n", "known", "base", "model"],
                )

    rows = tokens.select("_lm_id", "_lm_n", "_lm_keys").mapInArrow(run, f"uid long, h long, tf long, _lm_id {kind}, n long, known long, base double, model double")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    rows = rows.join(counts, "h", "left").select("uid", "_lm_id", "n", F.when(tf == 0, F.col("known")).when(c > 0, tf).otherwise(0).alias("known"), F.when(tf > 0, tf * F.log10(c + 0.5)).otherwise(0.0).alias("rare"), "base", "model")
    each = rows.groupBy("uid").agg(F.max("_lm_id").alias("_lm_id"), F.max("n").alias("n"), F.sum("known").alias("known"), F.sum("rare").alias("rare"), F.max("base").alias("base"), F.max("model").alias("model"))
    level = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    return each.select(F.col("_lm_id").alias(id_col), F.col("n").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), (F.col("base") + F.col("rare") - F.col("n") * level).alias("base_score"), (F.col("model") + F.col("rare")).alias("score"))
