"""Packing: deficit round-robin over source queues, in closed form, so that windows need no order of work."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, split_words, stored, text_slices

#: Bytes of text that a worker tokenises at a time, and words that it remembers.
CHUNK_BYTES, CACHE = 8 << 20, 1_000_000
#: Words of letters that go to the tokenizer as one text.
TOGETHER = 200
#: Parts of a tokenizer file that treat what is left and right of white space apart.
SPACE_SAFE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Strip", "BertNormalizer"}
SPACE_CUTS = {"WhitespaceSplit", "Whitespace", "BertPreTokenizer"}


class WordTokens:
    """Ids of whole texts by a tokenizer file; ids of white-space separated words are remembered as bytes.

    That is exact for tokenizers whose normaliser does not look across white space and whose
    pre-tokenizer cuts there and drops it, which the file tells; other tokenizers get whole texts.
    Where the normaliser also lower-cases and the pre-tokenizer cuts between a letter or digit and
    marks, A-Z are lower-cased and marks are set apart from letters and digits, so that fewer words
    are new. New words of letters alone go to the tokenizer many at a time, and their ids are cut
    where the vocabulary marks a word's end.
    """

    MARKS = b".,;:!?%$*#&"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t["content"] for t in rules.get("added_tokens") or []]
        self.by_word = self._cuts_at_blanks(rules)
        steps = [x["type"] for x in self._steps(rules.get("normalizer"), "normalizers")]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_end = self.by_word and "Lowercase" in steps and ids("AB, c.. d1!?e") == ids("ab") + ids(",") + ids("c") + ids("..") + ids("d") + ids("1") + ids("!?") + ids("e")
        suffix = rules["model"].get("end_of_word_suffix") if rules["model"]["type"] == "BPE" else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _steps(part: dict | None, many: str) -> list[dict]:
        return [] if part is None else part[many] if part["type"] == "Sequence" else [part]

    def _cuts_at_blanks(self, rules: dict) -> bool:
        for step in self._steps(rules.get("normalizer"), "normalizers"):
            blanks_only = step["type"] == "Replace" and step["pattern"].get("Regex") == r"\s+" and step["content"] == " "
            if step["type"] not in SPACE_SAFE and not blanks_only:
                return False
        first = next(iter(self._steps(rules.get("pre_tokenizer"), "pretokenizers")), {"type": None})
        drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
        if first["type"] not in SPACE_CUTS and not drops:
            return False
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return ids(" ab1  cd\n\tef?\x0b") == ids("ab1") + ids("cd") + ids("ef?") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules.get("added_tokens") or [])

    def _raw(self, ids: list[int]) -> bytes:
        return array("H" if self.size == 2 else "I", ids).tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self._raw(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words that are not remembered."""
        texts = b"\n".join(words).decode().split("\n")
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        other = [i for i, t in enumerate(texts) if not t.isalpha()]
        out = [b""] * len(texts)
        packs = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for pack, e in zip(packs, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in p]) for p in packs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(pack):  # a letter that this tokenizer takes for a mark
                other += pack
                continue
            raw, at = self._raw(e.ids), 0
            for i, to in zip(pack, (cuts * self.size).tolist(), strict=True):
                out[i] = raw[at:to]
                at = to
        for i, ids in zip(other, self._each([texts[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        got = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(got) if ids is None]
        if new:
            todo = [words[i] for i in new]
            ids = self._encode_words(todo)
            self.known.update(zip(todo, ids, strict=True))
            for i, x in zip(new, ids, strict=True):
                got[i] = x
        return got

    def _apart(self, texts: pa.Array) -> pa.Array:
        """A-Z lower-cased, and a space between any letter or digit of ASCII and a mark beside it."""
        low = pc.ascii_lower(pa.concat_arrays([texts])).fill_null("").cast(pa.large_string())
        _, offsets, data = low.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(low) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[: offsets[-1]]
        kind = np.zeros(256, np.uint8)
        kind[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
        kind[list(self.MARKS)] = 2
        kinds = kind[raw]
        border = kinds[1:] * kinds[:-1] == 2
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        border[inner - 1] = False  # two texts meet there
        at = np.flatnonzero(border) + 1
        raw = np.insert(raw, at, 32)
        offsets = offsets + np.searchsorted(at, offsets, side="left")
        return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(raw))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        dtype = np.uint16 if self.size == 2 else np.uint32
        if not self.by_word or any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            ids = [np.frombuffer(x, dtype) for x in self._each([t or "" for t in texts.to_pylist()])]
            return np.concatenate([np.empty(0, dtype), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)
        ends, places, words = split_words(self._apart(texts) if self.by_end else texts, False)
        taken = pa.array(self._of_words(words), pa.large_binary()).take(pa.array(places))
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(taken) + 1] // self.size if len(taken) else np.zeros(1, np.int64)
        return np.frombuffer(data or b"", dtype)[: offsets[-1]], offsets[ends]


_tokens: dict[str, WordTokens] = {}


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_pk_id, _pk_source, _pk_n, _pk_part, _pk_before, _pk_ids): whole texts as ids, the end id last.

    _pk_part is the task, and _pk_before how many ids of the same source lie before the row in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = WordTokens(path)
        tok = _tokens[path]
        task, dealt = TaskContext.get().partitionId(), {}
        for big in batches:
            for batch in text_slices(big, 2, CHUNK_BYTES):
                ids, ends = tok.encode(batch.column(2))
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                before = []
                for source, k in zip(batch.column(1).to_pylist(), n.tolist(), strict=True):
                    at = dealt.get(source, 0)
                    before.append(at)
                    dealt[source] = at + k
                offsets = np.append(0, ends * tok.size)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                part = pa.array(np.full(len(n), task, np.int64))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), part, pa.array(before, pa.int64()), raw], names=["_pk_id", "_pk_source", "_pk_n", "_pk_part", "_pk_before", "_pk_ids"])

    rows = docs.select(F.col(id_col).alias("_pk_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_pk_source"), F.col(text_col).cast("string").alias("_pk_text"))
    kind = dict(rows.dtypes)["_pk_id"]
    return rows.mapInArrow(run, f"_pk_id {kind}, _pk_source string, _pk_n long, _pk_part long, _pk_before long, _pk_ids binary")


class Phase:
    """Windows first..first+count in which queues get fixed shares.

    Queue s has granted floor(t * after / whole) - floor(t * before / whole) tokens when t tokens of
    the phase are dealt. That is the state of deficit round-robin after those windows: the deficit,
    t * share less what was granted, stays within one token and is carried from window to window. A
    window's grants add up to its length, and any task can tell the state of any window.
    """

    def __init__(self, first: int, total: int, whole: int, shares: dict[int, tuple[int, int]], starts: dict[int, int], length: int) -> None:
        self.first, self.total, self.whole, self.shares, self.starts, self.length = first, total, whole, shares, starts, length
        self.count = -(-total // length)

    def dealt(self, w: int, bound: int) -> int:
        return min(w * self.length, self.total) * bound // self.whole

    def granted(self, queue: int, w: int) -> int:
        before, after = self.shares[queue]
        return self.dealt(w, after) - self.dealt(w, before)

    def pieces(self, queue: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset, from, to) of the queue's tokens low..high, as far as this phase holds them."""
        if queue not in self.shares:
            return
        before, after = self.shares[queue]
        start = self.starts[queue]
        low, high = max(low - start, 0), min(high - start, self.granted(queue, self.count))
        if low >= high:
            return
        w = min(low * self.whole // ((after - before) * self.length), self.count - 1)
        while w > 0 and self.granted(queue, w) > low:
            w -= 1
        while self.granted(queue, w + 1) <= low:
            w += 1
        while low < high:
            begin, end = self.granted(queue, w), self.granted(queue, w + 1)
            to = min(end, high)
            if to > low:
                yield self.first + w, self.dealt(w + 1, before) - self.dealt(w, before) + low - begin, low + start, to + start
                low = to
            w += 1


class Rest:
    """What no target could use: the ends of queues, one after another."""

    def __init__(self, first: int, begins: dict[int, int], starts: dict[int, int], length: int) -> None:
        self.first, self.begins, self.starts, self.length = first, begins, starts, length

    def pieces(self, queue: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        if queue not in self.begins:
            return
        start = self.starts[queue]
        low = max(low, start)
        while low < high:
            at = self.begins[queue] + low - start
            to = min(high, low + self.length - at % self.length)
            yield self.first + at // self.length, at % self.length, low, to
            low = to


def plan(totals: dict[int, int], targets: dict[int, int] | None, length: int) -> list[Phase | Rest]:
    """Phases for queues of so many tokens. Without targets every window has the shares of the whole."""

    def cumulated(weights: dict[int, int]) -> dict[int, tuple[int, int]]:
        at, out = 0, {}
        for q, w in weights.items():
            out[q] = (at, at + w)
            at += w
        return out

    left = {q: n for q, n in sorted(totals.items()) if n}
    used = dict.fromkeys(left, 0)
    if not left:
        return []
    if not targets:
        whole = sum(left.values())
        return [Phase(0, whole, whole, cumulated(left), used, length)]
    phases: list[Phase | Rest] = []
    first = 0
    active = {q: targets[q] for q in left if targets.get(q, 0) > 0}
    while active:
        whole = sum(active.values())
        if min(active.values()) * length < whole:
            raise ValueError("a target is under one token a window")
        windows = min((left[q] - 2) * whole // (w * length) for q, w in active.items())
        if windows > 0:
            phase = Phase(first, windows * length, whole, cumulated(active), {q: used[q] for q in active}, length)
            phases.append(phase)
            first += windows
            for q in active:
                got = phase.granted(q, windows)
                used[q] += got
                left[q] -= got
        scarce = min(active, key=lambda q: left[q] * whole / active[q])
        del active[scarce]
    begins, at = {}, 0
    for q, n in left.items():
        begins[q] = at
        at += n
    return [*phases, Rest(first, begins, dict(used), length)]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, targets: dict[str, float] | None = None, flatten: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 5_000) -> DataFrame:
    """Cut the token streams of all documents into windows of `length` with fixed shares of each source.

    Every source is a queue; window after window takes from each queue what its share and its deficit
    allow. Sources with under one token a window share a queue. Without targets the shares are those
    of the whole corpus, so that all queues end together and every window but the last is full. With
    targets (source -> weight) the windows keep to them as long as the queues last; when one ends, the
    others go on in proportion; what no target can use follows, queue after queue. `flatten` sets the
    targets from the corpus: a source of n tokens has the weight n ** flatten, so that below 1 small
    sources have more of each window than of the corpus, and the largest ones fill the last windows.

    A queue is ordered by runs, a run being one source's documents in one task of the reading; only
    the runs' sizes are shuffled to find where each begins, and tokens only where the table of runs is too large to be sent to the tasks.

    Result, a row for each piece: id_col, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian uint32). Null and empty texts are their end id alone; a null source is the source
    ''; repeated rows are packed each; other columns are not read; an empty table gives no piece.
    Tokens exist once, in a table in the shared folder; totals of at most `length` queues come to the
    driver.
    """
    spark = docs.sparkSession
    rows = stored(tokenised(docs, tokenizer, end_id, id_col, text_col, source_col), "pack-tokens")
    runs = stored(rows.groupBy("_pk_source", "_pk_part").agg(F.sum("_pk_n").alias("n")), "pack-runs")
    sums = runs.groupBy("_pk_source").agg(F.sum("n").alias("n"))
    whole = runs.agg(F.sum("n"), F.count("*")).first()
    total, count = whole[0] or 0, whole[1] or 0
    large = {r["_pk_source"]: r["n"] for r in sums.where(F.col("n") * length >= total).orderBy("_pk_source").collect()}  # `length` rows at most
    number = {s: i + 1 for i, s in enumerate(sorted(large))}
    totals = {number[s]: n for s, n in large.items()}
    small = total - sum(large.values())
    shared = 0
    if small and (small * length < total):
        shared = number[min(large, key=lambda s: (large[s], s))]
        totals[shared] += small
    elif small:
        totals[0] = small
    weights = None
    if targets:
        weights = {number[s]: round(w * 1_000_000) for s, w in targets.items() if s in number}
    elif flatten is not None:
        most = max(totals.values(), default=1)
        weights = {q: max(1, round((n / most) ** flatten * 1_000_000)) for q, n in totals.items()}
    phases = plan(totals, weights, length)
    queue = F.lit(shared)
    if number:
        found = spark.createDataFrame([(s, i) for s, i in number.items()], "_pk_s string, _pk_q int")
        runs = runs.join(F.broadcast(found), F.col("_pk_source") == F.col("_pk_s"), "left").drop("_pk_s")
        queue = F.coalesce("_pk_q", queue)
    runs = runs.withColumn("_pk_queue", queue)
    begin = F.struct("_pk_source", "_pk_part")
    starts = running_total(runs, ["_pk_queue"], ["_pk_source", "_pk_part"], F.col("n"), "_pk_begin", begin, 1 + count // rows_per_bucket)
    starts = stored(starts.select("_pk_source", "_pk_part", "_pk_queue", "_pk_begin"), "pack-starts")
    # the table of runs is small beside the tokens, and Spark sends it to the tasks if its size allows
    placed = rows.join(starts, ["_pk_source", "_pk_part"]).select("_pk_id", "_pk_queue", "_pk_n", (F.col("_pk_begin") + F.col("_pk_before")).alias("_pk_at"), "_pk_ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_pk_queue", "_pk_n", "_pk_at", "_pk_ids")}
            row, start, size, doc, seq, off, out = ([] for _ in range(7))
            for i, (q, n, at, ids) in enumerate(zip(*(c.to_pylist() for c in cols.values()), strict=True)):
                wide = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4")
                for phase in phases:
                    for w, o, low, high in phase.pieces(q, at, at + n):
                        row.append(i)
                        start.append(low - at)
                        size.append(high - low)
                        doc.append(n)
                        seq.append(w)
                        off.append(o)
                        out.append(wide[low - at : high - at].tobytes())
            ids_col = batch.column(batch.schema.get_field_index("_pk_id")).take(pa.array(row, pa.int64()))
            longs = [pa.array(x, pa.int64()) for x in (start, size, doc, seq, off)]
            yield pa.record_batch([ids_col, *longs, pa.array(out, pa.binary())], names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = dict(rows.dtypes)["_pk_id"]
    return placed.mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
