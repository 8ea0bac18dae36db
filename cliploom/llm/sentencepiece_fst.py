"""SentencePiece encoding and decoding as a weighted transducer over pieces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITE = float("inf")
#: What an unknown id is decoded to.
UNKNOWN_TEXT = " ⁇ ".encode()
#: Segments and pairs of pieces that a worker remembers, and the longest such segment.
CACHE, REMEMBERED = 1_000_000, 256
#: Scores of unigram models times this are whole numbers.
SCALE = 2**64


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


def character_map(raw: bytes) -> dict[str, str]:
    """A precompiled character map as {source: target}.

    It is a double-array trie over UTF-8 bytes, whose leaves point into a list of zero-ended targets.
    The trie is walked level by level: a unit's low byte is its label, bit 8 says that a key ends
    there, and its upper bits say where its children lie.
    """
    if not raw:
        return {}
    size = int.from_bytes(raw[:4], "little")
    units, targets = np.frombuffer(raw, "<u4", size // 4, 4), raw[4 + size :]
    children = lambda u: (u >> 10) << ((u & 512) >> 6)
    base, keys, out = children(units[:1]), [b""], {}
    labels = np.arange(1, 256, dtype=np.uint32)
    while len(keys):
        at = base[:, None] ^ labels
        found = units[np.minimum(at, len(units) - 1)]
        row, col = np.nonzero((at < len(units)) & ((found & 0x800000FF) == labels))
        unit, at = found[row, col], at[row, col]
        keys = [keys[r] + bytes((c + 1,)) for r, c in zip(row.tolist(), col.tolist(), strict=True)]
        base = at ^ children(unit)
        for i in np.nonzero(unit & 256)[0].tolist():
            begin = int(units[base[i]]) & 0x7FFFFFFF
            out[keys[i].decode()] = targets[begin : targets.index(b"\0", begin)].decode()
    return out


class Normaliser:
    """The model's normaliser as a transducer: it rewrites the longest mapped string at each place, left to right.

    User symbols pass as they are. With `squeeze`, runs of spaces become one and both ends lose theirs.
    """

    def __init__(self, mapped: dict[str, str], protected: list[str], prefix: bool, squeeze: bool) -> None:
        self.mapped, self.prefix, self.squeeze = mapped, SPACE if prefix else "", squeeze
        self.symbols = re.compile("|".join(map(re.escape, sorted(protected, key=len, reverse=True)))) if protected else None
        self.longest: dict[str, int] = {}
        for w in [*mapped, *protected]:
            self.longest[w[0]] = max(len(w), self.longest.get(w[0], 0))
        self.heads = re.compile("[" + "".join(map(re.escape, sorted(self.longest))) + "]") if self.longest else None

    def _rewritten(self, text: str) -> str:
        out, at = [], 0
        for head in self.heads.finditer(text):
            i = head.start()
            if i < at:
                continue
            symbol = self.symbols.match(text, i) if self.symbols else None
            if symbol:
                source = target = symbol.group()
            else:
                sources = (text[i : i + n] for n in range(self.longest[head.group()], 0, -1))
                source = next((w for w in sources if w in self.mapped), None)
                if source is None:
                    continue
                target = self.mapped[source]
            out += text[at:i], target
            at = i + len(source)
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.heads:
            done = self._rewritten(text)
        else:
            done = text
        if self.squeeze:
            done = re.sub(" +", " ", done).strip(" ")
            return (self.prefix + done).replace(" ", SPACE).rstrip(SPACE) if done else ""
        return (self.prefix + done).replace(" ", SPACE) if text else ""


class Transducer:
    """Normaliser, pieces and byte fallback of a model, compiled into one transducer.

    An arc reads one piece and writes its id (or the ids of its bytes); the encoding of a text is the
    shortest path, in the tropical semiring, over the composition with the normalised text.

    Unigram models: a state is a place in the text, and an arc weighs what its piece's score is short
    of zero. A character that is no piece is an arc of the least score minus 10. Weights are exact
    integers (SCALE), so a path does not depend on where it is cut; of equal paths the one whose last
    piece is longer is taken.

    Byte-pair models: a state is a place and the last piece before it. An arc weighs 0, if merging the
    last piece and the new one, character by character, ends in these two pieces, and is infinite
    otherwise: a sequence is what the model's merges make of a text if and only if that holds for all
    pieces that stand side by side. As merges never pass from a letter to a space mark, nor over a
    character that is in no piece, the composition falls into segments. User symbols stand alone.

    Paths of segments are remembered. Refused are word and character models, white space as a suffix
    or unmarked, maps for decoding, byte-pair models with unused pieces or with pieces that go on
    after a word's end, and user symbols with several spaces.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer, rules, back = (dict(next((_fields(v) for k, v in model if k == n), iter(()))) for n in (2, 3, 5))
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p[1].decode() for p in pieces]
        users = [w for w, k in zip(names, kinds, strict=True) if k == USER]
        self.unigram = trainer.get(3, 1) == 1
        if trainer.get(3, 1) not in (1, 2) or trainer.get(24, 0) or not rules.get(5, 1) or back.get(2) or any(w.count(" ") > 1 for w in users):
            raise ValueError("this kind of model is not compiled")
        if not self.unigram and UNUSED in kinds:
            raise ValueError("byte-pair models with unused pieces are not compiled")
        self.normalise = Normaliser(character_map(rules.get(2, b"")), users, bool(rules.get(3, 1)), bool(rules.get(4, 1)))
        self.names = names
        self.ids = {w: i for i, (w, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        self.scores = {names[i]: float(np.frombuffer(pieces[i].get(2, b"\0\0\0\0"), "<f4")[0]) for i in self.ids.values()}
        self.byte_ids = {int(names[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.dtype = np.uint16 if len(names) <= 1 << 16 else np.uint32
        self.users = {names[i]: i for i, k in enumerate(kinds) if k == USER}
        arcs = {**self.ids, **self.users} if self.unigram else self.ids
        self.longest = max(map(len, arcs), default=1)
        self.touching = {w[i : i + 2] for w in arcs for i in range(len(w) - 1)}
        crossing = any(b == SPACE != a for a, b in self.touching)
        if self.unigram:
            exact = lambda score: int(-score * SCALE)
            least, most = min(self.scores.values(), default=0.0), max([0.0, *self.scores.values()])
            weigh = lambda w, i: exact(len(w.encode()) * most - 0.1 if w in self.users else self.scores[w])
            self.arcs = {w: (i + 1, weigh(w, i)) for w, i in arcs.items()}
            self.unknown_weight = exact(least - 10)
            self.segment = re.compile("(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            if crossing:
                raise ValueError("a piece goes on after a word's end")
            letters = {c for w in self.ids for c in w}
            inside = "".join(map(re.escape, sorted(letters - {SPACE})))
            self.segment = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]" if inside else "(?s).")
        self.raw = set(self.byte_ids.values())
        self.text = [b"" if k == UNUSED else w.replace(SPACE, " ").encode() for w, k in zip(names, kinds, strict=True)]
        for i, k in enumerate(kinds):
            if k in (CONTROL, UNKNOWN):
                self.text[i] = b"" if k == CONTROL else UNKNOWN_TEXT
        for byte, i in self.byte_ids.items():
            self.text[i] = bytes([byte])
        self.paths: dict[str, bytes] = {}
        self.pairs: dict[int, float] = {}

    def _name(self, state: int) -> str:
        """The piece of a state: its id plus 1, a character that is no piece by its negative code, or 0 at the start."""
        return self.names[state - 1] if state > 0 else chr(-state) if state else ""

    def weight(self, last: int, new: int) -> float:
        """0 if merges over both pieces' characters never join what is left and right of the border, else infinite."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        known = self.pairs[(last << 24) + new] = self._weight(self._name(last), self._name(new))
        return known

    def _weight(self, last: str, new: str) -> float:
        parts, border, scores = [*last, *new], len(last), self.scores
        while True:
            best, where = -INFINITE, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1], -INFINITE)
                if s > best:
                    best, where = s, i
            if where < 0:
                return 0.0 if parts == [p for p in (last, new) if p] else INFINITE
            if where == border - 1:
                return INFINITE
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            if where < border - 1:
                border -= 1

    def shortest(self, segment: str) -> list[int]:
        """The states of the shortest path over a segment of a byte-pair model.

        Paths of infinite weight are left out, and of the others only one ends at each place, so the
        first arc of weight 0 into a place is the shortest path to it.
        """
        size, longest = len(segment), self.longest
        ids, pairs = self.ids.get, self.pairs.get
        last, back = [0] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                new = ids(segment[begin:end])
                if new is not None:
                    new += 1
                elif begin == end - 1:
                    new = -ord(segment[begin])
                else:
                    continue
                w = pairs((last[begin] << 24) + new)
                if w is None:
                    w = self.weight(last[begin], new)
                if w == 0.0:
                    last[end], back[end] = new, begin
                    break
        out, at = [], size
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def lightest(self, segment: str) -> list[int]:
        """The states of the shortest path over a segment of a unigram model."""
        size, longest, arcs = len(segment), self.longest, self.arcs.get
        cost, into = [0] + [INFINITE] * size, [(0, 0)] * (size + 1)
        for begin in range(size):
            so_far, alone = cost[begin], False
            for end in range(begin + 1, min(size, begin + longest) + 1):
                arc = arcs(segment[begin:end])
                if arc is not None:
                    alone = alone or end == begin + 1
                    if so_far + arc[1] < cost[end]:
                        cost[end], into[end] = so_far + arc[1], (arc[0], begin)
            if not alone and so_far + self.unknown_weight < cost[begin + 1]:
                cost[begin + 1], into[begin + 1] = so_far + self.unknown_weight, (-ord(segment[begin]), begin)
        out, at = [], size
        while at:
            state, at = into[at]
            out.append(state)
        return out[::-1]

    def _ids(self, state: int) -> list[int]:
        if state > 0:
            return [state - 1]
        raw = chr(-state).encode()
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def _path(self, segment: str) -> bytes:
        """Ids of a segment, cut further where no piece holds both neighbours."""
        cuts = [0, *(i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.touching), len(segment)]
        if len(cuts) == 2:
            states = self.lightest(segment) if self.unigram else self.shortest(segment)
            return array("H" if self.dtype is np.uint16 else "I", [i for state in states for i in self._ids(state)]).tobytes()
        return b"".join([self._remembered(segment[a:b]) for a, b in zip(cuts, cuts[1:])])

    def _remembered(self, segment: str) -> bytes:
        got = self.paths.get(segment)
        if got is None:
            got = self._path(segment)
            if len(segment) <= REMEMBERED:
                if len(self.paths) >= CACHE:
                    self.paths.clear()
                self.paths[segment] = got
        return got

    def _encode(self, text: str) -> bytes:
        paths, segments = self.paths, self.segment.findall(text)
        try:
            return b"".join([paths[s] for s in segments])
        except KeyError:
            return b"".join([self._remembered(s) for s in segments])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as an array of self.dtype; without byte fallback unknown characters side by side are one id."""
        text = self.normalise(text)
        if self.users and not self.unigram:
            out, at = [], 0
            for symbol in self.normalise.symbols.finditer(text):
                out += self._encode(text[at : symbol.start()]), self.dtype(self.users[symbol.group()]).tobytes()
                at = symbol.end()
            raw = b"".join([*out, self._encode(text[at:])])
        else:
            raw = self._encode(text)
        if self.byte_ids:
            return raw
        ids = np.frombuffer(raw, self.dtype)
        unknown = ids == self.unknown
        return ids[~(unknown & np.append(False, unknown[:-1]))].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids: space marks become spaces, those that encoding adds go, bytes that are no UTF-8 become U+FFFD.

        Of a model that squeezes spaces every piece up to the first letter loses one space, of others
        that put a space before texts only the first piece does.
        """
        ids = np.frombuffer(ids, self.dtype).tolist()
        pieces = [self.text[i] for i in ids]
        squeeze = self.normalise.squeeze
        for at, piece in enumerate(pieces if squeeze or self.normalise.prefix else ()):
            spaced = piece[:1] == b" " and ids[at] != self.unknown and ids[at] not in self.raw
            pieces[at] = piece[spaced:]
            if pieces[at] or (spaced and not squeeze):
                break
        return b"".join(pieces).decode("utf-8", "replace")


_compiled: dict[str, Transducer] = {}


def _transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): every whole text as little-endian uint32 ids.

    Null and empty texts have no ids; repeated rows are each encoded; other columns are not read.
    `model` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(model)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                ids = [np.frombuffer(fst.encode(t or ""), fst.dtype).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_sp_text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """The columns of encoded and `out`, the text of its ids; null ids give a null text."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(model)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
                texts = [None if x is None else fst.decode(np.frombuffer(x, "<u4").astype(fst.dtype).tobytes()) for x in ids]
                yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, `{out}` string")
