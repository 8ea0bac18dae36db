"""Finding the names of a table in texts: one automaton for a block of names, built once a worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of names in one automaton. Names beyond that go to further automata, one pass over the texts each.
BLOCK_CHARS = 16_000_000
#: Texts that a worker has as Python strings at once; the rest of a batch stays in Arrow's buffers.
SLICE = 64
#: Automata that a worker keeps.
KEPT = 4
_built: dict[int, tuple] = {}
_PART = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def blocks(names: DataFrame, chars: int | None = None) -> Iterator[list]:
    """Rows of an ordered table with a column `name`, in blocks of about BLOCK_CHARS characters; the driver holds one at a time."""
    rows, held = [], 0
    for r in names.toLocalIterator():
        if rows and held + len(r.name) > (chars or BLOCK_CHARS):
            yield rows
            rows, held = [], 0
        rows.append(r)
        held += len(r.name)
    if rows:
        yield rows


def _kept(sent: Broadcast, build):
    """What `build` makes of the broadcast value, made once in this worker."""
    key = id(sent.value)
    if key not in _built or _built[key][0] is not sent.value:
        while len(_built) >= KEPT:
            del _built[next(iter(_built))]
        _built[key] = (sent.value, build(sent.value))
    return _built[key][1]


def by_text(texts: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each text (or null), few texts at a time."""
    done = [pa.array([f(t) for t in texts.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def automaton(keys: list[str]) -> ahocorasick.Automaton:
    """Of keys that differ; each carries its number and length."""
    out = ahocorasick.Automaton()
    for i, k in enumerate(keys):
        out.add_word(k, (i, len(k)))
    out.make_automaton()
    return out


def whole_words(found: ahocorasick.Automaton, low: str) -> set[int]:
    """Numbers of the keys that stand in the text with no letter a-z or digit before or after."""
    hits: set[int] = set()
    for end, (i, n) in found.iter(low):
        if i not in hits and (end + 1 == len(low) or low[end + 1] not in _PART) and (end < n or low[end - n] not in _PART):
            hits.add(i)
    return hits


def with_names(df: DataFrame, column: Column, names: DataFrame, out: str) -> DataFrame:
    """df with the names of each text as an array in the order of the names; null texts hold none.

    names: (name, ref_order). Names that differ in case only are one, at the place of the first and in the
    spelling of the last; null and empty ones are none. A name stands as a whole word: no letter a-z or digit
    touches it. Each block of names is one automaton, so the plan does not grow with the names.
    """
    key = F.lower("name")
    first = names.where(F.coalesce("name", F.lit("")) != "").groupBy(key.alias("key")).agg(F.min(F.struct("ref_order", "name")).alias("_at"), F.max_by("name", F.struct("ref_order", "name")).alias("name"))
    result = df.withColumn(out, F.array().cast("array<string>"))
    for rows in blocks(first.orderBy("_at").select("name")):
        sent = df.sparkSession.sparkContext.broadcast([r.name for r in rows])  # bounded by BLOCK_CHARS
        result = result.withColumn(out, F.concat(out, _found_in(sent)(column)))
    return result


def _found_in(sent: Broadcast):
    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        one = _kept(sent, lambda names: automaton([n.lower() for n in names]))
        return by_text(texts, lambda t: [] if t is None else [sent.value[i] for i in sorted(whole_words(one, t.lower()))], pa.list_(pa.string()))

    return found


@lru_cache(maxsize=65_536)
def _pattern(name: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(name)}\b", re.IGNORECASE)


@lru_cache(maxsize=1)
def _odd_letters() -> re.Pattern:
    """Letters that equal others, apart from case, whose small letters differ."""
    some = {c for c in map(chr, range(128, 0x1FFFF)) if c.casefold() != c.lower()} - set("ßẞ") | set("ıİΣ")
    return re.compile("[" + "".join(sorted(some)) + "]")


def _odd(text: str) -> bool:
    return not text.isascii() and _odd_letters().search(text) is not None


class Recase:
    """Puts names into their shown form, in the given order, wherever they stand as whole words of Unicode in any case."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = pairs
        keys: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(pairs):
            keys.setdefault(name.lower(), []).append(i)
        self.of = list(keys.values())
        self.automaton = automaton(list(keys))
        self.odd = [i for i, (name, _) in enumerate(pairs) if _odd(name)]

    def candidates(self, text: str) -> list[int]:
        if _odd(text):  # small letters don't decide
            return list(range(len(self.pairs)))
        found = {j for _, (i, _) in self.automaton.iter(text.lower()) for j in self.of[i]}
        return sorted(found.union(self.odd))

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.pairs:
            return text
        todo = self.candidates(text)
        at = 0
        while at < len(todo):
            i = todo[at]
            name, shown = self.pairs[i]
            new = _pattern(name).sub(lambda _, shown=shown: shown, text)
            at += 1
            if len(new) != len(text):  # spaces went: other names can stand there now
                todo, at = [j for j in self.candidates(new) if j > i], 0
            text = new
        return text


def recased(column: Column, df: DataFrame, names: DataFrame) -> Column:
    """The text with all names in their shown form, block after block. names: (name, shown), ordered."""
    for rows in blocks(names):
        sent = df.sparkSession.sparkContext.broadcast([(r.name, r.shown) for r in rows])  # bounded by BLOCK_CHARS
        column = _recase_by(sent)(column)
    return column


def _recase_by(sent: Broadcast):
    @F.arrow_udf("string")
    def cased(texts: pa.Array) -> pa.Array:
        return by_text(texts, _kept(sent, Recase), pa.string())

    return cased
