"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Bytes of a window, units of each direction, windows that are labelled at once.
STEPS, UNITS, AT_ONCE = 64, 8, 2048
UNKNOWN = "und"


def _windows(text: bytes) -> np.ndarray:
    """The whole text as rows of STEPS bytes, the last one filled with zeros."""
    n = -(-len(text) // STEPS)
    out = np.zeros(n * STEPS, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, STEPS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over both at every position.

    Arrays are feature by window. For each direction d: x (3U x 256, what a byte adds to the update
    gate, the reset gate and the candidate) and u (3U x U, what the state adds); v (K x 2U) and c (K)
    are the output. Windows begin with an empty state; bytes that only fill a window leave it empty.
    """

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng, u = np.random.default_rng(seed), UNITS
        p = {f"x{d}": rng.normal(0, 0.3, (3 * u, 256)) for d in "fb"} | {f"u{d}": rng.normal(0, u**-0.5, (3 * u, u)) for d in "fb"}
        p |= {"v": rng.normal(0, 0.3, (len(languages), 2 * u)), "c": np.zeros((len(languages), 1))}
        return cls(languages, {k: a.astype(np.float32) for k, a in p.items()})

    def _direction(self, d: str, text: np.ndarray, real: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step (STEPS x U x windows) and, to train, what the way back needs."""
        u, n = UNITS, text.shape[1]
        x, w = self.p["x" + d], self.p["u" + d]
        states, kept = np.empty((STEPS, u, n), np.float32), []
        h = np.zeros((u, n), np.float32)
        for t in range(STEPS) if d == "f" else range(STEPS - 1, -1, -1):
            own, add = np.take(x, text[t], axis=1), w @ h
            gates = _sigmoid(own[: 2 * u] + add[: 2 * u])
            z, r = gates[:u], gates[u:]
            new = np.tanh(own[2 * u :] + r * add[2 * u :])
            after = (new + z * (h - new)) * real[t]
            if keep:
                kept.append((t, h, z, r, new, add[2 * u :]))
            h = states[t] = after
        return states, kept

    def _positions(self, text: np.ndarray, real: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Probabilities (STEPS x K x windows), both states, and what was kept of each direction."""
        forward, kf = self._direction("f", text, real, keep)
        backward, kb = self._direction("b", text, real, keep)
        both = np.concatenate([forward, backward], axis=1)
        logits = np.matmul(self.p["v"], both) + self.p["c"]
        np.exp(logits - logits.max(axis=1, keepdims=True), out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, both, kf, kb

    def gradients(self, text: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over all positions, and its gradients by backpropagation through time."""
        u = UNITS
        prob, both, kf, kb = self._positions(text, real, True)
        total = max(1.0, float(real.sum()))
        picked = prob[:, label, np.arange(len(label))]
        loss = -float((np.log(picked + 1e-9) * real[:, 0]).sum()) / total
        d = prob
        d[:, label, np.arange(len(label))] -= 1
        d *= real / total
        g = {"v": np.einsum("tkn,tun->ku", d, both, optimize=True), "c": d.sum(axis=(0, 2))[:, None]}
        back = np.matmul(self.p["v"].T, d)
        for name, kept, part in (("f", kf, back[:, :u]), ("b", kb, back[:, u:])):
            w, gx, gw = self.p["u" + name], np.zeros((3 * u, 256), np.float32), np.zeros((3 * u, u), np.float32)
            dh = np.zeros_like(part[0])
            for t, h, z, r, new, add in reversed(kept):
                dh = (dh + part[t]) * real[t]
                dz, dn = dh * (h - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
                inner = np.concatenate([dz, dn * add * r * (1 - r), dn])
                for k in range(3 * u):
                    gx[k] += np.bincount(text[t], inner[k], 256)
                inner[2 * u :] *= r
                gw += inner @ h.T
                dh = dh * z + w.T @ inner
            g |= {"x" + name: gx, "u" + name: gw}
        return loss, g

    def train(self, text: np.ndarray, lengths: np.ndarray, label: np.ndarray, rounds: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over batches of windows (rows of bytes), equally many of each language; returns the last loss."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        mean = {k: np.zeros_like(a) for k, a in self.p.items()}
        square = {k: np.zeros_like(a) for k, a in self.p.items()}
        loss = 0.0
        for i in range(1, rounds + 1):
            at = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
            real = (np.arange(STEPS)[:, None] < lengths[at]).astype(np.float32)[:, None, :]
            loss, g = self.gradients(np.ascontiguousarray(text[at].T), real, label[at])
            scale = min(1.0, 1.0 / (1e-6 + float(np.sqrt(sum((x * x).sum() for x in g.values())))))
            step = rate * (1 - 0.9 * i / rounds)
            for k, x in g.items():
                x = x * scale
                mean[k] += 0.1 * (x - mean[k])
                square[k] += 0.01 * (x * x - square[k])
                self.p[k] -= (step * (mean[k] / (1 - 0.9**i)) / (np.sqrt(square[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text that isn't empty, the mean over its positions of the languages' probabilities."""
        rows = [_windows(t) for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        sums = np.zeros((len(texts), len(self.languages)))
        if not len(of):
            return sums
        text = np.concatenate(rows)
        size = np.full(len(of), STEPS)
        last = np.flatnonzero(np.diff(of, append=-1))
        size[last] = [len(texts[i]) - (len(rows[i]) - 1) * STEPS for i in of[last]]
        for at in range(0, len(of), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            real = (np.arange(STEPS)[:, None] < size[part]).astype(np.float32)[:, None, :]
            prob = self._positions(np.ascontiguousarray(text[part].T), real)[0]
            np.add.at(sums, of[part], np.einsum("tkn,tn->nk", prob, real[:, 0], optimize=True))
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]

    def label_positions(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        raw = text.encode()
        rows = _windows(raw)
        real = (np.arange(rows.size).reshape(rows.shape) < len(raw)).T.astype(np.float32)[:, None, :]
        prob = self._positions(np.ascontiguousarray(rows.T), real)[0]
        return [self.languages[k] for k in prob.argmax(axis=1).T.ravel()[: len(raw)]]


def train_network(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_each: int = 400, windows_each: int = 8, rounds: int = 300) -> Network | None:
    """Train on a bounded sample: of each language about docs_each distinct texts (those of smallest hash), of
    each up to windows_each windows spread over the whole text. None without labelled text."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("_li_lang"), F.col(text_col).alias("_li_text"), F.xxhash64(text_col).alias("_li_h"))
    share = F.least(F.lit(1.0), docs_each / F.count("*"))
    # hashes are spread evenly over 64 bits, so a share of them lies under that share of the range
    limits = rows.select("_li_lang", "_li_h").distinct().groupBy("_li_lang").agg((share * 2.0**64 - 2.0**63).alias("_li_most"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                starts = np.unique(np.linspace(0, max(0, len(t) - STEPS), windows_each).astype(int))
                out.append([t[s : s + STEPS] for s in starts])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "windows"])

    few = rows.join(F.broadcast(limits), "_li_lang").where("_li_h <= _li_most").select("_li_lang", "_li_text", "_li_h").mapInArrow(windows, "lang string, h long, windows array<binary>")
    got = few.groupBy("lang", "h").agg(F.first("windows").alias("windows")).orderBy("lang", "h").collect()  # about docs_each a language
    if not got:
        return None
    net = Network.fresh(sorted({r.lang for r in got}))
    flat = [(w, r.lang) for r in got for w in r.windows]
    text = np.zeros((len(flat), STEPS), np.uint8)
    for i, (w, _) in enumerate(flat):
        text[i, : len(w)] = np.frombuffer(bytes(w), np.uint8)
    number = {x: i for i, x in enumerate(net.languages)}
    net.train(text, np.array([len(w) for w, _ in flat]), np.array([number[x] for _, x in flat]), rounds)
    return net


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None), then _lang (string) and _lang_score (0 to 1).

    Every byte of the whole text is labelled; a document's score of a language is the mean of its
    probability over all positions. `und` with score 0 if the text is null or has no letter, or
    nothing could be learned. Repeated rows get equal results. Columns of docs may have any names; those
    called _lang or _lang_score give way to the result's.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("_lang", "_lang_score")]
    held, has_letters = fresh(docs, "_li_text"), fresh(docs, "_li_letters")
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_lang", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    letters: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
                lang, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                has = [i for i, x in enumerate(get(has_letters).to_pylist()) if x and net is not None]
                if has:
                    texts = get(held).take(pa.array(has)).cast(pa.large_binary()).to_pylist()
                    for i, p in zip(has, net.pooled(texts), strict=True):
                        k = int(p.argmax())
                        lang[i], score[i] = net.languages[k], min(1.0, float(p[k]))
                yield pa.record_batch([*[get(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=out.names)

    return docs.select(*keep, F.col(text_col).alias(held), letters.alias(has_letters)).mapInArrow(run, out)
