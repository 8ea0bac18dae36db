"""Quality rules: a decision list learned by sequential covering, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS_SQL, stored

SYMBOLS = r"[^#*$%&|<>]+"
#: What a rule may test, as expressions over the counts of text_counts().
FEATURES = {
    "n_words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
#: Up to so many repeated windows of a text are looked up one by one; with more, windows are sorted with their places.
FEW = 12


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id (as _q_id), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts; with `whole`, the row as struct _q_row too."""
    blank = F.expr(BLANKS_SQL)
    row = [F.struct(*docs.columns).alias("_q_row")] if whole else []
    kept = ["_q_row"] if whole else []
    rows = docs.select(*row, F.col(id_col).alias("_q_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_q_text"))
    rows = rows.withColumn("_q_trim", F.btrim("_q_text", blank))
    rows = rows.withColumn("_q_words", F.when(F.col("_q_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_q_trim", r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, blank) != "")
    w = F.col("_q_words")
    rows = rows.select(
        *kept,
        "_q_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_q_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("_q_lines"),
        # a window is known by its hash; the last two places hold no whole window and are cut off
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))).alias("_q_win"),
    )
    rows = rows.withColumns({"n_lines": F.size("_q_lines").cast("long"), "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"), "_q_sorted": F.sort_array("_q_win")}).drop("_q_lines")
    same = F.zip_with("_q_sorted", F.slice("_q_sorted", F.lit(2), F.size("_q_sorted")), lambda a, b: F.when(a == b, a))
    rows = rows.withColumn("_q_again", F.array_distinct(F.filter(same, lambda x: x.isNotNull()))).drop("_q_sorted")
    again, win = F.col("_q_again"), F.col("_q_win")
    few = F.filter(F.transform(win, lambda h, i: F.when(F.array_contains(again, h), i)), lambda x: x.isNotNull())
    pairs = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_q_pairs", F.when(F.size(again) > FEW, pairs)).withColumn("_q_few", F.when(F.size(again).between(1, FEW), few))
    p = F.col("_q_pairs")
    many = F.sort_array(F.filter(F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()))
    rows = rows.withColumn("_q_at", F.coalesce("_q_few", many, F.array().cast("array<int>"))).drop("_q_pairs", "_q_few", "_q_win", "_q_again")
    at = F.col("_q_at")
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return rows.select(*kept, "_q_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        value = F.col(f"_f_{self.feature}")
        return value >= self.threshold if self.at_least else value < self.threshold

    def in_bins(self, k: int) -> Column:
        value = F.get("bins", F.lit(k))
        return value >= self.bin if self.at_least else value < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions together tell the class: 1 is bad, 0 is good."""

    conditions: tuple[Condition, ...]
    bad: int

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + (": reject" if self.bad else ": keep")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def with_features(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"_f_{k}": F.expr(v) for k, v in FEATURES.items()})


def learn_rules(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.95, min_bad: int = 5, cuts: int = 32) -> list[Rule]:
    """An ordered list of rules for documents of quality 0 and 1, from all rows of labelled (_q_id, counts, _q_bad 0/1).

    Each value becomes a bin between quantiles of either class, ends included; rows with equal bins are added up.
    Two thirds of the documents (by a hash of the id) grow a rule, one condition of highest
    information gain after another, from one histogram a step; the rest prune its last conditions
    and accept it, if it is right in at least min_precision of at least min_bad documents. Covered
    documents then leave. A rule that rejects comes next where one is accepted; where none is, a rule
    that keeps may take documents out of the way, once between two that reject. What no rule meets is
    kept, so a last rule that keeps is dropped. Only histograms (features x cuts rows) come to the driver.
    """
    names = list(FEATURES)
    rows = with_features(labelled)
    steps = [0.0, 0.002, 0.01, *[i / cuts for i in range(1, cuts)], 0.99, 0.998, 1.0]
    asked = [F.percentile_approx(F.when(F.col("_q_bad") == y, F.col(f"_f_{n}")), steps, 10_000).alias(f"{n}_{y}") for n in names for y in (0, 1)]
    got = rows.agg(*asked).first()
    edges = {n: sorted({x for y in (0, 1) for x in got[f"{n}_{y}"] or []}) for n in names}
    if not any(edges.values()):
        return []

    def bin_of(name: str) -> Column:  # how many edges the value reaches
        return reduce(lambda c, e: c + (F.col(f"_f_{name}") >= e).cast("int"), edges[name], F.lit(0))

    bins = F.array(*[bin_of(n) for n in names])
    cells = rows.select(bins.alias("bins"), F.col("_q_bad").cast("int").alias("bad"), (F.pmod(F.xxhash64("_q_id"), F.lit(3)) == 0).alias("held"))
    cells = stored(cells.groupBy("bins", "bad", "held").agg(F.count("*").alias("n")), "quality-cells").persist()
    index = {n: i for i, n in enumerate(names)}
    hits = lambda conditions: _all([c.in_bins(index[c.feature]) for c in conditions])

    def grown(left: DataFrame, target: int) -> tuple[Condition, ...]:
        own, other = (F.sum(F.when(F.col("bad") == y, F.col("n")).otherwise(0)) for y in (target, 1 - target))
        found: tuple[Condition, ...] = ()
        while len(found) < max_conditions:
            seen = left.where(~F.col("held") & hits(found)).select(F.posexplode("bins").alias("f", "bin"), "bad", "n")
            table: dict[int, dict[int, tuple[int, int]]] = {}
            for r in seen.groupBy("f", "bin").agg(own.alias("p"), other.alias("q")).collect():
                table.setdefault(r.f, {})[r.bin] = (r.p, r.q)
            best = (0.0, None)
            for f, bins_of in sorted(table.items()):
                p_all, q_all = (sum(v[i] for v in bins_of.values()) for i in (0, 1))
                if not q_all or not p_all:
                    continue
                base = math.log2(p_all / (p_all + q_all))
                for b in range(1, len(edges[names[f]]) + 1):
                    p_up, q_up = (sum(v[i] for k, v in bins_of.items() if k >= b) for i in (0, 1))
                    for up, p, q in ((True, p_up, q_up), (False, p_all - p_up, q_all - q_up)):
                        gain = p * (math.log2(p / (p + q)) - base) if p else 0.0
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(names[f], up, float(edges[names[f]][b - 1]), b))
            if best[1] is None:
                break
            found = (*found, best[1])
        return found

    def accepted(left: DataFrame, conditions: tuple[Condition, ...], target: int) -> Rule | None:
        shorter = [conditions[:k] for k in range(1, len(conditions) + 1)]
        if not shorter:
            return None
        got = left.where(F.col("held")).agg(*[F.coalesce(F.sum(F.when(hits(c) & (F.col("bad") == y), F.col("n"))), F.lit(0)).alias(f"{k}_{y}") for k, c in enumerate(shorter) for y in (0, 1)]).first()
        right = [(got[f"{k}_{target}"], got[f"{k}_{1 - target}"]) for k in range(len(shorter))]
        scored = [((p - q) / max(1, p + q), p, -len(shorter[k]), k) for k, (p, q) in enumerate(right)]
        fit = [x for x in scored if x[1] >= min_bad and (x[0] + 1) / 2 >= min_precision]
        # of those that are right often enough, the one that finds most
        return Rule(shorter[max(fit, key=lambda x: (x[1], x[0], x[2]))[3]], target) if fit else None

    rules: list[Rule] = []
    left = cells
    while len(rules) < max_rules:
        rule = accepted(left, grown(left, 1), 1)
        if rule is None and not (rules and rules[-1].bad == 0):
            rule = accepted(left, grown(left, 0), 0)
        if rule is None:
            break
        rules.append(rule)
        left = left.where(~hits(rule.conditions))
    cells.unpersist()
    return rules[:-1] if rules and rules[-1].bad == 0 else rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a document meets (from 1), negative if that rule keeps it; 0 without one. One conditional expression."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(_all([c.column() for c in rule.conditions]), F.lit(k if rule.bad else -k))
    return out.otherwise(F.lit(0))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _labels(labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id).alias("_q_lid")).agg(F.min(label_col).alias("_q_label"))


def _with_labels(counts: DataFrame, known: DataFrame) -> DataFrame:
    return counts.where(~_failed()).join(known, F.col("_q_id") == F.col("_q_lid")).withColumn("_q_bad", 1 - F.col("_q_label"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", **learning) -> tuple[DataFrame, list[Rule]]:
    """The rows of docs that judge_quality() keeps, with all their columns, and the rules.

    Counts are written beside the rows, so that every row is judged where it stands, by its own text:
    nothing is shuffled, and rows with a null or repeated id are judged each for itself.
    """
    rows = stored(text_counts(docs, id_col, text_col, whole=True), "quality-rows")
    rules = learn_rules(_with_labels(rows.drop("_q_row"), _labels(labels, label_id, label_col)), **learning)
    return with_features(rows).where(~_failed() & (verdict(rules) <= 0)).select("_q_row.*"), rules


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", **learning) -> tuple[DataFrame, list[Rule]]:
    """Counts and verdict of every document, and the learned rules.

    Words are runs of characters outside U+0020 and U+0009..U+000D. base_failed: under 50 words, or
    more than half of them in three-word windows found twice or more. kept: neither base_failed nor
    rejected by the first learned rule that is met. Labels that are null or of unknown documents teach nothing; without
    labels there is no rule. Null and empty texts have no words and fail the base rule; repeated
    rows are each judged; other columns of docs are not read.

    rule is the number of the first rule that is met, negative if that rule keeps.

    Result: (id_col, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    base_failed, rule, kept), rules. The text is read once.
    """
    counts = stored(text_counts(docs, id_col, text_col), "quality-counts")
    rules = learn_rules(_with_labels(counts, _labels(labels, label_id, label_col)), **learning)
    judged = with_features(counts).withColumns({"base_failed": _failed(), "rule": verdict(rules)})
    return judged.select(F.col("_q_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") <= 0)).alias("kept")), rules
