"""URL filters: rules by host and path, host word segmentation, and naive Bayes over the words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Longest word of the lexicon, and first letters of words that one row of a run looks up (a host label has 63 characters at most).
LONGEST, WINDOW = 20, 64
#: Tokens' worth by which a word's chances in both classes are drawn together.
PULL = 10.0
#: Words that mark a url as unwanted when the classifier's examples are gathered; a parameter of judge_urls().
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "viagra")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, action): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path), and its action; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda values: reduce(lambda c, x: c.when(x[0], F.lit(x[1])), zip(fits, values, strict=True), F.when(F.lit(False), F.lit(None).cast("string")))
    return pick([h + p for h, p, _ in ordered]), pick([a for *_, a in ordered])


def tokens(text: Column) -> Column:
    """Runs of letters, A-Z lower-cased, and runs of digits, which all count as '0'."""
    words = F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
    return F.filter(F.transform(words, lambda w: F.when(w.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(w)), lambda w: w != "")


def letter_runs(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"\P{L}+"), lambda w: w != "")


def word_counts(pages: DataFrame, html_col: str | None, unwanted: tuple[str, ...]) -> DataFrame:
    """(word, n, parts): letter runs of up to LONGEST characters. n counts texts, paths, hosts' parts and the unwanted words.

    A page says nothing about the runs of its own host, or one page that names its site would make
    'casinowin' a word. Of hosts only last labels ('com') and labels that marks cut count; a part of
    these that holds an unwanted word and more counts only in other runs (parts). Single letters are
    left to the cost of unknown words.
    """
    text = F.col("path") if html_col is None else F.concat_ws(" ", "path", F.regexp_replace(F.col("_uf_html"), r"(?s)<[^>]*>|&#?\w+;", " "))
    # the host's runs are found before its page is cut into rows, not again for each of them
    words = pages.withColumn("own", letter_runs(F.col("host"))).select("own", F.explode(F.split(F.translate(text, UPPER, LOWER), r"\P{L}+")).alias("word"))
    words = words.where(F.length("word").between(2, LONGEST) & ~F.array_contains("own", F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))
    labels, none = F.split("host", r"\."), F.lit(0).cast("long")
    hosts = pages.groupBy("host").agg(F.count("*").alias("k"))
    ends = hosts.where(F.size(labels) > 1).select(F.element_at(labels, -1).alias("word"), F.col("k").alias("n"), none.alias("parts"))
    cut = F.flatten(F.filter(F.transform(labels, letter_runs), lambda x: F.size(x) > 1))
    cut = hosts.select("k", F.explode(cut).alias("word"))
    more = reduce(lambda c, w: c | (F.col("word").contains(w) & (F.col("word") != w)), unwanted, F.lit(False))
    cut = cut.select("word", F.when(more, 0).otherwise(F.col("k")).alias("n"), F.when(more, F.col("k")).otherwise(0).alias("parts"))
    named = ends.unionByName(cut).where(F.length("word").between(2, LONGEST))
    seeds = pages.sparkSession.createDataFrame([(w, 1) for w in unwanted] or [("", 0)], "word string, n long")
    rows = words.unionByName(seeds).withColumn("parts", none).unionByName(named)
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("parts").alias("parts"))


def segment(run: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable words of a run of letters: Viterbi over unigrams; unknown words cost more with each letter."""
    best = [0.0] + [-math.inf] * len(run)
    back = [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for begin in range(max(0, end - LONGEST), end):
            n = known.get(run[begin:end], 0)
            p = math.log(n / total) if n else math.log(0.1 / total) - 2.3 * (end - begin)
            if best[begin] + p > best[end]:
                best[end], back[end] = best[begin] + p, begin
    out, at = [], len(run)
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def host_words(hosts: DataFrame, lexicon: DataFrame, total: int) -> DataFrame:
    """(host, words): each distinct host's runs of letters and of digits, runs of letters cut into words.

    Every run looks up only its own substrings, window by window, so the lexicon is joined and never
    sent anywhere. Long runs are joined by their hash.
    """
    runs = hosts.select("host", F.posexplode(tokens(F.col("host"))).alias("at", "run"))
    each = runs.select("run").distinct()
    size, i = F.length("run"), F.col("from")
    key = F.when(size > WINDOW, F.sha2("run", 256)).otherwise(F.col("run"))
    pieces = each.where("run <> '0'").select("run", F.explode(F.sequence(F.lit(1), size, F.lit(WINDOW))).alias("from"))
    pieces = pieces.select(key.alias("key"), F.substring(F.col("run"), i, F.lit(WINDOW + LONGEST - 1)).alias("piece"))
    size = F.length("piece")
    subs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(WINDOW), size)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - i + 1)), lambda n: F.substring(F.col("piece"), i, n)))))
    found = pieces.select("key", F.explode(subs).alias("word")).join(lexicon, "word")
    found = found.withColumn("n", F.col("n") + F.when(F.col("word") == F.col("key"), 0).otherwise(F.col("parts"))).where("n > 0")
    known = found.groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("w")).select("key", F.col("w.word").alias("w"), F.col("w.n").alias("n"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"run": f["run"], "words": [[r] if w is None else segment(r, dict(zip(w, n, strict=True)), total) for r, w, n in zip(f["run"], f["w"], f["n"], strict=True)]})

    done = each.withColumn("key", key).join(known, "key", "left").drop("key").mapInPandas(cut, "run string, words array<string>")
    return runs.join(done, "run").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))


def word_odds(examples: DataFrame) -> tuple[DataFrame, bool]:
    """(word, w) of examples (words, bad, pages): log odds of block to allow, and whether there is an example of block at all."""
    n = F.when(F.col("bad"), F.col("pages")).otherwise(0)
    seen = examples.select(F.explode("words").alias("word"), n.alias("b"), (F.col("pages") - n).alias("a")).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    seen = stored(seen, "url-evidence")
    sums = seen.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    pull = F.lit(PULL) * (F.col("a") + F.col("b")) / max(1, sums.a + sums.b)
    odds = F.log((F.col("b") + pull) / (sums.b + PULL)) - F.log((F.col("a") + pull) / (sums.a + PULL))
    return seen.select("word", odds.alias("w")), sums.b > 0


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, unwanted: tuple[str, ...] = UNWANTED, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", verdicts: DataFrame | None = None) -> DataFrame:
    """Host, path, the rule that fits and the verdict of every url.

    Where no rule fits, multinomial naive Bayes over segmented host words and path tokens decides, with
    equal priors, so that a url is blocked only for its words. With `verdicts` (url, blocked) it learns
    from those that are given: of one host and path all count as blocked if one is. Without, the given urls themselves are its
    examples: those with an unwanted word are examples of block; those without, unless a rule blocks
    them, of allow. Without an example of block, all are allowed. Each word's chance is its share in a
    class, drawn by PULL tokens' worth towards its share in both, so that a rare word speaks for neither. Words are segmented
    with the unigram counts of the pages' texts, paths and hosts' parts, a host's own pages left out.

    Result: id_col, host, path, rule, verdict, score (log odds of block; null where a rule decides).
    A null url, or one without ://, has an empty host and path and is allowed; repeated rows are each
    judged; runs end where letters meet digits; an empty table gives no rows.
    """
    host, path = parts(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("_uf_id"), host.alias("host"), path.alias("path"), *([] if html_col is None else [F.col(html_col).alias("_uf_html")]))
    rule, action = ruling(F.col("host"), F.col("path"), rules)
    urls = stored(base.groupBy("host", "path").agg(F.count("*").alias("pages")).withColumns({"rule": rule, "action": action}), "url-distinct")
    lexicon = stored(word_counts(base, html_col, unwanted), "url-lexicon")
    total = lexicon.agg(F.sum(F.col("n") + F.col("parts"))).first()[0] or 1
    hosts = stored(host_words(urls.select("host").distinct(), lexicon, total), "url-hosts")
    path_words = F.filter(tokens(F.col("path")), lambda w: w != "0")
    words = urls.join(hosts, "host", "left").withColumn("words", F.concat(F.coalesce("words", F.array().cast("array<string>")), path_words))
    if verdicts is None:
        bad = F.arrays_overlap("words", F.array(*[F.lit(w) for w in unwanted]).cast("array<string>"))
        words = words.withColumn("bad", bad).withColumn("taught", F.col("bad") | F.coalesce(F.col("action") != "block", F.lit(True)))
    else:
        host, path = parts(F.col("url").cast("string"))
        given = verdicts.where(F.col("blocked").isNotNull()).groupBy(host.alias("host"), path.alias("path")).agg(F.bool_or("blocked").alias("bad"))
        words = words.join(given, ["host", "path"], "left").withColumn("taught", F.col("bad").isNotNull())
    words = stored(words, "url-words")
    weights, learned = word_odds(words.where("taught"))
    weights = stored(weights, "url-weights")
    odds = words.where("rule IS NULL").select("host", "path", F.explode("words").alias("word")).join(weights, "word").groupBy("host", "path").agg(F.sum("w").alias("score"))
    judged = urls.join(odds, ["host", "path"], "left").withColumn("score", F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))))
    block = (F.col("score") > 0) if learned else F.lit(False)
    verdict = F.coalesce("action", F.when(block, "block").otherwise("allow"))
    judged = stored(judged.select("host", "path", "rule", verdict.alias("verdict"), "score"), "url-verdicts")
    return base.select(F.col("_uf_id").alias(id_col), "host", "path").join(judged, ["host", "path"]).select(id_col, "host", "path", "rule", "verdict", "score")
