"""Line dedup, quality rules, sharding, packing and the n-gram join against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import line_dedup, ngram_join, packing, quality_rules, queries, sharding
from cliploom.llm.components import components

LINE = "a line that several texts hold"
ODD = [
    (1, "Alpha beta gamma delta\n  A LINE that several texts hold\t\nshort\nshort", "s0"),
    (2, f"{LINE}\nown words here only\n{LINE}", "s0"),
    (3, None, "s1"),
    (4, "", None),
    (5, " \t\n\x0b\n", "s0"),
    (6, "ÄÖÜ ßéè one two three four\nÄÖÜ zwölf Zeichen", "s2"),
    (7, "äÖÜ zwölf Zeichen\nÄÖÜ ZWÖLF zeichen\nÄÖÜ zwölf Zeichen", "s2"),
    (8, "word " * 4000, "s1"),
    (9, "word " * 4000, "s1"),
    (9, "word " * 4000, "s1"),
    (None, f"{LINE}\nno id", "s1"),
    (10, "\n".join(f"long text line number {i}" for i in range(3000)), "s3"),
    (11, "\n".join(f"long text line number {i}" for i in range(0, 3000, 2)), "s3"),
]
STRIP = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    # columns that clash with inner names, and one that is all null
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"key": F.lit("k"), "n": F.lit(1), "size": F.lit(2), "tokens": F.lit("t"), "h": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def brute_lines(rows):
    key = lambda x: x.strip(STRIP).translate(LOWER)
    first = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                first[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(first.get(key(x), ())) < 2 or min(first[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines_each", [line_dedup.LINES_EACH, 10])
@pytest.mark.parametrize("parts", [1, 7])
def test_lines_are_dropped_as_by_brute_force(odd, lines_each, parts):
    got = line_dedup.dedup_lines(odd.repartition(parts), lines_each=lines_each)
    assert got.columns == [*odd.columns, "_n_lines", "_n_dropped"]
    rows = [(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in got.collect()]
    assert sorted(rows, key=str) == brute_lines(ODD)


def test_filters_pass_few_lines_that_are_not_repeated(spark):
    rows = [(i, "\n".join(f"own line {i} {j}" for j in range(200)) + "\nthe line of all of them") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.suspects(docs, "doc_id", "text", 10, 40, 3).collect()
    repeated = Counter(r._ld_h for r in got).most_common(1)[0]
    assert repeated[1] == 60 and len(got) < 60 + 0.02 * 12_000


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_of_whole_texts(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 100, "text"))
    extra = spark.createDataFrame([(90, "a b c a b c x a b c"), (91, "a a a a"), (92, "x y"), (93, "a b c d a b"), (94, " ".join(f"w{i % 40}" for i in range(300)))], "doc_id long, text string")
    docs = docs.union(extra)
    got = quality_rules.text_counts(docs).collect()
    want = sorted((r.doc_id, *brute_counts(r.text)) for r in docs.where("doc_id IS NOT NULL").collect())
    assert sorted((r._q_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r._q_id is not None) == want


def test_a_rule_is_learned_and_kept_documents_are_clean(spark):
    rows = [(i, " ".join(f"w{i}x{j}{'%%%' if i % 4 == 0 else ''}" for j in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(300)] + [(0, None), (9999, 0)], "doc_id long, quality int")
    judged, rules = quality_rules.judge_quality(docs, labels)
    assert rules and all(len(r.conditions) <= 3 for r in rules)
    assert {r.doc_id for r in judged.where("NOT kept").collect()} == {i for i in range(400) if i % 4 == 0}


def test_rules_of_both_classes_are_ordered(spark):
    # bad: many symbols; but of these, texts of 200 words and more are good, and half of the shorter ones with few symbols are too
    rows, labels = [], []
    for i in range(3000):
        n, marked = (220 if i % 3 == 0 else 60), i % 2 == 0
        rows.append((i, " ".join(f"w{i}x{j}{'%%%' if marked else ''}" for j in range(n))))
        labels.append((i, 0 if marked and (n == 60 or i % 10 == 0) else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "rule": F.lit(None).cast("int")})
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    judged, rules = quality_rules.judge_quality(docs, table)
    assert rules and rules[-1].bad == 1
    got = {r.doc_id: (r.rule, r.kept) for r in judged.collect()}
    assert all(kept == (rule <= 0) for rule, kept in got.values())
    wrong = sum(got[i][1] != bool(q) for i, q in labels)
    assert wrong <= 100  # the tenth of the long ones is noise
    kept, again = quality_rules.keep_good(docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))), table)
    assert kept.columns == docs.columns and again == rules
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i, (_, k) in got.items() if k] + [None])


def test_rules_hold_on_labels_that_were_kept_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    judged, _ = quality_rules.judge_quality(docs, labels.where(~out))
    rows = judged.where("NOT base_failed").join(labels.where(out & F.col("quality").isin(0, 1)), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0)) > 0
    assert n.get((1, False), 0) <= 0.02 * n[1, True]


def test_quality_without_labels_or_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality_rules.judge_quality(odd, labels)
    assert rules == [] and judged.count() == len(ODD)
    assert not any(r.kept for r in judged.where("n_words < 50").collect())
    assert quality_rules.judge_quality(empty, labels)[0].count() == 0


def brute_capacity(sizes, shards):
    low, high = -(-sum(sizes) // shards), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > mid:
                used = shards + 1
                break
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(spark, seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    if seed % 2:  # keys that share their first bits
        keys = (keys >> 40) + (1 << 61)
    sizes = rng.integers(1, 50, 300) ** rng.integers(1, 4)
    if seed == 5:
        sizes[7] = sizes.sum()
    table = dict(zip(keys.tolist(), sizes.tolist()))
    df = spark.createDataFrame(list(table.items()), "key long, bytes long")
    capacity, last = sharding.minimax_cuts(df, 8)
    ordered = [table[k] for k in sorted(table)]
    assert capacity == brute_capacity(ordered, 8)
    shards = Counter()
    for k, s in table.items():
        shards[sum(k > x for x in last)] += s
    assert max(shards.values()) == capacity


def test_shards_hold_whole_groups_and_gapless_slots(odd, empty):
    rows = sharding.shard_documents(odd, 4, rows_per_bucket=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ODD)
    text = dict((i, t or "") for i, t, _ in ODD)
    where = defaultdict(set)
    for r in rows:
        t = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        where[t].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(empty, 4).count() == 0


def whole_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("targets, flatten", [(None, None), ({"s0": 3.0, "s1": 1.0}, None), (None, 0.5)])
def test_packing_holds_every_token_once(odd, targets, flatten):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(odd, path, length=64, targets=targets, flatten=flatten, rows_per_bucket=2).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    texts = defaultdict(list)
    for i, t, _ in ODD:
        texts[i].append(t)
    for i, own in texts.items():
        ids = whole_ids(path, own[0])
        got = Counter()
        for r in by_doc[i]:
            part = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert part == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
            got.update(range(r.start, r.start + r.length))
        assert got == Counter({k: len(own) for k in range(len(ids))})
    for k, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    full = [k for k in by_seq if sum(r.length for r in by_seq[k]) == 64]
    assert len(by_seq) - len(full) <= (1 if targets is None and flatten is None else 2)


def test_every_window_has_the_mixture_of_the_whole():
    totals = {1: 700_000, 2: 200_001, 3: 99_999, 4: 321}
    phase = packing.plan(totals, None, 4096)[0]
    seen = Counter()
    for q, n in totals.items():
        for w, offset, low, high in phase.pieces(q, 0, n):
            seen[w] += high - low
            if w < phase.count - 1:
                assert abs((high - low) - 4096 * n / sum(totals.values())) < 2
        assert sum(h - l for _, _, l, h in phase.pieces(q, 0, n)) == n
    assert all(v == 4096 for w, v in seen.items() if w < phase.count - 1)


def test_windows_keep_to_targets_while_queues_last():
    totals, targets = {1: 500_000, 2: 100_000, 3: 5_000}, {1: 1, 2: 1, 3: 2}
    phases = packing.plan(totals, targets, 4096)
    first = phases[0]
    assert first.count == (5_000 - 2) * 4 // (2 * 4096)
    for q, n in totals.items():
        got = sorted((low, high) for p in phases for _, _, low, high in p.pieces(q, 0, n))
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("name,by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_tokenizers(name, by_word):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    rng = random.Random(3)
    letters = "aB cD\n\t.,!?'é\u0301  <|>12ßİıǅ日本🙂K\x1c\x85½²ªſ"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)] + ["x" * 3000, "don't. it's 'll.'s", "ab.,cd..e", None, " ", "a.", ".b"]
    tokens = packing.WordTokens(path)
    assert tokens.by_word == by_word
    for part in (texts, texts[::-1], ["A b<|endoftext|>C.", "plain. Text"]):
        ids, ends = tokens.encode(pa.array(part).slice(1))
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in part[1:]], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_packing_of_nothing(empty):
    assert packing.pack(empty, queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def brute_groups(rows, k=5, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids = [i for i in sets if i is not None]
    low = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    again = True
    return {i: (len(sets[i]), low.get(i)) for i in sets}


def near_copies(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    rows, passage = [], [f"p{i}" for i in range(60)]
    for i in range(60):
        base = list(rng.choice(vocabulary, 120))
        if i % 3 == 0:
            base[20:80] = passage
        rows.append((i * 20, " ".join(base)))
        for j in range(1, 1 + int(rng.integers(0, 9))):
            words = list(base)
            for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
                words[at] = f"e{i}-{j}-{at}"
            rows.append((i * 20 + j, " ".join(words).upper() if j % 4 == 0 else " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_groups_as_by_brute_force(spark, seed):
    rows = near_copies(seed)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_groups_of_odd_texts(spark, odd, empty):
    got = ngram_join.jaccard_groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(ODD)
    assert ngram_join.jaccard_groups(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 199, 199: 199}


def test_line_query_hashes_the_kept_text(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute_lines(rows)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op1_line_dedup(spark, sf_dir).collect()}
    assert got == want
