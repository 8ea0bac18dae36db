"""Operators that SQL can't express, invariants and golden cases."""

import difflib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom import jobs
from cliploom.operators import captions, identity, metrics, mining, quota, reconcile, timeline
from cliploom.sources import media


# --- captions ---------------------------------------------------------------


def test_names_and_quotes(spark):
    rows = [(1, "a 'mo-mo' and it's AUNT RUTH, ruth; `x`"), (2, ""), (3, None), (4, "ÉLODIE met élodie, not xélodie or ruthless; STRAßE")]
    names = spark.createDataFrame([("ruth",), ("aunt ruth",), ("mo-mo",), ("élodie",), ("",), (None,)], "name string")
    got = {r.i: r.caption for r in captions.normalize_caption(spark.createDataFrame(rows, "i int, caption string"), names).collect()}
    assert got[1] == "a Mo-mo and it's Aunt Ruth, Ruth; x" and got[2] == "" and got[3] is None
    assert got[4] == "Élodie met Élodie, not xélodie or ruthless; STRAßE"
    assert captions.normalize_caption(spark.createDataFrame(rows, "i int, caption string"), names.limit(0)).where("i = 4").first().caption == rows[3][1]


def test_captions_are_normalised_as_by_brute_force(spark, sf_dir):
    names = {r.name for r in jobs.Tables(spark, sf_dir).b_names.collect() if r.name}

    def brute(t):
        if t is None:
            return None
        t = re.sub(captions.QUOTES, "", t)
        for n in sorted(names, key=lambda n: (-len(n), n)):
            t = re.sub(rf"\b{re.escape(n)}\b", lambda _, n=n: " ".join(w[:1].upper() + w[1:] for w in n.split(" ") if w), t, flags=re.IGNORECASE)
        return t

    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.caption for r in jobs.QUERIES["normalize_caption"](spark, sf_dir).collect()}
    assert got == want


def test_short_replies(spark):
    rows = [(1, "None"), (2, "No match, the"), (3, "**The** [le]"), (4, None), (5, "<think>the</think> le. <think> the"), (6, " ")]
    df = spark.createDataFrame([(i, f"n{i}", r) for i, r in rows], "i int, name string, reply string")
    table = lambda *names: spark.createDataFrame(list(enumerate(names)), "ref_order int, name string")
    cast = {r.i: r.cast_names for r in captions.parse_cast_reply(df, table("the", "le", None, "")).collect()}
    assert cast == {1: [], 2: [], 3: ["the", "le"], 4: [], 5: ["le"], 6: []}
    place = {r.i: r.location for r in captions.parse_location_reply(df, table("le", "the")).collect()}
    assert place == {1: None, 2: None, 3: "le", 4: None, 5: "le", 6: None}
    clean = {r.i: r.clean for r in captions.clean_reply(df, "tok").collect()}
    assert clean == {1: "None", 2: "No match, the", 3: "**The** [le]", 4: "tok n4", 5: "le.", 6: "tok n6"}


def test_names_of_a_large_table(spark, monkeypatch):
    """100,000 names, in one automaton and in several, with the plan of a few; equal names but for case are one."""
    from cliploom.functions import names as N

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé-' 1") for _ in range(rng.randint(2, 9)))
    many = [w for w in (word() for _ in range(100_000)) if w.strip()] + ["Ann", "Bob Lee", "ann", "ANN"]
    texts = ["Ann, bob lee", "annual ann-bob leeds", "", None, "x1y ann1 1ann (ANN)"] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "found int, reply string")
    table = spark.createDataFrame(list(enumerate(many)), "ref_order int, name string")

    spelled = {}
    for n in many:
        spelled[n.lower()] = n  # at the first place, spelled as the last

    def brute(t):
        # what touches a name decides; all substrings up to the longest name are looked up
        low = (t or "").translate({ord(c): " " for c in "[]{}\"'"}).strip(" ").lower()
        part = lambda c: c.isascii() and c.isalnum()
        hits = {low[i:j] for i in range(len(low)) for j in range(i + 1, min(len(low), i + 9) + 1) if low[i:j] in spelled and not (i and part(low[i - 1])) and not (j < len(low) and part(low[j]))}
        return [n for k, n in spelled.items() if k in hits]

    for chars in (N.BLOCK_CHARS, 100_000):
        monkeypatch.setattr(N, "BLOCK_CHARS", chars)
        out = captions.parse_cast_reply(df, table)
        assert out.columns == ["found", "reply", "cast_names"]
        got = {r.found: r.cast_names for r in out.collect()}
        assert got == {i: brute(t) for i, t in enumerate(texts)}
        assert got[0] == ["ANN", "Bob Lee"] and got[4] == ["ANN"]
    size = lambda t: len(captions.parse_cast_reply(df, t)._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(N, "BLOCK_CHARS", 16_000_000)
    assert size(table) == size(table.where("ref_order < 3"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAbsſσςΣKkiıİßẞ -'x", min_size=1, max_size=4), max_size=8), st.text("aAbBsSſσςΣKKkiıİIßẞ -'xX", max_size=40))
def test_recasing_equals_one_substitution_after_another(names, text):
    from cliploom.functions.names import Recase

    pairs = [(n, " ".join(w[:1].upper() + w[1:] for w in n.split(" ") if w)) for n in sorted(set(names), key=lambda n: (-len(n), n))]
    want = text
    for n, shown in pairs:
        want = re.sub(rf"\b{re.escape(n)}\b", lambda _, shown=shown: shown, want, flags=re.IGNORECASE)
    assert Recase(pairs)(text) == want


def test_a_location_may_end_with_a_dot(spark):
    names = spark.createDataFrame([(1, "st."), (2, "the attic "), (3, "..hall")], "ref_order int, name string")
    rows = [(1, "Main St."), (2, "in the attic ."), (3, " ..Hall of mirrors"), (4, "None."), (5, "main st"), (6, "St. No match. ")]
    got = {r.i: r.location for r in captions.parse_location_reply(spark.createDataFrame(rows, "i int, reply string"), names).collect()}
    assert got == {1: "st.", 2: "the attic ", 3: "..hall", 4: None, 5: None, 6: None}


def test_transcripts_without_captions(spark):
    rows = [(1, None, "hi"), (2, "", "hi"), (3, " A shot", " hi "), (4, "A shot", ""), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, caption string, transcript string").withColumn("transcript_segments", F.lit(None).cast("array<string>"))
    got = {r.i: (r.caption, r.caption_original) for r in captions.merge_transcript(df).collect()}
    assert got == {1: ('Dialogue: "hi"', None), 2: ('Dialogue: "hi"', ""), 3: (' A shot Dialogue: " hi "', " A shot"), 4: ("A shot", None), 5: (None, None)}


def test_speaker_names(spark):
    rows = [("aunt-ruth",), ("mo-mo",), ("unknown",), ("",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "s string").select(captions.speaker_display(F.col("s")).alias("x")).collect()]
    assert got == ["Aunt Ruth", "Mo Mo", "Someone", "Someone", "Someone"]


# --- timelines --------------------------------------------------------------


def brute_cuts(centers, targets, total):
    if len(centers) < len(targets):
        return None
    return min(sum((c / total - t) ** 2 for c, t in zip(pick, targets)) for pick in itertools.combinations(centers, len(targets)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9, unique=True), st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_cuts_are_the_nearest_silences(centers, targets):
    centers, targets = sorted(centers), sorted(targets)
    got = timeline.best_cuts(centers, targets, 1000.0)
    best = brute_cuts(centers, targets, 1000.0)
    if best is None:
        assert got == [int(1000 * t) for t in targets]
    else:
        assert got == sorted(got) and len(set(got)) == len(got)
        assert math.isclose(sum((c / 1000 - t) ** 2 for c, t in zip(got, targets)), best, abs_tol=1e-12)


def test_words_take_the_lines_of_their_script():
    lines = ["The quick brown fox", "", "jumps over", "the lazy dog"]
    words = ["the", "Quick,", "uh", "fox", "jumps", "over", "the", "crazy", "dog"]
    got, ratio = timeline.align_lines(words, lines)
    assert got == [0, 0, 0, 0, 2, 2, 3, 3, 3] and ratio == 7 / 9
    script = [w for x in lines for w in re.findall("[a-z0-9]+", x.lower())]
    blocks = difflib.SequenceMatcher(None, [re.sub("[^a-z0-9]", "", w.lower()) for w in words], script, autojunk=False).get_matching_blocks()
    assert sum(b.size for b in blocks) == 7


@pytest.mark.parametrize("total", [0.5, 60.0])
def test_rescaled_segments_cover_everything(spark, total):
    rows = [(1, 0, 0.0, 3.0), (1, 1, 3.0, 3.0), (1, 2, 5.0, 6.5), (2, 0, 0.0, 0.0), (2, 1, 0.0, 0.0)]
    got = timeline.timeline_rescale(spark.createDataFrame(rows, "clip_id int, line int, t_start double, t_end double"), F.lit(total)).orderBy("clip_id", "line").collect()
    for clip in (1, 2):
        own = [r for r in got if r.clip_id == clip]
        assert own[0].new_start == 0 and own[-1].new_end == total
        assert all(a.new_end == b.new_start for a, b in zip(own, own[1:]))
    assert math.isclose(got[0].new_end, total * 3 / 4.5) and math.isclose(got[3].new_end, total / 2)


def relay(spark, segments):
    rows = [(i, a, b, s, e, 25.0, 12) for i, (a, b, s, e) in enumerate(segments)]
    return spark.createDataFrame(rows, "line int, start_token int, end_token int, t_start double, t_end double, fps double, latent_frames int")


def test_routing_prefers_the_near_segment(spark):
    got = {(r.line, r.frame): r.weight for r in timeline.route_segments(relay(spark, [(4, 12, 0.0, 1.92), (12, 20, 1.92, 3.84)])).collect()}
    assert -got[0, 0] < -got[1, 0] and -got[1, 0] > 1.0
    assert -got[1, 9] < -got[0, 9]
    assert timeline.route_segments(relay(spark, [(4, 4, 0.0, 1.0), (4, 8, 2.0, 2.0)])).count() == 0
    audio = {(r.line, r.frame): r.weight for r in timeline.route_segments(relay(spark, [(4, 12, 0.0, 1.92), (12, 20, 1.92, 3.84)]).withColumn("latent_frames", F.lit(100)), stream="audio").collect()}
    assert -audio[0, 0] < -audio[1, 0]


# --- mining -----------------------------------------------------------------


def test_chunks_of_a_faster_source_are_longer(spark):
    videos = spark.createDataFrame([(1, 30.0, 200)], "video_id int, fps double, total_frames int")
    got = mining.chunk_grid(videos, 49, 24.0).orderBy("chunk_idx").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 64), (64, 128), (128, 192)]


def brute_extend(chunk, hits, unknowns, n=4, required=0.25, unknown=0.75):
    start, end, first, last, best = chunk
    size = end - start

    def seen(a):
        at = [a + i * size // n for i in range(n)]
        return sum(p in hits for p in at), sum(p in unknowns for p in at)

    snap = lambda f: int(size * f) // 8 * 8
    if abs(best) < snap(2.0) or seen(start + best)[0] == n or best == 0:
        return []
    before, out = seen(start + best)[0], []
    for f in mining.FURTHER:
        shift = snap(f) * (1 if best > 0 else -1)
        if start + shift < first or end + shift > last:
            break
        h, u = seen(start + shift)
        if h < max(1, round(required * n)) or u > round(unknown * n) or h < before:
            break
        out.append((shift, h))
        before = h
        if h == n:
            break
    return out


def test_search_goes_on_as_by_brute_force(spark):
    rng = random.Random(4)
    chunks, frames, want = [], [], {}
    for v in range(60):
        hits = {f for f in range(400) if rng.random() < 0.4 + 0.3 * math.sin(f / 40)}
        unknowns = {f for f in range(400) if rng.random() < 0.1}
        best = rng.choice([-32, 32, 16, -24])
        chunks.append((v, 0, 160 + best, 176 + best, 0, 400, best))
        frames += [(v, f, f in hits, f in unknowns) for f in range(400)]
        h = sum(160 + best + i * 4 in hits for i in range(4))
        chunks[-1] += (h, 4)
        want[v] = brute_extend((160, 176, 0, 400, best), hits, unknowns)
    best = spark.createDataFrame(chunks, "video_id int, chunk_idx int, start_frame int, end_frame int, first_frame int, last_frame int, shift int, hits long, n_pos long").withColumn("unknowns", F.lit(0).cast("long"))
    matches = spark.createDataFrame(frames, "video_id int, frame int, hit boolean, unknown boolean")
    got = {v: [] for v in want}
    for r in mining.shift_extend(best, matches, required=0.25, unknown=0.75).orderBy("search_order").collect():
        got[r.video_id].append((r.shift, r.hits))
    assert got == want and any(want.values())


# --- quotas -----------------------------------------------------------------

NAMES = "abcd"
sets = st.lists(st.sampled_from(NAMES), max_size=3, unique=True).map(lambda x: tuple(sorted(x)))


def brute_removals(entries, quotas):
    """Clip by clip, in the order of the manifest; identities without a quota are never over it."""
    counts = {c: sum(c in s for s in entries) for c in NAMES}
    over = {c for c in quotas if counts.get(c, 0) > quotas[c]}
    able = [(max(counts[c] - quotas[c] for c in s), i, s) for i, s in enumerate(entries) if s and set(s) <= over]
    out = []
    for _, i, s in sorted(able, key=lambda x: -x[0]):
        if all(counts[c] > quotas[c] for c in s):
            out.append(i)
            for c in s:
                counts[c] -= 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(sets, max_size=40), st.dictionaries(st.sampled_from(NAMES), st.integers(0, 12)))
def test_first_clips_of_a_signature_are_enough_to_rebalance(entries, quotas):
    counts = {c: sum(c in s for s in entries) for c in NAMES}
    some, seen = [], {}
    for i, s in enumerate(entries):
        seen[s] = seen.get(s, 0) + 1
        if s and all(c in quotas for c in s) and seen[s] <= min(counts[c] - quotas[c] for c in s):
            some.append((i, s))
    assert quota.removals(some, counts, quotas) == brute_removals(entries, quotas)


def test_rebalancing_as_by_brute_force(spark):
    rng = random.Random(8)
    entries = [tuple(sorted(rng.sample(NAMES, rng.randint(0, 3)))) for _ in range(300)] + [("z",)] * 5
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(entries)], "clip_id long, signature array<string>").repartition(5)
    for quotas in ({"a": 90, "b": 100, "c": 80, "d": 120}, {"a": 20, "c": 0}, {"q": 3}):
        limits = spark.createDataFrame(list(quotas.items()), "identity string, quota long")
        assert sorted(r.clip_id for r in quota.rebalance_over_quota(df, limits).collect()) == sorted(brute_removals(entries, quotas))
    ties = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a"]), (4, ["a"])], "clip_id long, signature array<string>")
    assert sorted(r.clip_id for r in quota.rebalance_over_quota(ties, spark.createDataFrame([("a", 2), ("b", 0)], "identity string, quota long")).collect()) == [1, 2]


def brute_intake(pool, old, quotas):
    """Clip by clip: (accepted, clip that leaves); old clips are 0, 1, ..., the pool's come after them."""
    have = list(enumerate(old))
    counts = {c: sum(c in s for s in old) for c in NAMES}
    out = {}
    for i, s in enumerate(pool, len(old)):
        if all(counts[c] >= quotas[c] for c in NAMES):
            break
        full = {c for c in s if counts[c] >= quotas[c]}
        if full == set(s):
            continue
        leaves = None
        if full:
            fit = sorted((o for o in have if o[1] and set(o[1]) < set(s) and full <= set(o[1])), key=lambda o: len(o[1]))
            if not fit:
                continue
            leaves = fit[0]
            have.remove(leaves)
            for c in leaves[1]:
                counts[c] -= 1
        have.append((i, s))
        for c in s:
            counts[c] += 1
        out[i] = leaves and leaves[0]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(sets.filter(len), max_size=60), st.lists(sets.filter(len), max_size=12), st.lists(st.integers(0, 4), min_size=4, max_size=4))
def test_first_clips_of_a_signature_decide_on_intake(pool, old, q):
    quotas = dict(zip(NAMES, q))
    most = sum(q)
    existing, seen, some = {}, {}, []
    for i, s in enumerate(old):
        n, ids = existing.setdefault(s, (0, []))
        existing[s] = (n + 1, [*ids, i][: most + 1])
    for i, s in enumerate(pool, len(old)):
        seen[s] = seen.get(s, 0) + 1
        if seen[s] <= most + 1:
            some.append((i, s))
    assert {i: leaves for i, ok, leaves in quota.intake(some, existing, quotas) if ok} == brute_intake(pool, old, quotas)


def brute_walk(candidates, existing, quotas):
    """intake() with a scan of all signatures for each clip."""
    from collections import Counter, deque

    queues = {s: deque((0, i) for i in ids) for s, (_, ids) in existing.items()}
    counts = Counter({c: 0 for c in quotas})
    for s, (n, _) in existing.items():
        counts.update({c: n for c in s})
    out = []
    for turn, (clip, s) in enumerate(candidates):
        if all(counts[c] >= q for c, q in quotas.items()):
            break
        full = {c for c in s if counts[c] >= quotas.get(c, 0)}
        leaves = None
        if s and len(full) == len(s):
            out.append((clip, False, None))
            continue
        if full:
            fit = [o for o in queues if queues[o] and set(o) < set(s) and full <= set(o)]
            if not fit:
                out.append((clip, False, None))
                continue
            swap = min(fit, key=lambda o: (len(o), queues[o][0]))
            leaves = queues[swap].popleft()[-1]
            counts.subtract(swap)
        if s:
            queues.setdefault(tuple(sorted(s)), deque()).append((1, turn, clip))
            counts.update(s)
        out.append((clip, True, leaves))
    return out


def test_intake_by_trie_equals_a_scan():
    rng = random.Random(6)
    for _ in range(300):
        cast = "abcdefghij"[: rng.randint(2, 10)]
        sets = [tuple(sorted(rng.sample(cast, rng.randint(0, min(6, len(cast)))))) for _ in range(rng.randint(1, 60))]
        held: dict = {}
        for i in range(rng.randint(0, 60)):
            s = tuple(sorted(rng.sample(cast, rng.randint(1, min(4, len(cast))))))
            n, ids = held.get(s, (0, []))
            held[s] = (n + 1, [*ids, i])
        quotas = {c: rng.randint(0, 12) for c in cast if rng.random() < 0.9}
        new = list(enumerate(sets, 1000))
        assert quota.intake(new, held, quotas) == brute_walk(new, held, quotas)


def test_intake_of_many_signatures_is_fast():
    import time

    rng = random.Random(7)
    cast = [f"p{i}" for i in range(3000)]
    draw = lambda k: tuple(sorted({cast[int(3000 * rng.random() ** 3)] for _ in range(k)}))  # noqa: E731  a few are in most
    held: dict = {}
    for i in range(100_000):
        s = draw(rng.randint(1, 4))
        n, ids = held.get(s, (0, []))
        held[s] = (n + 1, [*ids, i])
    new = [(200_000 + i, draw(rng.randint(1, 6))) for i in range(100_000)]
    began = time.perf_counter()
    got = quota.intake(new, held, {c: 60 for c in cast})
    assert time.perf_counter() - began < 30 and sum(x is not None for _, _, x in got) > 100


def test_swaps_of_large_signatures(spark, monkeypatch):
    rng = random.Random(9)
    cast = "abcdefghijkl"
    sig = lambda k: sorted(rng.sample(cast, k))
    new = [(i, sig(rng.randint(0, 9))) for i in range(200)]
    old = [(1000 + i, sig(rng.randint(0, 5))) for i in range(150)]
    met = set("abdgh")
    q = spark.createDataFrame([(c, c in met) for c in cast], "identity string, met boolean")

    def brute(s):
        held = set(s) & met
        fit = sorted((len(o), o) for _, o in old if o and held and set(o) < set(s) and held <= set(o))
        return fit[0][1] if fit else None

    tables = [spark.createDataFrame(x, "clip_id int, signature array<string>") for x in (new, old)]
    for free in (10, 2):
        monkeypatch.setattr(quota, "FREE", free)
        got = {r.clip_id: r.swap for r in quota.swap_candidates(*tables, q).collect()}
        assert got == {i: brute(s) for i, s in new} and any(got.values())


def test_intake_marks_all_candidates(spark):
    new = spark.createDataFrame([(i, i, s) for i, s in enumerate([["a"], ["a"], ["a"], [], ["a", "b"], ["b"], ["b"]])], "clip_id long, pos long, signature array<string>")
    old = spark.createDataFrame([(100, ["a"])], "clip_id long, signature array<string>")
    q = spark.createDataFrame([("a", 2), ("b", 2)], "identity string, quota long")
    got = {r.clip_id: (r.accepted, r.swapped) for r in quota.quota_intake(new, old, q, 4).collect()}
    assert got == {0: (True, None), 1: (False, None), 2: (False, None), 3: (True, None), 4: (True, 100), 5: (True, None), 6: (False, None)}


def test_a_walk_that_is_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(quota, "WALK_ROWS", 3)
    new = spark.createDataFrame([(i, i, ["a"]) for i in range(5)], "clip_id long, pos long, signature array<string>")
    with pytest.raises(ValueError):
        quota.quota_intake(new, new.limit(0), spark.createDataFrame([("a", 9)], "identity string, quota long"), 9)


# --- telemetry --------------------------------------------------------------


def brute_events(losses, threshold, detect, stop, alpha, warmup):
    ema = low = None
    since, watching, boosted, out = 0, False, False, []
    for step, loss in enumerate(losses, 1):
        ema = loss if ema is None else (1 - alpha) * ema + alpha * loss
        if step < warmup:
            continue
        low = ema if low is None else min(low, ema)
        over = (ema - low) / low * 100 if low > 0 else 0.0
        if not watching:
            if over > threshold:
                since = since or step
                if step - since >= detect:
                    watching = True
                    out.append((step, "monitor"))
            else:
                since = 0
        if watching:
            if over <= threshold:
                out.append((step, "recovered"))
                watching, boosted, since = False, False, 0
            elif step - since >= stop:
                if boosted:
                    out.append((step, "stop"))
                    break
                boosted, since = True, step
                out.append((step, "lr_reset"))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0.01, 5), max_size=120), st.integers(1, 7))
def test_events_in_any_parts(losses, part):
    limits = {"threshold": 5.0, "detect": 3, "stop": 6, "alpha": 0.3, "warmup": 5}
    want = brute_events(losses, **limits)
    watch, got = metrics.Watch(), []
    for at in range(0, len(losses), part):
        piece = losses[at : at + part]
        watch = metrics.Watch(*watch.as_tuple())
        got += [(s, e) for s, e, _ in watch.feed(list(range(at + 1, at + 1 + len(piece))), piece, **limits)]
    assert got == want


def test_averages(spark):
    rows = [(1, i + 1, float(x)) for i, x in enumerate([4, 2, 8, 8, 1])]
    got = metrics.loss_ema(spark.createDataFrame(rows, "run_id long, step int, loss double"), 0.5).orderBy("step").collect()
    assert [r.ema_after for r in got] == [4.0, 3.0, 5.5, 6.75, 3.875]
    assert [r.ema_before for r in got] == [None, 4.0, 3.0, 5.5, 6.75]
    w = metrics.chart_weight(5)
    assert math.isclose(got[1].chart_ema, w * 4 + (1 - w) * 2)


def test_trend_of_the_smoothed_loss(spark):
    rows = [(1, i, 100.0 - i) for i in range(1, 81)] + [(2, i, 1.0) for i in range(1, 20)]
    ema = metrics.loss_ema(spark.createDataFrame(rows, "run_id long, step int, loss double"))
    got = metrics.loss_trend(ema).collect()
    smooth = {r.step: r.chart_ema for r in ema.where("run_id = 1").collect()}
    x = np.arange(21, 81)
    assert [r.run_id for r in got] == [1] and got[0].direction == "down"
    assert math.isclose(got[0].slope, np.polyfit(x, [smooth[i] for i in x], 1)[0], rel_tol=1e-9)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_divergence_of_long_runs_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "BLOCK", block)
    rng = random.Random(4)
    loss = {0: [1.0] * 60 + [9.0] * 900 + [0.5] * 700, 1: [1.0] * 60 + [9.0] * 380 + [0.5] * 500 + [9.0] * 800, None: [2.0] * 30}
    loss |= {i: [rng.choice([0.5, 1.0, 3.0]) if rng.random() < 0.1 else 1.0 + 2 * (s // 90 % 2) for s in range(700)] for i in (2, 3, 4)}
    steps = {i: list(range(len(x))) for i, x in loss.items()}
    steps |= {i: np.cumsum(np.random.default_rng(i).integers(1, 4, len(loss[i]))).tolist() for i in (3, 4)}  # with gaps
    rows = [(i, s, x) for i in loss for s, x in zip(steps[i], loss[i])] + [(2, 10_000, None)]
    want = [(i, *e[:2], round(e[2], 6)) for i in loss for e in metrics.Watch().feed(steps[i], loss[i], 0.2, 20, 60, 40, 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id long, step int, loss double").repartition(3)
    got = [(r.run_id, r.step, r.event, round(r.percent_over, 6)) for r in metrics.divergence_events(df, 60, 40, 60, 0.2, warmup=20).collect()]
    key = lambda r: (str(r[0]), *r[1:])
    assert {e[2] for e in want} == {"monitor", "recovered", "lr_reset", "stop"} and sorted(got, key=key) == sorted(want, key=key)
    got = {(r.run_id, r.step): r for r in metrics.loss_ema(df, 0.2).collect()}
    assert len(got) == len(rows) and got[2, 10_000].ema_after is None
    for i in loss:
        for name, a in (("ema_after", 0.2), ("chart_ema", 1 - metrics.chart_weight(len(loss[i])))):
            np.testing.assert_allclose([getattr(got[i, s], name) for s in steps[i]], metrics.smoothed(np.array(loss[i]), a), rtol=1e-9)
        before = [got[i, s].ema_before for s in steps[i]]
        assert before[0] is None
        np.testing.assert_allclose(before[1:], [got[i, s].ema_after for s in steps[i]][:-1], rtol=1e-9)


def test_one_long_run_is_many_tasks(spark):
    """Two million steps of one run: averaged in more than eight tasks, equal to the fold."""
    n = 2_000_000
    df = spark.range(n, numPartitions=8).select(F.lit(1).cast("long").alias("run_id"), (F.col("id") + 1).cast("int").alias("step"), (2 + F.sin(F.col("id") / 999)).alias("loss"))
    want = metrics.smoothed(2 + np.sin(np.arange(n) / 999), 0.001)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = metrics.loss_ema(df, 0.001)
        got = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.struct("step", "ema_after")).alias("m")).collect()
        assert sum(r.n for r in got) == n and len(got) >= 4 and max(r.n for r in got) < n / 2
        some = out.where("step % 99991 = 0").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(some) == n // 99991 and all(math.isclose(r.ema_after, want[r.step - 1], rel_tol=1e-9) for r in some)


def test_stream_equals_batch(spark, tmp_path):
    """With defaults, in two parts with a restart from the checkpoint between them, each run with a warm-up of its own."""
    from cliploom.streaming import telemetry

    loss = [1.0] * 500 + [9.0] * 700 + [0.5] * 500
    runs = {1: loss, 2: loss[:1300], 3: [2.0] * 10 + loss}
    rows = [(r, s, x) for r, v in runs.items() for s, x in enumerate(v, 1)] + [(1, 5000, None)]
    shape = "run_id long, step int, loss double"
    batch = metrics.divergence_events(spark.createDataFrame(rows[:-1], shape)).collect()
    plan = spark.createDataFrame([(r, len(v)) for r, v in runs.items()], "run_id long, total_steps int")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(0, 700), range(700, 10_000)):
        spark.createDataFrame([r for r in rows if r[1] in part], shape).coalesce(1).write.mode("append").parquet(source)
        telemetry.run_once(telemetry.stream_divergence(spark.readStream.schema(shape).parquet(source), plan), sink)
    stream = spark.read.schema(metrics.EVENTS).parquet(sink).collect()
    key = lambda rs: sorted((r.run_id, r.step, r.event, round(r.percent_over, 6)) for r in rs)
    assert key(batch) == key(stream) and {r.event for r in batch} == {"monitor", "lr_reset", "stop"}
    assert len({r.step for r in batch if r.event == "monitor"}) > 1


def test_media_are_taken_in_once(spark, sf_dir, tmp_path):
    from cliploom.streaming import telemetry

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    blocked = spark.createDataFrame([("c",)], "stem string")
    for batch in (["a", "b", "b", "c"], ["b", "d"]):
        spark.createDataFrame([(x,) for x in batch], "stem string").coalesce(1).write.mode("append").parquet(source)
        telemetry.stream_ingest(spark.readStream.schema("stem string").parquet(source), blocked, sink).awaitTermination()
    assert sorted(r.stem for r in spark.read.parquet(sink).collect()) == ["a", "b", "d"]


# --- manifests --------------------------------------------------------------


def clips_and_artifacts(spark, without=()):
    clips = spark.createDataFrame([(f"v1_chunk{i:04d}", "v1", f"clips/v1_chunk{i:04d}.mp4") for i in range(5)], "stem string, source_stem string, path string")
    rows = [(f"v1_chunk{i:04d}", k, 60) for i in range(5) for k in reconcile.KINDS if (i, k) not in without]
    return clips, spark.createDataFrame(rows, "stem string, kind string, token_len int")


def test_a_complete_set_needs_nothing_and_one_gap_is_found(spark):
    clips, arts = clips_and_artifacts(spark)
    assert reconcile.missing_artifacts(clips, arts).count() == 0
    assert reconcile.reconcile_report(clips, arts).first().complete
    clips, arts = clips_and_artifacts(spark, {(3, "conditions")})
    assert [(r.stem, r.kind) for r in reconcile.missing_artifacts(clips, arts).collect()] == [("v1_chunk0003", "conditions")]
    assert reconcile.reconcile_report(clips, arts).first().missing_any == 1


def test_reconciling_twice_changes_nothing(spark):
    clips, arts = clips_and_artifacts(spark)
    entries = spark.createDataFrame([("clips/v1_chunk0000.mp4", "v1.mp4", "x"), ("clips/gone_chunk0001.mp4", "gone.mp4", "y")], "media_path string, source_file string, caption string")
    media_rows = spark.createDataFrame([("/src/v1.mov",), ("/src/v1.mp4",)], "path string")
    once = reconcile.surviving_entries(entries, clips).select("media_path", "source_file", "caption").unionByName(reconcile.stub_entries(clips, entries, media_rows))
    assert once.count() == 5 and {r.source_file for r in once.where("caption = ''").collect()} == {"/src/v1.mov"}
    assert reconcile.orphan_entries(entries, clips).first().chunk_idx == 1
    assert reconcile.stub_entries(clips, once, media_rows).count() == 0 and reconcile.orphan_entries(once, clips).count() == 0


def test_manifest_versions(spark, tmp_path):
    root = str(tmp_path / "set")
    rows = [(f"{root}/clips/a.mp4", None), ("/elsewhere/b.mp4", "")]
    df = spark.createDataFrame(rows, "media_path string, transcript string")
    first = media.write_entries(df, root)
    media.write_entries(df.limit(1), root)
    assert media.current_entries(spark, root).count() == 1 and spark.read.parquet(first).count() == 2
    assert {(r.media_path, r.transcript) for r in spark.read.parquet(first).collect()} == {("clips/a.mp4", None), ("/elsewhere/b.mp4", "")}
    (tmp_path / "x.json").write_text('[{"media_path": "a", "transcript": ""}, {"media_path": "b"}]')
    got = {r.media_path: r.transcript for r in media.read_entries(spark, str(tmp_path / "x.json")).collect()}
    assert got == {"a": "", "b": None}
    (tmp_path / "bad.json").write_text("{not json")
    assert media.read_entries(spark, str(tmp_path / "bad.json")).count() == 0


def test_ranges_are_judged_from_masks_of_a_long_video(spark):
    """A day-long video: ranges over the borders of masks, few rows shuffled, one video in many tasks."""
    rng = np.random.default_rng(9)
    frames = np.sort(rng.choice(200_000, 30_000, replace=False))
    hit, unknown = rng.random(30_000) < 0.7, rng.random(30_000) < 0.2
    matches = spark.createDataFrame([(1, int(f), bool(h), bool(u)) for f, h, u in zip(frames, hit, unknown)] + [(1, 7, None, True)] * (7 not in frames), "video_id long, frame int, hit boolean, unknown boolean")
    of = {int(f): (h, u) for f, h, u in zip(frames, hit, unknown)} | ({7: (False, True)} if 7 not in frames else {})
    chunks = [(1, i, i * 97, i * 97 + 97, 0, 200_000) for i in range(2000)] + [(2, 0, 5, 90, 0, 100)]
    df = spark.createDataFrame(chunks, "video_id long, chunk_idx int, start_frame int, end_frame int, first_frame int, last_frame int")

    def look(video, a, b, n=4):
        at = [a + i * (b - a) // n for i in range(n)]
        seen = [(f, *of.get(f, (False, False))) if video == 1 else (f, False, False) for f in at]
        hits = [f for f, h, _ in seen if h]
        return len(hits), sum(u for *_, u in seen), len(at), min(hits, default=None), max(hits, default=None)

    got = {(r.video_id, r.chunk_idx): (r.hits, r.unknowns, r.n_pos, r.first_hit, r.last_hit) for r in mining.validate_ranges(df, matches, ["video_id", "chunk_idx"]).collect()}
    assert got == {(v, i): look(v, a, b) for v, i, a, b, *_ in chunks}
    want = set()
    for v, i, a, b, lo, hi in chunks:
        hits, unknowns, n, *_ = look(v, a, b)
        passes = hits >= max(1, round(0.75 * n)) and unknowns <= round(0.25 * n)
        if passes:
            want.add((v, i, 0, 0, hits, unknowns))
        if hits and not (passes and hits == n):
            for k, f in enumerate([-f for f in mining.FRACTIONS] + list(mining.FRACTIONS), 1):
                move = int((b - a) * abs(f)) // 8 * 8 * (1 if f > 0 else -1)
                if move and a + move >= lo and b + move <= hi:
                    h, u, m, *_ = look(v, a + move, b + move)
                    if h >= max(1, round(0.75 * m)) and u <= round(0.25 * m):
                        want.add((v, i, k, move, h, u))
    found = mining.candidates(df, matches)
    assert {(r.video_id, r.chunk_idx, r.search_order, r.shift, r.hits, r.unknowns) for r in found.collect()} == want
    asked = mining.with_masks(df, matches, F.col("start_frame") - 194, F.col("end_frame") + 194).select(F.sum(F.lit((97 * 5) // mining.MASK + 2)).alias("n")).first().n
    assert asked <= 2001 * 2 and mining.masks(matches).count() <= 200_000 // mining.MASK + 1  # a position was a row before: 68 a chunk


def test_capacity_counts_clips_without_a_source(spark):
    rows = [(1, None), (2, "b"), (3, None), (4, "a"), (5, "a")]
    clips = spark.createDataFrame(rows, "clip_id int, source_stem string").repartition(2)
    for most in (10, 3, 2, 1):
        want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))[:most]
        assert sorted(tuple(r) for r in identity.capacity_limit(clips, most, ["clip_id"]).collect()) == sorted(want)


def test_placeholders_are_complete(spark):
    rows = [("a", "latents", 5), ("a", "conditions", 7), ("a", "audio_latents", None), ("b", "latents", None), ("b", "conditions", 1), ("c", "latents", 2)]
    artifacts = spark.createDataFrame(rows, "stem string, kind string, token_len int")
    assert [tuple(r) for r in reconcile.training_manifest(artifacts, reconcile.KINDS).collect()] == [("a", 5, 7, None)]
    assert sorted(tuple(r)[0] for r in reconcile.training_manifest(artifacts).collect()) == ["a", "b"]


def test_bucketed_tables_are_not_shuffled(spark):
    rng = random.Random(2)
    clips = spark.createDataFrame([(f"c{i}",) for i in range(300)] + [("c1",), (None,)], "stem string")
    artifacts = spark.createDataFrame([(f"c{rng.randrange(350)}", rng.choice(reconcile.KINDS), rng.choice([None, 5])) for _ in range(900)], "stem string, kind string, token_len int").dropDuplicates(["stem", "kind"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c, a = media.bucketed(clips, "clips", buckets=6), media.bucketed(artifacts, "artifacts", buckets=6)
        for f in (lambda c, a: reconcile.missing_artifacts(c, a), lambda c, a: reconcile.complete_stems(c, a), lambda c, a: reconcile.training_manifest(a)):
            out = f(c, a)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            assert sorted(map(str, out.collect())) == sorted(map(str, f(clips, artifacts).collect())) and out.count() > 0
        got = {(r.stem, r.kind) for r in reconcile.missing_artifacts(c, a).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    have = {(r.stem, r.kind) for r in artifacts.collect()}
    assert got == {(s, k) for s in {r.stem for r in clips.collect()} for k in reconcile.KINDS if (s, k) not in have}


def test_totals_are_no_identity(spark):
    members = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (3, None)], "clip_id int, identity string")
    got = {(r.identity, r.is_total): (r.appearances, r.clips) for r in identity.identity_counts(members).collect()}
    assert got == {("a", False): (2, 2), (None, False): (2, 2), (None, True): (4, 3)}
    new = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (3, "a")], "clip_id int, identity string")
    got = {(r.identity, r.is_total): (r.added, r.removed, r.clips) for r in identity.relabel_diff(members, new).collect()}
    assert got == {("a", False): (1, 1, 2), ("b", False): (1, 0, 1), (None, False): (0, 1, 1), (None, True): (2, 2, 2)}


def test_pool_has_places(spark):
    got = identity.shuffle_pool(spark.range(50).withColumnRenamed("id", "slot"), 7, "slot").collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.shuffle_key, r.slot))] == list(range(1, 51))


def test_two_writers_lose_nothing(spark, tmp_path):
    import threading

    root = str(tmp_path)
    shape = "media_path string, n int"
    media.write_entries(spark.createDataFrame([("a", 0)], shape), root)
    both = threading.Barrier(2)
    waits = {1: True, 2: True}

    def add(k):
        def change(old):
            if waits[k]:  # the first time both have read the same version
                waits[k] = False
                both.wait(timeout=60)
            return old.unionByName(spark.createDataFrame([(f"w{k}", k)], shape))

        media.update_entries(spark, root, change)

    threads = [threading.Thread(target=add, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert media.current_version(spark, root) == 3
    assert sorted(tuple(r) for r in media.current_entries(spark, root).collect()) == [("a", 0), ("w1", 1), ("w2", 2)]
    assert media.current_entries(spark, root, 1).count() == 1
    with pytest.raises(media.Conflict):
        media.write_entries(spark.createDataFrame([("late", 9)], shape), root, based_on=2)
    assert media.expire_versions(spark, root, keep=1) == 2 and media.expire_versions(spark, root, keep=1) == 0
    assert media.current_entries(spark, root).count() == 3
    with pytest.raises(FileNotFoundError):
        media.current_entries(spark, str(tmp_path / "none"))


def test_many_appends_become_few_files(spark, tmp_path):
    path, shape = str(tmp_path / "ledger"), "media_path string, chunk_idx int, reason string"
    assert media.read_rejections(spark, path, shape).count() == 0 and media.compact_rejections(spark, str(tmp_path / "empty"), shape) == 0
    for i in range(25):
        media.append_rejections(spark.createDataFrame([(f"c{i}", i, "a/b" if i % 3 else "x")], shape).repartition(2), path)
    rows = sorted(tuple(r) for r in media.read_rejections(spark, path, shape).collect())
    assert len(rows) == 25
    assert media.compact_rejections(spark, path, shape) == 25
    files = list((tmp_path / "ledger").rglob("*.parquet"))
    assert len(files) == 2 and sorted(tuple(r) for r in media.read_rejections(spark, path, shape).collect()) == rows
    media.append_rejections(spark.createDataFrame([("late", 1, "x")], shape), path)
    assert media.read_rejections(spark, path, shape).count() == 26
    assert media.compact_rejections(spark, path, shape, files=3) == 2 and media.read_rejections(spark, path, shape).count() == 26


@pytest.mark.parametrize("block", [1, 64])
def test_silences_over_block_borders(spark, monkeypatch, block):
    monkeypatch.setattr(timeline, "SIGNAL_BLOCK", block)
    rng = np.random.default_rng(5)
    clips = {}
    for i in range(6):
        frames = np.sort(rng.choice(900, 500 + 50 * i, replace=False)) if i % 2 else np.arange(400 + i)  # gaps: neighbours are what is there
        loud = np.repeat(rng.random(len(frames) // 20 + 1) < 0.5, 20)[: len(frames)]
        clips[i] = list(zip(frames.tolist(), np.where(loud, 1.0, 0.01 * rng.random(len(frames))).tolist()))
    clips[6], clips[None] = [(f, 0.0) for f in range(300)], [(f, 1.0 if f < 150 else 0.0) for f in range(300)]
    want = set()
    for i, rows in clips.items():
        limit = np.mean([x for _, x in rows]) * 0.3
        at = 0
        for quiet, run in itertools.groupby(rows, key=lambda r: r[1] < limit):
            run = list(run)
            if quiet and len(run) >= 5:
                want.add((i, run[0][0], len(run), (run[0][0] + len(run) // 2) * 160))
            at += len(run)
    df = spark.createDataFrame([(i, f, x) for i, rows in clips.items() for f, x in rows], "clip_id long, frame_idx int, rms double").repartition(3)
    assert {tuple(r) for r in timeline.silence_regions(df, 0.3, 5).collect()} == want
    peaks = {(r.clip_id, r.col): r.peak for r in timeline.waveform_peaks(df.where("clip_id = 0 OR clip_id IS NULL"), 9).collect()}
    for i in (0, None):
        n = len(clips[i])
        assert all(peaks[i, c] == max(abs(x) for _, x in clips[i][c * n // 9 : (c + 1) * n // 9]) for c in range(9))


def test_capacity(spark):
    clips = spark.createDataFrame([(i, f"s{i % 4}") for i in range(60)], "clip_id int, source_stem string").repartition(3)
    for most in (50, 45, 15, 7, 60, 99, 0):
        want = sorted((f"s{i % 4}", i) for i in range(60))[: most or None]
        got = identity.capacity_limit(clips, most, ["clip_id"]).select("source_stem", "clip_id").collect()
        assert sorted(map(tuple, got)) == want
    assert identity.capacity_limit(clips.limit(0), 5, ["clip_id"]).count() == 0
    short = identity.capacity_shortfall(clips, clips.limit(0), 70).first()
    assert (short.samples, short.pool_remaining, short.shortfall, short.advice) == (60, 0, 10, "add sources")
    assert identity.capacity_shortfall(clips, clips, 70).first().advice == "mine more" and identity.capacity_shortfall(clips, clips, 60).first().advice is None


@pytest.mark.parametrize("broadcast_blocks,vectors_each", [(10, 16_384), (1, 16_384), (1, 3)])
def test_references_with_gaps_and_in_many_blocks(spark, monkeypatch, broadcast_blocks, vectors_each):
    from cliploom.functions import vectors

    for name, value in (("BLOCK", 2), ("BROADCAST_BLOCKS", broadcast_blocks), ("EACH", 3), ("VECTORS", vectors_each)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    refs = rng.normal(size=(11, 6))
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    order = [1, 5000, 5001, 9000, 12000, 40000, 40001, 50000, 60000, 70000, 90000]
    table = spark.createDataFrame([(o, f"r{i % 9}", v.tolist()) for i, (o, v) in enumerate(zip(order, refs))], "ref_order int, trigger_name string, ref_embedding array<double>")
    rows = rng.normal(size=(40, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[0] = refs[1]
    det = spark.createDataFrame([(i, v.tolist(), [f"r{i % 4}"] if i % 2 else None, 0.0, 1.0) for i, v in enumerate(rows)] + [(99, None, None, 0.0, 1.0)], "det_id int, embedding array<double>, on_screen array<string>, t_start double, t_end double")
    sims = rows @ refs.T
    got = {r.det_id: r for r in identity.match_face_refs(det, table, -1.0).collect()}
    assert all(got[i].matched == f"r{sims[i].argmax() % 9}" and math.isclose(got[i].similarity, sims[i].max(), rel_tol=1e-5, abs_tol=1e-6) for i in range(40))
    assert got[0].matched == "r1" and got[99].matched is None
    over = {(r.det_id, r.trigger_name, round(r.similarity, 4)) for r in identity.match_scene_refs(det, table, 0.4).collect()}
    assert over == {(i, f"r{j % 9}", round(float(sims[i, j]), 4)) for i in range(40) for j in range(11) if sims[i, j] >= 0.4}
    said = {r.det_id: r for r in identity.attribute_speakers(det, table).collect()}
    for i in range(40):
        d = sorted((1 - sims[i, j] - (0.15 if i % 2 and f"r{j % 9}" == f"r{i % 4}" else 0.0), f"r{j % 9}") for j in range(11))
        assert math.isclose(said[i].distance, d[0][0], rel_tol=1e-5, abs_tol=1e-6)
        assert said[i].speaker == (d[0][1] if d[0][0] <= 0.7 and d[1][0] - d[0][0] >= 0.05 else "unknown")
    assert identity.match_face_refs(det, table.limit(0)).where("matched IS NULL").count() == 41


def test_many_references_are_pruned(spark, monkeypatch):
    """20,000 references around 50 people: the same matches as with all of them, and few units asked."""
    from cliploom.functions import vectors

    rng = np.random.default_rng(11)
    people = rng.normal(size=(50, 24))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    refs = unit(people[rng.integers(0, 50, 20_000)] + rng.normal(size=(20_000, 24)) * 0.15)
    faces = unit(people[rng.integers(0, 50, 400)] + rng.normal(size=(400, 24)) * 0.15)
    table = spark.createDataFrame([(i, f"r{i}", v.tolist()) for i, v in enumerate(refs)], "ref_order int, trigger_name string, ref_embedding array<double>").repartition(6)
    det = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(faces)], "det_id int, embedding array<double>").repartition(6)
    for name, value in (("BLOCK", 400), ("BROADCAST_BLOCKS", 2), ("EACH", 100)):
        monkeypatch.setattr(vectors, name, value)
    asked = []
    real = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, what: asked.append((what, real(df, what))) or asked[-1][1])
    sims = faces @ refs.T
    got = {r.det_id: r for r in identity.match_face_refs(det, table).collect()}
    assert all(got[i].matched == f"r{sims[i].argmax()}" and math.isclose(got[i].similarity, sims[i].max(), rel_tol=1e-9) for i in range(400))
    written = dict(asked)
    units = written["reference-units"].select("pivot", "part").distinct().count()
    assert units > 100 and written["asked-units"].count() < 0.25 * 400 * units
    assert [what for what, _ in asked].count("asking") == 1  # rows are written once
    over = {(r.det_id, r.trigger_name) for r in identity.match_scene_refs(det, table, 0.9).collect()}
    assert over == {(i, f"r{j}") for i, j in zip(*np.nonzero(sims >= 0.9))}


def test_media_and_references_by_extension(spark, tmp_path):
    names = ["a.TIFF", "b.wmv", "c.flv", "d.tif", "_e.mp4", "notes.txt", "f.wav", "Big_Cat.png"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    files = media.list_files(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[-1], r.kind) for r in media.scan_media(files).collect()} == {("a.TIFF", "image"), ("b.wmv", "video"), ("c.flv", "video"), ("d.tif", "image"), ("Big_Cat.png", "image")}
    assert {r.ref_key for r in media.load_refs(files).collect()} == {"a", "d", "big-cat"}
    assert {r.ref_key for r in media.load_refs(files, "location").collect()} == {"a", "d", "Big Cat"}
    assert {r.ref_key for r in media.load_refs(files, "voice").collect()} == {"f"}  # names that begin with _ are hidden from listings


def test_a_run_goes_on_from_its_averages(spark):
    rows = [(1, s, float(s), e) for s, e in enumerate([None, 3.0, 2.0, 2.0, 5.0, 1.0], 1)] + [(2, 9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, step int, loss double, ema_loss double")
    assert {(r.run_id, r.step) for r in metrics.resume_truncate(df, 5).collect()} == {(1, s) for s in range(1, 6)}
    got = {r.run_id: (r.dropped, r.ema_last, r.ema_low, r.ema_low_step) for r in metrics.resume_state(df, 5).collect()}
    assert got == {1: (1, 5.0, 2.0, 3), 2: (1, None, None, None)}


def test_each_run_has_its_own_warm_up(spark):
    loss = [1.0] * 60 + [9.0] * 540
    rows = [(1, s, x) for s, x in enumerate(loss, 1)] + [(2, s, x) for s, x in enumerate(loss[:200], 1)]
    got = metrics.divergence_events(spark.createDataFrame(rows, "run_id long, step int, loss double"), detect=20, stop=40).collect()
    for run, n in ((1, 600), (2, 200)):
        want = metrics.Watch().feed(list(range(1, n + 1)), loss[:n], 0.02, max(50, n // 4), 15, 20, 40)
        assert want and sorted((r.step, r.event) for r in got if r.run_id == run) == [e[:2] for e in want]


def test_status_has_totals(spark, tmp_path):
    from cliploom.streaming import telemetry

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (["a", "b", "b"], ["b", "d"]):
        spark.createDataFrame([(x,) for x in batch], "identity string").coalesce(1).write.mode("append").parquet(source)
        telemetry.stream_identity_status(spark.readStream.schema("identity string").parquet(source), sink).awaitTermination()
    status = telemetry.current_status(spark, sink)
    assert {(r.identity, r.appearances) for r in status.collect()} == {("a", 1), ("b", 3), ("d", 1), (None, 5)}
    totals = telemetry.status_totals(status, status, status.limit(2), 9, 50).first()
    assert (totals.appearances, totals.clips, totals.pool_remaining, totals.cap, totals.pool_total) == (5, 4, 2, 50, 9)


def test_a_frame_at_the_limit_is_judged_by_the_mean_in_frame_order(spark):
    """0.3 x the mean equals a frame but for rounding, and rows come in an order that rounds the other way."""
    values = [0.1, 0.2, 0.3, 0.4, 0.7, 1.3, 2.2, 0.6, 3.1]
    rng = random.Random(3)
    rows, want = [], set()
    for clip in range(150):
        rest = rng.sample(values, len(values))
        # the last value makes 0.3 x the mean of all eleven equal to the first one, in decimals
        first = rng.choice([0.3, 0.6, 0.9])
        frames = [first, *rest, round(first / 0.3 * (len(rest) + 2) - first - sum(rest), 6)]
        total = 0.0
        for x in frames:
            total += x
        if first < total / len(frames) * 0.3:
            want.add(clip)
        assert math.isclose(first, total / len(frames) * 0.3)
        rows += [(clip, i, x) for i, x in enumerate(frames)]
    assert 0 < len(want) < 150
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "clip_id long, frame_idx int, rms double").repartition(4)
        got = timeline.silence_regions(df, 0.3, 1).where("start_frame = 0").collect()
        assert {r.clip_id for r in got} == want


def test_token_padding_keeps_rows_without_a_length(spark, sf_dir):
    rows = timeline.token_padding(spark.createDataFrame([(1, 130), (2, None), (3, 128)], "i int, n int"), "n").collect()
    assert {r.i: (r.padded_len, r.pad_left, r["mask"] and len(r["mask"])) for r in rows} == {1: (256, 126, 256), 2: (None, None, None), 3: (128, 0, 128)}
    every = jobs.Tables(spark, sf_dir).b_artifacts
    got = jobs.QUERIES["token_padding"](spark, sf_dir)
    assert got.count() == every.count() and got.where("padded_len IS NULL").count() == every.where("token_len IS NULL").count() > 0


def test_alignment_goes_clip_by_clip(spark):
    """A worker gets one clip at a time; nulls, clips on one side and clips without a match give no rows."""
    rng = random.Random(12)
    lines = {c: ["".join(rng.choice("ab c") for _ in range(30)) if rng.random() < 0.9 else None for _ in range(5)] for c in range(8)}
    said = {c: [w if rng.random() < 0.8 else "noise" for x in lines[c] for w in (x or "").split()] for c in range(7)}
    said[3] = ["nothing"] * 9
    words = [(c, i, w, float(i), i + 0.5) for c, ws in said.items() for i, w in enumerate(ws)] + [(None, 0, "a", 0.0, 1.0), (99, 0, "a", 0.0, 1.0)]
    script = [(c, 10 * i, x) for c, xs in lines.items() for i, x in enumerate(xs)] + [(None, 0, "a")]
    rng.shuffle(words)
    rng.shuffle(script)
    out = timeline.align_words_to_lines(spark.createDataFrame(words, "clip_id long, pos int, word string, t_start double, t_end double"), spark.createDataFrame(script, "clip_id long, line int, text string"))
    want = set()
    for c, ws in said.items():
        found, ratio = timeline.align_lines(ws, [x or "" for x in lines[c]])
        if ratio >= 0.4:
            want |= {(c, i, w, float(i), i + 0.5, None if f is None else 10 * f) for i, (w, f) in enumerate(zip(ws, found, strict=True))}
    assert {tuple(r) for r in out.collect()} == want and {r[0] for r in want} < set(said)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_an_intake_keeps_a_few_bytes_a_clip():
    import tracemalloc

    n = 200_000
    walk = quota.Intake({"a": n // 2 + 1000, "b": n})
    tracemalloc.start()
    for i in range(n):
        walk.hold(("a",) if i % 2 else ("b",), 1, [i])
    for i in range(n, 2 * n):
        walk.offer(i, ("a", "b"))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert walk.counts["a"] >= n // 2 + 1000 and held < 30 * n


def test_a_rebalancing_reads_its_walk_in_batches(spark):
    df = spark.createDataFrame([(i, ["a"]) for i in range(20)], "clip_id long, signature array<string>")
    out = quota.rebalance_over_quota(df, spark.createDataFrame([("a", 5)], "identity string, quota long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(r.clip_id for r in out.collect()) == list(range(15))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_names_are_sought_in_few_texts_at_a_time():
    import pyarrow as pa

    from cliploom.functions import names as N

    texts, seen = pa.array([f"text {i}" if i % 7 else None for i in range(1000)])[3:], []
    assert N.by_text(texts, lambda t: seen.append(t) or (None if t is None else [t]), pa.list_(pa.string())).to_pylist() == [None if t is None else [t] for t in texts.to_pylist()]
    assert seen == texts.to_pylist() and N.by_text(texts[:0], str, pa.string()).type == pa.string()
