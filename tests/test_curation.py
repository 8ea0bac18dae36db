"""The curation pass against a loop that takes one slot after another."""

import hashlib
from collections import Counter

import pytest

from cliploom import jobs
from cliploom.jobs import queries_curation
from cliploom.jobs.curation import curate, read_set, repair
from cliploom.operators import curation, mining
from cliploom.sources import media


def loop(given, cap, seed=0, n=4):
    """entries, new ledger rows and open slots, as one walk through the pool."""
    rows = {k: [r.asDict() for r in df.collect()] for k, df in given.items()}
    cast = sorted(r["identity"] for r in rows["cast"])
    quota = {c: cap // len(cast) + (i < cap % len(cast)) for i, c in enumerate(cast)}
    entries = [(r["entry_id"], r["media_path"], frozenset(r["characters"] or ())) for r in sorted(rows["entries"], key=lambda r: r["entry_id"])]
    counts = Counter(c for *_, s in entries for c in s)
    ledger, known = [], {r["media_path"] for r in rows["entries"]} | {r["media_path"] for r in rows["ledger"]}
    over = {c for c in cast if counts[c] > quota[c]}
    able = sorted((-max(counts[c] - quota[c] for c in s), i, p, s) for i, p, s in entries if s and s <= over)
    gone = set()
    for _, i, p, s in able:
        if all(counts[c] > quota[c] for c in s):
            gone.add(i)
            counts.subtract(s)
            ledger.append((p, "rebalanced"))
    entries = [e for e in entries if e[0] not in gone]

    hit = {(r["video_id"], r["frame"]): (r["hit"], r["unknown"]) for r in rows["matches"]}
    seen = {}
    for r in rows["sightings"]:
        seen.setdefault((r["video_id"], r["frame"]), set()).add(r["identity"])

    def look(v, a, b):
        at = [a + i * (b - a) // n for i in range(n)]
        at = [f for f in at if a <= f < b]
        return sum(bool(hit.get((v, f), (0, 0))[0]) for f in at), sum(bool(hit.get((v, f), (0, 0))[1]) for f in at), at

    def best(v, a, b, lo, hi):
        h, u, at = look(v, a, b)
        good = lambda h, u, m: h >= max(1, round(0.75 * m)) and u <= round(0.25 * m)
        found = [(0, 0, h, u, len(at), a, b)] if good(h, u, len(at)) else []
        if h and len(at) >= 2 and not (found and h == len(at)):
            for k, f in enumerate([-f for f in mining.FRACTIONS] + list(mining.FRACTIONS), 1):
                move = int((b - a) * abs(f)) // 8 * 8 * (1 if f > 0 else -1)
                if move and a + move >= lo and b + move <= hi:
                    h2, u2, at2 = look(v, a + move, b + move)
                    if good(h2, u2, len(at2)):
                        found.append((k, move, h2, u2, len(at2), a + move, b + move))
        if found:
            return min(found, key=lambda x: (-x[2], 0 if x[2] == x[4] else x[3], 0 if x[2] == x[4] else abs(x[1]), x[0])), None
        m = len(at)
        return None, "no_known_character" if not h else "insufficient_character_presence" if h < max(1, round(0.75 * m)) else "unknown_face"

    name = lambda v, i: f"clips/v{v}_chunk{i:04d}.mp4"
    pool = [r for r in rows["grid"] if name(r["video_id"], r["chunk_idx"]) not in known]
    key = lambda r: hashlib.md5(f"{seed}:v{r['video_id']}#{r['chunk_idx']}".encode()).hexdigest()
    pool.sort(key=key)
    skipped, turn = set(), 0
    for turn, r in enumerate(pool):
        if all(counts[c] >= quota[c] for c in cast):
            break
        v, i = r["video_id"], r["chunk_idx"]
        if (v, i) in skipped:
            ledger.append((name(v, i), "absorbed"))
            continue
        got, reason = best(v, r["start_frame"], r["end_frame"], r["first_frame"], r["last_frame"])
        if got is None:
            ledger.append((name(v, i), reason))
            continue
        _, shift, *_, a, b = got
        for k in range(1, -(-abs(shift) // (b - a)) + 1):
            skipped.add((v, i + k * (1 if shift > 0 else -1)))
        times = Counter(c for f in look(v, a, b)[2] for c in seen.get((v, f), ()) if c in quota)
        s = frozenset(c for c, x in times.items() if x >= 0.5 * max(times.values()))
        full = {c for c in s if counts[c] >= quota[c]}
        if s and full == s:
            ledger.append((name(v, i), "quota_refused"))
            continue
        if full:
            fit = [(len(o), at) for at, (*_, o) in enumerate(entries) if o and o < s and full <= o]
            if not fit:
                ledger.append((name(v, i), "quota_refused"))
                continue
            _, p, o = entries.pop(min(fit)[1])
            counts.subtract(o)
            ledger.append((p, "swapped_out"))
        entries.append((None, name(v, i), s))
        counts.update(s)
    else:
        turn += 1
    return {(p, ",".join(sorted(s))) for _, p, s in entries}, sorted(ledger), {name(r["video_id"], r["chunk_idx"]) for r in pool[turn:]}


@pytest.mark.parametrize("part", [0.7, 50.0])
def test_a_pass_equals_the_loop_and_a_second_one_changes_nothing(spark, sf_dir, tmp_path, part):
    given = queries_curation.curation_inputs(jobs.Tables(spark, sf_dir))
    cap = int(queries_curation.samples(given["entries"]) / 1.2 * part)
    entries, rejected, pool = loop(given, cap)
    root = str(tmp_path / "set")
    before = given["ledger"].count()
    media.append_rejections(given.pop("ledger"), f"{root}/ledger")
    media.write_entries(given.pop("entries"), root)
    done = curate(spark, root, **given, max_samples=cap)
    assert sorted((r.media_path, r.reason) for r in done.rejections.collect()) == rejected
    now, ledger = read_set(spark, root)
    state = {(r.media_path, ",".join(r.characters)) for r in now.collect()}
    assert state == entries and ledger.count() == before + len(rejected)
    name = lambda r: f"clips/{r.source_stem}_chunk{r.chunk_idx:04d}.mp4"
    assert {name(r) for r in done.pool.collect()} == pool
    assert {name(r) for r in done.clips.collect()} == {p for p, _ in entries} - {r.media_path for r in queries_curation.curation_inputs(jobs.Tables(spark, sf_dir))["entries"].collect()}
    again = curate(spark, root, **given, max_samples=cap)
    now, ledger = read_set(spark, root)
    assert again.rejections.count() == 0 and {(r.media_path, ",".join(r.characters)) for r in now.collect()} == state and ledger.count() == before + len(rejected)


def test_slots_are_covered_in_turn(spark):
    """Each slot covers the next two to the right; what is skipped covers nothing."""
    order = [(1, i, p) for i, p in enumerate([5, 1, 7, 2, 9, 3, 4, 8, 6, 0])] + [(2, 0, 10), (2, 1, 11)]
    moved = [(v, i, 20, i * 10, i * 10 + 10) for v, i, _ in order if i != 3]
    skipped = set()
    for v, i, _ in sorted(order, key=lambda x: x[2]):
        if (v, i) not in skipped and i != 3:
            skipped |= {(v, i + 1), (v, i + 2)}
    done = {(v, i): p for v, i, p in order}
    want, covered = set(), {}
    for v, i, p in sorted(order, key=lambda x: x[2]):
        if (v, i) in covered:
            want.add((v, i))
        elif i != 3:
            for k in (1, 2):
                if done.get((v, i + k), -1) > p:
                    covered[v, i + k] = True
    got = curation.absorbed(spark.createDataFrame(order, "video_id int, chunk_idx int, place int"), spark.createDataFrame(moved, "video_id int, chunk_idx int, shift int, start_frame int, end_frame int"))
    assert {tuple(r) for r in got.collect()} == want


def test_purge_names_artifacts_of_rejected_clips(spark):
    ledger = spark.createDataFrame([("clips/a_chunk0001.mp4", "a.mp4", "x", 1), (None, "b.mp4", "y", None)], "media_path string, source_file string, reason string, chunk_idx int")
    artifacts = spark.createDataFrame([("a_chunk0001", "latents"), ("a_chunk0001", "conditions"), ("a_chunk0002", "latents"), ("b_chunk0001", "latents")], "stem string, kind string")
    assert sorted(map(tuple, curation.purge_list(ledger, artifacts).collect())) == [("a_chunk0001", "conditions"), ("a_chunk0001", "latents")]


def test_a_second_repair_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    shape = "stem string, media_path string, source_file string, caption string, characters array<string>"
    rows = [("a_chunk0001", "clips/a_chunk0001.mp4", "a.mp4", "long", ["x"]), ("a_chunk0002", "clips/a_chunk0002.mp4", "a.mp4", "gone", None), ("b_chunk0001", "clips/b_chunk0001.mp4", "b.mp4", "", None), (None, None, "c.mp4", "no path", None)]
    media.write_entries(spark.createDataFrame(rows, shape), root)
    clips = spark.createDataFrame([(f"{s}_chunk000{i}", f"clips/{s}_chunk000{i}.mp4", s) for s, i in (("a", 1), ("b", 1), ("b", 2), ("b", 2))], "stem string, path string, source_stem string")
    files = spark.createDataFrame([("/s/b.mov",), ("/s/b.avi",)], "path string")
    artifacts = spark.createDataFrame([("a_chunk0001", "conditions", 500), ("b_chunk0001", "conditions", 900), ("a_chunk0001", "latents", 900)], "stem string, kind string, token_len int")
    done = repair(spark, root, clips, files, artifacts)
    want = {("clips/a_chunk0001.mp4", "a.mp4", "", ("x",)), ("clips/b_chunk0001.mp4", "b.mp4", "", None), ("clips/b_chunk0002.mp4", "/s/b.avi", "", None)}
    state = lambda: {(r.media_path, r.source_file, r.caption, tuple(r.characters) if r.characters else None) for r in read_set(spark, root)[0].collect()}
    assert state() == want and [tuple(r) for r in done.drop.collect()] == [("a_chunk0001", "conditions")]
    assert sorted((str(r.media_path), r.reason, r.chunk_idx) for r in read_set(spark, root)[1].collect()) == [("None", "deleted", None), ("clips/a_chunk0002.mp4", "deleted", 2)]
    again = repair(spark, root, clips, files, artifacts.join(done.drop, ["stem", "kind"], "left_anti"))
    assert state() == want and again.rejections.count() == again.drop.count() == 0 and media.current_version(spark, root) == 2


def test_the_steps_of_a_pass_read_frames_that_were_numbered_once(spark, sf_dir):
    given = queries_curation.curation_inputs(jobs.Tables(spark, sf_dir))
    for name, df in given.items():
        assert not any("events.parquet" in f for f in df.inputFiles()) and "Window" not in df._jdf.queryExecution().executedPlan().toString(), name
    # a frame meets its own chunk, not all of its video
    first = given["sightings"].join(given["grid"], "video_id").where("frame >= start_frame AND frame < start_frame + 3").select("video_id", "chunk_idx", "identity").distinct()
    want = {(r.video_id * 1000 + r.chunk_idx, r.identity) for r in first.where("(video_id * 7 + chunk_idx) % 5 = 0").collect()}
    entries = given["entries"].collect()
    assert {(r.entry_id, c) for r in entries for c in r.characters or ()} == want and len(entries) == given["clips"].count()
    plan = given["entries"]._jdf.queryExecution().optimizedPlan().toString()
    assert all("chunk_idx" in line for line in plan.splitlines() if "Join" in line)
