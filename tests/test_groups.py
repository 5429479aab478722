"""Cuts, islands, intervals, similarity and the store against plain Python on small inputs."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from duskline.functions.text import decode_slots, plate_text
from duskline.operators import appearance, matching, results, rules
from duskline.operators.cuts import CutRules, greedy_segments
from duskline.operators.detections import sampled_frames
from duskline.operators.search import SearchQuery, batch_search, search
from duskline.operators.trails import TrailConfig, attribute_trails, plate_trails
from duskline.sources import artifacts, manifests, store
from duskline.streaming.hosting import drain
from duskline.streaming.trails import trail_stream


def fold(rows, rule):
    seg, out = [], []
    for r in sorted(rows):
        if seg and (r[0] - seg[-1][0] > rule.max_gap_ms or r[0] - seg[0][0] > rule.max_span_ms or len(seg) >= rule.max_rows
                    or len({x[1] for x in seg} | {r[1]}) > rule.max_sources):
            out.append(seg)
            seg = []
        seg.append(r)
    return out + [seg] if seg else out


def test_cuts_equal_a_fold_whatever_the_bucket(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 30_000), rng.choice("abcde"), f"{k}-{i}") for k in ("x", "y", "hot") for i in range(900 if k == "hot" else 60)]
    df = spark.createDataFrame(rows, "k string, timestamp_ms long, source_id string, observation_id string").repartition(6)
    for bucket in (501, 1500, 50_000):
        rule = CutRules(120, 500, 7, 3, bucket_ms=bucket)
        got = greedy_segments(df, ["k"], "timestamp_ms", "source_id", "observation_id", rule)
        have = {(r.k, r.observation_id): r.cut_id for r in got.collect()}
        want = {}
        for k in ("x", "y", "hot"):
            for seg in fold([r[1:] for r in rows if r[0] == k], rule):
                want.update({(k, o): seg[0][2] for _, _, o in seg})
        assert have == want


def records(spark, rows):
    df = spark.createDataFrame(rows, "observation_id string, source_id string, timestamp_ms long, category string, plate_text string, confidence double")
    a = F.array(F.struct(F.lit("colour").alias("name"), F.lit("red").alias("value"), F.lit(1.0).alias("confidence"), F.lit("p").alias("provenance")))
    return df.withColumns({"attributes": a, "track_id": F.lit(None).cast("string"), "evidence": F.struct(*[
        F.lit("e").alias(n) for n in ("event_id", "producer", "producer_version", "config_sha256", "model_sha256", "source_revision")])})


def test_trails_need_two_sources_and_cut_after_the_gap(spark):
    rows = [("a", "c1", 0, "license_plate", "P1", 0.9), ("b", "c2", 60_000, "license_plate", "P1", 0.9),
            ("c", "c1", 120_001, "license_plate", "P1", 0.9), ("d", "c1", 130_000, "license_plate", "P1", 0.9),
            ("e", "c1", 0, "car", None, 0.9), ("f", "c2", 10, "car", None, 0.9)]
    r = records(spark, rows)
    trail = plate_trails(r).collect()
    assert [(t.plate_text, t.start_ms, t.record_count, t.identity_claim) for t in trail] == [("P1", 0, 2, False)]
    cand = attribute_trails(r, SearchQuery(attributes=(("colour", "red"),))).collect()
    assert [(t.category, t.record_count) for t in cand] == [("car", 2)]
    lines = results.envelopes(results.trail_results(plate_trails(r), r))
    back = results.read_envelopes(lines, "trail").first()
    assert back.accepted and [h.observation_id for h in back.payload.hits] == ["a", "b"]
    lines = results.envelopes(results.trail_results(attribute_trails(r, SearchQuery(attributes=(("colour", "red"),))), r))
    assert results.read_envelopes(lines, "trail").first().accepted


def test_streamed_trails_are_the_closed_batch_trails(spark, tmp_path):
    rng = random.Random(9)
    cfg = TrailConfig(100, 400, 6, 3, bucket_ms=5_000)
    rows = [(f"o{i}", rng.choice(["c1", "c2", "c3", "c4"]), rng.randint(0, 20_000), "license_plate", f"P{rng.randint(0, 3)}", 0.9) for i in range(600)]
    r = records(spark, rows)
    r.coalesce(1).write.parquet(str(tmp_path / "r"))
    got = drain(trail_stream(spark.readStream.schema(r.schema).parquet(str(tmp_path / "r")), "plate_text", cfg), spark, "tr")
    want = {(t.plate_text, t.start_ms, t.end_ms, t.record_count) for t in plate_trails(r, None, cfg).collect()}
    have = {(t.plate_text, t.start_ms, t.end_ms, t.record_count) for t in got.collect()}
    assert have <= want and len(want - have) <= 4


def test_sampling_is_greedy(spark):
    df = spark.createDataFrame([("c", "s", t, f"f{t:05d}") for t in (0, 100, 359, 360, 500, 719, 720, 5000)],
                               "source_id string, segment_id string, timestamp_ms long, frame_id string")
    for bucket in (400, 60_000):
        assert [r.timestamp_ms for r in sampled_frames(df, 360, bucket_ms=bucket).orderBy("timestamp_ms").collect()] == [0, 360, 720, 5000]


def test_interval_matching_is_maximum(spark):
    rng = random.Random(4)
    for tolerance in (0, 3):
        ev, lb, want = [], [], {}
        for s in range(40):
            es = [(a, a + rng.randint(1, 8)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 5)))]
            ls = [(a, a + rng.randint(1, 8)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 5)))]
            ev += [(f"s{s}", f"e{i}", *e) for i, e in enumerate(es)]
            lb += [(f"s{s}", f"l{i}", *x) for i, x in enumerate(ls)]
            best = 0
            small, large = (es, ls) if len(es) <= len(ls) else (ls, es)
            for perm in itertools.permutations(range(len(large)), len(small)):
                best = max(best, sum(small[i][0] <= large[j][1] + tolerance and large[j][0] - tolerance <= small[i][1] for i, j in enumerate(perm)))
            want[f"s{s}"] = best
        e = spark.createDataFrame(ev, "sample_id string, event_id string, start_ms long, end_ms long")
        x = spark.createDataFrame(lb, "sample_id string, label_id string, start_ms long, end_ms long")
        for bucket in (7, 1000):
            got = {r["sample_id"]: r["count"] for r in matching.match_intervals(e, x, tolerance, bucket).groupBy("sample_id").count().collect()}
            assert {s: got.get(s, 0) for s in want} == want


def test_nested_intervals_lose_no_pair(spark):
    """Intervals of 1 to 60 that nest and reach over buckets, against exhaustive pairing."""
    rng = random.Random(11)
    ev, lb, want = [("n", "A", 15, 20), ("n", "B", 5, 25)], [("n", "L", 0, 10), ("n", "M", 0, 40)], {"n": 2}
    for s in range(60):
        es, ls = ([(a, a + rng.randint(1, 60)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 6)))] for _ in range(2))
        ev += [(f"s{s}", f"e{i}", *e) for i, e in enumerate(es)]
        lb += [(f"s{s}", f"l{i}", *x) for i, x in enumerate(ls)]

        def best(i, used):
            if i == len(es):
                return 0
            meets = [j for j, x in enumerate(ls) if j not in used and es[i][0] <= x[1] and x[0] <= es[i][1]]
            return max([best(i + 1, used), *[1 + best(i + 1, used | {j}) for j in meets]])

        want[f"s{s}"] = best(0, frozenset())
    e = spark.createDataFrame(ev, "sample_id string, event_id string, start_ms long, end_ms long")
    x = spark.createDataFrame(lb, "sample_id string, label_id string, start_ms long, end_ms long")
    for bucket in (7, 1000):
        pairs = matching.match_intervals(e, x, 0, bucket).collect()
        got = {s: sum(r.sample_id == s for r in pairs) for s in want}
        assert got == want
        assert len({(r.sample_id, r.event_id) for r in pairs}) == len({(r.sample_id, r.label_id) for r in pairs}) == len(pairs)


def test_similarity_blocks_do_not_change_the_ranking(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        v = [rng.random() for _ in range(8)]
        rows.append((f"o{i:02d}", "c", i, "class" if i % 3 else "other", [x / sum(v) for x in v]))
    rows += [("face", "c", 1, "face", [0.5, 0.5]), ("bad", "c", 1, "class", [0.5, 0.6])]
    d = spark.createDataFrame(rows, "observation_id string, source_id string, timestamp_ms long, category string, vals array<double>")
    out = [sorted((r.probe_id, r.rank, r.candidate_id, round(r.similarity, 12)) for r in appearance.rank_similarity(d, d, 0.3, 5, b).collect()) for b in (4, 17, 4096)]
    assert out[0] == out[1] == out[2] and not any(p in ("face", "bad") for p, *_ in out[0])
    sims = {(a[0], b[0]): sum(map(min, a[4], b[4])) for a in rows[:60] for b in rows[:60] if a[3] == b[3] and a[0] != b[0]}
    best = max(v for (p, _), v in sims.items() if p == "o01")
    assert [r[3] for r in out[0] if r[0] == "o01" and r[1] == 1] == [round(best, 12)]


def test_search_orders_then_limits(spark):
    r = records(spark, [(f"o{i}", f"c{i % 2}", 100 - i, "car", None, i / 10) for i in range(10)])
    q = SearchQuery("q", categories=("car",), min_confidence=0.3, limit=3)
    assert [x.observation_id for x in search(r, q).collect()] == ["o9", "o8", "o7"]
    both = batch_search(r, [q, SearchQuery("none", source_ids=("zz",))])
    assert sorted((x.query_id, x.rank, x.observation_id) for x in both.collect()) == [("q", 1, "o9"), ("q", 2, "o8"), ("q", 3, "o7")]


def test_store_is_idempotent_and_reports_conflicts(spark, tmp_path):
    path = str(tmp_path / "store")
    r = records(spark, [("a", "c", 1, "car", None, 0.5), ("b", "c", 2, "car", None, 0.5)])
    assert store.append(spark, r, path).count() == 0
    assert store.append(spark, r, path).count() == 0
    assert spark.read.parquet(path).count() == 2
    changed = records(spark, [("a", "c", 1, "car", None, 0.6), ("d", "c", 3, "car", None, 0.5)])
    assert [x.observation_id for x in store.append(spark, changed, path).collect()] == ["a"]
    assert sorted(x.observation_id for x in spark.read.parquet(path).collect()) == ["a", "b", "d"]
    flat, attrs = store.flatten(r)
    assert store.audit(flat, attrs).count() == 0


def test_rules_strict_raises(spark):
    r = records(spark, [("a b", "c", 1, "car", None, 0.5)])
    assert rules.check(r, rules.record_rules(), ["observation_id"]).violations.first().rule == "observation_id"
    try:
        rules.check(r, rules.record_rules(), ["observation_id"], strict=True)
        raise AssertionError("no error")
    except rules.RuleViolation:
        pass


def test_best_disjoint_pair_equals_trying_all(spark):
    rng = random.Random(8)
    for _ in range(12):
        rows = [(rng.choice(["negative", "positive"]), f"s{rng.randint(0, 3)}", f"l{rng.randint(0, 3)}", rng.randint(1, 9), f"n{i}") for i in range(14)]
        used = ("l0", "l1")
        pairs = [(-((a[2] not in used) + (b[2] not in used)), a[3] + b[3], max(a[3], b[3]), a[4], b[4]) for a in rows for b in rows
                 if a[0] == "negative" and b[0] == "positive" and a[1] != b[1] and a[2] != b[2]]
        df = spark.createDataFrame(rows, "role string, subject_id string, location_id string, uncompressed_size long, name string")
        got = artifacts.disjoint_pair(df, used).first()
        assert (None if got is None else (got.negative, got.positive)) == (min(pairs)[3:] if pairs else None)


def test_manifest_and_truth_package(spark, tmp_path):
    doc = ('{"samples":[{"sample_id":"a","site_id":"x","camera_id":"c","video_path":"v","start_timestamp_ms":0,"end_timestamp_ms":9,'
           '"authorization_ref":"r","media_sha256":"h","labels":[{"label_id":"l","start_timestamp_ms":1,"end_timestamp_ms":2}]}]}')
    path = tmp_path / "m.json"
    path.write_text(doc)
    samples, labels = manifests.read_samples(spark, str(path))
    assert samples.first().camera_id == "c" and labels.first().label_id == "l"
    path.write_text(doc.replace('"site_id"', '"extra":1,"site_id"'))
    try:
        manifests.read_samples(spark, str(path))
        raise AssertionError("no error")
    except ValueError:
        pass
    pack = '{"schema_version":1,"frames":[{"frame_index":3,"frame_sha256":"h","objects":[{"object_id":"o","category":"person","box":[0.1,0.2,0.3,0.4]}]}]}'
    frames, objects = manifests.parse_truth_packages(spark.createDataFrame([("q", pack)], "sequence_id string, value string"))
    assert frames.first().frame_index == 3 and objects.first().y_max == 0.4


def test_plate_text_rules(spark):
    df = spark.createDataFrame([("ab-1 2",), ("straße",), ("x" * 17,), ("",)], "raw string")
    assert [r[0] for r in df.select(plate_text(F.col("raw"))).collect()] == ["AB12", None, None, ""]
    one = [0.0] * 36 + [1.0]
    a = [1.0] + [0.0] * 36
    d = spark.createDataFrame([([a] * 2 + [one] * 8,), ([one] * 10,), ([a, one, a] + [one] * 7,)], "slots array<array<double>>")
    out = decode_slots(F.col("slots"))
    got = [(r.plate_text, r.rejection_reason) for r in d.select(*[c.alias(n) for n, c in out.items()]).collect()]
    assert got == [("00", None), (None, "blank"), (None, "interior_padding")]
