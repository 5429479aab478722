"""Queries as rows of a table against a plain scan."""

import random

from duskline.operators import query_table as qt

RECORD = ("observation_id string, source_id string, timestamp_ms long, category string, confidence double, track_id string, "
          "plate_text string, attributes array<struct<name:string,value:string>>")
QUERY = ("query_id string, start_ms long, end_ms long, source_ids array<string>, categories array<string>, "
         "track_ids array<string>, plate_text string, plate_prefix string, attributes array<struct<name:string,value:string>>, "
         "min_confidence double, max_rows int")


def fits(r, q):
    _, source, ts, category, confidence, track, plate, attributes = r
    _, start, end, sources, categories, tracks, exact, prefix, wanted, least, _ = q
    return ((start is None or ts is not None and ts >= start) and (end is None or ts is not None and ts <= end)
            and all(not want or have in want for have, want in ((source, sources), (category, categories), (track, tracks)))
            and (not least or confidence is not None and confidence >= least) and (exact is None or plate == exact)
            and (prefix is None or plate is not None and plate.startswith(prefix))
            and all(w in (attributes or []) for w in wanted or []))


def made(seed, n_records=600, n_queries=250):
    rng = random.Random(seed)
    maybe = lambda make, share=0.5: make() if rng.random() < share else None
    pair = lambda: (rng.choice("ab"), rng.choice("xyz"))
    some = lambda letter, n: [f"{letter}{rng.randrange(n)}" for _ in range(rng.randrange(3))]
    records = [(f"o{i}", maybe(lambda: f"c{min(rng.randrange(9), 5)}", 0.9), maybe(lambda: rng.randrange(-500, 5000), 0.95),
                rng.choice("pv"), maybe(rng.random, 0.9), maybe(lambda: f"t{rng.randrange(40)}"),
                maybe(lambda: "P" + "Q" * rng.randrange(20) + str(rng.randrange(30))),
                maybe(lambda: [pair() for _ in range(rng.randrange(4))], 0.8)) for i in range(n_records)]
    queries = []
    for i in range(n_queries):
        start, plate = maybe(lambda: rng.randrange(-600, 5000)), rng.random()
        queries.append((f"q{i}", start, maybe(lambda: (start or 0) + rng.choice([0, 1, 63, 900, 9000])),
                        maybe(lambda: some("c", 6), 0.3), maybe(lambda: [rng.choice("pv")], 0.3), maybe(lambda: some("t", 45), 0.2),
                        f"P{rng.randrange(30)}" if plate < 0.1 else None,
                        rng.choice(["", "P", "PQ", "P" + "Q" * 17]) if plate > 0.85 else None,
                        maybe(lambda: [pair() for _ in range(rng.randrange(3))], 0.4), maybe(rng.random, 0.3), rng.choice([1, 5, 1000])))
    return records, queries


def compared(spark, records, queries):
    got = {}
    table = qt.search_table(spark.createDataFrame(records, RECORD), spark.createDataFrame(queries, QUERY))
    for r in table.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.observation_id))
    low = ("",)
    order = lambda r: (low if r[2] is None else ("~", r[2]), low if r[1] is None else ("~", r[1]), r[0])
    for q in queries:
        want = [r[0] for r in sorted((r for r in records if fits(r, q)), key=order)][:q[-1]]
        assert [o for _, o in sorted(got.pop(q[0], []))] == want, q
    assert not got


def test_against_a_plain_scan(spark):
    compared(spark, *made(1))


def test_shuffled_form(spark, monkeypatch):
    monkeypatch.setattr(qt, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(qt, "BROADCAST_KEYS", -1)
    compared(spark, *made(2, 300, 120))


def test_filed_where_fewest_records_are(spark):
    records = [(f"o{i}", "hot", i, "p", 1.0, f"t{i % 50}", None, [("a", "x")]) for i in range(500)]
    q = ("q", 0, 400, ["hot"], ["p"], ["t1", "t2"], None, None, [("a", "x")], None, 9)
    rows = qt.filed(spark.createDataFrame(records, RECORD), spark.createDataFrame([q], QUERY)).collect()
    assert [r.kind for r in rows] == ["track_id"] * 2
    compared(spark, records, [q])
    compared(spark, [], [q])
    compared(spark, records, [])


def test_refused_queries(spark):
    base = ("q", None, None, None, None, None, None, None, None, None, 5)

    def but(query_id, **more):
        names = [c.strip().split(" ")[0] for c in QUERY.split(", ")]
        return tuple({**dict(zip(names, base)), "query_id": query_id, **more}[n] for n in names)

    rows = [but("ok"), but(None), but("plates", plate_text="A", plate_prefix="B"), but("none", max_rows=0), but("many", max_rows=1001),
            but("list", source_ids=["a"] * 257), but("attrs", attributes=[("a", "b")] * 33), but("turned", start_ms=2, end_ms=1),
            but("nan", min_confidence=float("nan")), but("twice"), but("twice", max_rows=7), but("open", end_ms=-5)]
    got = qt.checked_queries(spark.createDataFrame(rows, QUERY))
    assert sorted(r.query_id for r in got.clean.collect()) == ["ok", "open"]
    assert {(r.query_id, r.rule) for r in got.violations.collect()} == {
        (None, "query_id"), ("plates", "plate"), ("none", "max_rows"), ("many", "max_rows"), ("list", "lists"),
        ("attrs", "attributes"), ("turned", "window"), ("nan", "min_confidence"), ("twice", "repeated")}
