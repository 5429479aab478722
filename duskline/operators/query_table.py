"""Search where the queries are rows of a table: any number of them in one run.

A query has query_id, start_ms, end_ms, source_ids, categories, track_ids (arrays of strings), plate_text, plate_prefix,
attributes (array of structs with name and value), min_confidence and max_rows. Null or empty members do not constrain.

Every query is filed under the keys of one of its conditions, the one that the fewest records meet: a plate, the first
characters of one, a listed source, category or track, one of its attributes, or the one or two time blocks of its own
length that its window touches. Records meet only the queries filed under their own keys, and the whole condition is then
checked. A record has each key once and a query is filed under one kind of key, so a pair meets at most once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import MAX_TIMESTAMP_MS, Checked, check, duplicates, without
from ..session import durable
from .scale import Columns, fold_sorted, once, rank_limit
from .search import MAX_ATTRIBUTES, MAX_LIMIT, MAX_LIST, ORDER

LISTS = {"source_ids": "source_id", "categories": "category", "track_ids": "track_id"}
#: Prefixes are filed under at most so many characters; a filed query travels whole.
PREFIX = 16
#: Filed queries are broadcast up to so many bytes (of their JSON form), mentioned keys up to so many; beyond, joins shuffle.
BROADCAST_BYTES, BROADCAST_KEYS = 32 << 20, 200_000
#: Combinations of listed values a query is filed under; records in a block, blocks of a key; steps of confidence.
MANY, PER_BLOCK, MAX_BLOCKS, STEPS = 64, 32, 4096, 32
#: Up to so many records times shapes meet in a join; beyond, parts of so many records answer so many queries and give so many rows
#: at once, counted in so many steps of confidence. Bins of time at first.
JOINED = 1 << 20
PART, ASKED, GIVEN, COARSE, BINS = 65_536, 32_768, 1 << 19, 8, 4096


def checked_queries(queries: DataFrame) -> Checked:
    """Queries that can be run, and (query_id, rule) of the others. Of a repeated query_id every row is refused."""
    c = F.col

    def most(name: str, n: int) -> Column:
        return F.coalesce(F.array_size(name), F.lit(0)) <= n

    start, end = F.coalesce("start_ms", F.lit(-MAX_TIMESTAMP_MS)), F.coalesce("end_ms", F.lit(MAX_TIMESTAMP_MS))
    rules = {
        "query_id": c("query_id").isNotNull(),
        "plate": c("plate_text").isNull() | c("plate_prefix").isNull(),
        "max_rows": c("max_rows").between(1, MAX_LIMIT),
        "lists": most("source_ids", MAX_LIST) & most("categories", MAX_LIST) & most("track_ids", MAX_LIST),
        "attributes": most("attributes", MAX_ATTRIBUTES),
        "window": (start <= end) & (start >= -MAX_TIMESTAMP_MS) & (end <= MAX_TIMESTAMP_MS),
        "min_confidence": ~F.isnan(F.coalesce("min_confidence", F.lit(0.0))),
    }
    got = check(queries, rules, ["query_id"])
    again = duplicates(queries.filter("query_id is not null"), ["query_id"])
    return Checked(without(got.clean, again, ["query_id"]),
                   got.violations.unionByName(again.select("query_id", F.lit("repeated").alias("rule"))))


def _key(kind: Column | str, *value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), F.xxhash64(kind, *value).alias("key"))


def _block(ts: Column, level: Column) -> Column:
    return F.call_function("shiftright", ts, level)


def conditions(queries: DataFrame) -> DataFrame:
    """query_id, choice, kind, key: the ways a query can be filed, each with all its keys."""
    def way(choice: Column | str, keys: Column) -> Column:
        return F.struct((F.lit(choice) if isinstance(choice, str) else choice).alias("choice"), F.array_distinct(keys).alias("keys"))

    def listed(column: str, values: Column) -> Column:
        return way(column, F.transform(values, lambda v: _key(column, v)))

    plate, prefix = F.col("plate_text"), F.substring("plate_prefix", 1, PREFIX)
    ways = [F.when(plate.isNotNull(), way("plate", F.array(_key("plate", plate)))),
            F.when(prefix.isNotNull(), way("prefix", F.array(_key(F.concat(F.lit("prefix-"), F.length(prefix)), prefix))))]
    for name, column in LISTS.items():
        ways.append(F.when(F.array_size(name) > 0, listed(column, F.array_compact(name))))
    # The window is shorter than a block, so it touches two at most.
    level = F.length(F.bin(F.col("end_ms") - F.col("start_ms"))).cast("int")
    kind = F.concat(F.lit("time-"), level)
    ways.append(F.when(level.isNotNull(), way("time", F.array(*[_key(kind, _block(F.col(c), level)) for c in ("start_ms", "end_ms")]))))
    ways.append(way("whole", F.array(_key("whole"))))
    attributes = F.transform(F.coalesce("attributes", F.array()), lambda a, i: way(
        F.concat(F.lit("attribute-"), i), F.array(_key("attribute", a["name"], a["value"]))))
    each = F.explode(F.concat(F.array_compact(F.array(*ways)), attributes))
    return queries.select("query_id", each.alias("w")).select("query_id", "w.choice", F.explode("w.keys").alias("k")).select(
        "query_id", "choice", "k.kind", "k.key")


def record_keys(kinds: list[str]) -> Column:
    """All keys of a record of the given kinds, each once."""
    one = [F.when(F.lit(False), _key("whole"))]  # gives the array its type where there are no kinds
    for kind in kinds:
        name, _, n = kind.partition("-")
        if name == "prefix":
            one.append(F.when(F.length("plate_text") >= int(n), _key(kind, F.substring("plate_text", 1, int(n)))))
        elif name == "time":
            one.append(F.when(F.col("timestamp_ms").isNotNull(), _key(kind, _block(F.col("timestamp_ms"), F.lit(int(n))))))
        elif name == "whole":
            one.append(_key(kind))
        elif name != "attribute":
            column = F.col("plate_text" if name == "plate" else name)
            one.append(F.when(column.isNotNull(), _key(kind, column)))
    keys = F.array_compact(F.array(*one))
    if "attribute" in kinds:
        keys = F.concat(keys, F.array_distinct(F.transform(
            F.coalesce("attributes", F.array()), lambda a: _key("attribute", a["name"], a["value"]))))
    return keys


def filed(records: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, kind, key: every query under the condition that the fewest records meet (ties: first by name).

    Counted over all records, for the keys that queries mention only; counts meet map side first."""
    ways = conditions(queries)
    mentioned = ways.select("kind", "key").distinct()
    kinds = [r["kind"] for r in mentioned.select("kind").distinct().collect()]  # a dozen, and at most 64 time levels
    if mentioned.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        mentioned = F.broadcast(mentioned)
    held = records.select(F.explode(record_keys(kinds)).alias("k")).select("k.kind", "k.key")
    counts = held.join(mentioned, ["kind", "key"]).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    best = ways.join(counts, ["kind", "key"], "left").groupBy("query_id", "choice").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_list(F.struct("kind", "key")).alias("keys"))
    return best.groupBy("query_id").agg(F.min_by("keys", F.struct("n", "choice")).alias("keys")).select(
        "query_id", F.explode("keys").alias("k")).select("query_id", "k.kind", "k.key")


def _holds(q: str) -> Column:
    """The whole condition of the query in struct ``q`` on a record; null counts as not met."""
    c = F.col

    def free(name: str, test: Column) -> Column:
        return c(f"{q}.{name}").isNull() | F.coalesce(test, F.lit(False))

    out = free("start_ms", c("timestamp_ms") >= c(f"{q}.start_ms")) & free("end_ms", c("timestamp_ms") <= c(f"{q}.end_ms"))
    for name, column in LISTS.items():
        empty = F.coalesce(F.array_size(f"{q}.{name}"), F.lit(0)) == 0
        out = out & (empty | F.coalesce(F.array_contains(f"{q}.{name}", c(column)), F.lit(False)))
    least = F.coalesce(f"{q}.min_confidence", F.lit(0.0))
    out = out & ((least <= 0) | F.coalesce(c("confidence") >= least, F.lit(False)))
    out = out & free("plate_text", c("plate_text") == c(f"{q}.plate_text"))
    out = out & free("plate_prefix", c("plate_text").startswith(c(f"{q}.plate_prefix")))
    wanted = F.coalesce(F.col(f"{q}.attributes"), F.array())
    return out & F.coalesce(F.forall(wanted, lambda w: F.exists(
        "attributes", lambda a: (a["name"] == w["name"]) & (a["value"] == w["value"]))) | (F.size(wanted) == 0), F.lit(False))


def _bit(column: str, value: Column) -> Column:
    """What a value brings to a key: keys are exclusive ors of such hashes, so records and Python tasks make the same ones."""
    return F.xxhash64(F.lit(column), value)


def together(queries: DataFrame) -> DataFrame:
    """Queries with ``_keys``, the keys of all their equal conditions at once, and ``_shape``, which conditions these are.

    ``_keys`` is null where that is not exact or not worth it: more than ``MANY`` combinations of listed values, more than
    two attributes, attributes with nulls, prefixes that are empty or over ``PREFIX`` characters.
    """
    def with_each(column: str, values: Column):
        return lambda k: F.transform(values, lambda x: k.bitwiseXOR(_bit(column, x)))

    listed = {n: F.coalesce(F.array_size(n), F.lit(0)) > 0 for n in LISTS}
    plate, prefix = F.col("plate_text"), F.col("plate_prefix")
    wanted = F.coalesce("attributes", F.array().cast(queries.schema["attributes"].dataType))
    df = queries.withColumn("_attrs", F.array_sort(F.array_distinct(F.transform(wanted, lambda a: F.xxhash64(a["name"], a["value"])))))
    shape = F.struct(*[listed[n].alias(c) for n, c in LISTS.items()],
                     F.when(plate.isNotNull(), -1).otherwise(F.coalesce(F.length(prefix), F.lit(0))).alias("plate"), F.size("_attrs").alias("attributes"))
    df = once(df.withColumn("_shape", shape), {"_keys": F.array(F.xxhash64(F.col("_shape").cast("string")))})
    size = F.lit(1)
    for name, column in LISTS.items():
        values = F.array_distinct(F.array_compact(name))
        size = size * F.when(listed[name], F.size(values)).otherwise(1)
        df = df.withColumn("_keys", F.when(listed[name], F.flatten(F.transform("_keys", with_each(column, values)))).otherwise(F.col("_keys")))
    text = _bit("plate_text", F.coalesce(plate, prefix))
    df = df.withColumn("_keys", F.when((F.col("_shape.plate") != 0), F.transform("_keys", lambda k: k.bitwiseXOR(text))).otherwise(F.col("_keys")))
    for i in (0, 1):
        df = df.withColumn("_keys", F.when(F.size("_attrs") > i, F.transform("_keys", lambda k: k.bitwiseXOR(F.get("_attrs", F.lit(i))))
                                           ).otherwise(F.col("_keys")))
    known = F.forall(wanted, lambda a: a["name"].isNotNull() & a["value"].isNotNull()) & F.coalesce(prefix != "", F.lit(True))
    exact = known & (size <= MANY) & (F.size("_attrs") <= 2) & (F.col("_shape.plate") <= PREFIX)
    return df.withColumn("_keys", F.when(exact, F.col("_keys"))).drop("_attrs")


def _held_attributes() -> Column:
    held = F.filter(F.coalesce("attributes", F.array()), lambda a: a["name"].isNotNull() & a["value"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(held, lambda a: F.xxhash64(a["name"], a["value"]))))


def postings(records: DataFrame, shapes: list) -> DataFrame:
    """Every record under its keys in every shape: ``_keys`` of a query names just the records that meet its equal conditions."""
    shape = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in z.asDict().items()]) for z in shapes]))
    df = once(records, {"_attrs": _held_attributes()})
    df = df.withColumn("_z", shape)
    z = lambda n: F.col(f"_z.{n}")
    fits = (z("plate") == 0) | F.coalesce(F.length("plate_text") >= z("plate"), F.lit(False))
    key = F.xxhash64(F.col("_z").cast("string"))
    for column in LISTS.values():
        fits = fits & (~z(column) | F.col(column).isNotNull())
        key = F.when(z(column), key.bitwiseXOR(_bit(column, F.col(column)))).otherwise(key)
    text = F.when(z("plate") < 0, F.col("plate_text")).otherwise(F.substring("plate_text", F.lit(1), z("plate")))
    key = F.when(z("plate") != 0, key.bitwiseXOR(_bit("plate_text", text))).otherwise(key)
    df = once(df.filter(fits), {"_k": key})
    pairs = F.flatten(F.transform("_attrs", lambda x, i: F.transform(
        F.slice("_attrs", i + 2, F.size("_attrs")), lambda y: F.col("_k").bitwiseXOR(x).bitwiseXOR(y))))
    each = F.when(z("attributes") == 0, F.array("_k")).when(
        z("attributes") == 1, F.transform("_attrs", lambda x: F.col("_k").bitwiseXOR(x))).otherwise(pairs)
    return df.withColumn("_key", F.explode(each)).drop("_z", "_k", "_attrs")


def stretches(posts: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with their ``_block`` of time, query_id/key/block): the blocks in which a query's first rows surely lie.

    A key's records lie in blocks of about ``PER_BLOCK`` records, ``MAX_BLOCKS`` at most. They are counted by blocks and steps of
    confidence, so it is known after how many blocks ``max_rows`` hits are certain; later blocks cannot hold an earlier hit.
    """
    keys = posts.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("timestamp_ms").alias("_lo"), F.max("timestamp_ms").alias("_hi"))
    parts = F.least(F.greatest(F.floor(F.col("_n") / PER_BLOCK), F.lit(1)), F.lit(MAX_BLOCKS))
    keys = durable(keys.select("_key", F.coalesce("_lo", F.lit(0)).alias("_lo"), F.length(F.bin(F.floor(F.coalesce(
        F.col("_hi") - F.col("_lo"), F.lit(0)) / parts))).alias("_level")))
    few = keys.count() <= BROADCAST_KEYS
    near = F.broadcast(keys) if few else keys
    block = F.coalesce(_block(F.col("timestamp_ms") - F.col("_lo"), F.col("_level")), F.lit(-1))
    placed = posts.join(near, "_key").withColumn("_block", block).drop("_lo", "_level")
    counted = placed.groupBy("_key", "_block", _step(STEPS).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    start, end = F.col("start_ms"), F.col("end_ms")
    asking = queries.select("*", F.explode("_keys").alias("_key")).join(near, "_key").withColumns({
        "_from": F.greatest(_block(start - F.col("_lo"), F.col("_level")), F.lit(0)),
        "_to": _block(end - F.col("_lo"), F.col("_level")), "_inside": start > F.col("_lo")})
    return placed, needed(counted, asking, STEPS)


def _step(steps: int) -> Column:
    """The step of confidence of a record, 0 where it has none."""
    return F.coalesce(F.floor(F.least(F.greatest("confidence", F.lit(0.0)) * steps, F.lit(float(steps)))) + 1, F.lit(0))


def needed(counted: DataFrame, asking: DataFrame, steps: int, extra: Mapping[str, str] = {}) -> DataFrame:
    """_key, _block, query_id and ``extra`` (columns and their types): the blocks in which the first ``max_rows`` rows of a query surely lie.

    ``counted``: _key, _block, _step, _n. ``asking``: a row for every key of a query, with the blocks ``_from`` and ``_to`` that its
    window reaches (null where it is open) and ``_inside``, whether it may begin inside the first; block -1 has the records without time."""
    counted = counted.selectExpr("_key", "0 _turn", "_block", "cast(_step as long) _step", "_n", "cast(0 as long) _to", "cast(0 as long) _sure",
                                 "'' query_id", *[f"cast(0 as {t}) {x}" for x, t in extra.items()])
    start, end, least = F.col("start_ms"), F.col("end_ms"), F.coalesce("min_confidence", F.lit(0.0)) * steps
    asking = asking.select(
        "_key", F.lit(1).alias("_turn"),
        F.when(start.isNotNull(), F.col("_from")).when(end.isNotNull(), 0).otherwise(-1).cast("long").alias("_block"),
        # Steps in which some rows, and those in which all rows, are confident enough.
        F.when(least > 0, F.floor(F.least(least, F.lit(steps))) + 1).otherwise(0).cast("long").alias("_step"),
        F.col("max_rows").cast("long").alias("_n"), F.coalesce("_to", F.lit((1 << 62))).alias("_to"),
        (F.when(least > 0, F.ceil(F.least(least, F.lit(steps + 1))) + 1).otherwise(0) * 2
         + F.coalesce("_inside", F.lit(False)).cast("long")).cast("long").alias("_sure"), "query_id", *extra)

    def take(state: dict, c: Columns) -> Columns | None:
        n = int(np.searchsorted(c["_turn"], 1))
        if n:
            state.setdefault("rows", []).append([c[x][:n] for x in ("_block", "_step", "_n")])
        if n == len(c["_turn"]):
            return None
        if "blocks" not in state:
            if "rows" not in state:  # no record has the key
                return None
            at, step, count = (np.concatenate(x) for x in zip(*state.pop("rows")))
            state["blocks"], place = np.unique(at, return_inverse=True)
            table = np.zeros((steps + 3, len(state["blocks"]) + 1), dtype=np.int64)
            np.add.at(table, (step, place + 1), count)
            state["held"] = np.cumsum(np.cumsum(table[::-1], axis=0)[::-1], axis=1)  # steps from one on, blocks before one
        blocks, held = state["blocks"], state["held"]
        got_row, got_block = [], []
        for row, (at, step, most, to, sure) in enumerate(zip(*(c[x][n:].tolist() for x in ("_block", "_step", "_n", "_to", "_sure")))):
            first, end = np.searchsorted(blocks, at), np.searchsorted(blocks, to, "right")
            if first >= end:
                continue
            whole = first + (sure % 2 and blocks[first] == at)  # the window may begin inside its first block
            certain = held[sure // 2]
            end = min(end, np.searchsorted(certain, certain[whole] + most))
            some = first + np.flatnonzero(np.diff(held[step][first:end + 1]))
            got_row += [n + row] * len(some)
            got_block += blocks[some].tolist()
        return {"_key": np.full(len(got_block), c["_key"][0]), "_block": got_block, **{x: c[x][got_row] for x in ("query_id", *extra)}}

    return fold_sorted(counted.unionByName(asking), ["_key"], ["_turn", "_block"], dict, take, lambda state: None,
                       ", ".join(["_key long, _block long, query_id string", *[f"{x} {t}" for x, t in extra.items()]]))


def _listed(values: Sequence[int]) -> Column:
    """The numbers as one constant array."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<long>)")


def timeline(records: DataFrame, part: int) -> tuple[Callable[[Column], Column], list[int]]:
    """(the slice of a time, the parts of every slice): slices of about ``part`` records that follow one another, from 0 on.

    Times are counted in bins, crowded bins once more in finer ones. What is still more than a part (one moment may hold any number
    of records) has several parts. Records without a time are the last slice, number -1.
    """
    ts = F.col("timestamp_ms")
    quantiles, missing = records.agg(F.percentile_approx(ts, [0.01, 0.99], 1000), F.count_if(ts.isNull())).first()
    lo, hi = quantiles or (0, 0)
    width = (hi - lo) // BINS + 1

    def bin_of(t: Column, low: Column, wide: Column, n: Column) -> Column:
        return F.greatest(F.least(F.floor((t - low) / wide).cast("long"), n - 1), F.lit(0).cast("long"))

    def coarse(t: Column) -> Column:
        return bin_of(t, F.lit(lo), F.lit(width), F.lit(BINS))

    counts = dict(records.filter(ts.isNotNull()).groupBy(coarse(ts)).count().collect())
    finer = [min(-(-8 * counts.get(b, 0) // part), width) or 1 for b in range(BINS)]
    first = [0, *accumulate(finer)]

    def fine(t: Column) -> Column:
        b = coarse(t)
        n = F.get(_listed(finer), b.cast("int"))
        return F.get(_listed(first), b.cast("int")) + bin_of(t, F.lit(lo) + b * F.lit(width), F.ceil(F.lit(width) / n), n)

    counts = dict(records.filter(ts.isNotNull()).groupBy(fine(ts)).count().collect())
    slice_of, sizes = [], [0]
    for b in range(first[-1]):
        n = counts.get(b, 0)
        if sizes[-1] and sizes[-1] + n > part:
            sizes.append(0)
        sizes[-1] += n
        slice_of.append(len(sizes) - 1)
    return (lambda t: F.when(t.isNotNull(), F.get(_listed(slice_of), fine(t).cast("int"))).otherwise(F.lit(-1).cast("long")),
            [max(1, -(-n // part)) for n in (*sizes, missing)])


def _plate(n: int) -> str:
    return "_plate" if n < 0 else f"_plate{n}"


def _values(table: pa.Table, plates: Sequence[int]) -> dict:
    """What the records of a task bring to keys: for every condition hashes and where there are any, attributes as one list."""
    out = {}
    for name in (*[f"_{c}" for c in LISTS.values()], *map(_plate, plates)):
        column = table.column(name)
        out[name] = pc.fill_null(column, 0).to_numpy(), column.is_valid().to_numpy()
    lists = table.column("_attrs").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    out["_attrs"] = lists.flatten().to_numpy(), np.cumsum(size) - size, size
    return out


def keys_in(values: dict, shape: dict, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, positions of the records) in one shape, like ``postings``."""
    attrs, begins, size = values["_attrs"]
    key, fits = np.full(len(size), base), np.ones(len(size), dtype=bool)
    for name in [*[f"_{c}" for c in LISTS.values() if shape[c]], *([_plate(shape["plate"])] if shape["plate"] else [])]:
        key ^= values[name][0]
        fits &= values[name][1]
    for nth in combinations(range(int(size.max(initial=0))), shape["attributes"]):
        at = np.flatnonzero(fits & (size > nth[-1]) if nth else fits)
        yield np.bitwise_xor.reduce([key[at], *[attrs[begins[at] + i] for i in nth]]), at


def search_slices(records: DataFrame, queries: DataFrame, give: Sequence[str]) -> DataFrame:
    """query_id, _most and the columns ``give`` of the records that may be among a query's first rows, cut to ``max_rows`` a task.

    Records travel once to be counted and once to be met, not once for every shape: a task has a part of a slice of time, finds its
    records under the keys that are asked there and answers its share of the queries; where many ask, several tasks have the part.
    Keys are 64-bit hashes of the equal conditions.
    """
    slice_of, parts = timeline(records, PART)
    base = F.xxhash64(F.col("_shape").cast("string")).alias("base")
    shapes = [(r["_shape"].asDict(), r["base"]) for r in queries.select("_shape", base).distinct().collect()]
    plates = sorted({z["plate"] for z, _ in shapes} - {0})
    hashed = {f"_{c}": F.when(F.col(c).isNotNull(), _bit(c, F.col(c))) for c in LISTS.values()}
    for n in plates:
        text = F.col("plate_text") if n < 0 else F.substring("plate_text", 1, n)
        hashed[_plate(n)] = F.when(F.length("plate_text") >= n, _bit("plate_text", text))
    hashed = [v.alias(n) for n, v in {**hashed, "_attrs": _held_attributes()}.items()]

    def of_slice(values: Sequence[int]) -> Column:  # the last value is that of slice -1
        at = F.when(F.col("_block") < 0, len(values) - 1).otherwise(F.col("_block"))
        return F.get(_listed(values), at.cast("int"))

    placed = records.withColumn("_block", slice_of(F.col("timestamp_ms")))
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("observation_id"), of_slice(parts)))

    # The keys that are asked, by shape; tasks know them if they are few.
    wanted = queries.select(base, F.explode("_keys").alias("_key")).distinct().limit(BROADCAST_KEYS + 1).toPandas()
    told = {b: np.sort(g.to_numpy()) for b, g in wanted.groupby("base")["_key"]} if len(wanted) <= BROADCAST_KEYS else None
    steps = COARSE + 3

    def count(table: pa.Table) -> pa.Table:
        values, step = _values(table, plates), table.column("_step").to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        for shape, base in shapes:
            if told is not None and base not in told:
                continue
            for key, at in keys_in(values, shape, base):
                known = told[base] if told is not None else np.unique(key)
                if not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                number = np.bincount(place[hit] * steps + step[at[hit]])
                full = np.flatnonzero(number)
                found.append((known[full // steps], full % steps, number[full]))
        key, step, number = map(np.concatenate, zip(*found))
        return pa.table({"_key": key, "_block": np.full(len(key), table.column("_block")[0].as_py()), "_step": step, "_n": number})

    narrow = placed.select("_block", "_part", _step(COARSE).cast("long").alias("_step"), *hashed)
    counted = narrow.groupBy("_block", "_part").applyInArrow(count, "_key long, _block long, _step long, _n long")
    start, end = F.col("start_ms"), F.col("end_ms")
    asking = queries.select("*", F.explode("_keys").alias("_key")).withColumns({
        "_from": F.when(start.isNotNull(), slice_of(start)), "_to": F.when(end.isNotNull(), slice_of(end)), "_inside": start.isNotNull(),
        "_start": F.coalesce(start, F.lit(-(1 << 62))), "_end": F.coalesce(end, F.lit(1 << 62)),
        "_least": F.coalesce("min_confidence", F.lit(0.0)), "_most": F.col("max_rows").cast("long")})
    visits = durable(needed(counted, asking, COARSE, {"_start": "long", "_end": "long", "_least": "double", "_most": "long"}))

    tasks = [0] * len(parts)
    for r in visits.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.sum("_most").alias("rows")).collect():
        tasks[r["_block"]] = max(-(-r["n"] // ASKED), -(-r["rows"] // GIVEN))
    here = ["_block", "_part", "_task"]
    kept = list(dict.fromkeys([*give, *ORDER, "confidence"]))
    there = placed.withColumn("_tasks", of_slice(tasks)).filter("_tasks > 0").withColumn(
        "_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1))).select(*here, *kept, *hashed)
    asked = visits.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), of_slice(parts) - 1))).withColumn(
        "_task", F.pmod(F.xxhash64("query_id"), of_slice(tasks)))
    types = dict(records.dtypes)
    out = list(dict.fromkeys([*give, *ORDER]))

    def answer(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ORDER], null_placement="at_start"))
        ask, place = np.unique(asked.column("_key").to_numpy(), return_inverse=True)
        maybe = np.zeros(1 << 20, dtype=bool)  # most keys are not asked here
        maybe[ask.view(np.uint64) >> np.uint64(44)] = True
        found = [(np.zeros(0, np.int64),) * 2]
        values = _values(rows, plates) if len(ask) else None
        for shape, base in shapes if len(ask) and rows.num_rows else ():
            for key, at in keys_in(values, shape, base):
                some = maybe[key.view(np.uint64) >> np.uint64(44)]
                key, at = key[some], at[some]
                which = np.minimum(np.searchsorted(ask, key), len(ask) - 1)
                hit = ask[which] == key
                found.append((which[hit], at[hit]))
        which, at = map(np.concatenate, zip(*found))
        order = np.lexsort((at, which))
        which, at = which[order], at[order]
        ends = np.searchsorted(which, np.arange(len(ask) + 1))
        ts = pc.fill_null(rows.column("timestamp_ms"), 0).to_numpy()[at]
        sure = rows.column("confidence").to_numpy()[at].astype(float)
        # Null is never enough, what is not a number always.
        sure = np.where(np.isnan(sure), np.where(rows.column("confidence").is_valid().to_numpy()[at], np.inf, -np.inf), sure)
        got, sizes = [np.zeros(0, np.int64)], []
        for k, start, end, least, most in zip(place.tolist(), *(asked.column(c).to_pylist() for c in ("_start", "_end", "_least", "_most"))):
            a, b = ends[k], ends[k + 1]
            a, b = a + np.searchsorted(ts[a:b], start), a + np.searchsorted(ts[a:b], end, "right")
            if least <= 0:
                one = [np.arange(a, min(b, a + most))]
            else:
                one, n = [], 0
                while a < b and n < most:
                    upto = min(b, a + 4 * most + 16)
                    one.append(a + np.flatnonzero(sure[a:upto] >= least)[:most - n])
                    n, a = n + len(one[-1]), upto
            got += one
            sizes.append(sum(map(len, one)))
        chosen = rows.select(out).take(at[np.concatenate(got)])
        who = asked.select(["query_id", "_most"]).take(np.repeat(np.arange(len(sizes)), sizes))
        return pa.table([*who.columns, *chosen.columns], names=["query_id", "_most", *out])

    schema = ", ".join(["query_id string, _most long", *[f"{c} {types[c]}" for c in out]])
    return there.groupBy(*here).cogroup(asked.groupBy(*here)).applyInArrow(answer, schema)


def search_table(records: DataFrame, queries: DataFrame, give: Sequence[str] | None = None) -> DataFrame:
    """query_id, rank and the record, for the first ``max_rows`` records of every query in order of time, source and id.

    Queries are filed under all their equal conditions at once and under the stretches of time in which their first rows
    surely lie, so broad queries meet few records more than they return. Those that cannot be (``together``) are filed under
    the condition that the fewest records meet. ``give``: the columns of the record that are wanted, by default all.
    """
    names = ["query_id", "start_ms", "end_ms", *LISTS, "plate_text", "plate_prefix", "attributes", "min_confidence", "max_rows"]
    give = list(give or records.columns)
    queries = durable(together(queries.select(*names)))
    plain = queries.filter("_keys is null").select(*names)
    rest = met_by_condition(records, plain, names).select(*give, "query_id", "rank") if plain.limit(1).count() else None
    joint = queries.filter("_keys is not null")
    shapes = [r["_shape"] for r in joint.select("_shape").distinct().collect()]  # kinds of conditions: 432 at most
    if not shapes:
        return rest if rest is not None else met_by_condition(records, plain, names).select(*give, "query_id", "rank")
    if records.count() * len(shapes) > JOINED:
        found = ranked(search_slices(records, joint, give))
    else:
        asked_keys = joint.select(F.explode("_keys").alias("_key")).distinct()
        if asked_keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            asked_keys = F.broadcast(asked_keys)
        placed, stretch = stretches(postings(records, shapes).join(asked_keys, "_key", "left_semi"), joint)
        side = stretch.join(joint.select("query_id", F.struct(*names).alias("_q")), "query_id").drop("query_id")
        found = first_rows(placed.join(side, ["_key", "_block"]).drop("_key", "_block"))
    found = found.select(*give, "query_id", "rank")
    return found if rest is None else found.unionByName(rest)


def first_rows(met: DataFrame) -> DataFrame:
    hits = met.filter(_holds("_q")).withColumn("query_id", F.col("_q.query_id")).withColumn("_most", F.col("_q.max_rows"))
    return ranked(hits.drop("_q"))


def ranked(hits: DataFrame) -> DataFrame:
    first = rank_limit(hits, ["query_id"], [F.col(c) for c in ORDER], MAX_LIMIT)
    return first.filter(F.col("rank") <= F.col("_most")).drop("_most")


def met_by_condition(records: DataFrame, queries: DataFrame, names: list[str]) -> DataFrame:
    """Records are not shuffled while the filed queries fit a broadcast; beyond that they meet in a join on the key, whose hot
    keys Spark splits. Each task keeps ``MAX_LIMIT`` rows of a query before rows move."""
    side = filed(records, queries).join(queries, "query_id").select(
        F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.struct(*names).alias("_q"))
    size = side.select(F.sum(F.length(F.to_json("_q")) + 32)).first()[0] or 0
    kinds = [r["_kind"] for r in side.select("_kind").distinct().collect()]
    met = records.withColumn("_k", F.explode(record_keys(kinds))).join(
        F.broadcast(side) if size <= BROADCAST_BYTES else side, (F.col("_k.key") == F.col("_key")) & (F.col("_k.kind") == F.col("_kind")))
    return first_rows(met.drop("_k", "_key", "_kind"))
