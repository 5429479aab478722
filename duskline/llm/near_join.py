"""N-gram Jaccard join with count vectors: links documents whose word shingles are nearly the same sets.

Every shingle is hashed into one of GROUPS groups; the counts of a document's distinct shingles per group are a point.
Two sets share at most the sum of the coordinate minima of their points.

* Equal sets are one document from the start.
* Routing: two sets that link differ in at most r shingles, so of r + 1 or more finer blocks of groups at most r differ. A
  block's counts, hashed, are a bucket key; the number of blocks follows from the size class.
* Only keys of different sets count. A set of f keys of which its links can disturb r must find f - r of its keys elsewhere,
  or it links with nothing and goes (``viable``). Of the s keys that it does find, the s - (f - r) + 1 that the fewest sets
  have are enough: of any two sets that link, the one that keeps keys up to the higher frequency has all the other
  one's shared keys. So very common keys are not followed, and nothing that links is lost.
* The first set of each bucket leads it. Pairs (leader, member) pass the minima bound or go; survivors are verified on
  their shingles. A cluster, however large, is joined up by about as many pairs as it has members.
* What leaders did not join: members of one leader outside its component are searched for among all its members, in
  R-trees over their points in blocks of bounded size; a node's upper corner bounds the overlap of a query with all it
  holds. Survivors are verified in the same task, and only links between different components come out.

Shingles and sets are known by 64-bit hashes; blocks and verification work on them. Texts are read three times rather than
writing keys and shingles of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bit_table, filled, packed, possibly_in, released, resolved, stored, with_group
from .components import components

#: Coordinates of a point; growth of a size class; most targets and queries of one block of a tree search; rows to a batch.
GROUPS, CLASS_GROWTH, LEAF_ROWS, QUERY_ROWS, ROWS = 64, 1.5, 16_384, 16_384, 256
#: Shingles to a block of a tree search (8 bytes each): bounds its rows where sets are large.
BLOCK_SHINGLES = 2_000_000
#: Members that meet one copy of their leader's shingles.
LED_ROWS = 1000
FAN_OUT = 16  # points in a node of the tree, nodes in the one above

U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _times(n: int, i: int) -> np.ndarray:
    """n times a fixed odd number, as an array of one."""
    return np.array([n], U) * _ODD[i]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and where each text's words begin (one more than texts)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(~inside & before)
    text_at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    bounds = np.searchsorted(starts, text_at)
    if not len(starts):
        return np.zeros(0, U), bounds
    length = ends - starts
    power = np.ones(int(length.max()), U)
    power[1:] = _ODD[0]
    power = np.multiply.accumulate(power)
    total = int(length.sum())
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    offset = np.arange(total) - np.repeat(first, length)
    value = (data[inside].astype(U) + U(1)) * power[offset]
    return mixed(np.add.reduceat(value, first) + length.astype(U) * _ODD[1]), bounds


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    hashes, bounds = word_hashes(texts)
    count = len(hashes)
    joint = np.zeros(max(0, count - words + 1), U)
    for i in range(words):
        joint += mixed(hashes[i:count - words + 1 + i] + _ODD[2]) * _ODD[3] * U(2 * i + 1) + hashes[i:count - words + 1 + i] * _ODD[i % 8]
    joint = mixed(joint)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(joint[a:b - words + 1])
        elif b > a:
            few = hashes[a:b]
            yield mixed(np.sum(mixed(few + _ODD[4]) * (np.arange(b - a, dtype=U) * U(2) + U(1)), keepdims=True)
                        + _times(b - a, 5))
        else:
            yield np.zeros(0, U)


class Classes:
    """Size classes and how many blocks a pair whose larger set is in a class needs."""

    def __init__(self, percent: int):
        if not 50 < percent < 100:
            raise ValueError("percent must lie between 50 and 100")
        if CLASS_GROWTH * percent <= 100:
            raise ValueError("classes must be wider than the size ratio of a link")
        self.percent, self.low = percent, [1]

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * CLASS_GROWTH)))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, blocks, needed) for each class of which a set of n shingles may meet a pair. ``needed``: of so many blocks
        that are not empty in this set, one is equal in any set that links with it. Classes in which sets link only when
        equal need no routing. A few blocks more than any pair can differ in make up for empty ones."""
        self._grow(n)
        c = next(i for i in range(len(self.low) - 1, -1, -1) if self.low[i] <= n)
        self._grow(self.low[c + 1])
        meets = [c] + ([c + 1] if 100 * n >= self.percent * self.low[c + 1] else [])
        out = []
        for m in meets:
            top = self.low[m + 1] - 1
            differ = 2 * top * (100 - self.percent) // (100 + self.percent)
            own = (n + min(top, 100 * n // self.percent)) * (100 - self.percent) // (100 + self.percent)
            if differ:
                out.append((m, differ + 3 + differ // 32, own + 1))
        return out


def set_id(shingles: np.ndarray) -> int:
    """One 64-bit number for a whole set."""
    whole = np.sum(mixed(shingles + _ODD[6]), keepdims=True) + _times(len(shingles), 7)
    return int(mixed(whole).view(np.int64)[0])


def class_keys(shingles: np.ndarray, classes: Classes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, need, keys): the counts of a block's groups, hashed with the class and the block, are a key; a set that links
    with this one in the class has at least ``need`` of the keys.

    Empty blocks are alike in many sets and say little; they get keys only in a set that has too few others. Of two sets
    that link, one with enough others shares them with the other, and two without share some block of either kind.
    """
    spread = mixed(shingles ^ _ODD[5])
    content = mixed(shingles + _ODD[4])
    for c, k, needed in classes.of(len(shingles)):
        block = (spread % U(k)).astype(np.int64)
        sums = np.zeros(k, U)
        np.add.at(sums, block, content)
        every = mixed(sums + np.arange(k, dtype=U) * _ODD[1] + _times(c + 1, 2))
        filled_blocks = np.bincount(block, minlength=k) > 0
        extra = int(filled_blocks.sum()) - needed
        yield (c, extra + 1, every[filled_blocks].view(np.int64)) if extra >= 0 else (c, 1, every.view(np.int64))


def bucket_keys(shingles: np.ndarray, classes: Classes) -> np.ndarray:
    """The keys of all classes."""
    keys = [k for _, _, k in class_keys(shingles, classes)]
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def point(shingles: np.ndarray) -> np.ndarray:
    """Shingles per group."""
    return np.bincount((shingles >> U(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def _per_batch(texts: DataFrame, words: int, schema: str, make) -> DataFrame:
    """``make(batch, sets)`` for ROWS rows at a time; ``texts`` has a column text without nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield make(part, list(shingle_sets(part.column("text").to_pylist(), words)))

    return texts.mapInArrow(run, schema)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def described(docs: DataFrame, words: int) -> DataFrame:
    """All columns but the text, n (shingles) and fp (id of the set) per row."""
    kept = [c for c in docs.columns if c != "text"]
    types = dict(docs.dtypes)

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in kept], pa.array([len(s) for s in sets], pa.int64()),
             pa.array([set_id(s) for s in sets], pa.int64())], names=[*kept, "n", "fp"])

    return _per_batch(docs.select(*kept, filled("text").alias("text")), words,
                      f"{', '.join(f'`{c}` {types[c]}' for c in kept)}, n long, fp long", make)


def keyed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """fp, class, need, key: the routing keys of every row's set."""
    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        classes = Classes(percent)
        rows = [(set_id(s), c, need, keys) for s in sets if len(s) for c, need, keys in class_keys(s, classes)]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))],
             _lists([r[3] for r in rows], np.int64)], names=["fp", "class", "need", "keys"])

    return _per_batch(docs.select(filled("text").alias("text")), words, "fp long, class int, need int, keys array<long>",
                      make).select("fp", "class", "need", F.explode("keys").alias("key"))


def shingles_of(texts: DataFrame, words: int) -> DataFrame:
    """fp, n, point, shingles per row."""
    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             _lists([point(s) for s in sets], np.int32), _lists([s.view(np.int64) for s in sets], np.int64)],
            names=["fp", "n", "point", "shingles"])

    return _per_batch(texts.select(filled("text").alias("text")), words,
                      "fp long, n long, point array<int>, shingles array<long>", make)


def may_link(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """100 * shared >= percent * union."""
    return (100 + percent) * shared >= percent * (n + m)


class CountTree:
    """R-tree over count vectors, packed by size and heaviest coordinates; a node keeps its upper corner and its least
    set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        spread = np.argsort(-points.std(axis=0))[:3] if len(points) else []
        self.order = np.lexsort([*(points[:, c] for c in spread), sizes])
        level, least = points[self.order].astype(np.int64), sizes[self.order].astype(np.int64)
        self.levels = [(level, least)]
        while len(level) > FAN_OUT:
            cuts = np.arange(0, len(level), FAN_OUT)
            level, least = np.maximum.reduceat(level, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((level, least))

    def search(self, query: np.ndarray, size: int) -> np.ndarray:
        """Rows whose points may share enough with the query."""
        upper, _ = self.levels[-1]
        nodes = np.arange(len(upper))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            shared = np.minimum(upper[nodes], query).sum(axis=1)
            nodes = nodes[(100 + self.percent) * shared >= self.percent * (size + least[nodes])]
            if depth:
                nodes = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def viable(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, fp) of the sets that may link, each with the rarest of its keys, as many as cannot all be disturbed."""
    routed = keyed(docs, words, percent)
    # One shuffle of all keys finds those of different sets; only rows that may hold one are shuffled again.
    shared = stored(routed.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last"))
                    .filter("first < last").select("key"))
    met = possibly_in(routed, F.col("key"), bit_table(shared, F.col("key"))).filter("maybe").drop("maybe")
    every = stored(met.join(shared, "key").dropDuplicates(["key", "fp"]).select("fp", "class", "need", "key"))
    able = every.groupBy("fp", "class", "need").agg(F.count(F.lit(1)).alias("found")).filter("found >= need")
    met = stored(every.join(able.select("fp", "class"), ["fp", "class"], "left_semi"))
    released(shared, every)
    # Sets that went leave keys behind that only one set still has.
    met = with_group(met, "key", {"sets": ("sum", F.lit(1))}).filter("sets > 1")
    of_set = Window.partitionBy("fp", "class")  # at most the keys of one set
    place = F.row_number().over(of_set.orderBy("sets", "key"))
    ranked = met.select("key", "fp", "need", place.alias("place"), F.count(F.lit(1)).over(of_set).alias("found"))
    return ranked.filter("found >= need and place <= found - need + 1").select("key", "fp")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (lead, fp) that link, as (a, b). Every member's shingles travel to its leader; a leader's go out once for
    LED_ROWS members."""
    point = sets.select("fp", "n", "point")
    least = F.aggregate(F.zip_with("point", "lp", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    lead_point = point.select(F.col("fp").alias("lead"), F.col("n").alias("ln"), F.col("point").alias("lp"))
    close = pairs.join(point, "fp").join(lead_point, "lead").filter(may_link(least, F.col("n"), F.col("ln"), percent))
    sized = with_group(close.select("lead", "fp"), "lead", {"size": ("sum", F.lit(1))})
    salted = stored(sized.select("lead", "fp", F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / LED_ROWS)).alias("salt")))
    heads = salted.select("lead", "salt").distinct().join(
        sets.select(F.col("fp").alias("lead"), F.col("shingles").alias("led_by")), "lead")
    met = salted.join(sets.select("fp", "shingles"), "fp").join(heads, ["lead", "salt"])
    shared = F.size(F.array_intersect("shingles", "led_by"))
    return met.filter(may_link(shared, F.size("shingles"), F.size("led_by"), percent)).select(
        F.col("lead").alias("a"), F.col("fp").alias("b"))


def searched(asked: pd.DataFrame, held: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Pairs of different roots whose rows link, few enough to join all roots that links join."""
    points, sizes = np.stack(held["point"].to_numpy()), held["n"].to_numpy()
    tree = CountTree(points, sizes, percent)
    fp, root = held["fp"].to_numpy(), held["root"].to_numpy()
    sets = held["shingles"].to_numpy()
    joined: dict[int, int] = {}

    def find(r: int) -> int:
        while joined.get(r, r) != r:
            r = joined[r]
        return r

    out = []
    for x, r, n, at, mine in zip(asked["fp"], asked["root"], asked["n"], asked["point"], asked["shingles"]):
        hit = tree.search(np.asarray(at), n)
        hit = hit[(root[hit] != r) & (fp[hit] != x)]
        if not len(hit):
            continue
        # All survivors at once: which of their shingles are among this set's (both sorted as unsigned numbers).
        mine = np.sort(mine)
        every = np.concatenate(sets[hit])
        place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        starts = np.concatenate([[0], np.cumsum(sizes[hit])[:-1]])
        shared = np.add.reduceat((mine[place] == every).astype(np.int64), starts)
        for i in hit[(100 + percent) * shared >= percent * (n + sizes[hit])].tolist():
            mine_root, other = find(int(r)), find(int(root[i]))
            if mine_root != other:
                joined[mine_root] = other
                out.append((int(r), int(root[i])))
    return out


def _left_over(led: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that links between members of one leader join."""
    of_root = roots.select(F.col("id").alias("fp"), "root")
    members = led.unionByName(led.select("lead", F.col("lead").alias("fp")).distinct()).join(sets.select("fp", "n"), "fp")
    members = members.join(of_root, "fp", "left").select("lead", "fp", "n", F.coalesce("root", "fp").alias("root"))
    main = F.when(F.col("lead") == F.col("fp"), F.col("root"))
    members = with_group(members, "lead", {"size": ("sum", F.lit(1)), "main": ("max", main), "largest": ("max", F.col("n")),
                                           "r0": ("min", F.col("root")), "r1": ("max", F.col("root"))}).filter("r0 <> r1")
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) / F.col("largest")))
    members = stored(members.select(
        "lead", "fp", "root", "main", F.ceil(F.col("size") / F.least(most, F.lit(LEAF_ROWS))).cast("int").alias("held_blocks"),
        F.ceil(F.col("size") / F.least(most, F.lit(QUERY_ROWS))).cast("int").alias("asked_blocks")))
    rows = members.join(sets, "fp")
    kept = ["lead", "fp", "root", "n", "point", "shingles"]

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    held = rows.select(*kept, F.lit(False).alias("asks"), F.pmod(F.xxhash64("fp"), F.col("held_blocks")).cast("int").alias("held"),
                       every("asked_blocks").alias("asked"))
    asked = rows.filter("root <> main").select(
        *kept, F.lit(True).alias("asks"), every("held_blocks").alias("held"),
        F.pmod(F.xxhash64("fp", F.lit(1)), F.col("asked_blocks")).cast("int").alias("asked"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy()
        out = searched(block[asks], block[~asks], percent) if asks.any() and not asks.all() else []
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return held.unionByName(asked).groupBy("lead", "held", "asked").applyInPandas(search, "a long, b long")


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per row: the smallest doc_id that links reach, itself included.

    A document's set are the distinct runs of ``words`` words, A-Z lower-cased; fewer words are one run as a whole.
    Documents link when 100 times the shared runs is at least ``percent`` times the runs of either. Null text and text
    without words have no runs and link with nothing. Repeated rows link like any equal texts; a null doc_id gives way
    to any number, and a component of null ids only has null. An empty table gives an empty result.
    """
    base, met = grouped(docs.select("doc_id", "text"), words, percent)
    whole = stored(with_group(met, "root", {"component": ("min", F.col("doc_id"))}).select("fp", "component"))
    alone = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return base.select("doc_id", "n", "fp").join(whole, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), alone.cast("long").alias("component_id"))


def grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What ``described`` tells of the rows, and fp, doc_id (the smallest), root of the sets that are linked or have
    several rows."""
    base = stored(described(docs, words))
    per_set = base.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    met = stored(viable(docs, words, percent))
    leads = met.groupBy("key").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    led = stored(met.join(leads, "key").filter("fp <> lead").select("lead", "fp").distinct())
    ends = stored(led.select("fp").unionByName(led.select(F.col("lead").alias("fp"))).distinct())
    ids = per_set.join(ends, "fp", "left_semi").select("doc_id")
    texts = possibly_in(docs.select("doc_id", "text"), F.xxhash64("doc_id"), bit_table(ids, F.xxhash64("doc_id")))
    sets = stored(shingles_of(texts.filter("maybe"), words).dropDuplicates(["fp"]).join(ends, "fp", "left_semi"))
    edges = stored(_links(led, sets, percent))
    roots = components(edges)
    released(met, edges)
    more = stored(_left_over(led, sets, roots, percent))
    if not more.isEmpty():
        step = components(more).select(F.col("id").alias("root"), F.col("root").alias("then"))
        alone = step.join(roots.select(F.col("id").alias("root")), "root", "left_anti")
        roots = roots.join(step, "root", "left").select("id", F.coalesce("then", "root").alias("root")).unionByName(
            alone.select(F.col("root").alias("id"), F.col("then").alias("root")))
    # Back to the rows: sets that are linked or have several rows have a component, all others are on their own.
    found = per_set.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left")
    return base, found.filter("root is not null or rows > 1").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, bound: int = BROADCAST_IDS) -> DataFrame:
    """One row of each component, and every row that links with none, with all columns.

    Rows are told apart by doc_id and text. Of a component the row with the smallest doc_id stays, a null doc_id only
    where there is no other; of several such rows the one with the least hash of its text, and of equal rows one. So
    what happens to a row says nothing about others of its doc_id, or about others without one. Columns of any name
    are allowed; null and empty texts stay; an empty table gives an empty result.
    """
    rows = packed(docs).withColumn("of", F.xxhash64("text"))
    base, met = grouped(rows.select("doc_id", "text", "of"), words, percent)
    sets = base.filter("n > 0").select("doc_id", "of", "fp").join(met.select("fp", "root"), "fp")
    sets = sets.groupBy("root", "doc_id", "of").agg(F.count(F.lit(1)).alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("of").alias("of"))
    judged = with_group(sets, "root", {"first": ("min", first)})
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("of") == F.col("first.of"))
    judged = stored(judged.select("doc_id", "of", "rows", stays.alias("stays")))
    return resolved(rows, judged.filter("not stays or rows > 1"), "of", bound)
