"""Building blocks that keep hot keys spread over many tasks.

A camera, plate or category may hold a large share of all rows, so no window here runs over a whole key. Keys are
cut into time buckets; what a row needs from outside its bucket arrives either as a halo of copied rows (when the
look-back is bounded) or through a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def with_bucket(df: DataFrame, ts: str, bucket_ms: int) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(F.col(ts) / F.lit(bucket_ms)).cast("long"))


def with_halo(df: DataFrame, ts: str, bucket_ms: int, before_ms: int) -> DataFrame:
    """Rows labelled with their own bucket, and again with the next one when in its look-back."""
    if before_ms >= bucket_ms:
        raise ValueError("the halo must be shorter than a bucket")
    own = F.floor(F.col(ts) / F.lit(bucket_ms)).cast("long")
    in_halo = F.col(ts) >= (own + 1) * F.lit(bucket_ms) - F.lit(before_ms)
    return df.withColumn(BUCKET, F.explode(F.when(in_halo, F.array(own, own + 1)).otherwise(F.array(own))))


def bucketed_lead(df: DataFrame, keys: Sequence[str], ts: str, out: str, bucket_ms: int) -> DataFrame:
    """``lead(ts)`` per key over distinct timestamps, without a window spanning the whole key.

    Inside a bucket a plain lead; the last row of a bucket takes the first timestamp of the key's next bucket from
    a table that has one row per (key, bucket).
    """
    b = with_bucket(df, ts, bucket_ms)
    part = [*keys, BUCKET]
    inner = b.withColumn(out, F.lead(ts).over(Window.partitionBy(*part).orderBy(ts)))
    heads = b.groupBy(*part).agg(F.min(ts).alias("_head"))
    nexts = heads.select(
        *part, F.lead("_head").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_next_head"))
    return (
        inner.join(nexts, part, "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_next_head")))
        .drop("_next_head", BUCKET)
    )


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row.

    A plain projection is folded into every later use and every filter pushed below it, so long expressions run many
    times over and outgrow the compiled method; a one-element generator is not folded.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def rank_limit(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each group before the shuffle, so a hot key moves k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """1-based position per key in ``order`` via per-bucket counts; ``bucket`` must be monotone in the order."""
    part = [*keys, BUCKET]
    b = df.withColumn(BUCKET, bucket)
    local = b.withColumn("_local", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    base = b.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(
        *part,
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_base"),
    )
    return local.join(base, part).withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local", BUCKET)


Columns = dict[str, np.ndarray]


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` in one partition, for Python that streams through partitions.

    By a hash of the keys, not the keys themselves: after a join on them Spark leaves a plain repartition out as already
    met, and then, as a Python map asks for nothing, may turn the join into a broadcast that reads its rows where they
    were written, which tears groups apart.
    """
    return df.repartition(F.xxhash64(*keys))


def map_sorted_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      fn: Callable[[Columns], Columns | None], schema: str,
                      spread_by: Sequence[str] | None = None) -> DataFrame:
    """Apply ``fn`` to the rows of every key, in order, as numpy columns.

    Like a grouped map, but a task streams through its sorted partition and hands over array slices, so many small
    groups cost little. Only one group is held at a time; callers keep groups bounded. ``spread_by`` (a prefix of
    ``keys``) keeps groups sharing it in one task, visited in key order; ``fn`` is then a factory called per task.
    """
    keys, names = list(keys), list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = fn() if spread_by is not None else fn
        held: list[Columns] = []  # pieces of the group still open at the end of a batch
        held_key: tuple | None = None
        ready: list[Columns] = []

        def take(cols: Columns) -> None:
            out = call(cols)
            if out is not None:
                ready.append(out)

        def close() -> None:
            take(held[0] if len(held) == 1 else {n: np.concatenate([h[n] for h in held]) for n in names})
            held.clear()

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame({n: np.concatenate([r[n] for r in ready]) for n in ready[0]})
            ready.clear()
            return frame

        for pdf in batches:
            if not len(pdf):
                continue
            cols = {n: pdf[n].to_numpy() for n in names}
            change = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            if held and tuple(cols[k][0] for k in keys) != held_key:
                close()
            for a, b in zip(cuts[:-1], cuts[1:]):
                piece = {n: v[a:b] for n, v in cols.items()}
                if b == len(pdf):
                    held_key = tuple(cols[k][a] for k in keys)
                    held.append(piece)
                elif held:
                    held.append(piece)
                    close()
                else:
                    take(piece)
            if ready:
                yield flush()
        if held:
            close()
        if ready:
            yield flush()

    return (dealt(df, spread_by or keys).sortWithinPartitions(*keys, *[o for o in order if o not in keys])
            .mapInPandas(run, schema))


def map_sorted_stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                         fn: Callable[[Columns, list[int]], Columns | None], schema: str) -> DataFrame:
    """Like ``map_sorted_groups`` for groups of a few rows: ``fn`` gets many whole groups at once, and where each begins
    (with the end of the last)."""
    keys, names = list(keys), list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Columns] = []  # pieces of the group still open at the end of a batch

        def ready(cols: Columns) -> Iterator[pd.DataFrame]:
            change = np.zeros(len(cols[keys[0]]), dtype=bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            out = fn(cols, [0, *np.flatnonzero(change).tolist(), len(change)])
            if out is not None:
                yield pd.DataFrame(out)

        for pdf in batches:
            if not len(pdf):
                continue
            cols = {n: pdf[n].to_numpy() for n in names}
            # The last group may go on in the next batch.
            last = np.ones(len(pdf), dtype=bool)
            for k in keys:
                last &= cols[k] == cols[k][-1]
            cut = len(pdf) - int(last.sum())
            same = bool(held) and all(held[0][k][0] == cols[k][0] for k in keys)
            if cut == 0 and same:
                held.append(cols)
                continue
            whole = [*held, {n: v[:cut] for n, v in cols.items()}]
            if held or cut:
                yield from ready({n: np.concatenate([h[n] for h in whole]) for n in names})
            held = [{n: v[cut:] for n, v in cols.items()}]
        if held:
            yield from ready({n: np.concatenate([h[n] for h in held]) for n in names})

    return (dealt(df, keys).sortWithinPartitions(*keys, *[o for o in order if o not in keys])
            .mapInPandas(run, schema))


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable[[], object],
                take: Callable[[object, Columns], Columns | None], end: Callable[[object], Columns | None],
                schema: str) -> DataFrame:
    """Read the rows of every key in order, slice by slice, with a state per key that ``begin`` makes.

    ``take(state, slice)`` and, after the last slice of a key, ``end(state)`` return output columns or None (of ``end`` the
    key columns are filled in). A task holds one slice and one state, however long a key is.
    """
    keys, names = list(keys), list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = None, None

        def closed() -> Columns | None:
            out = end(state)
            if out is None:
                return None
            size = len(next(iter(out.values())))
            return {**{k: [v] * size for k, v in zip(keys, held)}, **out}

        def together(ready: list[Columns | None]) -> Iterator[pd.DataFrame]:
            """One frame for all keys of a slice: a frame for every key costs far more than its rows."""
            ready = [r for r in ready if r is not None and len(next(iter(r.values())))]
            if len(ready) == 1:
                yield pd.DataFrame(ready[0])
            elif ready:
                yield pd.DataFrame({n: pd.Series(list(chain.from_iterable(r[n] for r in ready)), dtype=object) for n in ready[0]})

        for pdf in batches:
            if not len(pdf):
                continue
            cols = {n: pdf[n].to_numpy() for n in names}
            change = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            ready = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(cols[k][a] for k in keys)
                if key != held:
                    ready.append(closed() if held is not None else None)
                    state, held = begin(), key
                ready.append(take(state, {n: v[a:b] for n, v in cols.items()}))
            yield from together(ready)
        if held is not None:
            yield from together([closed()])

    return (dealt(df, keys).sortWithinPartitions(*keys, *[o for o in order if o not in keys])
            .mapInPandas(run, schema))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, out: str, bucket: int) -> DataFrame:
    """Label each interval with the start of its chain of touching intervals, and the latest end before it.

    The running maximum is taken inside buckets of ``start`` and carried between them through one row per bucket, so
    a busy key is not one window. Adds ``out`` and ``_before`` (NULL for the first interval of a key).
    """
    part = [*keys, BUCKET]
    b = df.withColumn(BUCKET, F.floor(F.col(start) / F.lit(bucket)).cast("long"))
    w = Window.partitionBy(*part).orderBy(start, end)
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy(*part).agg(F.max(end).alias("_m")).select(*part, F.max("_m").over(across).alias("_carry"))
    b = b.join(ends, part).withColumn(
        "_before", F.greatest(F.col("_carry"), F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    opens = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), F.col(start))
    b = b.withColumn("_open", opens)
    heads = b.groupBy(*part).agg(F.max("_open").alias("_o")).select(*part, F.max("_o").over(across).alias("_last"))
    inner = F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return b.withColumn("_in", inner).join(heads, part).withColumn(
        out, F.coalesce(F.col("_in"), F.col("_last"))).drop(BUCKET, "_carry", "_open", "_in", "_last")
