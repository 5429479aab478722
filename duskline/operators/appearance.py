"""Ranking by histogram intersection between appearance descriptors.

Probes and candidates meet in blocks: both sides are split into hash blocks per comparison group, and every block pair
keeps only the best rows per probe. Nothing is broadcast, no pair list is written, and a group holding a large share
of the rows is spread over many block pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import rank_limit

GROUP = ("category", "kind", "dims")
# The refused categories and the rounding tolerance of L1-normalised descriptors.
REFUSED = ("face", "license_plate")
TOLERANCE = 1e-9
#: Probes that meet a block of candidates at once.
PROBES = 16


def admissible(desc: DataFrame) -> DataFrame:
    """Descriptors that may be compared: allowed category, 2..512 finite non-negative values summing to one."""
    total = F.aggregate("vals", F.lit(0.0), lambda s, v: s + v)
    bad = F.exists("vals", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")))
    ok = ~F.col("category").isin(*REFUSED) & F.size("vals").between(2, 512) & ~bad & (
        F.abs(total - 1.0) <= TOLERANCE)
    df = desc if "kind" in desc.columns else desc.withColumn("kind", F.lit("colour_histogram"))
    return df.filter(ok).withColumn("dims", F.size("vals"))


def similarities(probes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Intersections of all probes (a row each) with all candidates (a column each), summed dimension by dimension."""
    out = np.zeros((len(probes), columns.shape[1]))
    least = np.empty_like(out)
    for values, column in zip(probes.T, columns):
        np.minimum(values[:, None], column, out=least)
        out += least
    out[(out > 1.0) & (np.abs(out - 1.0) <= TOLERANCE)] = 1.0
    return out


def first_of(values: np.ndarray, limit: int | None) -> np.ndarray:
    """Places of the largest values in falling order, equal ones as they stand; all without a limit."""
    if limit is None or len(values) <= limit:
        return np.argsort(-values, kind="stable")
    few = np.flatnonzero(values >= np.partition(values, len(values) - limit)[len(values) - limit])
    return few[np.argsort(-values[few], kind="stable")[:limit]]


def _blocks(side: DataFrame, rows: int, out: str) -> DataFrame:
    return side.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(out))


def rank_similarity(probes: DataFrame, candidates: DataFrame, min_similarity: float = 0.0, limit: int = 100,
                    block_rows: int = 2048, until: str | None = None) -> DataFrame:
    """Per probe the best candidates of its group: similarity desc, then time, source and id; never itself.

    ``until``: a column of both sides. Candidates beyond the limit then follow up to the first that has the probe's value
    there, whatever its rank, and ``hit`` tells which have it. A block gives its rows up to its own first one: what comes
    before the first of all is among them.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie in 1..1000")
    p, c = admissible(probes), admissible(candidates)
    grid = _blocks(p, block_rows, "_np").join(_blocks(c, block_rows, "_nc"), list(GROUP))

    def spread(side: DataFrame, mine: str, other: str, mine_n: str, other_n: str) -> DataFrame:
        return (
            side.join(grid, list(GROUP))
            .withColumn(mine, F.pmod(F.xxhash64("observation_id"), F.col(mine_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        )

    mark = F.col(until) if until else F.lit(0)
    pb = spread(p, "_pb", "_cb", "_np", "_nc").select(*GROUP, "_pb", "_cb", "observation_id", "vals", mark.alias("mark"))
    cb = spread(c, "_cb", "_pb", "_nc", "_np").select(
        *GROUP, "_pb", "_cb", "observation_id", "timestamp_ms", "source_id", "vals", mark.alias("mark"))
    keys = [*GROUP, "_pb", "_cb"]
    # Fresh names on the right: both sides may come from one table.
    cb = cb.select(*[F.col(k).alias("r" + k) for k in keys], *[c for c in cb.columns if c not in keys])
    cb = cb.select(*[F.col(c).alias(c if c.startswith("r") else "c_" + c) for c in cb.columns])

    # A number of its own: block pairs are few bytes and much work, and adaptive execution would put them all into one task.
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pb, cb = pb.repartition(tasks, *keys), cb.repartition(tasks, *["r" + k for k in keys])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ("probe_id", "candidate_id", "similarity", "timestamp_ms", "source_id", "hit")
        out: list[list[np.ndarray]] = [[np.empty(0, dtype=t)] for t in (object, object, float, np.int64, object, bool)]
        if len(left) and len(right):
            right = right.sort_values(["c_timestamp_ms", "c_source_id", "c_observation_id"])
            dims = np.ascontiguousarray(np.stack(right["c_vals"].to_numpy()).T)
            ids, sources = (right[c].to_numpy(dtype=object) for c in ("c_observation_id", "c_source_id"))
            times = right["c_timestamp_ms"].to_numpy()
            marks = right["c_mark"].to_numpy()
            wanted = None if until else limit
            rows = zip(left["observation_id"], left["mark"])
            for at in range(0, len(left), PROBES):
                every = similarities(np.stack(left["vals"].iloc[at:at + PROBES].to_numpy()), dims)
                enough = (every >= min_similarity) | (np.abs(every - min_similarity) <= TOLERANCE)
                for acc, good, (pid, own) in zip(every, enough, rows):
                    keep = np.flatnonzero(good & (ids != pid))
                    best = keep[first_of(acc[keep], wanted)]
                    hit = marks[best] == own
                    last = (hit.argmax() + 1 if hit.any() else len(hit)) if until else 0
                    best, hit = best[:max(limit, last)], hit[:max(limit, last)]
                    found = (np.full(len(best), pid, dtype=object), ids[best], acc[best], times[best], sources[best], hit)
                    for column, part in zip(out, found):
                        column.append(part)
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, out)})

    pairs = pb.groupBy(*keys).cogroup(cb.groupBy(*["r" + k for k in keys])).applyInPandas(
        score, "probe_id string, candidate_id string, similarity double, timestamp_ms long, source_id string, hit boolean")
    order = [F.desc("similarity"), F.col("timestamp_ms"), F.col("source_id"), F.col("candidate_id")]
    if not until:
        return rank_limit(pairs.drop("hit"), ["probe_id"], order, limit)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("probe_id").orderBy(*order)))
    first = F.min(F.when(F.col("hit"), F.col("rank"))).over(Window.partitionBy("probe_id"))
    return ranked.withColumn("_first", first).filter(F.col("rank") <= F.greatest(F.lit(limit), "_first")).drop("_first")


def benchmark_cases(ranked: DataFrame, cases: DataFrame, relevance: DataFrame, k: int = 5,
                    counts: DataFrame | None = None) -> DataFrame:
    """Precision and recall at k, reciprocal rank and top-1 per probe; undefined precision counts as zero.

    ``cases``: probe_id, candidate_count. ``relevance``: probe_id, candidate_id of relevant candidates.
    ``counts``: probe_id, relevant_count, where the ranking and ``relevance`` go no further than rank k and the first
    relevant rank; probes without a relevant candidate are left out.
    """
    rel = relevance.select("probe_id", "candidate_id").distinct()
    if counts is None:
        counts = rel.groupBy("probe_id").agg(F.count(F.lit(1)).alias("relevant_count"))
    hit = F.col("_r").isNotNull()
    per = (
        ranked.join(rel.withColumn("_r", F.lit(1)), ["probe_id", "candidate_id"], "left")
        .groupBy("probe_id").agg(
            F.count_if(F.col("rank") <= k).alias("retrieved_count"),
            F.count_if((F.col("rank") <= k) & hit).alias("relevant_retrieved"),
            F.min(F.when(hit, F.col("rank"))).alias("_first")))
    base = cases.join(counts, "probe_id").join(per, "probe_id", "left").na.fill(
        0, ["retrieved_count", "relevant_retrieved"])
    return base.select(
        "probe_id", "candidate_count", "relevant_count", "retrieved_count", "relevant_retrieved",
        F.when(F.col("retrieved_count") > 0, F.col("relevant_retrieved") / F.col("retrieved_count")).otherwise(0.0)
        .alias("precision_at_k"),
        (F.col("relevant_retrieved") / F.col("relevant_count")).alias("recall_at_k"),
        F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("_first") == 1, F.lit(False)).alias("top1_relevant"))


def benchmark_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.avg("precision_at_k").alias("mean_precision_at_k"),
        F.avg("recall_at_k").alias("mean_recall_at_k"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.avg(F.col("top1_relevant").cast("double")).alias("top1_rate"))
