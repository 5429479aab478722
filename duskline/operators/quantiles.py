"""Exact medians and percentiles of groups of any size: value ranges are counted first, then ranks looked up inside the
few ranges that hold a wanted position. No task holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the different values of a group are cut into, accuracy of the sketch that cuts them (it only balances the
#: ranges), and parts (a power of 2) that a group's values are dealt to while they meet their cuts.
RANGES, ACCURACY, SALTS = 64, 10_000, 64


def _position(how: str, fraction: float, total: Column) -> Column:
    """Place in the sorted group, from 0; between two rows for interpolated percentiles."""
    if how == "nearest":
        return F.greatest(F.ceil(F.lit(fraction) * total) - 1, F.lit(0)).cast("double")
    if how == "between":
        return F.lit(fraction) * (total - 1)
    raise ValueError(f"unknown percentile {how}")


def with_order_statistics(groups: DataFrame, rows: DataFrame, keys: Sequence[str], value: str,
                          wanted: Mapping[str, tuple[str, float]], ranges: int = RANGES) -> DataFrame:
    """Add exact order statistics of ``rows`` to ``groups``, which has one row per ``keys``; a group without values gets NULL."""
    found = _found(rows, keys, value, wanted, ranges).drop("_total")
    return groups.withColumn("_k", _key(keys)).join(found, "_k", "left").drop("_k")


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[str, float]],
                     ranges: int = RANGES) -> DataFrame:
    """``keys``, n (values that are not null) and the statistics, for groups that have values; ``rows`` are read once."""
    found = _found(rows, keys, value, wanted, ranges)
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], F.col("_total").alias("n"), *wanted)


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _found(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[str, float]], ranges: int) -> DataFrame:
    """_k (the keys as a struct), _total and the statistics.

    ``wanted``: name -> (how, fraction). ``nearest`` takes the least value that so large a share of the rows does not
    exceed, in the type of the column; ``between`` interpolates between neighbours (0.5 is the median), as a double. Null
    values do not count. Null keys are a group like any other.
    """
    kind = dict(rows.dtypes)[value]
    values = rows.filter(F.col(value).isNotNull()).select(_key(keys).alias("_k"), F.col(value).alias("_v")).groupBy("_k", "_v").agg(
        F.count(F.lit(1)).alias("_n"))

    # Cuts go out once per salt, so a group with most of the values meets them in many tasks. All branches share the exchange
    # of the counts: this one reads them too, and a salt that cannot be null puts no filter of its own below them.
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = values.filter("_n > 0").groupBy("_k").agg(F.percentile_approx("_v", shares, ACCURACY).alias("_cuts")).select(
        "_k", "_cuts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = values.withColumn("_salt", F.hash("_v").bitwiseAND(SALTS - 1))
    placed = salted.join(cuts, ["_k", "_salt"]).select(
        "_k", "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))

    # At most ``ranges`` rows of a group meet in this window.
    along = Window.partitionBy("_k").orderBy("_range")
    counted = placed.groupBy("_k", "_range").agg(F.sum("_n").alias("_rows")).select(
        "_k", "_range", "_rows", (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_k")).alias("_total"))
    spots = []
    for name, (how, fraction) in wanted.items():
        at = _position(how, fraction, F.col("_total"))
        spots += [F.struct(F.lit(name).alias("name"), at.alias("at"), F.lit(upper).alias("upper"),
                           (F.ceil(at) if upper else F.floor(at)).alias("rank")) for upper in (False, True)]
    spots = counted.withColumn("_spot", F.explode(F.array(*spots))).select(
        "_k", "_range", "_rows", "_total", "_spot.*", (F.col("_spot.rank") - F.col("_before")).alias("_offset")).filter(
        "_offset >= 0 and _offset < _rows").select("_k", "_range", "_total", "name", "at", "upper", "_offset")

    held = placed.join(spots.select("_k", "_range").distinct(), ["_k", "_range"], "left_semi")
    upto = F.sum("_n").over(Window.partitionBy("_k", "_range").orderBy("_v"))
    found = held.select("_k", "_range", "_v", "_n", upto.alias("_upto")).join(spots, ["_k", "_range"]).filter(
        "_offset < _upto and _offset >= _upto - _n")

    def pick(name: str) -> Column:
        def of(column: str, upper: bool) -> Column:
            return F.max(F.when((F.col("name") == name) & (F.col("upper") == upper), F.col(column)))

        low, high, at = of("_v", False), of("_v", True), of("at", False)
        if wanted[name][0] == "nearest":
            return low.cast(kind).alias(name)
        low, high = low.cast("double"), high.cast("double")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.groupBy("_k").agg(F.max("_total").alias("_total"), *[pick(n) for n in wanted])
