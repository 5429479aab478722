"""Expressions and joins shared by the corpus operators.

Every operator first selects the few columns it needs under its own names, so extra columns of the input never clash
with working columns. Joins that may meet a hot key are salted; broadcasts happen only behind a count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key's rows are spread over at most so many parts.
SALTS = 64
#: Most ids that are ever broadcast (8 bytes each); larger sides are shuffled.
BROADCAST_IDS = 200_000


def filled(text: Column | str) -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the faster built-in, which does the same to them."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder and read again.

    For loops: unlike a checkpoint it also forgets the size estimates of the joins before, which otherwise multiply from
    round to round until they fill the driver.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once everything that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def bits(label: str, *parts: Column | str | int, width: int = 13) -> Column:
    """A reproducible whole number of 4*width bits from md5, which other SQL engines compute alike."""
    text = F.concat_ws(":", F.lit(label), *[F.lit(str(p)) if isinstance(p, int) else (
        F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, width), 16, 10).cast("long")


def widened(schema: StructType, more: dict[str, DataType]) -> StructType:
    """The schema with further columns at its end."""
    return StructType([*schema.fields, *[StructField(n, t) for n, t in more.items()]])


def with_group(rows: DataFrame, key: str, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add aggregates over each key to its rows; no task ever holds a whole key.

    ``aggs``: output name -> (merge function, expression), the function one of min, max, sum. Rows are summed up per
    (key, salt), then per key, and the result goes back once for each salt that the key has.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(*[getattr(F, f)(e).alias(n) for n, (f, e) in aggs.items()])
    whole = parts.groupBy(key).agg(*[getattr(F, f)(n).alias(n) for n, (f, _) in aggs.items()],
                                   F.collect_list("_salt").alias("_salts"))
    back = whole.select(key, *aggs, F.explode("_salts").alias("_salt"))
    return salted.join(back, [key, "_salt"]).drop("_salt")


#: Bits of a filter table: 2^25 are 524,288 words of 8 bytes (4 MB of bits) at most, broadcast.
FILTER_BITS = 1 << 25


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the whole row as one struct, so that columns of any name can come along."""
    return docs.select(F.col("doc_id"), filled("text").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def bit_table(rows: DataFrame, hashed: Column, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The bits of ``hashed`` (a long) as words of 64: bounded, whatever the input."""
    cell = hashed.bitwiseAND(F.lit(filter_bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
    return rows.select(F.shiftright(cell, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def possibly_in(rows: DataFrame, hashed: Column, table: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Add ``maybe``: false only for rows whose ``hashed`` is certainly not in the table, which is broadcast. A fuller table
    lets more rows pass and loses none."""
    marked = rows.withColumn("cell_", hashed.bitwiseAND(F.lit(filter_bits - 1)))
    side = F.broadcast(table.select(F.col("word").alias("word_"), F.col("bits").alias("bits_")))
    found = F.call_function("shiftright", F.col("bits_"), (F.col("cell_") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return (marked.join(side, F.shiftright("cell_", 6) == F.col("word_"), "left")
            .withColumn("maybe", F.coalesce(found, F.lit(False))).drop("cell_", "word_", "bits_"))


def only_ids(rows: DataFrame, ids: DataFrame, key: str, keep: bool = True, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows whose key is (not) among ``ids``: a broadcast up to ``bound`` ids, a shuffled join beyond."""
    ids = ids.select(F.col(key).alias("_only_id")).distinct()
    side = F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids
    return rows.join(side, rows[key].eqNullSafe(F.col("_only_id")), "left_semi" if keep else "left_anti")


def resolved(rows: DataFrame, touched: DataFrame, of: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``packed`` that stay, unpacked. ``touched`` (doc_id, ``of``, stays) has those that go and those that stay
    once of several alike; rows outside its bit table are touched by nothing and pass straight through."""
    side = touched.select(F.col("doc_id").alias("id_"), F.col(of).alias("of_"), "stays")
    flagged = possibly_in(rows, F.xxhash64("doc_id", of), bit_table(side, F.xxhash64("id_", "of_")))
    few = touched.limit(bound + 1).count() <= bound

    def those(which: DataFrame, how: str) -> DataFrame:
        which = which.select("id_", "of_")
        same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col(of) == F.col("of_"))
        return flagged.filter("maybe").join(F.broadcast(which) if few else which, same, how)

    kept = flagged.filter("not maybe").unionByName(those(side, "left_anti"))
    repeated = side.filter("stays")
    if not repeated.isEmpty():
        kept = kept.unionByName(those(repeated, "left_semi").dropDuplicates(["doc_id", of]))
    return kept.select("row.*")


def running_sum(rows: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, before: str,
                seq: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each key, in order of (bucket, order), and the place in the bucket.

    Only rows of one bucket meet in a window; what lies before a bucket comes from one row per (key, bucket).
    """
    from pyspark.sql import Window

    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"))
    named = {k: f"_k{i}" for i, k in enumerate([*keys, bucket])}
    base = base.select(*[F.col(k).alias(n) for k, n in named.items()], "_base")
    local = rows.withColumn("_local", F.sum(value).over(inside)).withColumn(seq, F.count(F.lit(1)).over(inside))
    on = None
    for k, n in named.items():
        same = F.col(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return (local.join(base, on).withColumn(before, F.col("_base") + F.col("_local") - F.col(value))
            .drop("_base", "_local", *named.values()))
