"""Mixing sources to target weights, in fixed-length blocks of words.

Each source's documents are laid out in a pseudorandom order and cut into blocks of BLOCK words. The mix fills output
shards with block slots: how many slots each shard gives to each source is a multinomial draw (given the source's
total, so totals hit the targets). The slots of a source are numbered through the shards; slot i of pass e takes the
block whose index is the pass's pseudorandom permutation of i, and blocks are joined by index. A source's passes use
each block once, so nothing is taken more often than the target's cap allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import WORD, bits, filled, running_sum

#: Words in a block, slots in an output shard on average, rounds of the permutation, most passes over a source.
BLOCK, SHARD_SLOTS, ROUNDS, CAP = 64, 1024, 10, 3
#: Slots that one row of the draw stands for before it is unfolded; documents in a packing bucket on average.
CHUNK, BUCKET_ROWS = 2048, 2000
#: Sources up to this many are broadcast.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a digest of the text that tells rows of one doc_id apart."""
    text = filled("text")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.xxhash64(text).alias("mark"))


def targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """source, number, weight, source_size, target: one row per source.

    Sources in code point order (null last) weigh 1, 2, 3, repeating. Targets share all words by weight, stopping at
    ``cap`` times the source's size. Sorted by cap over weight, the level at which the rest share what is left rises
    while sources are capped and falls after, so its greatest value is the final one.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    per = per.withColumn("weight", (F.col("number") - 1) % 3 + 1)
    room = (F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy(room, "number")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", left.cast("double") / weights)
    level = F.max("_level").over(whole)
    return per.select("source", "number", "weight", "source_size", F.least(
        F.lit(float(cap)) * F.col("source_size"), F.col("weight") * level).alias("target"))


def permuted(index: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds: i and k-i change places or not, as a hash of the
    larger says; each round undoes itself, so this is one-to-one for every n."""
    def swap(i: Column, r: Column) -> Column:
        key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("k"), seed, r.cast("string"))), 1, 13), 16, 10)
        other = F.pmod(key.cast("long") - i, n)
        coin = F.ascii(F.md5(F.concat_ws(":", seed, r.cast("string"), F.greatest(i, other).cast("string")))) % 2
        return F.when(coin == 0, other).otherwise(i)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def slots(goals: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """shard, number (of the source), slot, pass, block_index: the whole mix as a table of block slots."""
    spark = goals.sparkSession
    blocks = F.ceil(F.col("source_size") / F.lit(float(block))).cast("long")
    plan = goals.filter("source_size > 0").withColumn("blocks", blocks).withColumn(
        "slots", F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"),
                         CAP * F.col("blocks"))).filter("slots > 0")
    plan = durable(plan.select("number", "blocks", "slots"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    unfolded = (plan.select("number", "slots", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("slots") - 1).cast(
        "long"), F.lit(CHUNK).cast("long"))).alias("low")).repartition(parts, "number", "low")
        .select("number", F.explode(F.sequence("low", F.least(F.col("low") + CHUNK, F.col("slots")) - 1)).alias("draw")))
    # Each source's slots fall on the shards at random: multinomial counts per shard, summing to the source's total.
    counts = unfolded.groupBy((bits("shard", seed, "number", "draw") % shards).alias("shard"), "number").agg(
        F.count(F.lit(1)).alias("count"))
    first = F.sum("count").over(Window.partitionBy("number").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1))
    drawn = counts.withColumn("first", F.coalesce(first, F.lit(0))).join(
        plan.select("number", "blocks"), "number").repartition(parts, "shard", "number")
    one = drawn.select("shard", "number", "blocks", F.explode(
        F.sequence("first", F.col("first") + F.col("count") - 1)).alias("slot"))
    one = one.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    return one.withColumn("block_index", permuted(
        F.col("slot") % F.col("blocks"), F.col("blocks"),
        F.concat_ws(":", F.lit(str(seed)), F.col("number").cast("string"), F.col("pass").cast("string")))).drop("blocks")


def laid_out(sized: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """Every row with its source's number, size and target, its place (bucket, seq) and the word it begins at."""
    n = sized.count()
    side = goals.select(F.col("source").alias("_source"), "number", "source_size", "target")
    side = F.broadcast(side) if goals.count() <= BROADCAST_SOURCES else side
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("order", bits("pack", seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("bucket", F.col("order") % max(1, -(-n // BUCKET_ROWS)))
    return running_sum(rows, ["number"], "bucket", ["order", "doc_id", "size", "mark"], "size", "start", "seq")


def pieces(rows: DataFrame, used: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row once per block it lies in, with the words in that block and the block's uses (null: none)."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = rows.withColumn("block_index", F.explode_outer(
        F.when(F.col("size") > 0, F.sequence(first.cast("long"), last.cast("long")))))
    low = F.greatest(F.col("start"), F.col("block_index") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block_index") + 1) * block)
    spread = spread.withColumn("low", low - F.col("start")).withColumn("words", high - low)
    return spread.join(used, ["number", "block_index"], "left")


def mix(docs: DataFrame, block: int = BLOCK, cap: int = CAP, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken per row: how many of a document's words the mix takes, with repeats.

    Null text has size 0 and null source is a source of its own, the last. Rows without words are returned with taken
    0; repeated rows are packed and returned each on its own. With no words at all every target is 0. An empty table
    gives an empty result. Reruns agree: all draws are hashes of the seed.
    """
    sized = durable(sizes(docs))
    goals = durable(targets(sized, cap))
    used = slots(goals, block, seed=seed).groupBy("number", "block_index").agg(F.count(F.lit(1)).alias("uses"))
    found = pieces(laid_out(sized, goals, seed), used, block)
    return (found.groupBy("number", "bucket", "seq", "doc_id", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).cast("long").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_texts(docs: DataFrame, block: int = BLOCK, cap: int = CAP, seed: int = 0) -> DataFrame:
    """The mix itself as documents: each row once for every pass that takes words of it, its text cut down to the
    blocks taken in that pass (a text taken whole is unchanged), n_chars to match; all other columns stay.

    Rows of which no pass takes a word go. Rows that repeat the same doc_id, source and text are packed each on its own
    and come out as often as they are taken. White space stays with the word before it.
    """
    sized = durable(sizes(docs))
    goals = durable(targets(sized, cap))
    used = slots(goals, block, seed=seed).groupBy("number", "block_index", "pass").agg(F.count(F.lit(1)).alias("uses"))
    found = pieces(laid_out(sized, goals, seed), used, block).filter("uses is not null")
    runs = found.groupBy("number", "bucket", "seq", "doc_id", "source", "mark", "size", "pass").agg(
        F.sum("words").alias("taken"),
        F.array_sort(F.collect_list(F.struct("low", "words"))).alias("runs"))
    key = ["doc_id", "source", "mark"]
    runs = runs.select(*[F.col(c).alias(f"of_{c}") for c in key],
                       F.when(F.col("taken") < F.col("size"), F.col("runs")).alias("runs"))
    rows = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), F.xxhash64(filled(docs["text"])).alias("mark"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    again = sized.groupBy(*key).count().filter("count > 1").select(*[F.col(c).alias(f"of_{c}") for c in key])
    if not again.isEmpty():  # rows alike would each meet the others' runs
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(key))
    text = filled(F.col("row")["text"])
    words = F.regexp_extract_all(text, F.lit(r"(\A[\x20\x09-\x0D]*)?" + WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "runs", lambda r: F.slice(w, (r["low"] + 1).cast("int"), r["words"].cast("int")))), ""))[0]
    joined = rows.join(runs, same).withColumn(
        "text", F.when(F.col("runs").isNull(), F.col("row")["text"]).otherwise(cut))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return joined.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
