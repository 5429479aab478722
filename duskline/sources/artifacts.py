"""Media and model files checked against a manifest, and archive member tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import git_blob_sha1

# Video suffixes, the member size bound and report sizes.
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm")
MAX_MEMBER_BYTES = 16 * 1024 * 1024
TOP_GROUPS, SMALLEST = 24, 32


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size and digests of every file; contents do not leave the task that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return digests(files)


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.length("content").cast("long").alias("size_bytes"),
                        F.sha2("content", 256).alias("sha256"), F.sha2("content", 384).alias("sha384"),
                        git_blob_sha1(F.col("content")).alias("git_blob_sha1"))


def identity_problems(manifest: DataFrame, found: DataFrame, digest: str = "sha256") -> DataFrame:
    """(path, problem): files missing, of another size or with another digest; unlisted files are ``unlisted``."""
    f = found.select("path", F.col("size_bytes").alias("_size"), F.col(digest).alias("_digest"))
    j = manifest.select("path", "size_bytes", digest, F.lit(1).alias("_m")).join(f, "path", "full")
    problem = (
        F.when(F.col("_m").isNull(), "unlisted").when(F.col("_digest").isNull(), "missing")
        .when(F.col("_size") != F.col("size_bytes"), "size").when(F.col("_digest") != F.col(digest), "digest"))
    return j.withColumn("problem", problem).filter("problem is not null").select("path", "problem")


def bounded_videos(members: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    return members.withColumn("extension", suffix).filter(
        suffix.isin(*VIDEO_SUFFIXES) & F.col("uncompressed_size").between(1, MAX_MEMBER_BYTES)
        & (F.col("compressed_size") >= 1) & (F.col("compressed_size") <= MAX_MEMBER_BYTES))


def top_groups(members: DataFrame, n: int = TOP_GROUPS) -> DataFrame:
    top = F.split("name", "/")[0]
    return members.groupBy(top.alias("top_level")).agg(F.count(F.lit(1)).alias("members")).orderBy(
        F.desc("members"), "top_level").limit(n)


def smallest(members: DataFrame, n: int = SMALLEST) -> DataFrame:
    return members.orderBy("uncompressed_size", "name").limit(n)


def pinned_matches(members: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins (role and five identity columns) with the number of members that match; anything but one is refused."""
    key = ["name", "compressed_size", "uncompressed_size", "crc32", "local_header_offset"]
    hits = members.join(pins.select("role", *key), key).groupBy("role").agg(F.count(F.lit(1)).alias("matches"))
    return pins.select("role", "name").join(hits, "role", "left").na.fill(0, ["matches"]).withColumn(
        "accepted", F.col("matches") == 1)


def disjoint_pair(members: DataFrame, used_locations: tuple[str, ...] = ()) -> DataFrame:
    """The best negative/positive pair with different subjects and different locations.

    Most new locations first, then total bytes, larger member and names. Whatever the negative is, its best positive is
    one of at most five rows: the best positive, the best ones avoiding its subject or its location, and the best ones
    that avoid one more. So every negative meets five rows, not every positive.
    """
    fresh = (~F.col("location_id").isin(*used_locations)).cast("int") if used_locations else F.lit(1)
    side = members.select("role", "subject_id", "location_id", fresh.alias("fresh"),
                          F.col("uncompressed_size").alias("size"), "name")
    pos = side.filter("role = 'positive'")

    def first(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("fresh"), "size", "name").limit(1)

    def avoiding(df: DataFrame, row: DataFrame, column: str) -> DataFrame:
        return df.join(row.select(column), column, "left_anti").select(side.columns)

    best = first(pos)
    other_subject, other_location = avoiding(pos, best, "subject_id"), avoiding(pos, best, "location_id")
    a, b = first(other_subject), first(other_location)
    short = best
    for more in (a, first(avoiding(other_subject, a, "location_id")), b, first(avoiding(other_location, b, "subject_id"))):
        short = short.unionByName(more)
    p = short.distinct().select(*[F.col(c).alias("p_" + c) for c in side.columns])
    pairs = side.filter("role = 'negative'").join(
        F.broadcast(p), (F.col("subject_id") != F.col("p_subject_id")) & (F.col("location_id") != F.col("p_location_id")))
    total = F.col("size") + F.col("p_size")
    return pairs.orderBy(F.desc(F.col("fresh") + F.col("p_fresh")), total, F.greatest("size", "p_size"), "name", "p_name"
                         ).limit(1).select(F.col("name").alias("negative"), F.col("p_name").alias("positive"),
                                           total.alias("total_bytes"))
