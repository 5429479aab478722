"""Document fingerprints by winnowing.

A text is read as tokens: its words, cut into parts of at most PART characters; unbroken text (words of more than LONG
characters, or of more than PART in a script without spaces) gives every PART characters in it instead, one token for each
start, so that a passage is read alike wherever it stands. Every run of K tokens gets a hash, built by
doubling: hashes of 2m tokens combine two overlapping hashes of m, so a token costs log2(K) steps. Of every WINDOW
consecutive hashes the smallest is chosen, the rightmost on ties, and kept with its position (in tokens). Any run of
K + WINDOW - 1 tokens that two texts share therefore puts a common hash into both fingerprints: five words or parts, or
PART + K + WINDOW - 2 characters of unbroken text. All of it is array
expressions; the tokens of long texts are worked through in overlapping pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, filled, let

#: Tokens in a hashed run and hashes in a window, both powers of two; window starts in a piece of a long text.
K, WINDOW, PIECE, PART = 2, 4, 8192, 8
TOKEN = rf"[^\x20\x09-\x0D]{{1,{PART}}}"
#: Words longer than this are unbroken text in any script; those of SPACELESS scripts are if longer than PART.
LONG = 48
SPACELESS = (r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
             r"\uFF66-\uFF9F\x{20000}-\x{323AF}]")  # Thai, Lao, Burmese, Khmer, Kana, Han: ranges, as scripts are slow to tell
UNBROKEN = rf"(?s)^(?:.{{{LONG + 1}}}|(?=.{{{PART + 1}}}).*{SPACELESS})"
#: Only texts in which this is found may have unbroken words; every start of PART characters in one.
SUSPECT, STARTS = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{{LONG + 1}}}|{SPACELESS}", rf"(?s)(?=(.{{{PART}}}))."
#: Hashes are taken modulo this prime below 2^42; multipliers stay below 2^20, so products fit a long.
PRIME, MULTIPLIERS = (1 << 42) - 11, (1_000_003, 786_433, 950_009, 611_953, 524_287)
#: A packed value is hash * POSITIONS - position: its minimum has the rightmost of equal hashes.
POSITIONS = 1 << 14
#: Rows (by id) whose next document is found in one sorted run; buckets likewise.
RUN, RUNS = 256, 4096

Selection = Column  # array<struct<pos: long, hash: long>>, by position


def _doubled(values: Column, times: int, step) -> Column:
    """Combine each value with the one 1, 2, 4, ... further on, ``times`` times over."""
    def level(a: Column, i: int) -> Column:
        m = 1 << i
        if i == times:
            return a
        return let(F.zip_with(F.slice(a, F.lit(1), F.size(a) - m), F.slice(a, F.lit(1 + m), F.size(a) - m),
                              lambda x, y: step(x, y, i)), lambda b: level(b, i + 1))

    return let(values, lambda a: level(a, 0))


def _packed(tokens: Column) -> Column:
    """Packed hashes of every run of K tokens, from the hashes of at least K tokens."""
    runs = _doubled(tokens, K.bit_length() - 1, lambda x, y, i: (x * MULTIPLIERS[i] + y) % PRIME)
    return F.transform(runs, lambda x, i: x * POSITIONS - i)


def _unpacked(packed: Column, base: Column) -> Selection:
    def one(p: Column) -> Column:
        high = F.shiftright(p + (POSITIONS - 1), POSITIONS.bit_length() - 1)
        return F.struct((base + 1 + high * POSITIONS - p).cast("long").alias("pos"), high.alias("hash"))

    return F.transform(packed, one)


def _steps(a: Column) -> Column:
    """Without repeats of the element before."""
    return let(a, lambda b: F.filter(b, lambda x, i: (i == 0) | (F.get(b, i - 1) != x)))


def _tokens(text: Column) -> Column:
    """The tokens of a text, in order."""
    def parts(word: Column) -> Column:
        return F.regexp_extract_all(word, F.lit(TOKEN), F.lit(0))

    def of(word: Column) -> Column:
        return F.when(word.rlike(UNBROKEN), F.regexp_extract_all(word, F.lit(STARTS), F.lit(1))).otherwise(parts(word))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(text.rlike(SUSPECT), F.flatten(F.transform(words, of))).otherwise(parts(text))


def select(text: Column) -> Selection:
    """The winnowed hashes of a text with their positions, from 1.

    An empty text has none. A text of fewer tokens than K is one run as a whole (also one without any token); one with
    fewer runs than WINDOW is one window.
    """
    none = F.expr("cast(array() as array<struct<pos:bigint,hash:bigint>>)")

    def of(tokens: Column) -> Column:
        windows = F.size(tokens) - (K + WINDOW - 2)
        whole = F.array(F.struct(F.lit(1).cast("long").alias("pos"), F.pmod(F.xxhash64(text), F.lit(PRIME)).alias("hash")))

        def piece(c: Column) -> Column:
            start = (c * PIECE).cast("int")
            packed = _packed(F.slice(tokens, start + 1, F.lit(PIECE + K + WINDOW - 2)))
            least = _doubled(packed, WINDOW.bit_length() - 1, lambda x, y, i: F.least(x, y))
            return _unpacked(_steps(least), start)

        last = F.floor((windows - 1) / PIECE).cast("int")
        many = F.when(last == 0, piece(F.lit(0))).otherwise(
            _steps(F.flatten(F.transform(F.sequence(F.lit(0), last), piece))))
        return (F.when(F.size(tokens) < K, whole)
                .when(windows < 1, _unpacked(F.array(F.array_min(_packed(tokens))), F.lit(0))).otherwise(many))

    tokens = F.transform(_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
    return F.when(F.length(text) == 0, none).otherwise(let(tokens, of))


def hashes(selection: Selection) -> Column:
    return F.array_distinct(F.transform(selection, lambda s: s["hash"]))


def digest(selection: Selection) -> Column:
    """Lowercase hex SHA-256 of the listed hashes and positions."""
    return F.sha2(F.array_join(F.transform(selection, lambda s: F.concat_ws(
        ":", s["hash"].cast("string"), s["pos"].cast("string"))), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Shared over all hashes of two lists of distinct hashes; two empty lists are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``: array<struct<pos, hash>> of each whole text (null: empty)."""
    return docs.withColumn(out, select(filled(text)))


def _next_run(heads: DataFrame) -> DataFrame:
    """run -> text of the first document of the next run in use; the last run meets the first."""
    runs = heads.select("run").withColumn("_group", F.floor(F.col("run") / RUNS))
    inner = runs.withColumn("_next", F.lead("run").over(Window.partitionBy("_group").orderBy("run")))
    groups = runs.groupBy("_group").agg(F.min("run").alias("_first"))
    order = Window.orderBy("_group")  # one row for RUN * RUNS ids
    groups = groups.select(F.col("_group").alias("_g"), F.coalesce(
        F.lead("_first").over(order), F.min("_first").over(order)).alias("_after"))
    found = inner.join(groups, F.col("_group") == F.col("_g")).select(
        F.col("run").alias("_run"), F.coalesce("_next", "_after").alias("_next"))
    return found.join(heads, F.col("_next") == F.col("run")).select("_run", F.col("head.text").alias("_head"))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes per row.

    The edited text replaces the last quarter of the code points by the first as many of the next document by
    ascending doc_id (after the last: the first). Null text is empty; a null doc_id counts as smaller than all; rows with
    the same doc_id follow each other by text; a lone row is its own next. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", filled("text").alias("text"))
    run = F.floor(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long") / RUN)
    rows = rows.withColumn("run", F.when(F.col("doc_id").isNull(), F.lit(-(1 << 62))).otherwise(run))
    heads = rows.groupBy("run").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    spread = rows.repartition("run").withColumn("n", F.length("text")).withColumn("sel", select(F.col("text")))
    spread = spread.withColumn("hashes", hashes(F.col("sel")))
    order = Window.partitionBy("run").orderBy("doc_id", "text")
    met = (spread.withColumn("next_text", F.lead("text").over(order))
           .withColumn("next_hashes", F.lead("hashes").over(order)))
    met = met.join(_next_run(heads), (F.col("run") == F.col("_run")) & F.col("next_text").isNull(), "left")
    met = met.withColumn("next_text", F.coalesce("next_text", "_head")).withColumn(
        "next_hashes", F.coalesce(F.col("next_hashes"), hashes(select(F.col("_head")))))
    n = F.col("n")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    met = met.withColumn("edited", edited)
    return (met.withColumn("edited_sel", select(F.col("edited"))).withColumn("edited_hashes", hashes(F.col("edited_sel")))
            .select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    digest(F.col("sel")).alias("fingerprint"), digest(F.col("edited_sel")).alias("edited_fingerprint"),
                    likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
                    likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
                    F.size("sel").alias("n_hashes")))
