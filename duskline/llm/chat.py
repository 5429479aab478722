"""Chat formatting by perspective rotation.

Every participant of a dialogue in turn is the assistant: their turns become assistant messages and are trained on, all
others become named users, system turns stay system messages. The rendered dialogue is one row per message, with its
place in the rendered text, so a dialogue of any length is never put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum

#: The markup of a message. Markers inside names and texts are broken up, so a text cannot pose as a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
#: Turns in one window of running lengths.
RUN = 512


def plain(text: Column) -> Column:
    """Text in which no marker can begin or end."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, message, start, train_start, train_end for every message.

    ``perspective`` is the participant rendered as assistant; ``message`` is the rendered text of the turn and ``start``
    its place in the rendered dialogue; [train_start, train_end) is the masked-in part, the assistant's text with its
    closing marker, empty for other messages. A null or blank role is the participant "unknown", "system" takes no
    perspective; a dialogue without participants gives no rows. Null text is empty. Turns that repeat a number follow
    each other by role and text, a null turn comes first, and null conv_id is a dialogue of its own. An empty table
    gives an empty result.
    """
    name = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    rows = turns.select("conv_id", "turn", F.when(name == "", F.lit(UNKNOWN)).otherwise(name).alias("speaker"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    people = rows.filter(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    met = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(system, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    named = F.when(own | system, F.lit("")).otherwise(F.concat(F.lit(" name="), plain(F.col("speaker"))))
    head = F.concat(F.lit(OPEN), role, named, F.lit("\n"))
    met = met.withColumn("role", role).withColumn("message", F.concat(head, plain(F.col("text")), F.lit(CLOSE)))
    met = met.withColumn("_head", F.length(head)).withColumn("_len", F.length("message").cast("long"))
    met = met.withColumn("_run", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / RUN))
    placed = running_sum(met, ["conv_id", "perspective"], "_run", ["turn", "speaker", "text"], "_len", "start", "_seq")
    end = F.col("start") + F.col("_len")
    return placed.select("conv_id", "perspective", "turn", "speaker", "role", "message", "start",
                         F.when(own, F.col("start") + F.col("_head")).otherwise(end).alias("train_start"),
                         end.alias("train_end"))
