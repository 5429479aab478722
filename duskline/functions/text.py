"""Plate text, attribute text and read-comparison expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The slot alphabet (padding last), the slot count and the plate length bound.
SLOT_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_"
SLOTS = 10
MAX_PLATE = 16


# What records may hold.
ATTRIBUTE = "^[A-Za-z0-9_.:/ -]{1,128}\\z"
TOKEN = "^[A-Za-z0-9_.:/-]{1,128}\\z"
IDENTIFIER = "^[A-Za-z0-9_.-]{1,128}\\z"


def plate_text(raw: Column) -> Column:
    """Normalised plate text, NULL where a character or the length is not allowed.

    The character check runs before upper-casing: case expansion must not invent ASCII letters.
    """
    squeezed = F.upper(F.translate(raw, " -", ""))
    ok = raw.rlike("^[A-Za-z0-9 -]*\\z") & (F.length(squeezed) <= MAX_PLATE)
    return F.when(ok, squeezed)


def attribute_text(raw: Column) -> Column:
    """Trimmed, whitespace-collapsed attribute text; NULL when outside the allowed characters."""
    flat = F.trim(F.regexp_replace(raw, "\\s+", " "))
    return F.when(flat.rlike(ATTRIBUTE), flat)


def token(raw: Column) -> Column:
    return F.when(raw.rlike(TOKEN), raw)


def identifier(raw: Column) -> Column:
    return F.when(raw.rlike(IDENTIFIER), raw)


def edit_distance(expected: Column, observed: Column) -> Column:
    return F.levenshtein(expected, F.coalesce(observed, F.lit("")))


def decode_slots(slots: Column, min_confidence: float = 0.9) -> dict[str, Column]:
    """Decode slot probabilities: first arg-max per slot, weakest slot as confidence, abstain when unsure."""
    malformed = (F.size(slots) != SLOTS) | F.exists(
        slots,
        lambda r: (F.size(r) != len(SLOT_ALPHABET))
        | F.exists(r, lambda p: (p < 0) | (p > 1) | F.isnan(p))
        | (F.abs(F.aggregate(r, F.lit(0.0), lambda a, p: a + p) - 1.0) > 1e-3),
    )
    letters = F.transform(
        slots,
        lambda r: F.substring(
            F.lit(SLOT_ALPHABET), F.array_position(r, F.array_max(r)).cast("int"), F.lit(1)
        ),
    )
    raw = F.array_join(letters, "")
    conf = F.array_min(F.transform(slots, F.array_max))
    text = F.rtrim(raw, F.lit("_"))
    reason = (
        F.when(malformed, F.lit("malformed"))
        .when(conf < min_confidence, F.lit("low_confidence"))
        .when(text == "", F.lit("blank"))
        .when(F.contains(text, F.lit("_")), F.lit("interior_padding"))
    )
    return {
        "raw_text": F.when(~malformed, raw),
        "confidence": F.when(~malformed, conf),
        "rejection_reason": reason,
        "plate_text": F.when(reason.isNull(), text),
    }
