"""Deterministic ids, digests and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The RFC 4122 URL namespace and the analytic name bound into every event id.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
PERSON_DOWN_ANALYTIC = "person_down/0.0.1"


def uuid5(name: Column, namespace_hex: str = URL_NAMESPACE_HEX) -> Column:
    """Name-based UUID (version 5): SHA-1 of namespace and name with version and variant nibbles set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def person_down_event_id(source: Column, session: Column, track: Column, start_ms: Column) -> Column:
    q = F.lit('","')
    return uuid5(
        F.concat(F.lit('["' + PERSON_DOWN_ANALYTIC), q, source, q, session, q, track, F.lit('",'),
                 start_ms.cast("string"), F.lit("]"))
    )


def iso_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rgb_frame_digest(frame_index: Column, width: Column, height: Column, rgb24: Column,
                     preamble: str = "rgb24-frame-v1") -> Column:
    """SHA-256 of one decoded frame bound to its index and dimensions; callers choose the preamble."""
    head = F.concat_ws("\n", F.lit(preamble), frame_index.cast("string"),
                       width.cast("string"), height.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), rgb24), 256)


def git_blob_sha1(content: Column) -> Column:
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.length(content).cast("string")), "UTF-8"),
                    F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))
