"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Everything is a column expression. Where a pattern is found, the text is split by the same pattern: the lengths of the
parts between the matches give every match's place in code points. The patterns below accept exactly what their plain
forms accept, leftmost and non-overlapping, but never look at a character more than a few times (possessive
repetition, and no start inside a run that already failed).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, let

# The base kinds and what counts as one of them.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further kinds: bank account numbers confirmed by mod-97, and numbers that only their context makes personal.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Code points before and after a span in which context words count, what each such span gains, and the least score of
#: a span of the further kinds.
BEFORE, AFTER, GAIN, LEAST = 48, 24, 0.3, 0.5
#: Matches placed and judged together.
CHUNK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    context: str  # alternatives of a regular expression, matched as whole words without regard to case
    base: bool
    must_contain: str = ""


KINDS = (
    Kind("email", EMAIL, 0.9, "e-?mail|mail|contact|write|correo|courriel", True, "@"),
    Kind("ip", IP, 0.6, "ip|address|host|server|adresse", True, "."),
    Kind("card", CARD, 0.7, "card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta", True),
    Kind("phone", PHONE, 0.6, "phone|tel|call|mobile|fax|telefon|telefono", True, "+"),
    Kind("iban", IBAN, 0.8, "iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", SSN, 0.3, "ssn|social security|tax", False, "-"),
)


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(number: Column) -> Column:
    """True if the account number (letters A-Z and digits) has remainder 1, its first four moved to the end."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97))
    return rest == 1


def _only(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(_only(match, "0-9"), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_only(match, "0-9")).between(9, 15)
    if kind == "iban":
        return let(_only(match, "A-Z0-9"), lambda n: F.length(n).between(15, 34) & mod97(n))
    return F.lit(True)


def _places(parts: Column, found: Column, low: Column, high: Column, at: Column) -> Column:
    """array<struct<start, end, match>> in code points of the matches ``low`` to ``high``; the part before the first of them
    begins at ``at``."""
    first = F.struct(at.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(parts, i))
        end = start + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(
            start.alias("start"), end.alias("end"), F.get(found, i).alias("match"))).alias("out"))

    return F.aggregate(F.sequence(low, high), first, step, lambda acc: acc["out"])


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans of one kind, in order.

    Matches are taken CHUNK at a time, each chunk with its own cut of the text, so the work grows with the text and its
    matches and not with their product.
    """
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")

    def scored(s: Column, piece: Column, low: Column) -> Column:
        near = F.substring(piece, F.greatest(s["start"] - BEFORE, F.lit(0)) - low + 1,
                           F.least(s["start"], F.lit(BEFORE)) + s["end"] - s["start"] + AFTER)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{kind.context})(?![A-Za-z])"),
                               F.lit(min(1.0, kind.prior + GAIN))).otherwise(F.lit(kind.prior)).alias("score"))

    def of_chunk(parts: Column, found: Column, at: Column, c: Column) -> Column:
        places = _places(parts, found, c * CHUNK, F.least((c + 1) * CHUNK, F.size(found)) - 1, at)

        def judged(all_of: Column) -> Column:
            low = F.greatest(at - BEFORE, F.lit(0))
            piece = F.substring(text, low + 1, F.element_at(all_of, -1)["end"] - low + AFTER)
            sure = F.filter(all_of, lambda s: _valid(kind.name, s["match"]))
            spans = let(piece, lambda p: F.transform(sure, lambda s: scored(s, p, low)))
            return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST)

        return let(places, judged)

    def of(found: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))

        def length(parts: Column, c: Column) -> Column:
            def total(of: Column) -> Column:
                return F.aggregate(F.slice(of, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda n, x: n + F.length(x))

            return total(parts) + total(found)

        def whole(parts: Column) -> Column:
            begins = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.array_append(
                acc, F.element_at(acc, -1) + length(parts, c)))
            return let(begins, lambda at: F.flatten(F.transform(chunks, lambda c: of_chunk(parts, found, F.get(at, c), c))))

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, kind.pattern, -1), whole))

    spans = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), of)
    return F.when(F.contains(text, F.lit(kind.must_contain)), spans).otherwise(none) if kind.must_contain else spans


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one column per kind, ``pii_<kind>``: array<struct<kind, start, end, score>>, in code points, end exclusive.

    Null text is empty. Spans of different kinds may overlap; those of one kind never do. Matches that fail their check
    are dropped and their text is not tried again. Spans of the base kinds (email, ip, card, phone) always stay;
    those of the further kinds need a score of LEAST, which context words raise.
    """
    whole = filled(text)
    def of(kind: Kind) -> Column:
        return let(whole, lambda t: _spans(t, kind)).alias(f"pii_{kind.name}")

    return docs.select("*", *[of(k) for k in KINDS])


def listed(*names: str) -> Column:
    """kind:start:end of all spans of these kinds, comma-joined."""
    return F.array_join(F.transform(F.concat(*[F.col(f"pii_{n}") for n in names]), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score for every row.

    A document without spans, an empty or a null text has counts 0, the digest of the empty text, empty ``spans`` and null
    ``top_score``. Repeated rows come out as often as they went in; an empty table gives an empty result; other columns are
    not read.
    """
    found = find(docs.select("doc_id", "text")).drop("text")
    base = [k.name for k in KINDS if k.base]
    scores = F.transform(F.concat(*[F.col(f"pii_{k.name}") for k in KINDS]), lambda s: s["score"])
    return found.select("doc_id", *[F.size(f"pii_{n}").cast("long").alias(f"n_{n}") for n in base],
                        F.sha2(listed(*base), 256).alias("base_sha256"),
                        listed(*[k.name for k in KINDS]).alias("spans"), F.array_max(scores).alias("top_score"))
