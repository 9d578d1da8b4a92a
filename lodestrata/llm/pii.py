"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All built-in expressions over one row: the operator is map-only. Positions come from marking:
matches are wrapped in two control characters and the marked text is cut there, so that the
lengths of the pieces give the spans in code points.

Defined results: a null text counts as empty and has no spans; repeated rows are searched one by
one; the two marking characters, where a text has them, are read as a third control character,
which no pattern matches; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import columns, empty_as, let, running_total

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
NEAR = 48


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``check`` confirms; a base kind stays whatever its score is.

    A text in which ``needs`` finds nothing has no match of the pattern and is not searched for it.
    """

    name: str
    pattern: str
    base: bool
    score: float
    check: str = "none"
    checked: float = 0.0
    context: str = ""
    near: float = 0.3
    needs: str = "[0-9]"


# Possessive forms and run starts keep the search linear; they match what the plain forms match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", True, 0.5, "octets", 0.3, r"\b(?:ip|host|server|address)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.3, "luhn", 0.5, r"\b(?:card|visa|credit|karte|tarjeta|carte)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.5, "digits", 0.3, r"\b(?:tel|phone|call|mobile|fax)\b", needs=r"\+[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", False, 0.3, "mod97", 0.5,
         r"\b(?:iban|account|konto|cuenta|compte)\b"),
    Kind("local_phone", r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", False, 0.3, "none", 0.0,
         r"\b(?:tel|telephone|phone|call|mobile|fax|telefon|telefono|téléphone|teléfono)\b", 0.4),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])", False, 0.3, "none", 0.0,
         r"\b(?:token|secret|password|passwd|api[_-]?key|key)\b", 0.4, "[0-9A-Fa-f]{32}"),
)
ACCEPT = 0.6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    """14 to 19 digits whose Luhn sum ends in 0."""
    def total(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + let(
            F.substring(d, i, F.lit(1)).cast("int"), lambda x: F.when(
                (F.length(d) - i) % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)))
    return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def _mod97(value: Column) -> Column:
    """The account number read as digits, its first four characters last, leaves 1 on division by 97."""
    def rest(s: Column) -> Column:
        turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
            c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97))
    return let(F.replace(value, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & (rest(s) == 1))


def _octets(value: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


CHECKS = {
    "none": lambda v: F.lit(True),
    "octets": _octets,
    "luhn": _luhn,
    "digits": lambda v: F.length(_digits(v)).between(10, 15),
    "mod97": _mod97,
}


def _proposed(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind that pass its check, with their score."""
    marked = F.regexp_replace(text, f"({kind.pattern})", f"{OPEN}$1{CLOSE}")

    def spans(pieces: Column) -> Column:
        """Pieces alternate: text before, match, text after and before the next, ..."""
        def one(places: Column) -> Column:
            hits = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), lambda i: F.struct(
                F.element_at(places, i + 1).alias("start"),
                (F.element_at(places, i + 1) + F.length(F.element_at(pieces, i + 1))).alias("end"),
                F.element_at(pieces, i + 1).alias("value"),
                F.right(F.element_at(pieces, i), F.lit(NEAR)).alias("before"),
                F.left(F.element_at(pieces, i + 2), F.lit(NEAR // 2)).alias("after")))
            good = F.filter(hits, lambda h: CHECKS[kind.check](h["value"]))
            near = (lambda h: F.when(F.lower(F.concat(h["before"], F.lit(" "), h["after"])).rlike(kind.context),
                                     F.lit(kind.near)).otherwise(F.lit(0.0))) if kind.context else (lambda h: F.lit(0.0))
            return F.transform(good, lambda h: F.struct(
                h["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), h["end"].alias("end"),
                F.round(F.least(F.lit(1.0), F.lit(kind.score + kind.checked) + near(h)), 3).alias("score")))
        return F.when(F.size(pieces) < 3, F.array().cast(SPANS)).otherwise(
            let(running_total(F.transform(pieces, F.length)), one))

    return let(F.split(marked, f"[{OPEN}{CLOSE}]"), spans)


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def find_spans(text: Column) -> Column:
    """All accepted spans of a text by start, then kind: base kinds always, others by score."""
    clean = F.regexp_replace(empty_as(text), f"[{OPEN}{CLOSE}]", OTHER)

    def search(t: Column) -> Column:
        none, needs = F.array().cast(SPANS), list(dict.fromkeys(k.needs for k in KINDS))

        def among(has: Column) -> Column:
            return F.concat(*[F.when(F.get(has, F.lit(needs.index(k.needs))), _proposed(t, k, i).cast(SPANS)).otherwise(none)
                              for i, k in enumerate(KINDS)])

        found = let(F.array(*[t.rlike(n) for n in needs]), among)
        base = [k.name for k in KINDS if k.base]
        return F.sort_array(F.filter(found, lambda s: s["kind"].isin(*base) | (s["score"] >= ACCEPT)))

    return let(clean, search)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and ``found``, the spans with kind, start, end (exclusive) and score."""
    return columns(docs, "doc_id", "text").select("doc_id", find_spans(F.col("text")).alias("found"))


def masked(docs: DataFrame, mask: str = "*") -> DataFrame:
    """Documents with each span replaced by as many mask characters; other columns stay."""
    def over(text: Column, spans: Column) -> Column:
        return F.aggregate(spans, text, lambda t, s: F.overlay(
            t, F.repeat(F.lit(mask), (s["end"] - s["start"]).cast("int")), (s["start"] + 1).cast("int")))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), over(F.col("text"), find_spans(F.col("text")))))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""
    base = [k.name for k in KINDS if k.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"))
