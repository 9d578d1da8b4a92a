"""Line dedup across documents: exact copies and lines one character edit away, earliest kept.

Lines are taken by digest first. Lines one edit apart agree outside a short stretch, so two passes
rule out lines without a possible partner: grouped counts of half keys over all lines, then of
zone keys, all of a line but one of at least eight stretches of at most 64 characters, over the
rest. What is left emits the deletion neighbourhood of its shared zones as hashed keys: the stretch as it
is and without each of its characters, with the place of the deletion. Lines with one variant at one
place differ by one substitution, and a line that is itself the variant of another differs by one
insertion; so every line is compared with the earliest of its group and with the line that
equals its variant, never with all others, and the edit distance is verified.

The bound depends on the length: lines of fewer than ``exact_below`` characters have none, as one
character makes another word of a short line; all others have one edit.

Built-in expressions and joins only.

Defined results: order is (doc_id, line number, hash of the text), null doc_ids first; a null text has no line;
blank lines stay; a line is dropped if an equal line or one within the bound stands earlier
anywhere, whether or not that one is dropped itself; rows with one doc_id, or
none, are told apart by their texts, and those with one text too are treated alike; an empty table gives an empty table; extra columns are ignored by ``dropped_lines`` and
``line_report`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import columns
from lodestrata.llm.components import reliable

ZONES, ZONE = 8, 64


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def _place() -> Column:
    """Where a line stands, in the order of lines."""
    return F.struct("doc_id", "line_no", "text_key")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _half_keys(line: Column) -> Column:
    """Keys of the halves that a line shares with any line one edit away.

    The edit lies past the first q characters of both lines, or before the last q, where q is
    half the length of the shorter one; each line is prepared to be either.
    """
    n = F.length(line)

    def keys(q: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), q, F.left(line, q)), F.xxhash64(F.lit(1), q, F.right(line, q))]

    longer, shorter = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.array(*keys(longer), *keys(shorter)))


def _occurrences(docs: DataFrame, exact_below: int) -> DataFrame:
    """Every line with a word: doc_id, key of the text, line number from 0, digest, half keys; short lines have no half keys."""
    lines = columns(docs, "doc_id", "text").select("doc_id", _text_key(), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", "text_key", "line_no", F.unhex(F.md5("line")).alias("digest"),
        F.when(F.length("line") >= exact_below, _half_keys(F.col("line"))).otherwise(F.array().cast("array<bigint>")).alias("halves"))


def _zones(line: Column) -> Column:
    """(k1, k2, middle) of a line for each zone: keys of all before and after it, and the zone itself.

    Lengths are counted for the shorter of two lines, q characters, which is this one or one
    character shorter; zone number and q are part of the keys.
    """
    n = F.length(line)

    def of(q: Column) -> Column:
        zones = F.greatest(F.lit(ZONES), F.ceil(q / ZONE).cast("int"))

        def zone(j: Column) -> Column:
            before = F.floor(j.cast("long") * q / zones).cast("int")
            after = F.floor((zones - 1 - j).cast("long") * q / zones).cast("int")
            rest = (j, q, F.left(line, before), F.right(line, after))
            return F.struct(F.xxhash64(F.lit(1), *rest).alias("k1"), F.xxhash64(F.lit(2), *rest).alias("k2"),
                            F.substring(line, before + 1, n - before - after).alias("middle"))

        return F.transform(F.sequence(F.lit(0), zones - 1), zone)

    return F.concat(of(n), of(n - 1))


def _neighbourhood(text: Column) -> Column:
    """(place, key of the variant) of the text as it is, at place 0, and without its character at each place from 1."""
    n = F.length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cuts = F.transform(places, lambda i: F.struct(
        i.alias("place"), F.xxhash64(F.concat(F.left(text, i - 1), F.right(text, n - i))).alias("variant")))
    return F.concat(F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(text).alias("variant"))), cuts)


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once."""
    often = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return rows.join(often, keys, "left_semi")


def _near(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Digests of distinct lines that have an earlier line within one edit."""
    name = F.xxhash64("digest").alias("name")
    possible = _shared(lines.select(name, F.explode("halves").alias("half")), ["half"]).select("name").distinct()
    candidates = lines.select("digest", "first", name).join(possible, "name", "left_semi")
    # The texts of the candidates, from where each stands first; a row is known by its doc_id and text.
    places = candidates.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("first.line_no", "digest"))).alias("wanted"))
    left, right = columns(docs, "doc_id", "text").select("doc_id", _text_key(), "text").alias("d"), places.alias("p")
    found = left.join(right, _same_row("d", "p")).select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.text_key").alias("text_key"), "wanted",
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    texts = found.select("doc_id", "text_key", "line_no", "line", F.col("wanted")[F.col("line_no")].alias("digest")).filter(
        F.col("digest") == F.unhex(F.md5("line"))).groupBy("digest").agg(
        F.min(_place()).alias("first"), F.first("line").alias("line"))
    texts = reliable(texts)

    zones = texts.select("digest", "first", F.explode(_zones(F.col("line"))).alias("z")).select("digest", "first", "z.*")
    emitted = reliable(_shared(zones, ["k1", "k2"]).select(
        "digest", "first", "k1", "k2", F.inline(_neighbourhood(F.col("middle")))))
    group = ["k1", "k2", "variant"]
    # One substitution apart: same variant, same place; the earliest stands for the group.
    head = emitted.filter("place > 0").groupBy(*group, "place").agg(
        F.min(F.struct("first", "digest")).alias("head"), F.count("*").alias("n")).filter("n > 1").select(*group, "place", "head")
    same = emitted.join(head, [*group, "place"]).filter(F.col("digest") != F.col("head.digest")).select(
        "digest", F.col("head.digest").alias("other"))
    # One insertion apart: a line that is a variant of longer ones; the earliest of those stands for them.
    plain = emitted.filter("place = 0").select(*group, F.col("digest").alias("short"), F.col("first").alias("short_first"))
    longer = emitted.filter("place > 0").join(plain, group)
    after = longer.filter(F.col("first") > F.col("short_first")).select("digest", F.col("short").alias("other"))
    before = longer.filter(F.col("first") < F.col("short_first")).groupBy(F.col("short").alias("digest")).agg(
        F.min(F.struct("first", "digest")).alias("head")).select("digest", F.col("head.digest").alias("other"))
    pairs = same.unionAll(after).unionAll(before).distinct()
    mine = texts.select("digest", F.col("line").alias("mine"))
    theirs = texts.select(F.col("digest").alias("other"), F.col("line").alias("theirs"))
    verified = pairs.join(mine, "digest").join(theirs, "other").filter(F.levenshtein("mine", "theirs", 1).between(0, 1))
    return verified.select("digest").distinct()


def dropped_lines(docs: DataFrame, exact_below: int = 0) -> DataFrame:
    """``(doc_id, text_key, line_no, near)`` of every line that has an earlier equal line or near one."""
    occurrences = _occurrences(docs, exact_below)
    lines = reliable(occurrences.groupBy("digest").agg(
        F.min(_place()).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")))
    near = _near(docs, lines)
    judged = lines.join(near.withColumn("near", F.lit(True)), "digest", "left").filter((F.col("n") > 1) | F.col("near"))
    judged = reliable(judged.select("digest", "first", F.coalesce("near", F.lit(False)).alias("near")))
    return occurrences.select("doc_id", "text_key", "line_no", "digest").join(judged, "digest").filter(
        F.col("near") | (_place() > F.col("first"))).select("doc_id", "text_key", "line_no", "near").distinct()


def _per_row(docs: DataFrame, exact_below: int) -> DataFrame:
    return dropped_lines(docs, exact_below).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list("line_no")).alias("dropped"), F.count_if("near").alias("n_near"))


def line_report(docs: DataFrame, exact_below: int = 0) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, n_near and the numbers of the dropped lines."""
    rows = columns(docs, "doc_id", "text").select(
        "doc_id", _text_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    joined = rows.alias("r").join(_per_row(docs, exact_below).alias("p"), _same_row("r", "p"), "left")
    return joined.select(
        F.col("r.doc_id").alias("doc_id"), F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.transform("dropped", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))


def dedup(docs: DataFrame, exact_below: int = 0) -> DataFrame:
    """The documents without their dropped lines; other columns stay."""
    packed = docs.select(F.struct("*").alias("row"), F.col("`doc_id`").alias("doc_id"), F.xxhash64("`text`").alias("text_key"))
    joined = packed.alias("d").join(_per_row(docs, exact_below).alias("p"), _same_row("d", "p"), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(
        F.split("row.text", "\n"), lambda line, i: ~F.array_contains("dropped", i)), "\n"))
    names = [f.name for f in docs.schema]
    return joined.select(*[kept.alias(n) if n == "text" else F.col(f"row.`{n}`").alias(n) for n in names])
