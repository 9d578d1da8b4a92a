"""Quality rules: one projection of counts and ratios, judged by a table of thresholds.

Every measure is a built-in expression over one row, so the operator is map-only.

Defined results: a null text counts as empty; empty and blank texts have no words and fail the
word minimum; repeated rows are judged one by one; ratios of a text without words are 0; extra
columns are ignored by ``quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import columns, empty_as, let, pieces

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the languages in scope.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was were with",
    "de": "als auf aus bei das dem den der des die ein eine für ist mit nicht sich und von zu",
    "fr": "au aux avec ce dans de des du elle en est et il la le les pas pour que qui sur un une",
    "es": "a al como con de del el en es la las lo los no para por que se su un una y",
}


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; a bound of None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


# Measures a text must meet besides the base rule.
RULES = (
    Rule("mean_word", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.5),
    Rule("shout_ratio", None, 0.6),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bare_ratio", None, 0.5),
)


def stop_forms() -> list[str]:
    """The stop words as written in running text, at sentence starts and in capitals."""
    listed = {w for line in STOP_WORDS.values() for w in line.split()}
    return sorted(listed | {w.capitalize() for w in listed} | {w.upper() for w in listed})


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice; hashes are of single words."""
    def joined(parts: Column, step: int) -> Column:
        """Hash each element with the one ``step`` later: twice as many words each."""
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 1 - step), lambda i: F.xxhash64(F.get(parts, i), F.get(parts, i + step)))

    windows = F.when(F.size(hashes) >= WINDOW, let(joined(hashes, 1), lambda two: let(
        joined(two, 2), lambda four: joined(four, 4)))).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        """Words covered by windows that start at the (ascending) places."""
        gaps = F.transform(places, lambda p, i: F.when(i == F.size(places) - 1, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), F.try_element_at(places, i + 2) - p)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(pairs: Column) -> Column:
        """Places of sorted (hash, place) pairs that have an equal neighbour."""
        same = F.filter(pairs, lambda x, i: (
            (i > 0) & (F.try_element_at(pairs, F.greatest(i, F.lit(1)))["h"] == x["h"])
        ) | (F.coalesce(F.try_element_at(pairs, i + 2)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(same, lambda x: x["at"]))

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(let(pairs, repeated), covered))

    return let(windows, count)


def measures(text: Column) -> Column:
    """A struct of all counts of one text."""
    text = empty_as(text)
    stops = stop_forms()

    def length_without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def lines(kept: Column) -> Column:
        return F.struct(F.size(kept).cast("long").alias("n"), (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("dup"))

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(*stops))).cast("long").alias("n_stop"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words"),
        )

    def of_pieces(cut: Column) -> Column:
        return F.struct(
            let(F.filter(cut, lambda x: x != ""), of_words).alias("of"),
            (F.length(text) - F.size(cut) + 1).cast("long").alias("word_chars"))

    return F.struct(
        let(pieces(text), of_pieces).alias("w"),
        (F.length(text) - length_without(rf"{SYMBOLS}+")).cast("long").alias("n_symbols"),
        (F.length(text) - length_without(r"\p{Lu}+")).cast("long").alias("n_upper"),
        (F.length(text) - length_without(r"\p{L}+")).cast("long").alias("n_letters"),
        let(worded, lines).alias("lines"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _counts(m: Column) -> dict[str, Column]:
    """The counts of a measured text by name."""
    of = m["w"]["of"]
    return {"n_words": of["n_words"], "n_stop": of["n_stop"], "n_repeat_words": of["n_repeat_words"], "word_chars": m["w"]["word_chars"],
            "n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["dup"], **{c: m[c] for c in ("n_symbols", "n_upper", "n_letters")}}


def _ratios(n: dict[str, Column]) -> dict[str, Column]:
    return {
        "mean_word": _ratio(n["word_chars"], n["n_words"]),
        "symbol_ratio": _ratio(n["n_symbols"], n["n_words"]),
        "shout_ratio": _ratio(n["n_upper"], n["n_letters"]),
        "stop_ratio": _ratio(n["n_stop"], n["n_words"]),
        "dup_line_ratio": _ratio(n["n_dup_lines"], n["n_lines"]),
        "bare_ratio": _ratio(n["word_chars"] - n["n_letters"], n["word_chars"]),
    }


def _base_failed(n: dict[str, Column], min_words: int, max_repeat_percent: int) -> Column:
    return (n["n_words"] < min_words) | (100 * n["n_repeat_words"] > max_repeat_percent * n["n_words"])


def _broken(rule: Rule, ratios: dict[str, Column]) -> Column:
    low = F.lit(False) if rule.low is None else ratios[rule.measure] < rule.low
    return low | (F.lit(False) if rule.high is None else ratios[rule.measure] > rule.high)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20,
            max_repeat_percent: int = 30) -> DataFrame:
    """Per document: counts, ratios, ``base_failed``, the ``failed`` rule names and ``kept``."""
    measured = columns(docs, "doc_id", "text").select("doc_id", measures(F.col("text")).alias("m"))
    counted = measured.select("doc_id", *[c.alias(name) for name, c in _counts(F.col("m")).items()])
    n = {name: F.col(name) for name in counted.columns}
    rated = counted.select("*", _base_failed(n, min_words, max_repeat_percent).alias("base_failed"),
                           *[c.alias(name) for name, c in _ratios(n).items()])
    ratios = {name: F.col(name) for name in rated.columns}
    broken = [F.when(_broken(r, ratios), F.lit(r.measure)) for r in rules]
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    judged = rated.select("*", failed.alias("failed"))
    return judged.select("*", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def is_good(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """Whether the rules keep a text, as one predicate that measures it once wherever it is pushed to."""
    def verdict(m: Column) -> Column:
        n = _counts(m)
        ratios = _ratios(n)
        good = ~_base_failed(n, min_words, max_repeat_percent)
        for rule in rules:
            good = good & ~_broken(rule, ratios)
        return good
    return let(measures(text), verdict)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, with all their columns; map-only."""
    return docs.filter(is_good(F.col("`text`"), **options))
