"""Quality rules and personal data against brute force, and their edge cases."""

import collections
import hashlib
import re

import pytest

from lodestrata.llm import pii, quality_rules
from lodestrata.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h " * 2000), (6, "x" * 200_000), (7, "1." * 50_000),
    (8, "same line here\nsame line here\n\nsame line here"), (8, "same line here\nsame line here\n\nsame line here"),
    (None, "no id at all but with some words " * 5), (9, "\x01odd\x02 a@b.com \x01"), (10, "é ü " * 40),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", float(k)) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, w string, n_words double")


def counts(text):
    w = WORD.findall(text or "")
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    covered = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub(r"\D", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group())]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


def test_counts(spark, folder, edge):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    texts = collections.Counter((r.doc_id, counts(r.text)) for r in docs.collect())
    got = collections.Counter(
        (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        for r in quality_rules.quality(docs).collect())
    assert got == texts


def test_rules_keep_labelled_good_text(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality_rules.quality(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert not [r.doc_id for r in rows if labels.get(r.doc_id) == 1 and r.failed and not r.base_failed]
    assert [r.doc_id for r in rows if labels.get(r.doc_id) == 0 and not r.kept]


def test_keep_good_keeps_columns_and_repeats(spark, edge):
    good = "the cat and the dog are in the house with a lot of people that come from all over this big town"
    docs = edge.unionByName(spark.createDataFrame([(20, good, "x", 1.0)] * 2, edge.schema))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == edge.columns
    assert [(r.doc_id, r.n_words) for r in kept.filter("doc_id = 20").collect()] == [(20, 1.0)] * 2
    assert quality_rules.keep_good(edge.limit(0)).count() == 0


def test_operators_are_native(spark, folder):
    for name in ("op3_quality_rules", "op4_personal_data", "op5_line_dedup"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_base_spans(spark, folder, edge):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(30 + k, t) for k, t in enumerate([
        "a@b.com_x@y.org", "é 1.2.3.4.5.6.7.8 é", "x 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (017) 555-7713 +1 +12345678901234567", "a.b@c", "@@a@b.c.d.e..f", "5+1 2 3 4 5 6 7 8 9 0 1 2 3", "1 2.3.4.5@x.y"])], "doc_id bigint, text string"))
    want = collections.Counter((r.doc_id, hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest()) for r in docs.collect())
    rows = pii.digest(pii.personal_data(docs)).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert next(r.spans for r in rows if r.doc_id == 2) == ""


def test_added_spans_need_proof(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "code DE88 3704 0044 0532 0130 00 here", "call (017) 555-7713 now", "lot (017) 555-7713 now",
             "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [s["kind"] for s in r.found] for r in pii.personal_data(docs).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["local_phone"], 3: [], 4: ["secret"]}
    shown = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert shown[3] == texts[3] and "5557713" not in re.sub(r"\D", "", shown[2])


def test_pii_empty_table(spark):
    assert pii.digest(pii.personal_data(spark.createDataFrame([], "doc_id bigint, text string, found int"))).count() == 0
