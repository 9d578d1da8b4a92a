"""Fingerprint classes, components and line dedup against brute force."""

import collections
import random
import re

import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup, simhash
from lodestrata.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_classes(spark, folder):
    edge = [(1000, None), (1001, ""), (1002, "ÀB Σίσυφος OΣ Word"), (1003, "àb σίσυφος oς word"), (1004, "A b"), (1005, "a B"), (1005, "a B"),
            (1006, "w " * 200_000)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame(edge, "doc_id bigint, text string"))
    docs = docs.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = least(prints, linked)
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == collections.Counter(
        (r.doc_id, f"{prints[r.doc_id]:016x}", want[r.doc_id]) for r in rows)
    assert want[1001] == 1000 and want[1005] == 1004
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(want.values()))


def test_links_are_complete(spark):
    rnd, prints = random.Random(5), set()
    for _ in range(150):
        base = rnd.getrandbits(64)
        prints.add(base)
        for bits in (1, 2, 3, 4):
            x = base
            for b in rnd.sample(range(64), bits):
                x ^= 1 << b
            prints.add(x)
    prints |= {0, (1 << 64) - 1, 1 << 63, 7}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()}
    want = {(a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3}
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want} and len(got) * 2 == len(want)


def test_classes_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    nulls = spark.createDataFrame([(None, "some words"), (None, "some words"), (3, "some words")], "doc_id bigint, text string")
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [3, 3, 3]
    assert simhash.keep_one(nulls).count() == 1


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    pairs += [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(60)]
    rnd.shuffle(pairs)
    want = least({n for p in pairs if p[0] != p[1] for n in p}, [p for p in pairs if p[0] != p[1]])
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return a == b
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def line_drops(rows, exact_below=0):
    """(doc_id, line) drops by comparing every line with all earlier ones of like length; short ones are only compared exactly."""
    key = lambda d: (d is not None, d or 0)
    first, drops = {}, collections.defaultdict(set)
    places = sorted({(key(d), n, line, d) for d, t in rows for n, line in enumerate((t or "").split("\n")) if WORD.search(line)}, key=lambda p: p[:2])
    by_size = collections.defaultdict(list)
    for order, n, line, d in places:
        if line in first:
            drops[d].add(n) if (order, n) != first[line] else None
        first.setdefault(line, (order, n))
    for line in sorted(first, key=first.get):
        by_size[len(line)].append(line)
    near = {line for line in first for size in (len(line) - 1, len(line), len(line) + 1) for other in by_size[size]
            if first[other] < first[line] and min(len(line), len(other)) >= exact_below and one_edit(line, other)}
    for _, n, line, d in places:
        if line in near:
            drops[d].add(n)
    return drops


def test_line_dedup(spark):
    rnd = random.Random(11)
    base = ["the quick brown fox", "hello world again", "aaaa", "ab", "x", "line " * 30, "é ü ß", ""]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rnd.randrange(1, 12)):
            line = rnd.choice(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                p = rnd.randrange(len(line) + 1)
                line = rnd.choice([line[:p] + rnd.choice("abxy ") + line[p:], line[:p] + line[p + 1:], line[:p] + rnd.choice("abxy ") + line[p + 1:]])
            lines.append(line)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, " \n "), (3, rows[3][1]), (None, "the quick brown fox\nunseen"), (103, "y" * 30_000), (104, "y" * 29_999)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, line_no int")
    want = line_drops(rows)
    got = line_dedup.line_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.dropped == ",".join(map(str, sorted(want.get(r.doc_id, ())))), r
    shown = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup(docs).select("doc_id", "text").collect())
    assert shown == collections.Counter((d, None if t is None else "\n".join(
        x for n, x in enumerate(t.split("\n")) if n not in want.get(d, ()))) for d, t in rows)
    assert line_dedup.dedup(docs).columns == docs.columns


def test_short_lines_are_only_compared_exactly(spark):
    rows = [(1, "De.\nDie.\nsevench\neightcha\nIn."), (2, "De.\nsevenche\neightchb\nIt.\nsevencha"), (3, "10\n11\n10\neightchab")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bound in (0, 8, 9, 1000):
        want = line_drops(rows, bound)
        got = {r.doc_id: r.dropped for r in line_dedup.line_report(docs, bound).collect()}
        assert got == {d: ",".join(map(str, sorted(want.get(d, ())))) for d, _ in rows}, bound


def test_the_query_compares_lines_of_any_length(spark, tmp_path):
    from lodestrata.llm.queries import QUERIES

    rows = [(1, "De.\nDie.\nsevench\neightcha\nIn."), (2, "De.\nsevenche\neightchb\nIt.\nsevencha"), (3, "10\n11\n10\neightchab")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = line_drops(rows)
    got = {r.doc_id: r.dropped for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: ",".join(map(str, sorted(want.get(d, ())))) for d, _ in rows}


def test_line_dedup_of_rows_with_one_id(spark):
    one, two = "a fairly long line of words", "another line of quite other words"
    rows = [(None, f"{one}\nonly here"), (None, f"{two}\nunique in its row\n{one}"), (7, "the first of seven\nstays\nsomething"),
            (7, "a second text of seven\nthe first of seven\nnot the same"), (8, f"{one}s\n{two}s\nthe first of sevens\na second text of sevens\nnew")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.n_lines, r.n_dropped, r.n_near, r.dropped) for r in line_dedup.line_report(docs).collect())
    assert got == [(0, 2, 0, 0, ""), (0, 3, 1, 0, "2"), (7, 3, 0, 0, ""), (7, 3, 1, 0, "1"), (8, 5, 4, 4, "0,1,2,3")]
    kept = sorted(r.text for r in line_dedup.dedup(docs).collect())
    assert kept == sorted([rows[0][1], f"{two}\nunique in its row", rows[2][1], "a second text of seven\nnot the same", "new"])
    # Lines at one place of two rows without id: one of them stands first.
    same = spark.createDataFrame([(None, "one line\nx y z"), (None, "one line\np q r")], "doc_id bigint, text string")
    assert sorted(r.dropped for r in line_dedup.line_report(same).collect()) == ["", "0"]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
