"""Toxicity: the noisy-or, its learning from document labels, and where it points."""

import zlib

import numpy as np
import pyarrow as pa

from lodestrata.llm import toxicity


def test_sentences_keep_every_character():
    texts = ["One two. Three!\nFour", None, "", "...\n\n", "a b?! c", "é ß x1_2 🙂 done.", "word " * 60_000 + "end. last"]
    made = toxicity.sentences(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert made.lengths[made.of == k].sum() == len(text or "")
    names = made.names.to_pylist()
    words = [[names[w] for w in made.words[a:b]] for a, b in zip(made.starts[:-1], made.starts[1:])]
    assert [w for k, w in zip(made.of, words) if k == 0] == [["one", "two"], ["three"], [], ["four"]]
    assert [w for k, w in zip(made.of, words) if k == 5 and w] == [["é", "ß", "x1", "2", "done"]]
    assert [len(w) for k, w in zip(made.of, words) if k == 6] == [60_001, 1]


def test_loss_and_its_slope():
    rng = np.random.default_rng(0)
    of, toxic, weight = np.sort(rng.integers(0, 6, 40)), rng.random(6) < 0.5, rng.random(6)
    logits = rng.normal(size=40)
    scores = 1 / (1 + np.exp(-logits))
    p = np.array([1 - np.prod(1 - scores[of == k]) for k in range(6)])
    value, slope = toxicity.loss(logits, of, toxic, weight)
    assert np.isclose(value, -(weight * np.where(toxic, np.log(p), np.log(1 - p))).sum())
    assert np.allclose(toxicity.noisy_or(scores, of, 6), p)
    for k in range(40):
        up, down = logits.copy(), logits.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert np.isclose(slope[k], (toxicity.loss(up, of, toxic, weight)[0] - toxicity.loss(down, of, toxic, weight)[0]) / 2e-6, atol=1e-6)


def made_up(n, rng):
    """Documents of random words; a toxic one has a marked word in one of its sentences."""
    for k in range(n):
        sentences = [" ".join(rng.choice([f"w{i}" for i in range(60)], 8)) for _ in range(int(rng.integers(1, 30)))]
        toxic = rng.random() < 0.15
        place = int(rng.integers(len(sentences)))
        if toxic:
            sentences[place] += " " + str(rng.choice(["vile", "foulmouth" + str(rng.integers(10 ** 6))]))
        yield k, ". ".join(sentences) + ".", int(toxic), sum(len(s) + 1 for s in sentences[:place]) + place


def test_learning_from_document_labels(spark):
    rows = list(made_up(3000, np.random.default_rng(3)))
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id bigint, text string").selectExpr("*", "1 AS score", "'x' AS kind")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} == {k for k, r in got.items() if r.held_out}
    toxic, clean = [r for r in held if r[2]], [r for r in held if not r[2]]
    assert np.mean([got[r[0]].predicted for r in toxic]) > 0.95 and np.mean([got[r[0]].predicted for r in clean]) < 0.02
    # The sentence that carries the mark is found, whatever its place.
    found = [r for r in toxic if got[r[0]].predicted]
    right = [[(s.start <= at + 1 < s.end) for s in got[k].offending] for k, _, _, at in found]
    assert np.mean([any(x) for x in right]) > 0.95 and np.mean([all(x) for x in right]) > 0.9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_alone_matter(spark):
    """Scores depend on texts and learnable labels only: other columns, held-out labels and repeated rows change nothing."""
    rows = list(made_up(400, np.random.default_rng(4)))
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows], "doc_id bigint, toxic int")
    scores = lambda d, l: {(r.doc_id, round(r.score, 7)) for r in toxicity.score(d, l).collect()}
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    assert scores(docs, labels) == scores(docs.union(docs).repartition(7), flipped.union(flipped))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "words here"), (4, "words"), (4, "words")], "doc_id bigint, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == 6 and all((r.score, r.predicted, r.offending) == (0.0, 0, []) for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    ones = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id bigint, toxic int")
    assert {(r.doc_id or 0, r.score) for r in toxicity.score(docs, ones).collect()} == {(1, 0.0), (2, 0.0), (3, 0.0), (0, 1.0), (4, 1.0)}
    assert toxicity.score(docs.limit(0), none.limit(0)).count() == 0
