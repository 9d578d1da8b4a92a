"""Token counts and files, languages, mixing and the pipeline."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import language_id, mixing, pretokens, queries, samples, sparse_model, token_counts, token_files
from lodestrata.session import checkpoint_dir

EDGE = [
    (900, None), (901, ""), (902, "it's we'll  'sx ''s \n\n a  b \t c "), (903, "<|endoftext|> x<|endoftext|><|startoftext|>"), (904, "日本語 text ÅÉ ß İ Σς"),
    (905, "x1234y  " * 5000), (906, "a" * 50_000), (907, "\x00 \x0b   "), (902, "it's we'll  'sx ''s \n\n a  b \t c "), (902, "other"),
    (None, "no id"), (908, "\x001 \x002"),
]


@pytest.fixture(scope="module")
def docs(spark, folder):
    edge = spark.createDataFrame(EDGE, "doc_id bigint, text string")
    both = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(edge)
    return both.selectExpr("*", "1 AS n_tokens", "'t' AS token", "0 AS start")


def library(name):
    return Tokenizer.from_file(pretokens.tokenizer_path(name))


def test_token_counts(spark, docs):
    tok = library("byte_bpe_50k.json")
    want = collections.Counter()
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
    made = token_counts.token_counts(docs, pretokens.tokenizer_path("byte_bpe_50k.json"))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in made.collect()) == want
    assert token_counts.token_counts(docs.limit(0), pretokens.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_token_counts_without_common_table(spark, docs, monkeypatch):
    """With no pre-token held by the tasks everything goes through the join, to the same result."""
    path = pretokens.tokenizer_path("byte_bpe_50k.json")
    want = sorted(map(str, token_counts.token_counts(docs, path).collect()))
    monkeypatch.setattr(token_counts, "COMMON", 0)
    assert sorted(map(str, token_counts.token_counts(docs, path).collect())) == want


def test_token_files(spark, docs):
    tok, path = library("word_bpe_49k.json"), pretokens.tokenizer_path("word_bpe_49k.json")
    manifest = token_files.write_tokens(docs, checkpoint_dir(spark), path, length=128, rows=4)
    rows = token_files.read_tokens(spark, manifest).collect()
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    at, got = 0, sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, v in ids.items() for _ in v), key=lambda d: (d is not None, d or 0))
    for r in got:
        assert r.start == at
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in ids[r.doc_id]]
        at += r.n_tokens
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(
        (d, len(x), zlib.crc32(x.tobytes())) for d, v in ids.items() for x in v)
    first = manifest.orderBy("part").first()
    reader = token_files.open_ids(first.ids_path)
    assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 128)
    flat = np.concatenate([next(iter(ids[None])), *(x for r in got if r.doc_id is not None and len(ids[r.doc_id]) == 1 for x in ids[r.doc_id])])[:first.tokens]
    k = min(5, len(flat) // 128 - 1)
    sequence, mask = token_files.sequence(reader, k, rows=4)
    assert sequence.tolist() == flat[128 * k:128 * (k + 1)].tolist() and all(mask.to_pylist())
    real = sum(b.column("mask").flatten().true_count for b in (reader.get_batch(i) for i in range(reader.num_record_batches)))
    assert real == first.tokens


def test_token_files_of_nothing(spark, docs):
    manifest = token_files.write_tokens(docs.limit(0), checkpoint_dir(spark), pretokens.tokenizer_path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, manifest).count() == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    odd = spark.createDataFrame([(5000, None, "en"), (5001, "12 !?", "en"), (5002, "the and with", None), (None, "the and with", "en")], "doc_id bigint, text string, lang string")
    rows = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(odd).selectExpr("*", "1 AS score")).collect()
    assert len(rows) == len(truth) + 4 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {(r.doc_id, r.lang_pred) for r in rows if r.doc_id in (5000, 5001)} == {(5000, "und"), (5001, "und")}


def test_languages_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs).collect()] == [("und", 0.0)]
    assert language_id.identify(docs.limit(0)).count() == 0


def plain_ngrams(text):
    """Counts of hashed n-grams of letters, other characters as one space, in whole numbers of 64 bits."""
    codes = []
    for c in text.lower():
        c = ord(c) if c.isalpha() else 32
        if c != 32 or not codes or codes[-1] != 32:
            codes.append(c)
    counts = collections.Counter()
    for order in language_id.ORDERS:
        for i in range(len(codes) - order + 1):
            h = 0
            for c in codes[i:i + order]:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2 ** 64
            counts[(h * 0xD6E8FEB86659FD93) % 2 ** 64 >> 48] += 1
    return counts


def test_tfidf_by_hand():
    texts = ["The quick, brown fox; été!", "aaa bbb", "Straße 12 İx \U00030001\U00030002 z", "a" * 3000 + " b"]
    found = [plain_ngrams(t) for t in texts]
    frequency = collections.Counter(b for f in found for b in f)
    idf = np.array([np.log((1 + len(texts)) / (1 + frequency[b])) + 1 for b in range(language_id.BUCKETS)])
    for text, counts in zip(texts, found):
        at, n = language_id.ngram_counts(text)
        assert dict(zip(at.tolist(), n.tolist())) == dict(counts)
        want = np.array([(1 + np.log(counts[b])) * idf[b] for b in at])
        assert np.allclose(language_id._tfidf(at, n, idf), want / np.sqrt((want ** 2).sum()))
    assert len(language_id.ngram_counts("\U00030001\U00031000")[0]) and not len(language_id.ngram_counts("12 \U0001F600!")[0])


def test_ftrl_by_hand():
    """The first steps of the regularised leader, weight by weight, from its definition."""
    rng = np.random.default_rng(2)
    size, classes, alpha, beta, l1, l2 = 12, 3, 0.7, 1.0, 0.05, 0.1
    state = sparse_model.Ftrl(size, classes, alpha, beta, l1, l2)
    z, n = {}, {}

    def weight(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        bound = 0.0 if i == size else l1
        return 0.0 if abs(zi) <= bound else -(zi - np.sign(zi) * bound) / ((beta + ni ** 0.5) / alpha + l2)

    for _ in range(60):
        at = np.append(np.sort(rng.choice(size, 4, replace=False)), size)
        x, target = np.append(rng.random(4), 1.0), int(rng.integers(classes))
        scores = [sum(xi * weight(i, k) for i, xi in zip(at, x)) for k in range(classes)]
        p = np.exp(scores) / np.exp(scores).sum()
        before = {(i, k): weight(i, k) for i in at for k in range(classes)}
        state.step(at, x, target)
        for i, xi in zip(at, x):
            for k in range(classes):
                g = xi * (p[k] - (k == target))
                old = n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old ** 0.5) / alpha * before[i, k]
                n[i, k] = old + g * g
    got = state.weights(np.arange(size + 1))
    assert np.allclose(got, [[weight(i, k) for k in range(classes)] for i in range(size + 1)], atol=1e-10)


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(400, 3)) * 4
    targets = np.array([rng.choice(3, p=sparse_model.softmax(row / 2.5)) for row in logits])
    loss = lambda t: -np.log(sparse_model.softmax(logits / t)[np.arange(400), targets]).mean()
    assert loss(sparse_model._temperature(logits, targets)) <= min(loss(t) for t in np.exp(np.linspace(-2, 2, 400))) + 1e-6


def test_ngrams_cross_part_borders(monkeypatch):
    text = "the quick brown fox été " * 20
    want = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "_PART", 50)
    got = language_id.ngram_counts(text)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_regression_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1200):
        k = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(10, 300, 12), k if rng.random() < 0.9 else 9))
        rows.append((at, np.ones(len(at))))
        labels.append("abc"[k])
    model = sparse_model.fit(rows[:800], labels[:800], 300, epochs=8, l1=2.0)
    right = np.array([model.classes[int(model.posterior(*r).argmax())] == y for r, y in zip(rows[800:], labels[800:])])
    sure = np.array([model.posterior(*r).max() for r in rows[800:]])
    assert right.mean() > 0.85 and abs(sure.mean() - right.mean()) < 0.07
    # The penalty leaves few of the features without meaning, and weakening it leaves more.
    dense = sparse_model.fit(rows[:800], labels[:800], 300, epochs=8, l1=0.0)
    assert (model.weights[10:] == 0).mean() > 0.5 > (dense.weights[10:] == 0).mean() and (model.weights[:3] != 0).all()


def descend(tokens, p, target, most, rounds):
    """Projected gradient in plain numpy."""
    has, r = (tokens[:, None] * p).sum(0), np.minimum(1.0, most) * np.ones(len(tokens))
    for _ in range(rounds):
        now = (tokens[:, None] * p * r[:, None]).sum(0)
        r = np.clip(r - p @ ((now - target) / has), 0, most)
    return r


def test_fitted_rates(spark):
    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([0.3, 0.2, 0.1], 400), rng.integers(1, 500, 400)
    scored = spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens, p))], "doc_id bigint, tokens bigint, p array<double>")
    weights = {"clean": 0.7, "low": 0.3, "toxic": 0.0}
    misses = mixing.fit_rates(scored, weights, reach=0.9, most=3.0)
    got = np.array([r.rate for r in scored.select("doc_id", mixing.rate(scored.p, misses, 3.0).alias("rate")).orderBy("doc_id").collect()])
    has = (tokens[:, None] * p).sum(0)
    target = np.array([0.7, 0.3, 0.0]) * 0.9 * has[0] / 0.7
    assert np.allclose(got, descend(tokens, p, target, 3.0, len(misses)), atol=1e-9) and got.min() >= 0
    loss = lambda r: ((((tokens * r) @ p - target) ** 2) / has).sum()
    best = loss(descend(tokens, p, target, 3.0, 3000))
    assert loss(got) - best <= 0.02 * (loss(np.ones(400)) - best)


def test_mixing(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    weights = {"clean": 0.9, "low": 0.1, "toxic": 0.0}
    rows = mixing.rates(docs, labels, weights, reach=1.15).collect()
    truth = {r.doc_id: mixing.DOMAINS[2] if r.toxic else mixing.DOMAINS[0] if r.quality else mixing.DOMAINS[1] for r in labels.collect()}
    copies = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.rate <= 1 and abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-6
        copies[truth.get(r.doc_id)].append(r.copies)
    assert np.mean(copies["clean"]) > 0.95 and np.mean(copies["toxic"]) < 0.3
    kept = mixing.mixed(docs.selectExpr("*", "2 AS row", "'x' AS p"), labels, weights, reach=1.15)
    assert kept.columns == [*docs.columns, "row", "p"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows for _ in range(r.copies))


def test_registered_mixture_meets_its_targets(spark):
    folder = "/root/testdata/sf0.01"
    rows = mixing.rates(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"),
                        queries.MIX, reach=queries.REACH).collect()
    has, got = ({d: sum(r.tokens * r[f"p_{d}"] * (r.rate if rated else 1) for r in rows) for d in mixing.DOMAINS} for rated in (False, True))
    whole = queries.REACH * has["clean"] / queries.MIX["clean"]
    for d in mixing.DOMAINS:
        assert abs(got[d] - queries.MIX[d] * whole) <= 0.01 * whole, d
        assert queries.MIX[d] == 0 or abs(got[d] / (queries.MIX[d] * whole) - 1) <= 0.02, d


def test_sample_counts_documents_not_labels(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('word', id, ' and more') AS text")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id < 300 AS int) AS quality", "0 AS toxic")
    seen = []
    monkeypatch.setattr(mixing.sparse_model, "fit", lambda rows, names, *_, **__: seen.extend(names))
    mixing.fit_domains(docs, labels, per_domain=200)
    assert abs(seen.count("clean") - 200) < 45 and abs(seen.count("low") - 200) < 45


def plain_features(text):
    """What the vectorised features of a text are, one part after another."""
    parts, found = regex.findall(r"[\p{L}\p{N}]+|_+|[^\p{L}\p{N}_\s]+", text or ""), set()
    if not parts:
        return 0, []
    kinds, n = {p.lower() for p in parts}, len(parts)
    lines = text.split("\n")
    shares = {"capitals": sum(len(p) for p in parts if p.isupper() and len(p) > 1) / sum(map(len, parts)),
              "symbols": sum(not p[0].isalnum() for p in parts) / n, "different": len(kinds) / n, "lines": len(set(lines)) / len(lines)}
    names = [*kinds, *(k[:5] + "\x00" for k in kinds if len(k) >= 5), *(f"{k}\x00{int(np.searchsorted(mixing._STEPS, v, 'right'))}" for k, v in shares.items())]
    return len(regex.findall(r"[^\x20\x09-\x0D]+", text)), sorted({zlib.crc32(name.encode()) % mixing.FEATURES for name in names})


def test_features_of_texts():
    texts = [r.text for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["text"]).to_pandas().itertuples()]
    texts += [None, "", " \n ", "ÄÖ ßx, a_b__c x--y\u00a0zz 12ab3! ABC\nABC\nABC", "one " * 200_000 + "TWO,three", "x" * 300_000, "a\n\nb\n"]
    tokens, ends, found = mixing.features(pa.array(texts, pa.string()))
    starts = [0, *ends[:-1]]
    for k, text in enumerate(texts):
        n, want = plain_features(text)
        assert (tokens[k], found[starts[k]:ends[k]].tolist()) == (n, want), text and text[:80]
    model = sparse_model.Model(["clean", "toxic"], np.random.default_rng(0).normal(size=(mixing.FEATURES, 2)).astype(np.float32), np.array([0.3, -0.2]), 1.7)
    _, p = mixing._scores(model, pa.array(texts, pa.string()), "clean")
    for k in range(len(texts)):
        at = found[starts[k]:ends[k]]
        assert np.allclose(p[k, [0, 2]], model.posterior(at, np.ones(len(at))), atol=1e-5) and p[k, 1] == 0


def test_samples_are_bounded(spark):
    """A doc_id or a document that a third of the rows repeat neither swells nor empties the sample."""
    docs = spark.range(9000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "IF(id % 2 = 0, 'same text', concat('text ', id)) AS text")
    kinds = docs.selectExpr("doc_id", "xxhash64(text) AS text_key", "IF(doc_id = 7, 'a', 'b') AS kind")
    sample, sizes = samples.labelled_texts(docs, kinds, 300)
    rows = sample.collect()
    assert sizes == {"a": 1502, "b": 5999}  # 7 has a row of its own, too
    for kind in "ab":
        assert abs(sum(r.kind == kind for r in rows) - 300) < 90
    assert len(rows) <= 1200 and sum(r.text == "same text" and r.kind == "a" for r in rows) <= 1
    assert samples.labelled_texts(docs, kinds.limit(0), 300)[0].count() == 0


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x")], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = mixing.rates(docs, none, {"clean": 1.0}).collect()
    assert sorted((r.doc_id or 0, r.tokens, r.rate, r.copies) for r in rows) == [(0, 1, 1.0, 1), (1, 0, 1.0, 1), (2, 0, 1.0, 1), (3, 2, 1.0, 1), (3, 2, 1.0, 1)]
    assert mixing.rates(docs.limit(0), none, {"clean": 1.0}).count() == 0
    assert mixing.mixed(docs.limit(0), none.limit(0), {"clean": 1.0}).count() == 0


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, seen, folder).cache()
        assert kept.columns == docs.columns
        before, after = (collections.Counter(r.doc_id for r in x.collect()) for x in (seen, kept))
        assert not after - before and after, name
        seen = kept
    last = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in last) == collections.Counter(r.doc_id for r in seen.collect())
