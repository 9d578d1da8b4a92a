"""Alignment of two vocabularies against the definitions, token by token."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestrata.llm import alignment, pretokens

A, B = pretokens.tokenizer_path("byte_bpe_50k.json"), pretokens.tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "a ", " a  b   c\n\n  d\te \r\n f;\r\n g", "<|endoftext|> <s> <0x41> </s>", "it's we'll don't x", "日本語 text ÅÉ ß İ Σς", "naïve café é",
    "with ▁ inside", "x▁", "a\x00b c", "  b   c 　 d   e", "🙂🙂 \U0001f468‍\U0001f469", "word " * 3000, "q" * 5000, "  private", "a\x0b b\x1c c", "tab\t\ttab \n \n", "a\n",
]


def plain(text, tok, model):
    """Tokens of both sides with their byte ranges, straight from the libraries; none if a side differs."""
    if not text:
        return None
    letters = alignment._byte_letters()
    whole = (" " + text).encode()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    a_bytes = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    sides = []
    for ids, pieces in ((a, a_bytes), (b, b_bytes)):
        ends = np.cumsum(list(map(len, pieces))).tolist()
        sides.append([(i, e - len(p), e) for i, p, e in zip(ids, pieces, ends)])
    return sides


def links_of(a, b):
    k, found = 0, []
    for i, (_, start, end) in enumerate(a):
        while b[k][2] <= start:
            k += 1
        j = k
        while j < len(b) and b[j][1] < end:
            found.append((i, j))
            j += 1
    return found


def brute(rows):
    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    made = [(d, plain(t, tok, model)) for d, t in rows]
    counts, per = collections.Counter(), []
    for _, sides in made:
        links = links_of(*sides) if sides else []
        per.append(links)
        counts.update((sides[0][i][0], sides[1][j][0]) for i, j in links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (d, sides), links in zip(made, per):
        if not sides:
            yield (d, 0, 0, 0, 0, 0, 0, 0, "")
            continue
        common = sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]})
        groups = [[[], []] for _ in common]
        for k, side in enumerate(sides):
            for i, _, e in side:
                groups[int(np.searchsorted(common, e))][k].append(i)
        pairs = [(sides[0][i][0], sides[1][j][0]) for i, j in links]
        written = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        yield (d, len(sides[0]), len(sides[1]), len(common), len(links), sum(len(x) * len(y) for x, y in groups),
               sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest())


@pytest.fixture(scope="module")
def docs(spark, folder):
    edge = spark.createDataFrame([*((9000 + k, t) for k, t in enumerate(TEXTS)), (9001, ""), (9006, "twice"), (9006, "twice"), (None, "no id here")], "doc_id bigint, text string")
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(edge)


@pytest.mark.parametrize("common", [1 << 19, 300, 0])
def test_alignments(spark, docs, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    made = alignment.alignments(docs.selectExpr("*", "1 AS n_a", "'x' AS pair", "2 AS row"), A, B)
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_shared, r.n_best, r.count_sum, r.groups_sha256) for r in made.collect()]
    want = list(brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert collections.Counter(rows) == collections.Counter(want)


def test_alignments_of_nothing(docs):
    assert alignment.alignments(docs.limit(0), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.alignments(docs.filter("doc_id = 9000"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_products_of_sparse_rows():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = (rng.integers(0, 3, shape) * (rng.random(shape) < 0.3) for shape in ((7, 9), (9, 5)))
        a, b = (alignment.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0], m.shape[1]) for m in (x, y))
        got, dense = a.times(b), np.zeros((7, 5), int)
        dense[got.rows, got.indices] = got.values
        assert (dense == x @ y).all() and len(got.values) == ((x > 0).astype(int) @ (y > 0) > 0).sum()
        back = a.transposed()
        dense = np.zeros((9, 7), int)
        dense[back.rows, back.indices] = back.values
        assert (dense == x.T).all()


def test_pieces_join_to_the_whole_text():
    voc = alignment.vocabularies(A, B)
    assert voc.cuts
    texts = pa.array([t for t in TEXTS if t and "▁" not in t])
    whole = alignment.Vocabularies(A, B)
    whole.cuts = False
    cut, uncut = alignment.align(texts, voc), alignment.align(texts, whole)
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_shared"):
        assert cut.total(getattr(cut, name)).tolist() == uncut.total(getattr(uncut, name)).tolist()
