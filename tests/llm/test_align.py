"""Alignments of two tokenizers against the libraries and plain Python."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import documents
from test_texts import odd_texts

from veilspark.llm import align

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        bytes_a = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes_a[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    return tokens


def brute(texts, tokens):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    docs, count = [], Counter()
    for t in texts:
        sides, ends = tokens(t), []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        at_b = dict(ends[1])
        links = [(i, at_b[e]) for e, i in ends[0] if e in at_b]
        cuts = sorted({e for e, _ in ends[0]} & set(at_b))
        groups = [tuple([str(i) for e, i in side if a < e <= z] for side in ends) for a, z in zip([0, *cuts], cuts)]
        count.update(links)
        docs.append((len(sides[0]), len(sides[1]), groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    lines = [";".join(",".join(a) + "|" + ",".join(b) for a, b in groups) for _, _, groups, _ in docs]
    return [(a, b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if s else "") for (a, b, groups, links), s in zip(docs, lines)]


def digest_rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_ids_are_the_libraries_ids(libraries):
    both = align.Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    for t in odd_texts(800, 9) + ["<|endoftext|>", "a<|endoftext|> b", "ﬁne ｆｕｌｌ", "é", " ", "a ", "▁a", "a▁", "\n", "x" * 5000]:
        a, b = both.encode(t)
        want = libraries(t)
        assert [np.frombuffer(x, np.uint32).tolist() for x in (a, b)] == [[i for i, _ in side] for side in want], t


def test_digests_against_plain_python(spark, docs, rows, libraries):
    want = brute([t for _, t, _ in rows], libraries)
    assert digest_rows(align.alignment_digests(docs)) == sorted((-1 if i is None else i, *w) for (i, _, _), w in zip(rows, want))


@pytest.mark.parametrize("window, size", [(16, 40), (200, 1 << 20), (1 << 22, 300)])
def test_digests_of_odd_texts_in_small_windows(spark, libraries, monkeypatch, window, size):
    monkeypatch.setattr(align, "WINDOW", window)
    monkeypatch.setattr(align, "SLICE", size)
    texts = odd_texts(250, 5) + ["<|endoftext|> the <|endoftext|>"]
    both = align.pair()
    out = [x for b in documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", "text").toArrow().to_batches() for x in align._digested(None, None)([b])]
    want = brute(texts, libraries)
    got = [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "groups_sha256")) for x in out for r in x.to_pylist()]
    assert got == [(w[0], w[1], w[2], w[6]) for w in want]
    links = [x for b in out for row in b.column("links").to_pylist() for x in row]
    assert max(links) < len(both.links) and len(links) == sum(w[3] for w in want)


def test_alignments(spark, docs, rows, libraries):
    """Overlaps cover the bytes, each owned by the two tokens named; groups end where tokens of both do."""
    texts = {i: t for i, t, _ in rows}
    for r in align.alignments(docs).collect():
        a, b = libraries(texts[r.doc_id])
        assert r.a == [i for i, _ in a] and r.b == [i for i, _ in b]
        at, ends_a, ends_b = 0, np.cumsum([0, *(len(x) for _, x in a)]), np.cumsum([0, *(len(x) for _, x in b)])
        for o in r.overlaps:
            assert ends_a[o.a] <= at and at + o.bytes <= ends_a[o.a + 1] and ends_b[o.b] <= at and at + o.bytes <= ends_b[o.b + 1]
            at += o.bytes
        assert at == ends_a[-1]
        assert [(g.a, g.b) for g in r.groups] == [(int(np.searchsorted(ends_a, e)), int(np.searchsorted(ends_b, e))) for e in sorted(set(ends_a[1:]) & set(ends_b[1:]))]


def test_no_rows_and_texts_that_are_not_given_back(spark, no_docs):
    assert align.alignment_digests(no_docs).collect() == [] and align.alignments(no_docs).collect() == []
    got = digest_rows(align.alignment_digests(documents(spark, [(1, None, "a"), (2, "", "b"), (3, "a▁b", "b"), (None, "", None)])))
    assert got == [(i, 0, 0, 0, 0, 0, 0, "") for i in (-1, 1, 2, 3)]


def test_possible_links_are_few():
    both = align.pair()
    assert len(both.links) < sum(map(len, both.bytes_a)) + 2 * sum(map(len, both.bytes_b))
