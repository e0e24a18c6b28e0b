"""Token counts, packing and prefix fingerprints against the libraries and plain Python."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import documents

from veilspark.llm import packing, prefix, tokens

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
PIECES = list("ab thein  \n\t.,1@éß中文😀½ﬁ▁<s>/'sll ​\x00́\x85\xa0²_-\x1c") + ["<s>", "</s>", "<unk>", "<|endoftext|>", "   ", "the ", " 're", "'ll", "ing "]


def odd_texts(n=1500, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["", " ", "  ", "a" * 3000, " " * 70, "▁", "ab" * 2000 + " c"]


def test_transducer_counts_as_the_library():
    texts = odd_texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    assert tokens.count_tokens(texts, tokens.model_path()).tolist() == [len(x) for x in sp.encode(texts)]


@pytest.mark.parametrize("rounds", [0, 1, 9])
def test_transducer_with_small_tables(monkeypatch, rounds):
    for name, v in (("STATES", 300), ("PAIRS", 50), ("CHUNK", 7), ("SLICE", 200), ("WARM", 2), ("ROUNDS", rounds)):
        monkeypatch.setattr(tokens, name, v)
    monkeypatch.setattr(tokens, "_compiled", {})
    texts = odd_texts(300, 2)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    assert tokens.count_tokens(texts, tokens.model_path()).tolist() == [len(x) for x in sp.encode(texts)]


def test_transducer_on_long_texts_without_spaces():
    """Chunks end anywhere: texts whose states come together, pass from chunk to chunk, or go round."""
    r = random.Random(8)
    texts = ["a" * 300_001, "ab" * 70_000, "".join(r.choice("abcdefghijklmnop") for _ in range(40_000)), "".join(r.choice("中文的一é😀") for _ in range(60_000)), "1" + "the" * 50_000, " " * 40_000, "x" + " " * 5000 + "y" * 5000]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    assert tokens.count_tokens(texts, tokens.model_path()).tolist() == [len(x) for x in sp.encode(texts)]


def test_a_million_characters_without_a_space(monkeypatch):
    import time

    monkeypatch.setattr(tokens, "_compiled", {})
    tokens.count_tokens(["warm"], tokens.model_path())
    at = time.time()
    assert tokens.count_tokens(["abcd" * 250_000], tokens.model_path())[0] == len(sentencepiece.SentencePieceProcessor(model_file=tokens.model_path()).encode("abcd" * 250_000))
    assert time.time() - at < 20


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    with open(tokens.model_path(), "rb") as f:
        model = f.read()
    tokens.check_model(model)
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.pieces[5000], "piece", "a▁b")):
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        change(m)
        with pytest.raises(ValueError):
            tokens.check_model(m.SerializeToString())


def test_token_counts(spark, docs, rows, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()) == want
    assert tokens.token_counts(no_docs).collect() == []


def test_word_ids_are_the_library_ids():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = odd_texts() + [None]
    assert packing.encode(texts, path) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_pack(spark, docs, rows, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if k == 0 else a + 2048]
            want[(i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    out = packing.pack(docs).collect()
    got, bins = defaultdict(int), defaultdict(list)
    for r in out:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want and max(len(k) for k in got) == 5
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(no_docs).collect() == []


def test_sum_of_squares_rule():
    """Each placement is one of least squared counts, by counting them all."""
    r = np.random.default_rng(3)
    sizes = r.integers(1, 13, 400)
    place, offset = packing.sum_of_squares(sizes, 12)
    level = defaultdict(int)
    for s, b, o in zip(sizes.tolist(), place.tolist(), offset.tolist()):
        def squares(bin_no):
            after = dict(level)
            after[bin_no] = after.get(bin_no, 0) + s
            n = defaultdict(int)
            for v in after.values():
                if 0 < v < 12:
                    n[12 - v] += 1
            return sum(x * x for x in n.values())

        options = [k for k, v in level.items() if v + s <= 12] + [-1]
        assert o == level.get(b, 0) and (b in options or b not in level)
        assert squares(b) == min(map(squares, options))
        level[b] += s
    assert len(set(place.tolist())) <= sizes.sum() / 12 * 1.08 + 1


def test_prefix_equality_and_extension():
    r = random.Random(9)
    a = "".join(r.choice("ab") for _ in range(300))
    b = a[:120] + "x" + a[121:250]
    p, q = prefix.Prefix(a), prefix.Prefix(b)
    for _ in range(400):
        i, j = r.randrange(len(a)), r.randrange(len(b))
        n = r.randint(0, min(len(a) - i, len(b) - j))
        assert p.equal(i, q, j, n) == (a[i : i + n] == b[j : j + n])
        assert p.common(i, q, j) == len(os.path.commonprefix([a[i:], b[j:]]))


def test_sketch_depends_on_windows_alone():
    a, b = prefix.Prefix("abcdefghij" * 30), prefix.Prefix("zz" + "abcdefghij" * 9)
    both = set(a.sketch().tolist()) & set(b.sketch().tolist())
    assert len(a.sketch()) == 10 and len(both) == 10
    assert prefix.likeness(prefix.Prefix("").sketch(), prefix.Prefix("").sketch()) == 1.0
    assert prefix.likeness(a.sketch(), prefix.Prefix("").sketch()) == 0.0


def plain_sketch(text):
    """The smallest distinct hashes of a text's windows, each window hashed by itself."""
    size = min(prefix.WINDOW, len(text))
    if not size:
        return []
    out = set()
    for i in range(len(text) - size + 1):
        a, b = (sum((ord(c) + 1) * pow(base, k, mod) for k, c in enumerate(text[i : i + size])) % mod for base, mod in zip(prefix.BASES, prefix.MODULI))
        x = a << 32 | b
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) ^ size
        out.add(x ^ x >> 32)
    return sorted(out)[: prefix.SLOTS]


def plain_likeness(a, b):
    both = sorted({*a, *b})[: prefix.SLOTS]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def written(text, sketch):
    return f"{len(text):x}:" + "".join(f"{x:016x}" for x in sketch)


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_fingerprints(spark, docs, rows, no_docs, parts):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + after[:h]
        own, new, theirs = map(plain_sketch, (t, e, after))
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), written(t, own), written(e, new), plain_likeness(own, new), plain_likeness(own, theirs), len(os.path.commonprefix([t, e])), len(os.path.commonprefix([t, after]))))
    out = prefix.fingerprints(docs, parts).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in out) == sorted(want)
    by = {r.doc_id: r for r in out}
    assert by[2].fingerprint == by[3].fingerprint and by[2].near_next == 1.0
    assert by[6].fingerprint == by[7].fingerprint == by[7].edited_fingerprint and by[6].near_edited == 1.0
    assert by[9].near_edited > 0.2 > by[12].near_next
    assert prefix.fingerprints(no_docs, parts).collect() == []


def test_ranges_fill_partitions_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_CHARS", 1000)
    texts = [(i, "some text of a document " * 4, "s") for i in range(200)]
    out = prefix.fingerprints(documents(spark, texts))
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 and max(sizes) <= 2 * min(sizes) and sum(sizes) == 200


def test_fingerprint_of_one_row(spark):
    (r,) = prefix.fingerprints(documents(spark, [(1, "abcdef", "s")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
