"""The maximum-entropy model against plain Python, and as a probability."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents

from veilspark.llm import maxent

WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_base(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text, ..) rows."""
    tokens = [[w.translate(UPPER) for w in WORD.findall(t or "")] + [" "] for _, t, *_ in rows]
    c = Counter(w for (i, *_), ts in zip(rows, tokens) if not held(i) for w in ts)
    n, v = sum(c.values()), len(c)
    return [(held(i), len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)) for (i, *_), ts in zip(rows, tokens)]


def by_id(out):
    return {r.doc_id: r for r in out}


def check_base(rows, got):
    want = defaultdict(list)
    for (i, *_), w in zip(rows, brute_base(rows)):
        want[i].append(w)
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
    assert have.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(have[i]), sorted(want[i])):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)


def test_base_scores(spark, docs, rows, monkeypatch):
    got = maxent.scores(docs).collect()
    check_base(rows, got)
    assert all(r.score < 0 for r in got)
    # few words known everywhere, words written often, few tokens and bytes at once
    for name, v in (("FREQUENT", 5), ("FRESH", 20), ("SLICE", 8), ("PART", 50)):
        monkeypatch.setattr(maxent, name, v)
    again = maxent.scores(docs.repartition(3)).collect()
    check_base(rows, again)


def test_scores_do_not_depend_on_partitions_and_slices(spark, docs, monkeypatch):
    one = sorted((str(r.doc_id), r.score) for r in maxent.scores(docs.coalesce(1)).collect())
    monkeypatch.setattr(maxent, "SLICE", 64)
    monkeypatch.setattr(maxent, "FREQUENT", maxent.OWN)
    two = sorted((str(r.doc_id), r.score) for r in maxent.scores(docs.repartition(5)).collect())
    assert [i for i, _ in one] == [i for i, _ in two]
    assert [s for _, s in one] == pytest.approx([s for _, s in two], rel=1e-4)


def plain_scores(rows, rates):
    """The model anew, one token at a time with dictionaries: features, two updates, and probabilities."""
    M = maxent
    tokens = [[w.translate(UPPER).encode() for w in WORD.findall(t or "")] + [b" "] for _, t, *_ in rows]
    learn = [not held(i) for i, *_ in rows]
    c = Counter(w for ok, ts in zip(learn, tokens) if ok for w in ts)
    word = {w: M.word_hash(b"" if w == b" " else w) for ts in tokens for w in ts}
    top = {w: k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], word[x[0]]))[: M.OWN])}
    outcome = {w: top.get(w, M.OWN + word[w] % M.BUCKETS) for w in word}
    once = [max(1, sum(n == 1 and w not in top and word[w] % M.BUCKETS == b for w, n in c.items())) for b in range(M.BUCKETS)]
    total = [once[b] + sum(n for w, n in c.items() if w not in top and word[w] % M.BUCKETS == b) for b in range(M.BUCKETS)]
    mass = [next((c[w] for w, k in top.items() if k == o), 0) if o < M.OWN else total[o - M.OWN] for o in range(M.WIDE**2)]
    classes = [sum(mass[k * M.WIDE : (k + 1) * M.WIDE]) for k in range(M.WIDE)]
    prior = {None: [x / sum(classes) for x in classes]} | {k: [x / classes[k] for x in mass[k * M.WIDE : (k + 1) * M.WIDE]] for k in range(M.WIDE) if classes[k]}
    wrap, mask = (1 << 64) - 1, (1 << M.HASH) - 1

    def choices(ts):
        h = [word[w] % (1 << 64) >> 64 - M.HASH for w in ts]
        for i, w in enumerate(ts):
            a, b = (h[i - 1] if i else M.START), (h[i - 2] if i > 1 else M.START)
            mixed = []
            for x, m in ((a, 0x9E3779B97F4A7C15), (b, 0xC2B2AE3D27D4EB4F), (a << M.HASH + 1 | b, 0xD6E8FEB86659FD93)):
                x = x * m & wrap
                mixed.append(x ^ x >> 29)
            cls, bucket = divmod(outcome[w], M.WIDE)
            yield None, [(x * 0x165667B19E3779F9 & wrap) >> 49 for x in mixed], cls
            salt = (cls + 1) * 0x27D4EB2F165667C5 & wrap
            yield cls, [((x ^ salt) * 0x94D049BB133111EB & wrap) >> 53 for x in mixed], bucket

    weights = defaultdict(lambda: [0.0] * M.WIDE)

    def shares(node, features):
        z = [math.exp(sum(weights[node, f][k] for f in features)) * p for k, p in enumerate(prior[node])]
        return [x / sum(z) for x in z]

    seen = defaultdict(lambda: [0] * M.WIDE)
    every = [list(choices(ts)) for ts in tokens]
    for ok, cs in zip(learn, every):
        for node, features, k in cs if ok else ():
            for f in features:
                seen[node, f][k] += 1
    for rate in rates:
        expected = defaultdict(lambda: [0.0] * M.WIDE)
        for ok, cs in zip(learn, every):
            for node, features, _ in cs if ok else ():
                p = shares(node, features)
                for f in features:
                    for k in range(M.WIDE):
                        expected[node, f][k] += p[k]
        for (node, f), s in seen.items():
            for k, q in enumerate(prior[node]):
                if q > 0:
                    weights[node, f][k] += rate * math.log((s[k] + M.PRIOR * q) / (expected[node, f][k] + M.PRIOR * q))
    out = []
    for ts, cs in zip(tokens, every):
        score = sum(math.log10(shares(node, features)[k]) for node, features, k in cs)
        score += sum(math.log10((c[w] or once[outcome[w] - M.OWN]) / total[outcome[w] - M.OWN]) for w in ts if outcome[w] >= M.OWN)
        out.append(score)
    return out


def small(monkeypatch):
    for name, v in (("FREQUENT", 900), ("PRIOR", 2.0)):
        monkeypatch.setattr(maxent, name, v)


def chain(n=60, seed=5):
    """Texts in which a word follows from the one before, mostly."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(n):
        at, text = r.randrange(900), []
        for _ in range(r.randint(0, 40)):
            text.append(words[at] if r.random() < 0.95 else "New" + str(r.randrange(10**6)))
            at = (at * 7 + 1) % 900 if r.random() < 0.8 else r.randrange(900)
        rows.append((i, " ".join(text), "s"))
    return rows


@pytest.mark.parametrize("rates", [(0.5,), (0.5, 0.2), (0.4, 0.3, 0.2)])
def test_scores_against_the_model_in_plain_python(spark, monkeypatch, rates):
    small(monkeypatch)
    rows = chain(25)
    got = by_id(maxent.scores(documents(spark, rows), rates).collect())
    want = plain_scores(rows, rates)
    assert [got[i].score for i, *_ in rows] == pytest.approx(want, rel=1e-4)


def test_context_helps_on_texts_held_out(spark):
    rows = chain(2500)
    got = [r for r in maxent.scores(documents(spark, rows)).collect() if r.held_out]
    base, score, n = (sum(getattr(r, c) for r in got) for c in ("base_score", "score", "n_tokens"))
    assert len(got) > 200 and score / n > base / n + 0.3


def test_shares_add_up_to_one(spark, docs):
    counts = maxent.word_counts(maxent._texts(docs))
    words = maxent.Words(counts)
    assert np.exp(words.prior[0].astype(float)).sum() == pytest.approx(1, abs=1e-6)
    r = np.random.default_rng(1)
    weights = r.standard_normal((maxent.WIDE, maxent.ROWS)).astype(np.float32)
    lists = pa.array([r.integers(0, 1 << 32, 50).astype(np.uint32).view(np.int32), np.array([7], np.int32)], pa.list_(pa.int32()))
    for _, ((_, rows, _), (_, within, _)) in maxent._choices(lists):
        whole = maxent._shares(weights, words.prior, None, rows)
        whole /= whole.sum(axis=0)
        total = np.zeros(len(rows[0]))
        for k in range(maxent.WIDE):
            inner = maxent._shares(weights, words.prior, np.full(len(rows[0]), k), within)
            ok = np.exp(words.prior[1 + k].astype(float)).sum() > 0
            total += whole[k] * (inner / inner.sum(axis=0)).sum(axis=0) if ok else whole[k]
        assert total == pytest.approx(np.ones(len(total)), abs=1e-4)
    # a shared bucket's words and its unknown ones share it out
    for b in range(maxent.BUCKETS):
        assert (words.mass[b] + words.once[b]) / words.total[b] == pytest.approx(1)


def test_no_rows_and_nothing_to_learn_from(spark, no_docs):
    assert maxent.scores(no_docs).collect() == []
    ids = [i for i in range(200) if held(i)][:3]
    got = maxent.scores(documents(spark, [(i, t, "s") for i, t in zip(ids, (None, "", "a B a"))])).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 0, 0, 0.0)] * 3
    assert sorted(r.n_tokens for r in got) == [1, 1, 4]
    for r in got:
        assert r.score == pytest.approx(-r.n_tokens * math.log10(maxent.BUCKETS), rel=1e-5)


def test_hashes_tell_words_apart():
    r = random.Random(3)
    texts = ["".join(r.choice("aB \t\né中\x00") for _ in range(r.randint(0, 200))) for _ in range(300)] + [None, "", " ", "x" * 200, "x" * 264, "y" + "x" * 199]
    words = [[w.translate(UPPER).encode() for w in WORD.findall(t or "")] for t in texts]
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for part, some in ((column, words), (column.slice(50, 100), words[50:150])):
        got, n = maxent.hashed(part)
        assert n.tolist() == [len(x) + 1 for x in some]
        flat = [w for x in some for w in [*x, None]]
        known = dict(zip(flat, got.tolist()))
        assert [known[w] for w in flat] == got.tolist() and len(set(known.values())) == len(known)


def test_gradients_take_few_tasks(spark, docs, monkeypatch):
    """Every task writes a sum for each row of weights, so there are no more for a table that is cut into many parts."""
    words = spark.sparkContext.broadcast(maxent.Words(maxent.word_counts(maxent._texts(docs))))
    coded = maxent._texts(docs).mapInArrow(maxent._code(words), maxent.CODED)
    tasks, gradient = spark.sparkContext.accumulator(0), maxent._gradient

    def counted(*args):
        inner = gradient(*args)

        def run(batches):
            tasks.add(1)
            yield from inner(batches)

        return run

    want = maxent.feature_sums(coded.coalesce(1), words)
    monkeypatch.setattr(maxent, "_gradient", counted)
    got = maxent.feature_sums(coded.repartition(40), words)
    assert (got == want).all() and 0 < tasks.value <= 2 * spark.sparkContext.defaultParallelism


def test_gradients_of_few_tokens_take_one_task(spark, docs, monkeypatch):
    """A task writes WIDE x ROWS numbers, so it reads as many tokens at least: what is gathered follows the corpus."""
    words = spark.sparkContext.broadcast(maxent.Words(maxent.word_counts(maxent._texts(docs))))
    coded = maxent._texts(docs).mapInArrow(maxent._code(words), maxent.CODED)
    rows, gradient = spark.sparkContext.accumulator(0), maxent._gradient

    def counted(*args):
        def run(batches):
            for b in gradient(*args)(batches):
                rows.add(b.num_rows)
                yield b
        return run

    want = maxent.feature_sums(coded.coalesce(1), words)
    monkeypatch.setattr(maxent, "_gradient", counted)
    got = maxent.feature_sums(coded.repartition(40), words)
    assert 0 < rows.value <= maxent.ROWS // maxent.BLOCK
    assert (got == want).all()
