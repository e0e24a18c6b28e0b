"""The divergence audit against plain Python, and its tries against dicts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import documents

from veilspark.llm import tries

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=tries.TOP):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, by plain counting."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(UPPER) for t in TERM.findall(text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for x, s in groups if x == lang)
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return [1 + 1_000_000_000 * (c[t] + 5) // total for t in kept]

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            lead = sorted((-(a - b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b)[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(lead, 1)]
    return sorted(out)


def some_texts(n=160, seed=4):
    r = random.Random(seed)
    words = ["the", "The", "été", "ete", "中文", "中", "a", "ab", "abc", "abd", "😀", "zz9zz", "x-y", "'s"] + ["".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "fr"]), f"s{r.choice('0000123')}") for _ in range(n)]
    return [*rows, (None, "en", "s9"), ("", "fr", None), ("the 12 ?!", None, "s1"), ("the the", None, None), (" ".join(words * 50), "en", "s0"), rows[0], rows[0], ("x", "de", "only")]


def spark_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def texts(spark):
    rows = some_texts()
    return rows, spark.createDataFrame([(t, x, s, "t", 1, "b") for t, x, s in rows], "text string, lang string, source string, term string, n int, block string")


@pytest.mark.parametrize("least, top", [(1, 50), (3, 4), (30, 50), (10_000, 50)])
def test_divergence(texts, least, top):
    rows, df = texts
    assert spark_rows(tries.divergence(df, least, top)) == brute(rows, least, top)


def test_divergence_in_small_steps(spark, texts, monkeypatch):
    """Tries that are poured, written and merged often, blocks of few terms, tiles of two sources."""
    rows, df = texts
    for name, v in (("FRESH", 40), ("LEAVES", 30), ("BLOCK", 7), ("TILE", 2), ("SLICE", 64)):
        monkeypatch.setattr(tries, name, v)
    assert spark_rows(tries.divergence(df.repartition(5), 2)) == brute(rows, 2)


def test_divergence_of_no_rows_and_of_rows_without_terms(spark, no_docs):
    assert tries.divergence(no_docs).collect() == []
    got = spark_rows(tries.divergence(documents(spark, [(1, None, "a"), (2, "", "b"), (None, "1 2", None)])))
    assert got == brute([(None, "en", "a"), ("", "en", "b"), ("1 2", "en", None)], 30)
    assert {r[4] for r in got} == {0}


def test_tries_add_merge_and_walk():
    r = random.Random(6)
    whole, plain = tries.Trie(), defaultdict(Counter)
    for _ in range(30):
        part, path = tries.Trie(), []
        for t in sorted("".join(r.choice("abé中") for _ in range(r.randint(0, 6))).encode() for _ in range(40)):
            part.add(t, 1, [(f"s{r.randint(0, 2)}", 2)], path)
        for t, leaf in part.walk():
            plain[t].update(dict(zip(leaf.counts[::2], leaf.counts[1::2])))
            plain[t]["docs"] += leaf.docs
        whole.merge(part)
    got = [(t, dict(zip(leaf.counts[::2], leaf.counts[1::2])) | {"docs": leaf.docs}) for t, leaf in whole.walk()]
    assert [t for t, _ in got] == sorted(plain) and whole.leaves == len(plain)
    assert all(plain[t] == Counter(c) for t, c in got)


def test_shares_are_exact():
    r = random.Random(2)
    count = np.array([r.randint(0, 9 * 10**15) for _ in range(2000)] + [0, 5])
    total = np.array([r.randint(1, 9 * 10**15) for _ in range(2000)] + [9 * 10**15, 5])
    count = np.minimum(count, total)
    assert tries.share(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist())]


def test_tries_of_sorted_terms():
    r = random.Random(7)
    for width in (1, 3, 40):
        terms = sorted({"".join(r.choice("ab中") for _ in range(r.randint(1, width))).encode() for _ in range(300)})
        trie, leaves = tries.Trie.of(terms)
        assert [t for t, _ in trie.walk()] == terms and [x for _, x in trie.walk()] == leaves and trie.leaves == len(terms)
        for t in terms:
            assert trie.at(t) is leaves[terms.index(t)]
