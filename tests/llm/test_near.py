"""SimHash and embedding near-duplicates against all pairs."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import documents

from veilspark.llm import simhash, vectors
from veilspark.llm.common import components, spanning_edges


def reach(ids, linked):
    """Smallest id that each index reaches; ids that are null count for nothing."""
    comp = {}
    for i in sorted((k for k in range(len(ids)) if ids[k] is not None), key=lambda k: ids[k]):
        if i in comp:
            continue
        stack = [i]
        comp[i] = ids[i]
        while stack:
            x = stack.pop()
            for y in range(len(ids)):
                if y not in comp and linked(x, y):
                    comp[y] = ids[i]
                    stack.append(y)
    return comp


def slow_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(rows):
    for _, t, _ in rows:
        assert simhash.fingerprint(t) == slow_print(t)
    assert simhash.fingerprint("A É") == slow_print("a É") != slow_print("a é")


def near_copies(n=60, seed=5):
    r = random.Random(seed)
    long = " ".join(f"w{r.randint(0, 500)}" for _ in range(800)).split()
    rows = []
    for i in range(n):
        w = list(long)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
        rows.append((100 + i, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("distance,hot", [(4, 4096), (7, 4096), (4, 4)])
def test_near_duplicates(spark, rows, distance, hot):
    rows = [*rows, *near_copies()]
    out = simhash.near_duplicates(documents(spark, rows), distance, hot).collect()
    assert len(out) == len(rows)
    fps = [slow_print(t) for _, t, _ in rows]
    comp = reach([i for i, _, _ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= distance)
    want = sorted((str(i), f - (1 << 64) if f >> 63 else f, comp.get(k)) for k, ((i, _, _), f) in enumerate(zip(rows, fps)))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in out) == want


def test_near_joins_at_every_distance():
    """Fingerprints that differ in any four bits share a variant at which they are verified."""
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(1, 4)):
            b ^= 1 << bit
        keys = [m & ~(1 << bit) for bit in range(64) for m in simhash.segments(4) if m >> bit & 1]
        assert len(keys) == 64
        fp = np.array([a, b], dtype=np.uint64)
        hits = 0
        for bit, k in enumerate(keys):
            key = fp & np.uint64(k)
            hits += len(simhash._near(np.full(2, bit), key, np.zeros(2, int), np.array([1, 2]), fp, 4)[0])
        assert hits == 1


def test_near_holds_no_square_of_pairs():
    """All fingerprints of a key are near each other, so pairs are many more than rows."""
    import itertools
    import tracemalloc

    r = random.Random(6)
    low = simhash.segments(4)[0]
    free = [b for b in range(64) if not low >> b & 1]
    fp = [0, *(1 << b for b in free), *(1 << a | 1 << b for a, b in itertools.combinations(free, 2))]
    r.shuffle(fp)
    n = len(fp)
    rep = np.array(r.sample(range(10 * n), n))
    tracemalloc.start()
    a, b = simhash._near(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), rep, np.array(fp, dtype=np.uint64), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 900 and len(a) == n - 1 and set(a.tolist()) | set(b.tolist()) == set(rep.tolist())
    assert peak < 5e6 < 16 * n * n / 2


def test_frequent_variants_are_dealt_further(spark):
    """10^5 fingerprints of one segment value: no group that one task compares is large, and every near pair is in one."""
    r = random.Random(11)
    segment = simhash.segments(4)[0]
    free = [b for b in range(64) if not segment >> b & 1]
    fps = set()
    while len(fps) < 100_000:
        fp = r.getrandbits(64) & ~segment | (segment & 0x155555)
        fps.add(fp)
        if r.random() < 0.01:
            for b in r.sample(free, r.randint(1, 4)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    known = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long").repartition(8)
    rows = simhash.dealt(simhash.variants(known, 4), known, 4)
    size = rows.groupBy("bit", "key", "part").count().selectExpr("max(count) m", "sum(count) n").first()
    assert size.m <= 2 * simhash.HOT and size.n < 64 * len(fps) * 3
    # one bit's rows are enough to find all pairs of this segment value
    one = rows.where("bit = 0").repartition("bit", "key", "part").sortWithinPartitions("bit", "key", "part")
    got = one.mapInArrow(simhash._joined(4), "a long, b long").collect()
    node, root = spanning_edges(np.array([x.a for x in got], int), np.array([x.b for x in got], int), len(fps))
    label = np.arange(len(fps))
    label[node] = root
    a = np.array(fps, np.uint64)
    want = {(i, int(j)) for i in r.sample(range(len(fps)), 400) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if j != i}
    assert len(want) > 3 and all(label[i] == label[j] for i, j in want)


def test_a_large_part_is_cut_into_chunks(spark):
    """Near fingerprints in one variant and one block: chunks meet each other, and all end in one component."""
    import itertools as it

    segment = simhash.segments(4)[0]
    free = [b for b in range(64) if not segment >> b & 1]
    fps = [0, *(1 << b for b in free), *(1 << a | 1 << b for a, b in it.combinations(free, 2))]
    known = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    rows = simhash.dealt(simhash.variants(known, 4), known, 4, 64)
    assert rows.groupBy("bit", "key", "part").count().agg({"count": "max"}).first()[0] <= 3 * 64
    keyed = rows.repartition("bit", "key", "part").sortWithinPartitions("bit", "key", "part")
    comp = components(keyed.mapInArrow(simhash._joined(4), "a long, b long")).collect()
    assert {x.component for x in comp} == {0} and len(comp) == len(fps)


def test_deduplicated(spark, rows, no_docs):
    rows = [*rows, *near_copies(20)]
    docs = documents(spark, rows)
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in comp.items() if i is not None and i == c)
    assert ids.count(None) == 1
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.deduplicated(no_docs).collect() == []


def test_deduplicated_keeps_other_texts_of_an_id(spark):
    rows = [(2, "one two three four five six", "s"), (5, "one two three four five six", "s"), (5, "quite another text stands right here", "s"), (7, "x y", "s"), (7, "x y", "s")]
    out = sorted((r.doc_id, r.text) for r in simhash.deduplicated(documents(spark, rows)).collect())
    assert (5, rows[2][1]) in out and out.count((7, "x y")) == 1 and (2, rows[0][1]) in out


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 50)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3), (500, 400), (500, 401), (500, 402)]
    out = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = {(a, b) for a, b in edges if a is not None and a != b}
    ids = sorted({x for e in links for x in e})
    comp = reach(ids, lambda x, y: (ids[x], ids[y]) in links or (ids[y], ids[x]) in links)
    assert out == {ids[k]: c for k, c in comp.items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spanning_edges():
    node, root = spanning_edges(np.array([3, 4, 1]), np.array([4, 5, 2]), 7)
    assert dict(zip(node.tolist(), root.tolist())) == {4: 3, 5: 3, 2: 1}


def vector_rows(seed=4, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        c = r.standard_normal(dim)
        rows += [(len(rows) + k, (c + 0.1 * g / 6 * r.standard_normal(dim)).astype(np.float32).tolist()) for k in range(6)]
    rows += [(200 + k, rows[3][1]) for k in range(4)] + [(300 + k, (np.array(rows[9][1]) * 2 ** (10 * k)).tolist()) for k in range(3)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [1.0, None] + [0.0] * (dim - 2), [float("inf")] + [1.0] * (dim - 1), [1.0] * 3, []]
    return rows + [(400 + k, v) for k, v in enumerate(odd)] + [(200, rows[3][1]), (None, rows[3][1])]


@pytest.mark.parametrize("prunes", [0, 9])  # one cell for all blocks, and grids
@pytest.mark.parametrize("blocks,grid,chunk", [(4, 2, 4096), (2, 1, 5), (5, 3, 16)])
def test_near_vectors(spark, monkeypatch, blocks, grid, chunk, prunes):
    monkeypatch.setattr(vectors, "PRUNES", prunes)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], "vec_id long, embedding array<float>, label string, n long, e string, rep int")
    out = vectors.near_vectors(df, 0.9, blocks, grid, chunk).collect()
    assert len(out) == len(rows)

    def unit(i, v):
        if i is None or v is None or len(v) != 16 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, dtype=np.float64) / np.linalg.norm(v)

    units = [unit(*x) for x in rows]
    near = [[a is not None and b is not None and j != k and float(a @ b) >= 0.9 for k, b in enumerate(units)] for j, a in enumerate(units)]
    comp = reach([i for i, _ in rows], lambda a, b: near[a][b])
    want = sorted((str(i), sum(near[k]), comp.get(k), comp.get(k) == i and i is not None) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out) == want


def test_grid_cells_hold_all_near_rows():
    """Of rows within a block's radius each is in the other's cell, or visits it."""
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 12)) * np.array([3, 2, 1] * 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = vectors.Grid(x.T @ x, 0.9, 3, 2)
    for b in range(3):
        home, near = grid.cells(x, b)
        own = x @ grid.axes[:, grid.parts[b]]
        seen = [{int(home[i])} | {int(c[i]) for c, m in near if m[i]} for i in range(len(x))]
        gap = ((own[:, None] - own[None]) ** 2).sum(-1)
        for i, j in zip(*np.nonzero(gap <= grid.budget[b])):
            assert int(home[j]) in seen[i]
        assert sum(map(len, seen)) < 9 * len(x)


def test_near_vectors_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [0.9, 0.1, 0.0]), (7, [2.0]), (8, [3.0]), (9, [1.0, 0.0])]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_near_vectors_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(none).collect() == []
    only = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_vectors(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
