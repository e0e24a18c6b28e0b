"""Quality classifier, tagger and the pipeline: gradients, held-out accuracy, defined cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents
from test_native import brute_mix
from test_near import reach, slow_print

import corpus_pipeline
from veilspark.llm import pii, quality
from veilspark.llm.bilstm import Tagger


def junk_and_prose(n=240, seed=8):
    r = random.Random(seed)
    words = ["".join(r.choice("abehinorst") for _ in range(r.randint(2, 7))) for _ in range(150)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(30, 90))]
        bad = r.random() < 0.4
        if bad:
            w = [x + r.choice(["***", "###", "%%%"]) for x in w] if i % 2 else [w[0]] * len(w)
        rows.append((i, " ".join(w) + ".", int(not bad)))
    return rows


def test_quality(spark, no_docs):
    rows = junk_and_prose()
    more = [(900, None, None), (901, "", None), (902, " \n", None), (903, "new " * 20000, None), (904, rows[0][1], None), (None, "no id", None), (904, rows[0][1], None)]
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows + more])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 1), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(rows) + len(more)
    by = {r.doc_id: r for r in out}
    truth = dict((i, q) for i, _, q in rows)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len(held) > 30 and sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert by[900].score == by[901].score == by[902].score and by[904].score == by[0].score
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.score >= 0.5)
    assert quality.quality(no_docs, labels).collect() == []
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_change_nothing(spark):
    rows = junk_and_prose(80)
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows])
    import zlib

    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, _, q in rows]
    a, b = (quality.quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect() for x in ([(i, q) for i, _, q in rows], turned))
    assert a == b


def test_features_against_plain_python(spark, rows, no_docs):
    """Word vectors over all texts, and what is pooled from them, word by word."""
    import zlib
    from collections import Counter, defaultdict

    places, signs = quality._index()
    texts = [t for _, t, _ in rows]

    def ids(t):
        return [zlib.crc32(w.encode()) % quality.ROWS for w in quality.WORD.findall(t or "")]

    total, count = defaultdict(lambda: np.zeros(quality.SIZE)), Counter()
    for t in texts:
        r = ids(t)
        count.update(r)
        for a, b in zip(r, r[1:]):
            for x, y in ((a, b), (b, a)):
                for k in range(quality.ENTRIES):
                    total[x][places[y, k]] += signs[y, k]
    vectors, weights = quality.word_vectors(documents(spark, rows))
    n = sum(count.values())
    for x, k in count.items():
        v = total[x].astype(np.float32)
        assert np.allclose(vectors[x], v / (np.linalg.norm(v) + 1e-9), atol=1e-5) and weights[x] == pytest.approx(1e-3 / (1e-3 + k / n), rel=1e-5)
    assert not np.any(vectors[[x for x in range(quality.ROWS) if x not in count]])
    for t, got in zip(texts, quality.pooled(texts, vectors, weights)):
        r = ids(t)
        want = np.zeros(quality.FEATURES)
        if r:
            m = sum(vectors[x].astype(float) for x in r) / len(r)
            mw = sum(weights[x] * vectors[x].astype(float) for x in r) / sum(float(weights[x]) for x in r)
            want = [*m, *mw, np.log1p(len(r)) / 8, len(set(r)) / len(r), sum(a == b for a, b in zip(r, r[1:])) / len(r), np.linalg.norm(m)]
        assert np.allclose(got, want, atol=1e-4)
    assert not np.any(quality.word_vectors(no_docs)[0])


def test_kept_cases(spark, no_docs):
    """Empty tables, no labels, repeated rows and odd texts."""
    labels = spark.createDataFrame([(i, q) for i, _, q in junk_and_prose(60)], "doc_id long, quality int")
    assert quality.kept(no_docs, labels).collect() == []
    odd = documents(spark, [(1, None, None), (2, "", "s"), (None, "x y", "s"), (4, "again and again", "s"), (4, "again and again", "s"), (5, "word " * 30_000, "s")])
    assert quality.kept(odd, labels.limit(0)).count() == 6  # nothing learned, nothing rejected
    out = quality.kept(documents(spark, [(i, t, "s") for i, t, _ in junk_and_prose(60)]).unionByName(odd), labels)
    assert [r.doc_id for r in out.collect()].count(4) in (0, 2)


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.standard_normal((4000, quality.FEATURES))
    p = 1 / (1 + np.exp(-x[:, 0]))
    y = (r.random(4000) < p).astype(float)
    net = quality.Network(quality.FEATURES)
    net.fit(x[:300], y[:300], passes=200)  # overfits, so it is too sure
    net.calibrate(x[300:2000], y[300:2000])
    s = net.score(x[2000:])
    hot = net.temperature
    net.temperature = 1.0
    t = net.score(x[2000:])

    def loss(q):
        return -np.mean(np.log(np.where(y[2000:] > 0.5, q, 1 - q).clip(1e-12)))

    assert hot > 1 and loss(s) < loss(t)


def test_tagger_gradient():
    r = np.random.default_rng(0)
    t = Tagger(10, 5, 4, 3)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    x, y = r.integers(0, 10, (3, 7)), r.integers(0, 5, (3, 7))
    _, g = t.gradient(x, y)
    for k, w in t.w.items():
        for i in (tuple(0 for _ in w.shape), tuple(n - 1 for n in w.shape)):
            w[i] += 1e-3
            up = t.gradient(x, y)[0]
            w[i] -= 2e-3
            down = t.gradient(x, y)[0]
            w[i] += 1e-3
            assert (up - down) / 2e-3 == pytest.approx(g[k][i], abs=2e-5), k


SLOW = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), pii.CARD, pii.PHONE]


def slow_spans(text):
    out = []
    for k, p in enumerate(SLOW):
        for m in p.finditer(text):
            d = "".join(c for c in m[0] if c in "0123456789")
            if k == 1 and not all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(2)
    bits = ["0", "1", "2", "25", ".", ".", "@", "a", "b", " ", "-", "+", "(", ")", "%", "4242424242424242", "+1 (555) 123-4567", "١", "😀"]
    for _ in range(6000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == slow_spans(t), t
    assert pii.base_spans("9" * 100_000 + ".1.2.3") == [] and len(pii.base_spans("a" * 100_000 + "@b.c")) == 1


def personal(n=150, seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abehinorst") for _ in range(r.randint(2, 7))) for _ in range(90)]
    kinds = [lambda: f"{r.choice(words)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", lambda: "4242424242424242", lambda: f"in {r.randint(1, 99)} days"]
    return [(i, " ".join([*(r.choice(words) for _ in range(8)), r.choice(kinds)(), *(r.choice(words) for _ in range(8)), r.choice(kinds)()]), f"s{i % 3}") for i in range(n)]


def test_pii(spark, rows, no_docs):
    texts = [*((5000 + i, t, s) for i, t, s in personal()), *rows, (8000, "call (726) 555-9022 now or never and some more words", "s")]
    docs = documents(spark, texts)
    out = pii.find_pii(docs).collect()
    assert len(out) == len(texts)
    added = 0
    by = sorted(zip(sorted(texts, key=lambda x: (str(x[0]), x[1] or "")), sorted(out, key=lambda r: str(r.doc_id))), key=lambda z: str(z[0][0]))
    for (i, t, _), r in by:
        base, found = [tuple(x) for x in r.base], [tuple(x) for x in r.found]
        assert base == slow_spans(t or "") and set(base) <= set(found) and found == sorted(found)
        assert set(found) - set(base) <= {tuple(x) for x in r.tagged}
        for s, _, e in set(found) - set(base):
            added += 1
            assert all(e <= a or b <= s for a, _, b in base) and 0 <= s < e <= len(t) and re.search("[0-9@]", t[s:e])
    assert added < len(texts) / 10
    assert pii.find_pii(no_docs).collect() == []
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.count() == len(texts)
    kept = {r.doc_id: r.text for r in masked.where("doc_id is not null").collect()}
    assert kept[6] is None and kept[7] == "" and kept[0] == rows[0][1]
    assert all(not slow_spans(t or "") for t in kept.values())
    assert kept[10].startswith("mail [email] or [phone], card [card]") and "[ip]; password=hunter22x 😀 é" in kept[10]


def test_tagger_learns_spans():
    texts = [t for _, t, _ in personal(300)]
    x, y = np.zeros((len(texts), 64), np.int16), np.zeros((len(texts), 64), np.int8)
    for i, t in enumerate(texts):
        a = max(0, len(t) - 64)
        x[i, : len(t) - a], y[i, : len(t) - a] = pii.classes(t[a:]), pii.tags_of(pii.base_spans(t), a, len(t))
    model = Tagger(97, 9)
    losses = model.fit(x[:240], y[:240], 14)
    found = pii.tagged_spans(model, texts[240:])
    want = [set(pii.base_spans(t)) for t in texts[240:]]
    hits = sum(len(w & set(f)) for w, f in zip(want, found))
    assert losses[-1] < losses[0] / 5 and hits / sum(map(len, want)) > 0.6
    s = model.scores(x[:1])[:, 0]
    assert model.marginals(s).sum(1) == pytest.approx(np.ones(len(s)), abs=1e-3)


def test_decode_all():
    r = np.random.default_rng(3)
    t = Tagger(10, 9)
    t.w["next"] = r.standard_normal((9, 9)).astype(np.float32)
    many = [r.standard_normal((n, 9)).astype(np.float32) for n in (5, 1, 70, 5, 300, 2, 64, 1)]
    for cells in (1, 200, 1 << 18):
        assert all(np.array_equal(a, t.decode(b)) for a, b in zip(t.decode_all(many, cells), many, strict=True))
    assert t.decode_all([]) == []


def test_transitions_lift_a_span():
    """No character is likelier within a span than outside by itself, but the path through a phone number is."""
    t = Tagger(97, 9)
    t.w["next"] = np.full((9, 9), -8, np.float32)
    t.w["next"][0, :] = 0
    t.w["next"][:, 0] = 0
    t.w["next"][0, 8] = -8
    t.w["next"][7, 8] = t.w["next"][8, 8] = 6

    def scores(x, keep=False):
        digit = (x >= pii.CLASS[ord("0")]) & (x <= pii.CLASS[ord("9")])
        s = np.full((*x.shape, 9), -60, np.float32)
        s[..., 0] = 0
        s[..., 7:][digit] = -0.5
        return s.transpose(1, 0, 2)

    t.scores = scores
    assert pii.tagged_spans(t, ["call 5551234567 now", "none"]) == [[(5, 3, 15)], []]
    assert pii.added_spans([[(5, 3, 15)], []], [[(0, 1, 6)], []]) == [[], []] and pii.added_spans([[(5, 3, 15)]], [[(15, 1, 16)]]) == [[(5, 3, 15)]]


def test_decoding_against_all_paths():
    """The best path and the marginals of short regions, by weighing every path."""
    import itertools

    r = np.random.default_rng(9)
    t = Tagger(10, 5)
    for n in (1, 2, 5):
        t.w["next"] = r.standard_normal((5, 5)).astype(np.float32)
        s = r.standard_normal((n, 5)).astype(np.float32)
        paths = list(itertools.product(range(5), repeat=n))
        weight = np.array([sum(s[i, p[i]] for i in range(n)) + sum(t.w["next"][a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(t.decode(s).tolist()) == paths[weight.argmax()] == tuple(t.decode_all([s])[0].tolist())
        share = np.exp(weight - weight.max())
        want = np.array([[share[[k for k, p in enumerate(paths) if p[i] == tag]].sum() for tag in range(5)] for i in range(n)]) / share.sum()
        assert np.allclose(t.marginals(s), want, atol=1e-4)


def test_altered_windows_keep_their_tags():
    r = np.random.default_rng(4)
    text = "mail bo@x.org or +1 (555) 123-4567, card 4242 4242 4242 4242 ok"[: pii.WINDOW]
    tags = pii.tags_of(pii.base_spans(text), 0, len(text))
    seen = set()
    for _ in range(200):
        w, t = pii.altered(text, tags, r)
        assert len(w) == len(t) <= pii.WINDOW
        for s, k, e in pii.spans_of(t):
            if e < len(w):
                digits = sum(c.isdigit() for c in w[s:e])
                assert digits == {0: 0, 2: 16}.get(k, digits) and (k != 3 or digits in (10, 11))
            seen.add((k, w[s:e].translate(str.maketrans("0123456789", "d" * 10))))
    assert {(0, "bo @ x.org"), (3, "(ddd) ddd-dddd"), (2, "dddd.dddd.dddd.dddd")} <= seen


def test_span_checks():
    good = [(0, "a @ b.org"), (0, "a@b.c"), (1, "10.0.0.7"), (2, "4242.4242.4242.4242"), (3, "(555) 123-4567")]
    bad = [(0, "a@b"), (0, "@b.c"), (0, "a@b.c@d"), (1, "10.0.0.700"), (1, "1.2.3"), (2, "4242.4242.4242.4243"), (2, "42"), (3, "12345678"), (3, "1234567890123456")]
    assert all(pii.is_valid(*x) for x in good) and not any(pii.is_valid(*x) for x in bad)

def test_rare_kinds_have_training_windows(spark, monkeypatch):
    """One kind makes up nearly all spans, among texts and within those that have others."""
    r = random.Random(4)
    ips = [f"host {i} at {r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.7 is up" for i in range(2000)]
    rare = [f"mail x{i}@b{i}.org" + " ip 10.0.0.1" * 40 + f" call +1 (555) 123-45{i}" for i in range(10, 13)]
    seen = []
    monkeypatch.setattr(Tagger, "fit", lambda self, x, y, epochs: seen.append(y) or [0.0])
    with pytest.warns(UserWarning, match="too few"):
        pii.train(documents(spark, [(i, t, "s") for i, t in enumerate(ips + rare)]), 80, 1)
    n = next(n for n in range(40, 81) if n * (1 + pii.copies(n, 1)) == len(seen[0]))
    y = seen[0][:n]
    assert (y == 1).any(1).sum() == 3 and (y == 7).any(1).sum() == 3 and (y == 3).any(1).sum() >= 40


def windows_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    return [(w, np.frombuffer(tags, np.int8)) for b in pii._labelled([batch]) for w, tags in zip(b.column("w").to_pylist(), b.column("tags").to_pylist())]


def test_few_windows_are_enough():
    """The number of updates doesn't follow the number of windows; values that the base patterns read into one are told apart."""
    texts = [t for _, t, _ in personal(60, seed=9)]
    model = pii.fitted(windows_of(texts))
    assert model.recall >= 0.8
    other = [t for _, t, _ in personal(100, seed=10)]
    want, got = [set(pii.base_spans(t)) for t in other], [set(x) for x in pii.tagged_spans(model, other)]
    assert sum(len(a & b) for a, b in zip(want, got)) >= 0.8 * sum(map(len, want))
    glued = ["here 4242424242424242 4242424242424242 there", "tel +1 (555) 555-4081 10.20.30.40 now"]
    assert [pii.base_spans(t) for t in glued] == [[], [(22, 1, 33)]]
    added = pii.added_spans(pii.tagged_spans(model, glued), [pii.base_spans(t) for t in glued])
    assert (4, 3, 21) in added[1] or {(5, 2, 21), (22, 2, 38)} & set(added[0])


def test_training_says_so_when_it_fails():
    with pytest.warns(UserWarning, match="too few"):
        assert pii.fitted(windows_of([t for _, t, _ in personal(30)]), 0).recall < pii.POOR


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    prose = junk_and_prose(160)
    base = [(i, t, f"s{i % 4}") for i, t, _ in prose]
    base += [(1000 + i, t, "s1") for i, t, q in prose if q and i < 20] + [(2000 + i, t, s) for i, t, s in personal(30)]
    rows = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in base], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in prose] + [(2000 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if k < 4:
            assert docs.columns == rows.columns
    good, single, clean, mixed, packed = ([r for r in d.collect()] for d in seen)
    ids = [{r.doc_id for r in x} for x in (good, single, clean, mixed, packed)]
    bad = {i for i, _, q in prose if not q}
    assert len(ids[0] & bad) <= 0.15 * len(bad) and len({i for i, _, q in prose if q} - ids[0]) <= 8
    assert not {1000 + i for i in range(20) if 1000 + i in ids[1] and i in ids[1]} and len(single) == len(ids[1]) and ids[2] == ids[1] >= ids[3] == ids[4]
    assert any("[email]" in r.text for r in clean) and all(r.n_chars == len(r.text) and not slow_spans(r.text) for r in clean)
    assert len(mixed) == sum(1 for r in packed if r.piece == 0) > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    # each stage over what the one before kept, in plain Python: groups of near fingerprints, words near the targets, pieces of the library's ids
    prints = [slow_print(r.text) for r in good]
    comp = reach([r.doc_id for r in good], lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert sorted(r.doc_id for r in single) == sorted(r.doc_id for i, r in enumerate(good) if comp[i] == r.doc_id)
    before = {r.doc_id: r.text for r in single}
    assert all(r.text == before[r.doc_id] for r in clean if not re.search("[0-9@]", before[r.doc_id]))
    size, total, target = brute_mix([(r.doc_id, r.text, r.source) for r in clean])
    words = dict(zip([r.doc_id for r in clean], size))
    taken, copies = {s: 0 for s in total}, {}
    for r in mixed:
        taken[r.source] += words[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3 and all(abs(taken[s] - target[s]) <= max(size) for s in total)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed}
    assert sum(own[r.doc_id] for r in mixed) == sum(r.length for r in packed)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048


def test_pipeline_without_rows_and_with_other_columns(spark, tmp_path):
    prose = junk_and_prose(40)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    few = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in prose] + [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, "a@b.org " * 3000, "en", "s1", 1)]
    for name, rows in (("none", []), ("some", few)):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, q, 0) for i, _, q in prose] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    wide = spark.createDataFrame(few, kind).selectExpr("*", "1 as size", "2.0 as boost", "'x' as _row", "3 as f", "4 as score", "5 as held_out", "6 as piece", "7 as n", "8 as cuts", "null as component_id")
    wide.write.parquet(f"{tmp_path}/wide/documents.parquet")
    spark.read.parquet(f"{tmp_path}/some/labels.parquet").write.parquet(f"{tmp_path}/wide/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    some, other = (sorted(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{x}").drop("sequence_id", "offset").collect())) for x in ("some", "wide"))
    assert some == other and len(some) > 10
