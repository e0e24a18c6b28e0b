"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer calibrated network."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import id_text, stash, table

#: Words share this many rows of vectors by hash; numbers in a vector; entries of an index vector that aren't 0.
ROWS, SIZE, ENTRIES = 1 << 14, 32, 4
#: Labelled documents to train on at most (lowest hashes of the id first), hidden units, passes; the least score predicted as 1.
TRAIN, HIDDEN, PASSES, GOOD = 10_000, 32, 60, 0.7
#: Words are runs of letters and digits, and runs of other signs. Words a worker remembers; words handled at once.
WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
KEPT, SLICE = 1 << 17, 1 << 18


class RowOf(dict):
    """The row of vectors of a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % ROWS
        return out


_row_of = RowOf()


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ENTRIES numbers of each row's index vector that aren't 0."""
    r = np.random.default_rng(17)
    return np.argsort(r.random((ROWS, SIZE)), axis=1)[:, :ENTRIES], r.choice(np.array([-1.0, 1.0]), (ROWS, ENTRIES))


def _slices(texts):
    """(rows of all words, number of the text of each word) of runs of texts with SLICE words or more."""
    ids, of, n = [], [], 0
    for i, t in enumerate(texts):
        words = WORD.findall(t) if t else ()
        ids.append(np.fromiter(map(_row_of.__getitem__, words), np.int64, len(words)))
        of.append(i)
        n += len(words)
        if n >= SLICE or i == len(texts) - 1:
            yield np.concatenate(ids), np.repeat(of, [len(x) for x in ids]), of[0], i + 1
            ids, of, n = [], [], 0


def _contexts(batches):
    """Sums of the neighbours' index vectors of every row, and how often its words occur, over a task's texts."""
    places, signs = _index()
    total, count = np.zeros(ROWS * SIZE), np.zeros(ROWS, np.int64)
    for b in batches:
        for ids, of, _, _ in _slices(b.column("text").to_pylist()):
            count += np.bincount(ids, minlength=ROWS)
            near = of[1:] == of[:-1]
            left, right = ids[:-1][near], ids[1:][near]
            for a, c in ((left, right), (right, left)):
                for k in range(ENTRIES):
                    total += np.bincount(a * SIZE + places[c, k], signs[c, k], ROWS * SIZE)
    rows = np.flatnonzero(count)
    v = total.reshape(ROWS, SIZE)[rows]
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(count[rows]), *(pa.array(v[:, k]) for k in range(SIZE))], ["row", "n", *(f"v{k}" for k in range(SIZE))])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(unit context vectors, weights) of all rows over the whole corpus: ROWS x SIZE sums reach the driver, whatever the input."""
    names = [f"v{k}" for k in range(SIZE)]
    sums = docs.select("text").mapInArrow(_contexts, "row int, n long, " + ", ".join(f"{x} double" for x in names))
    got = sums.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()
    vectors, count = np.zeros((ROWS, SIZE), np.float32), np.zeros(ROWS)
    if got.num_rows:
        rows = got.column("row").to_numpy()
        vectors[rows] = np.stack([got.column(x).to_numpy() for x in names], axis=1)
        count[rows] = got.column("n").to_numpy()
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    share = count / max(1.0, count.sum())
    return vectors, (1e-3 / (1e-3 + share)).astype(np.float32)


FEATURES = 2 * SIZE + 4


def pooled(texts, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Features of each text: mean and weighted mean of its word vectors, log of its words, shares of distinct words and of repeats next
    to each other, and the length of its mean vector. Texts without words have zeros."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for ids, of, first, stop in _slices(texts):
        if not len(ids):
            continue
        of = of - first
        n = np.bincount(of, minlength=stop - first)
        some = np.flatnonzero(n)
        # each text's distinct rows, with how often they occur: sums over words are products with those counts
        key, times = np.unique(of * ROWS + ids, return_counts=True)
        row, kinds = key % ROWS, np.bincount(key // ROWS, minlength=stop - first)[some]
        v, share = vectors[row], np.stack([times, times * weights[row]]).astype(np.float32)
        ends = np.cumsum(kinds)
        sums = np.stack([share[:, a:z] @ v[a:z] for a, z in zip(ends - kinds, ends)])
        m = sums[:, 0] / n[some, None]
        mw = sums[:, 1] / np.add.reduceat(share[1], ends - kinds)[:, None]
        twice = np.bincount(of[1:][(of[1:] == of[:-1]) & (ids[1:] == ids[:-1])], minlength=stop - first)[some]
        out[first + some] = np.column_stack([m, mw, np.log1p(n[some]) / 8, kinds / n[some], twice / n[some], np.linalg.norm(m, axis=1)])
    return out


class Network:
    """Two layers, and a temperature that scales its logits to probabilities."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 23):
        r = np.random.default_rng(seed)
        self.w = [r.standard_normal((size, hidden)) * np.sqrt(2 / size), np.zeros(hidden), r.standard_normal(hidden) * np.sqrt(1 / hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.logits(x) / self.temperature))

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 3e-3, batch: int = 256, seed: int = 29) -> None:
        r, step = np.random.default_rng(seed), 0
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        m, v = ([np.zeros_like(p) for p in self.w] for _ in range(2))
        for _ in range(passes):
            order = r.permutation(len(z))
            for at in range(0, len(z), batch):
                i = order[at : at + batch]
                a = np.maximum(z[i] @ self.w[0] + self.w[1], 0)
                d = (0.5 * (1 + np.tanh(0.5 * (a @ self.w[2] + self.w[3][0]))) - y[i]) / len(i)
                da = np.outer(d, self.w[2]) * (a > 0)
                step += 1
                for k, g in enumerate((z[i].T @ da + 1e-4 * self.w[0], da.sum(0), a.T @ d + 1e-4 * self.w[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on documents that the layers weren't fitted on."""
        z, best = self.logits(x), None
        for t in np.geomspace(0.25, 8, 121):
            s = np.where(y > 0.5, 1, -1) * z / t
            loss = np.logaddexp(0, -s).mean()
            if best is None or loss < best[0]:
                best = (loss, t)
        self.temperature = float(best[1])


def teachers(labels: DataFrame, bound: int = TRAIN) -> DataFrame:
    """(id, quality, check) of at most ``bound`` labelled documents outside the held-out fold, lowest hashes first."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.where(fold != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("id"), "quality", (fold == 3).alias("check"))


def fitted(features: DataFrame, known: DataFrame) -> Network | None:
    """A network from the features of the ``known`` documents; a third of them set its temperature."""
    got = features.join(F.broadcast(known), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min(F.struct("f", "quality", "check")).alias("x")).orderBy("id").select("x.*").toArrow()  # a row per known document at most
    if not got.num_rows:
        return None
    x = got.column("f").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
    y, check = got.column("quality").to_numpy().astype(np.float64), got.column("check").to_numpy(zero_copy_only=False)
    net = Network(FEATURES)
    if (~check).any():
        net.fit(x[~check], y[~check])
    if check.any():
        net.calibrate(x[check], y[check])
    return net


def featured(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((vectors, weights))  # ROWS x SIZE numbers, whatever the input

    def run(batches):
        for b in batches:
            f = pooled(b.column("text").to_pylist(), *sent.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * FEATURES), pa.array(f.ravel()))], ["doc_id", "f"])

    return stash(id_text(docs).mapInArrow(run, "doc_id long, f array<float>"), "features")


def _scored(net: Network | None):
    def run(batches):
        for b in batches:
            x = b.column("f").flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
            s = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Word vectors come from all texts: each word's vector sums the sparse random index vectors of its neighbours, over rows that
    words share by hash. They are pooled per document and scored by a two-layer network whose temperature is set on a fold of its own.
    Labels of the fold crc32(doc_id) mod 4 = 2 are never read. Null and empty texts, and texts without words, are scored from zero features; with no
    label to learn from every score is 0.5. A null doc_id isn't held out. Repeated rows each get a row; other columns are ignored; an
    empty table gives no rows.
    """
    features = featured(docs, *word_vectors(docs))
    rows = features.mapInArrow(_scored(fitted(features, teachers(labels, bound))), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5, bound: int = TRAIN) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``. Texts are pooled where they are scored, and those known once before.

    Null and empty texts, and texts without words, are scored from zero features; long ones are read whole. Equal texts have equal scores, so repeated rows
    stay or go together. With no label to learn from every row stays. An empty table gives no rows; columns of any names and nulls in them are left alone.
    """
    vectors, weights = word_vectors(docs)
    known = stash(teachers(labels, bound), "known")
    net = fitted(featured(id_text(docs).join(F.broadcast(known), F.col("doc_id") == F.col("id"), "left_semi"), vectors, weights), known)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = net.score(pooled(b.column("text").to_pylist(), *sent.value).astype(np.float64)) if net else np.ones(b.num_rows)
                yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
