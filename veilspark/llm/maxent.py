"""LM scoring: a hashed maximum-entropy model of n-gram and skip features with a class-factored softmax, trained by distributed gradient updates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import id_text, stash, table

#: Classes, and buckets in a class. The most frequent words have buckets of their own, the other words share those of the last classes by hash.
WIDE, SHARED = 32, 8
OWN, BUCKETS = (WIDE - SHARED) * WIDE, SHARED * WIDE
#: Rows of weights for the choice of a class, and for the choice within each class.
CLASS_ROWS, BUCKET_ROWS = 1 << 15, 1 << 11
ROWS = CLASS_ROWS + WIDE * BUCKET_ROWS
#: Gradient updates, how far each goes, and the prior's weight in occurrences.
RATES, PRIOR = (0.5, 0.2), 30.0
#: Words whose counts every worker has; words counted by a task before they are written, tokens and bytes handled at once.
FREQUENT, FRESH, SLICE, PART = 1 << 18, 1 << 20, 1 << 16, 1 << 20
#: Bits of a token's hash that features see, and what they see in front of a text.
HASH = 22
START = 1 << HASH
#: What words are made of, in lower case; 0 between words.
LOWER = np.array([0 if b in (32, *range(9, 14)) else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORD = np.array([b not in (32, *range(9, 14)) for b in range(256)])
#: A random number for each byte at each of 64 places in a word: a word is known by their sum, which two words share by a chance of 2^-64.
RANDOM = np.random.default_rng(41).integers(0, 1 << 64, (64, 256), np.uint64)
END = int(np.random.default_rng(43).integers(0, 1 << 63))
TINY = -1e30


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, how many tokens each text has): its words, A-Z as a-z, and an end. Null texts are an end alone.

    Words of over 64 bytes go round the places again, each round with its own odd factor.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = np.diff(offsets)
    if texts.null_count:
        size[texts.is_null().to_numpy(zero_copy_only=False)] = 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets[:-1] - offsets[0]
    inside = WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = at[size > 0]
    begin[first] = inside[first]  # words don't go on from one text to the next
    place = np.flatnonzero(inside)
    head = np.flatnonzero(begin[place])
    n_words = np.diff(np.searchsorted(place[head], np.append(at, len(data))))
    long = np.diff(np.append(head, len(place)))
    step = np.arange(len(place)) - np.repeat(head, long)
    value = RANDOM.ravel()[(step & 63) << 8 | LOWER[data[place]]]
    if len(long) and long.max() > 64:
        value = value * (2 * (step >> 6) + 1).astype(np.uint64)
    words = np.add.reduceat(value, head) if len(head) else np.zeros(0, np.uint64)
    n = n_words + 1
    out = np.full(len(words) + len(n), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n_words)] = words
    return out, n


def word_hash(word: bytes) -> int:
    """What ``hashed`` knows a word by, as a signed long."""
    return int(hashed(pa.array([word], pa.binary()))[0][0].astype(np.int64)) if word else END


def _held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the text as bytes."""
    rows = id_text(docs)
    return rows.select("doc_id", _held_out(rows).alias("held_out"), F.col("text").cast("binary").alias("text"))


def _parts(texts: pa.Array):
    """Runs of texts of about PART bytes or more."""
    at, size = 0, np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    ends = np.cumsum(size)
    while at < len(texts):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART)) + 1
        yield texts.slice(at, stop - at)
        at = stop


def _count(batches):
    """(word, c) of a task's texts, written whenever there are FRESH of them."""
    words, c = [], []

    def written():
        every, of = np.unique(np.concatenate([np.zeros(0, np.int64), *words]), return_inverse=True)
        n = np.bincount(of, np.concatenate([np.zeros(0, np.int64), *c]), len(every)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(n)], ["word", "c"])

    for b in batches:
        for texts in _parts(b.column("text")):
            new, n = np.unique(hashed(texts)[0].view(np.int64), return_counts=True)
            words.append(new)
            c.append(n)
            if sum(map(len, words)) >= FRESH:
                yield written()
                words, c = [], []
    yield written()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all of ``texts``, kept as a table."""
    return stash(texts.select("text").mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def bucket_of(word: Column) -> Column:
    """The shared bucket of a word without one of its own."""
    return word.bitwiseAND(BUCKETS - 1).cast("int")


class Words:
    """What every worker knows of the vocabulary: counts of the FREQUENT words, and sums over the buckets that the others share.

    A shared bucket gives each of its words its part of the bucket's occurrences, and what it has of words that occur once to words never
    seen: a bucket's unknown words are one outcome, so the probabilities of all words add up to one.
    """

    def __init__(self, counts: DataFrame):
        self.n, self.v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        top = counts.orderBy(F.col("c").desc(), "word").limit(FREQUENT).toArrow()
        self.words, self.c = top.column("word").to_numpy(), top.column("c").to_numpy().astype(np.float64)
        own = counts.sparkSession.createDataFrame([(w,) for w in self.words[:OWN].tolist()], "word long")
        shared = counts.join(F.broadcast(own), "word", "left_anti")  # OWN words
        got = shared.groupBy(bucket_of(F.col("word")).alias("bucket")).agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect()
        self.mass, self.once = np.zeros(BUCKETS), np.ones(BUCKETS)
        for bucket, c, once in got:
            self.mass[bucket], self.once[bucket] = c, max(1, once)
        self.total = self.mass + self.once
        outcomes = np.zeros((WIDE, WIDE))
        outcomes.ravel()[: min(OWN, len(self.c))] = self.c[:OWN]
        outcomes.ravel()[OWN:] = self.total
        #: Log probabilities of the classes, then of the buckets of each class, without any feature.
        nodes = np.vstack([outcomes.sum(axis=1), outcomes])
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.log(nodes) - np.log(nodes.sum(axis=1, keepdims=True))
        self.prior = np.where(nodes > 0, logs, TINY).astype(np.float32)


class Tables:
    """The places of the words that a broadcast brings, as an index that a worker makes once."""

    words, places = None, None

    @classmethod
    def of(cls, words: Words) -> pd.Index:
        if cls.words is not words:
            cls.words, cls.places = words, pd.Index(words.words)
        return cls.places


CODED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, times array<int>, codes array<int>"


def _code(words):
    """Each text's tokens as codes, an outcome and HASH bits of a hash, with what follows from counts alone: the base score, and the parts that words have of
    their buckets. Words that aren't among the frequent ones are listed: their counts are joined afterwards."""
    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        places, w = Tables.of(words.value), words.value
        log_c, log_more, log_total = np.log10(w.c), np.log10(w.c + 1), np.log10(w.total)
        for b in batches:
            done = 0
            for texts in _parts(b.column("text")):
                every, n = hashed(texts)
                of = np.repeat(np.arange(len(n)), n)
                place = places.get_indexer(every.view(np.int64))
                outcome = np.where((place >= 0) & (place < OWN), place, OWN + (every & np.uint64(BUCKETS - 1)).astype(np.int64))
                frequent, shared = place >= 0, outcome >= OWN
                score, base = np.zeros(len(every)), np.zeros(len(every))
                score[shared] = -log_total[outcome[shared] - OWN]
                score[shared & frequent] += log_c[place[shared & frequent]]
                base[frequent] = log_more[place[frequent]]
                known, base, score = (np.bincount(of, x, len(n)) for x in (frequent, base, score))
                base -= n * np.log10(w.n + w.v + 1)
                rare_of, rare = of[~frequent], every[~frequent].view(np.int64)
                order = np.lexsort((rare, rare_of))
                rare_of, rare = rare_of[order], rare[order]
                new = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1]))[: len(rare)])
                lists = pa.array(np.append(0, np.cumsum(np.bincount(rare_of[new], minlength=len(n)))).astype(np.int32))
                coded = (outcome.astype(np.uint64) << np.uint64(HASH) | every >> np.uint64(64 - HASH)).astype(np.uint32).view(np.int32)
                ids, held = (b.column(c)[done : done + len(n)] for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(at, at + len(n))), ids, held, pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(lists, pa.array(rare[new])), pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(new, len(rare))).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(coded))],
                    ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times", "codes"])
                done, at = done + len(n), at + len(n)

    return run


def _choices(lists: pa.ListArray):
    """Slices of the tokens of some texts, with two choices each: (where each text's tokens begin in it, ((node, rows of the features, outcome), ..)).
    The node is None where a class is chosen."""
    codes, ends = lists.flatten().to_numpy().view(np.uint32), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    first = ends[:-1][np.diff(ends) > 0]
    for at in range(0, len(codes), SLICE):
        stop = min(at + SLICE, len(codes))
        outcome = (codes[at:stop] >> HASH).astype(np.int64)
        before = np.append([0] * max(0, 2 - at), codes[max(0, at - 2) : stop] & (1 << HASH) - 1).astype(np.uint64)
        one, two = before[1:-1].copy(), before[:-2].copy()
        begin = first[np.searchsorted(first, at - 1) : np.searchsorted(first, stop)] - at
        one[begin[begin >= 0]] = START
        two[begin[begin >= 0]] = START
        two[(begin + 1)[begin + 1 < stop - at]] = START
        mixed = [(x * np.uint64(m)) ^ ((x * np.uint64(m)) >> np.uint64(29)) for x, m in (
            (one, 0x9E3779B97F4A7C15), (two, 0xC2B2AE3D27D4EB4F), (one << np.uint64(HASH + 1) | two, 0xD6E8FEB86659FD93))]
        cls, bucket = outcome // WIDE, outcome % WIDE
        whole = [(x * np.uint64(0x165667B19E3779F9) >> np.uint64(49)).astype(np.int64) for x in mixed]
        salt = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x27D4EB2F165667C5)
        within = [((x ^ salt) * np.uint64(0x94D049BB133111EB) >> np.uint64(53)).astype(np.int64) + CLASS_ROWS + cls * BUCKET_ROWS for x in mixed]
        yield np.clip(ends, at, stop) - at, ((None, whole, cls), (cls, within, bucket))


def _shares(weights: np.ndarray, prior: np.ndarray, node: np.ndarray | None, rows: list[np.ndarray]) -> np.ndarray:
    """Unnormalised shares of the WIDE outcomes of some choices, an outcome a line: the prior's logit and the weights of all features.

    Outcomes have lines of their own, so that each line of weights stays in the cache while all choices look it up.
    """
    out, found = np.empty((WIDE, len(rows[0])), np.float32), np.empty(len(rows[0]), np.float32)
    for k, line in enumerate(out):
        line[:] = prior[0, k] if node is None else prior[1:, k][node]
        for r in rows:
            line += np.take(weights[k], r, out=found, mode="clip")
    return np.exp(out, out=out)


#: Rows whose sums travel together.
BLOCK = 1 << 10
SUMS = "block int, sums binary"


def _gradient(words, weights):
    """Of a task's texts, how often each feature is seen with each outcome or, with ``weights``, how often the model expects it to be."""
    def run(batches):
        prior = words.value.prior
        sums = np.zeros((WIDE, ROWS))
        for b in batches:
            for _, choices in _choices(b.column("codes")):
                for node, rows, outcome in choices:
                    if weights is None:
                        for r in rows:
                            np.add.at(sums.ravel(), outcome * ROWS + r, 1.0)
                        continue
                    shares = _shares(weights.value, prior, node, rows)
                    shares /= shares.sum(axis=0)
                    low, high = (0, CLASS_ROWS) if node is None else (CLASS_ROWS, ROWS)
                    places = [r - low for r in rows]
                    for k in range(WIDE):
                        share = shares[k].astype(np.float64)
                        for r in places:
                            sums[k, low:high] += np.bincount(r, share, high - low)
        some = [k for k in range(ROWS // BLOCK) if sums[:, k * BLOCK : (k + 1) * BLOCK].any()]
        blocks = [sums[:, k * BLOCK : (k + 1) * BLOCK].astype(np.float32).tobytes() for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])

    return run


def _added(tasks: pa.Table) -> pa.Table:
    """The sums of a block over all tasks."""
    total = np.zeros(WIDE * BLOCK)
    for one in tasks.column("sums"):
        total += np.frombuffer(one.as_buffer(), np.float32)
    return pa.table({"block": tasks.column("block").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def feature_sums(coded: DataFrame, words, weights=None) -> np.ndarray:
    """What ``_gradient`` gives, over all tasks: WIDE x ROWS numbers, whatever the corpus. Each task writes as many, 4 bytes each, so a task reads that many
    tokens at least, and there are two tasks a core at most, into however many files ``coded`` is cut."""
    tasks = max(1, min(2 * coded.sparkSession.sparkContext.defaultParallelism, int(words.value.n) // (WIDE * ROWS)))
    rows = coded.select("codes").coalesce(tasks).mapInArrow(_gradient(words, weights), SUMS)
    out = np.zeros((WIDE, ROWS))
    for block, sums in rows.groupBy("block").applyInArrow(_added, SUMS).collect():  # ROWS / BLOCK
        out[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums, np.float32).reshape(WIDE, BLOCK)
    return out


def step(seen: np.ndarray, expected: np.ndarray, prior: np.ndarray, rate: float) -> np.ndarray:
    """A gradient update: what was seen less what was expected, over the logarithmic mean of the two, each raised by PRIOR occurrences of the prior."""
    a, b = seen + PRIOR * prior, expected + PRIOR * prior
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(np.abs(a - b) < 1e-9 * b, b, (a - b) / np.log(a / b))
        return np.where((prior > 0) & (mean > 0), rate * (seen - expected) / mean, 0.0)


def train(coded: DataFrame, words, rates=RATES) -> np.ndarray:
    """Weights of all features. Every update takes the gradient over all of ``coded`` (codes), summed over tasks.

    Before the first the model is its prior, so what it expects of a row follows from how often the row is seen; from then on tasks work it out, token by
    token. A row belongs to one choice: the class, or the bucket within one class.
    """
    prior = np.exp(words.value.prior.astype(np.float64)).T
    own = np.hstack([np.repeat(prior[:, :1], CLASS_ROWS, axis=1), np.repeat(prior[:, 1:], BUCKET_ROWS, axis=1)])
    seen = feature_sums(coded, words)
    weights = np.zeros((WIDE, ROWS), np.float32)
    for i, rate in enumerate(rates):
        if i:
            sent = coded.sparkSession.sparkContext.broadcast(weights)
            expected = feature_sums(coded, words, sent)
            sent.unpersist()
        else:
            expected = seen.sum(axis=0) * own
        weights = (weights + step(seen, expected, own, rate)).astype(np.float32)
    return weights


def _score(words, weights):
    """Adds the model's log10 probabilities of each text's classes and buckets to its score."""
    def run(batches):
        prior = words.value.prior
        for b in batches:
            score = b.column("score").to_numpy().copy()
            for ends, choices in _choices(b.column("codes")):
                of_token = 0
                for node, rows, outcome in choices:
                    shares = _shares(weights.value, prior, node, rows)
                    of_token = of_token + np.log10(shares[outcome, np.arange(len(outcome))] / shares.sum(axis=0), dtype=np.float64)
                score += np.diff(np.append(0, np.cumsum(of_token))[ends])
            kept = [c for c in b.schema.names if c not in ("codes", "score")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(score)], [*kept, "score"])

    return run


def scores(docs: DataFrame, rates=RATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``: log10 probabilities of its whole text.

    Tokens are words and an end. The model first chooses a class, then a bucket in it, each by a softmax over weights of hashed features (the word before, the
    two before, the one two before) and the unigram logits; a bucket that words share gives each its part. It learns from the rows whose crc32 of
    doc_id mod 7 isn't 2. The base score has no context and adds one to counts.

    Null and empty texts are an end alone; a null doc_id isn't held out; texts of any length are read whole; repeated rows each count and each get a row; other
    columns are ignored; an empty table gives no rows. With nothing to learn from, all words are unknown: the base score is 0, and the score that of a shared bucket,
    chosen at random. Words are known by a hash of 64 bits. Weights, frequent words and sums of buckets have fixed sizes; counts of all other
    words are joined, and none of these is frequent.
    """
    texts = _texts(docs)
    counts = word_counts(texts.where(~F.col("held_out")))
    context = docs.sparkSession.sparkContext
    words = context.broadcast(Words(counts))  # FREQUENT hashes and counts
    coded = stash(texts.mapInArrow(_code(words), CODED), "coded")
    weights = context.broadcast(train(coded.where(~F.col("held_out")), words, rates))  # ROWS x WIDE numbers
    rare = coded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word", "left")
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(words.value.once)]), bucket_of(F.col("word")) + 1)
    rare = rare.select(
        "uid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"),
        F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("known"), (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"),
        (F.col("times") * F.coalesce(F.log10("c"), unseen)).alias("score"))
    parts = coded.drop("words", "times").mapInArrow(_score(words, weights), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    sums = parts.unionByName(rare).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.value.n).cast("long").alias("train_tokens"), "base_score", "score")


def op12_lm_score(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
