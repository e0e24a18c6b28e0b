"""Document fingerprints: prefix polynomial hashes, span equality, longest common extensions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import id_text, table

#: Two moduli below 2**31, so that products fit in 64 bits; a base for each.
MODULI, BASES = (2147483647, 2147483629), (1000003, 999983)
#: Characters in a fingerprinted window, and windows kept.
WINDOW, SLOTS = 8, 64
#: Characters in a range of documents, about; ranges at most (beyond those they grow).
RANGE_CHARS, RANGES = 16 << 20, 20_000

_powers: dict[int, np.ndarray] = {}


def powers(m: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), by doubling."""
    p = _powers.get(m)
    if p is None or len(p) < n:
        mod, p = np.uint64(MODULI[m]), np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(BASES[m], len(p), MODULI[m])) % mod])
        _powers[m] = p
    return p[:n]


class Prefix:
    """Modular prefix arrays of a text: H[i] sums (character + 1) * base**place over the first i characters."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.h = len(codes), []
        for m, mod in enumerate(MODULI):
            # terms are below 2**31, so 2**33 of them add up within 64 bits
            self.h.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(m, self.n) % np.uint64(mod))]) % np.uint64(mod))

    def equal(self, i: int, other: Prefix, j: int, size: int) -> bool:
        """Whether the spans of ``size`` from ``i`` here and ``j`` there are equal: their sums, lifted to one place, under both moduli."""
        for m, mod in enumerate(MODULI):
            p, a, b = powers(m, max(i, j) + 1), self.h[m], other.h[m]
            if (int(a[i + size]) - int(a[i])) * int(p[max(i, j) - i]) % mod != (int(b[j + size]) - int(b[j])) * int(p[max(i, j) - j]) % mod:
                return False
        return True

    def common(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common extension from ``i`` here and ``j`` there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.equal(i, other, j, half) else (low, half - 1)
        return low

    def sketch(self, window: int = WINDOW, slots: int = SLOTS) -> np.ndarray:
        """The ``slots`` smallest distinct window hashes, sorted; a shorter text is one window, the empty text none."""
        if not self.n:
            return np.empty(0, np.uint64)
        size = min(window, self.n)
        # windows are brought down to place 0: a hash must not depend on where its window stands
        keys, place = [], 1 << 16
        for at in range(0, self.n - size + 1, place):
            i = np.arange(at, min(at + place, self.n - size + 1))
            a, b = (self._local(m, i, size) for m in range(2))
            x = a << np.uint64(32) | b
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(size)
            x ^= x >> np.uint64(32)
            keys.append(np.unique(np.partition(x, slots * 8)[: slots * 8] if len(x) > slots * 16 else x)[:slots])
            if len(x) > slots * 16 and len(keys[-1]) < slots:  # the smallest repeat: take them all
                keys[-1] = np.unique(x)[:slots]
        return np.unique(np.concatenate(keys))[:slots]

    def _local(self, m: int, at: np.ndarray, size: int) -> np.ndarray:
        mod = np.uint64(MODULI[m])
        back = pow(BASES[m], -1, MODULI[m])
        down = _inverse(m, back, int(at[-1]) + 1)[at]
        return (self.h[m][at + size] + mod - self.h[m][at]) % mod * down % mod


_inverses: dict[int, np.ndarray] = {}


def _inverse(m: int, back: int, n: int) -> np.ndarray:
    p = _inverses.get(m)
    if p is None or len(p) < n:
        mod, p = np.uint64(MODULI[m]), np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(back, len(p), MODULI[m])) % mod])
        _inverses[m] = p
    return p


def written(n: int, sketch: np.ndarray) -> str:
    return f"{n:x}:" + sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, slots: int = SLOTS) -> float:
    """Estimated share of common windows: that among the ``slots`` smallest of either. Two empty sketches are alike."""
    both = np.unique(np.concatenate([a, b]))[:slots]
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).mean()) if len(both) else 1.0


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_edited long, common_prefix_next long"


def _result(rows) -> pa.RecordBatch:
    out = []
    for doc_id, (text, own, sketch), (after, theirs, their_sketch) in rows:
        new = edited(text, after)
        e = Prefix(new)
        es = e.sketch()
        out.append((doc_id, own.n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(own.n, sketch), written(e.n, es), likeness(sketch, es), likeness(sketch, their_sketch), own.common(0, e, 0), own.common(0, theirs, 0)))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*out), SCHEMA.split(", "))], names)


def _ready(text: str):
    p = Prefix(text)
    return text, p, p.sketch()


def _paired(batches):
    """Rows sorted by (part, tail, doc_id, text): each with the next of its part; tails only end a part."""
    last = None
    for b in batches:
        rows = []
        for part, tail, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text"))):
            if last is not None and last[0] == part and not last[1]:
                now = _ready(text)
                rows.append((last[2], last[3], now))
            elif tail and last is not None and last[0] == part:
                continue  # more rows of the id that ends the part
            else:
                now = _ready(text)
            last = (part, tail, doc_id, now)
            if len(rows) >= 1000:
                yield _result(rows)
                rows = []
        if rows:
            yield _result(rows)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs`` and of its edited text, and their likeness; columns as in SCHEMA.

    The edited text's last half, rounded down, is replaced by the front of the next document's text in order of doc_id,
    nulls first, then text; after the last comes the first. For that, rows are dealt to ranges of doc_id of about RANGE_CHARS characters, and the
    first rows of a range are also sent to the one before, which they end. A fingerprint is the length and the smallest distinct hashes of all windows of
    WINDOW characters, read off prefix polynomial hashes; equal texts have equal ones. Common prefixes are found by binary
    search over the prefix hashes. Null texts are empty; an empty text's fingerprint has no windows and is like another
    such only. A single row is its own next. Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    docs = id_text(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = F.col("doc_id").cast("double")
    low, nulls, chars = docs.agg(F.min(d), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = parts or max(1, min(RANGES, -(-chars // RANGE_CHARS)))
    at = [k / parts for k in range(1, parts)]
    cuts = docs.agg(F.percentile_approx(d, at, 10 * parts)).first()[0] if at and low is not None else ()
    firsts = sorted({c for c in cuts or () if c > low})
    edges = [-float("inf"), *firsts, float("inf")]
    placed = rows.withColumn("d", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7976931348623157e308)))
    if firsts:
        placed = Bucketizer(splits=edges, inputCol="d", outputCol="p").transform(placed)
    placed = placed.withColumn("part", F.col("p").cast("int") if firsts else F.lit(0))
    # the smallest ids of part k end part k - 1; those of the first end the last
    start = F.get(F.lit(edges), F.col("part")) == F.col("d")
    smallest = F.col("doc_id").isNull() if nulls else F.col("d") == F.lit(low)
    n = len(edges) - 1
    ends = F.when(smallest, F.lit(n - 1)).when(start, F.col("part") - 1)
    to = F.array(F.struct(F.col("part"), F.lit(False).alias("tail")))
    dealt = placed.select("doc_id", "text", F.explode(F.when(ends.isNull(), to).otherwise(F.concat(to, F.array(F.struct(ends.alias("part"), F.lit(True).alias("tail")))))).alias("x"))
    dealt = dealt.select(F.col("x.part").alias("part"), F.col("x.tail").alias("tail"), "doc_id", "text")
    # range k is partition k: dealing the numbers by hash would leave some tasks several ranges, and others none
    dealt = dealt.repartitionById(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_paired, SCHEMA)


def op9_prefix_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
