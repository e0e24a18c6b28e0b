"""SimHash near-dedup: fingerprints at a Hamming distance joined on segment variants with one bit deleted."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import components, id_text, spanning_edges, stash, table

WORDS, SEED, DISTANCE = 4, 42, 4
#: Pairs that a task holds, besides a forest of its rows, before it folds them.
PENDING = 1 << 16
#: Fingerprints of one variant that are compared with each other by one task at most; more are dealt further.
HOT = 4096


def fingerprint(text: str | None) -> int:
    """64 bits, each set if set in over half of the XXH64 of the text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(WORDS, len(words)) - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, 65536))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def segments(distance: int) -> list[int]:
    """Masks of the fewest segments of 64 bits of which one differs by at most one bit if all together differ by ``distance``."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(prints: DataFrame, distance: int) -> DataFrame:
    """(bit, key, rep, fp): for each bit, the rest of its segment. Two segments that differ by at most one bit share a variant."""
    keep = [_signed(m & ~(1 << b)) for b in range(64) for m in segments(distance) if m >> b & 1]
    rows = prints.select("rep", "fp", F.posexplode(F.array(*[F.lit(x) for x in keep])).alias("bit", "keep"))
    return rows.select(F.col("bit").cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.col("keep")).alias("key"), "rep", "fp")


def dealt(keyed: DataFrame, classes: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """``keyed`` with ``part``: rows of one (bit, key, part) meet, ``hot`` of them or twice as many at most.

    Where a segment's value is so frequent that its variants may be too large, their rows are dealt once more: near
    fingerprints agree in one of distance + 1 blocks of the bits outside the segment, so they meet under that block's value. What is still too
    large is cut into chunks, each of which meets each other one. No pair is lost, and no task holds a whole frequent variant.
    """
    values = [F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(segments(distance))]
    often = classes.select(F.explode(F.array(*values)).alias("x")).groupBy("x.seg", "x.value").count().where(F.col("count") * 2 > hot)
    often = stash(often.select("seg", "value"), "often")
    plain = keyed.withColumn("part", F.lit(0).cast("long"))
    if often.isEmpty():
        return plain
    bits = [(b, i, _signed(~(1 << b) & (1 << 64) - 1)) for i, m in enumerate(segments(distance)) for b in range(64) if m >> b & 1]
    bit = F.array(*[F.struct(F.lit(b).cast("byte").alias("bit"), F.lit(i).alias("seg"), F.lit(rest).alias("rest")) for b, i, rest in bits])
    large = often.select("seg", "value", F.explode(bit).alias("x")).where("seg = x.seg").select(F.col("x.bit").alias("bit"), F.col("value").bitwiseAND(F.col("x.rest")).alias("key")).distinct()
    plain = plain.join(large, ["bit", "key"], "left_anti")
    outside = {b: _outside(segments(distance)[i], distance + 1) for b, i, _ in bits}
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in outside[b]]) for b in range(64)])
    rows = keyed.join(large, ["bit", "key"], "left_semi").select("bit", "key", "rep", "fp", F.posexplode(F.get(masks, F.col("bit").cast("int"))).alias("block", "mask"))
    rows = rows.withColumn("part", F.xxhash64("block", F.col("fp").bitwiseAND(F.col("mask")))).drop("block", "mask")
    sizes = rows.groupBy("bit", "key", "part").count().where(F.col("count") > hot)
    rows = rows.join(sizes, ["bit", "key", "part"], "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / hot).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("n"))
    rows = rows.select("bit", "key", "rep", "fp", "part", "n", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    part = F.when(F.col("n") > 1, F.xxhash64("part", F.least("i", "j"), F.greatest("i", "j"))).otherwise(F.col("part"))
    return plain.unionByName(rows.select("bit", "key", "rep", "fp", part.alias("part")))


def _outside(segment: int, n: int) -> list[int]:
    """Masks of ``n`` blocks of the bits that ``segment`` lacks."""
    free = [b for b in range(64) if not segment >> b & 1]
    return [sum(1 << b for b in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]


def _near(bit, key, part, rep, fp, distance: int):
    """Edges among rows sorted by (bit, key, part): near pairs that share all three, each at the first variant it shares, as spanning trees.

    Pairs are folded into the forest so far whenever there are PENDING of them, or as many as rows: never all are held.
    """
    n, k = len(rep), 1
    masks = [np.uint64(m) for m in segments(distance)]
    at, a, b, held = np.arange(n), [], [], 0
    while True:
        at = at[at + k < n]
        at = at[(key[at] == key[at + k]) & (bit[at] == bit[at + k]) & (part[at] == part[at + k])]
        if not len(at):
            break
        x = fp[at] ^ fp[at + k]
        near = np.bitwise_count(x) <= distance
        x, i = x[near], at[near]
        first = np.full(len(x), -1)
        for m in reversed(masks):
            differ = x & m
            low = int(m) & -int(m)
            bit_no = np.where(differ == 0, low.bit_length() - 1, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)))
            first = np.where(np.bitwise_count(differ) <= 1, bit_no, first)
        i = i[first == bit[i]]
        a.append(i)
        b.append(i + k)
        held += len(i)
        if held >= max(n, PENDING):
            node, root = spanning_edges(np.concatenate(a), np.concatenate(b), n)
            a, b, held = [node], [root], 0
        k += 1
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    node, root = spanning_edges(np.concatenate(a), np.concatenate(b), n)
    return rep[node], rep[root]


COLUMNS = ["bit", "key", "part", "rep", "fp"]


def _joined(distance: int):
    def run(batches):
        rest = None
        for b in itertools.chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            t = pa.Table.from_batches([b.select(COLUMNS)]) if b is not None else rest
            if t is None:
                return
            if b is not None and rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            bit, key, part, rep, fp = (t.column(c).to_numpy() for c in COLUMNS)
            end = len(bit)
            if b is not None:  # rows of the last group may go on in the next batch
                other = np.flatnonzero((key != key[-1]) | (bit != bit[-1]) | (part != part[-1]))
                end = int(other[-1]) + 1 if len(other) else 0
                rest = t.slice(end)
            u, v = _near(bit[:end], key[:end], part[:end], rep[:end], fp[:end].view(np.uint64), distance)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """doc_id, fp (long), component_id for every row of ``docs``: the smallest doc_id reachable over near fingerprints.

    Documents of one fingerprint form a class. The classes' fingerprints are cut into distance // 2 + 1 segments, of which
    one differs by at most one bit, and each is indexed under 64 variants, a segment without one bit each; rows of equal
    variants meet in sorted partitions, frequent variants in parts (``dealt``), and are verified by the whole fingerprints. A task returns spanning trees of
    what it verifies, never all pairs, and components are then found by distributed star contraction. Null and empty texts, and texts of white
    space, have fingerprint 0 and link like any other. A null doc_id is never the smallest and makes no link that
    only it would make. Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    prints = stash(id_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    known = classes.where("rep is not null")
    keyed = dealt(variants(known, distance), known, distance, hot).repartition("bit", "key", "part").sortWithinPartitions("bit", "key", "part")
    found = components(keyed.mapInArrow(_joined(distance), "a long, b long"))
    of = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


#: Ids up to this many are sent to every executor; more are joined by shuffling.
BROADCAST_IDS = 1 << 20


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each group of near duplicates: that of the smallest doc_id, once.

    Null and empty texts, and texts of white space, are one group of copies. Long texts are read whole. Of repeated rows one stays; an empty table
    gives no rows; columns of any names and nulls in them stay as they are.

    Of rows that share a doc_id each different text stays, if one of them does. Rows without a doc_id can't stand for a group; of
    those only exact copies of one another go.
    """
    near = stash(near_duplicates(docs, distance).select("doc_id", "component_id"), "near").where("doc_id is not null")
    by_id = near.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    gone = by_id.where("not stays").select(F.col("doc_id").alias("_gone"))
    again = by_id.where("stays and n > 1").select(F.col("doc_id").alias("_again"))

    def sized(ids: DataFrame) -> DataFrame:
        ids = stash(ids, "ids")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    gone, again = sized(gone), sized(again)
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    once = left.where("doc_id is not null").join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    twice = left.join(again, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionAll(twice).unionAll(left.where("doc_id is null").dropDuplicates(["text"]))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
