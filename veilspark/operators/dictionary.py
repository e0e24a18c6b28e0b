"""Custom phrases by the table: dictionaries of any size, found by hashes of what may begin a phrase, then of whole phrases; the different stretches of a task that pass are compared with the phrases of their bucket."""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.kinds import PRIORITY
from veilspark.operators.detect import NONE, SPAN, resolved, with_candidates
from veilspark.operators.detect import spans as detected
from veilspark.session import stash, unstash

#: Characters of a phrase that are looked for first; bits of a map for each phrase, least and most of their power of two, and most for the map of heads.
HEAD, BITS, LEAST, MOST, MOST_HEADS = 8, 16, 16, 29, 25
#: Phrases that are looked for in one pass over the texts, about; stretches that a task remembers to have sent, and their length at most.
ROUND, SENT, SHORT = 1 << 26, 1 << 21, 64
#: Buckets of hashes by their first bits, as a power of two; stretches or characters of them that a task packs at once, about; how packs are compressed.
BUCKETS, PACKED, PACKED_CHARS, CODEC = 8, 1 << 20, 1 << 25, pa.Codec("zstd", 3)
#: Where in a hash the three bits of a word of a map are named.
SHIFTS = (30, 24, 18)
#: Characters of texts that are hashed together, about: few enough for most of what is worked out of them to stay in a core's caches.
SLICE = 1 << 17
BASE, OTHER = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03


def _made_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_kept_powers = functools.lru_cache(8)(_made_powers)


def _powers(base: int, n: int) -> np.ndarray:
    return _kept_powers(base, 4 * SLICE)[:n] if n <= 4 * SLICE else _made_powers(base, n)


@functools.cache
def _mixed() -> np.ndarray:
    """A number for each code point."""
    x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


class Hashes:
    """Hashes of any stretch of some code points, from sums up to each of them: equal stretches of one length have equal hashes. ``beyond`` places more can be
    asked for behind the end, where stretches have hashes of no use."""

    def __init__(self, codes: np.ndarray, base: int = BASE, beyond: int = 0):
        n = len(codes)
        x = _mixed()[codes]
        x *= _powers(base, n)
        self.upto = np.zeros(n + 1 + beyond, np.uint64)
        np.cumsum(x, out=self.upto[1 : n + 1])
        self.upto[n + 1 :] = self.upto[n]
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray | slice, n: int) -> np.ndarray:
        """Of stretches of a length from some places, or from all in a row."""
        if isinstance(start, slice):
            return self.between(self.upto[start], self.upto[start.start + n : start.stop + n], self.back[start], n)
        return self.between(self.upto[start], self.upto[start + n], self.back[start], n)

    @staticmethod
    def between(first: np.ndarray, last: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
        h = last - first
        h *= back
        h ^= np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64))
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its folded form's first code point, how many there are, and where they begin in a list of those of the forms below the private planes:
    decomposed, without case and without marks. Marks fold to nothing; sharp s, ligatures and syllables to several."""
    top = 0x30000
    parted = [chr(c) for c in range(top) if not 0xD800 <= c < 0xE000]
    whole = unicodedata.normalize("NFD", unicodedata.normalize("NFD", "\0".join(parted)).casefold())
    whole = whole.translate({ord(c): None for c in set(whole) if unicodedata.category(c) == "Mn"})
    forms = whole[1:].split("\0")  # the first form is that of the separator
    forms[0] = "\0"
    forms[0xD800:0xD800] = [chr(c) for c in range(0xD800, 0xE000)]
    size = np.ones(0x110000, np.int64)
    size[:top] = [len(f) for f in forms]
    every, first = _codes(forms), np.zeros(0x110000, np.int64)
    first[:top] = np.cumsum(size[:top]) - size[:top]
    one = np.arange(0x110000, dtype=np.uint32)
    one[:top][size[:top] > 0] = every[first[:top][size[:top] > 0]]
    return one, size.astype(np.uint8), first, every


def folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(code points of the folded text, the place of the character that each comes from, whether any character folds to several)."""
    one, size, first, forms = _folds()
    n = size[codes]
    if (n == 1).all():
        return one[codes], np.arange(len(codes)), False
    owner = np.repeat(np.arange(len(codes)), n)
    plain, wide = one[codes[owner]], np.flatnonzero(n > 1)
    if len(wide):
        at = np.cumsum(n, dtype=np.int64) - n
        for k in range(1, int(n[wide].max())):
            some = wide[n[wide] > k]
            plain[at[some] + k] = forms[first[codes[some]] + k]
    return plain, owner, len(wide) > 0


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _strings(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the texts of a column begin and end in their bytes. Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.string())
    _, at, data = column.buffers()
    return np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1] if at and at.size else np.zeros(1, np.int32), memoryview(data or b"")


def _cut(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.StringArray:
    """Stretches of some code points as texts."""
    ends = np.cumsum(n, dtype=np.int64)
    chars = codes[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
    if not len(chars) or chars.max() < 0x80:
        data = chars.astype(np.uint8)
    else:
        data = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        ends = np.append(0, np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)))[ends]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))


def _names(b: pa.RecordBatch, by: tuple[str, ...]) -> list[str]:
    """What has to be equal, as text: equal values have equal ones, others different ones."""
    if not by:
        return [""] * b.num_rows
    columns = [[x + 0 if isinstance(x, float) else x for x in b.column(c).to_pylist()] for c in by]  # no negative zero
    return list(map(repr, zip(*columns)))


def _named(b: pa.RecordBatch, by: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different ``_names`` of rows, a row that has each, and the number of each row's."""
    if any(pa.types.is_nested(b.column(c).type) for c in by):
        which, first = np.arange(b.num_rows), np.arange(b.num_rows)
    else:
        which = np.zeros(b.num_rows, np.int64)
        for c in by:
            column = b.column(c).dictionary_encode("encode")
            which = np.unique(which * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        first = np.unique(which, return_index=True)[1]
    return _names(b.select([*by]).take(pa.array(first)), by) if by else [""] * len(first), first, which


PACK = "bucket int, names array<string>, owners array<bigint>, counts array<int>, size int, packed binary"
PACK_NAMES = ["bucket", "names", "owners", "counts", "size", "packed"]


class _Packer:
    """Stretches or phrases of a task on their way to the buckets of their hashes, each once: rows of a bucket, the names and hashes of its owners, how many
    stretches each has, and the lengths and UTF-8 of all, in order, compressed. Most of a stretch is then shared with the one before."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.owners: list[int] = []
        self.clear()

    def clear(self) -> None:
        self.bucket, self.who, self.plain, self.count, self.chars = [], [], [], 0, 0

    def numbered(self, names: list[str], owners: np.ndarray) -> np.ndarray:
        out = np.empty(len(names), np.int64)
        for i, name in enumerate(names):
            out[i] = self.numbers.setdefault(name, len(self.numbers))
            if out[i] == len(self.owners):
                self.owners.append(int(owners[i]))
        return out

    def add(self, whole: np.ndarray, who: np.ndarray, plain: pa.StringArray, chars: int) -> None:
        self.bucket.append((whole >> np.uint64(64 - BUCKETS)).astype(np.uint16))
        self.who.append(who)
        self.plain.append(plain)
        self.count, self.chars = self.count + len(plain), self.chars + chars

    def add_packed(self, bucket: int, who: np.ndarray, plain: pa.StringArray) -> None:
        self.bucket.append(np.full(len(plain), bucket, np.uint16))
        self.who.append(who)
        self.plain.append(plain)
        self.count += len(plain)

    def full(self) -> bool:
        return self.count >= PACKED or self.chars >= PACKED_CHARS

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            bucket, who, plain = np.concatenate(self.bucket), np.concatenate(self.who), pa.concat_arrays(self.plain)
            self.clear()
            yield _packs(bucket, who, plain, list(self.numbers), self.owners)
            self.numbers, self.owners = {}, []


def _packs(bucket: np.ndarray, who: np.ndarray, plain: pa.StringArray, names: list[str], owners: list[int]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, who, plain = bucket[order], who[order], plain.take(pa.array(order))
    firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    out = []
    for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(bucket)]):
        own, order = who[i:j], pc.sort_indices(plain.slice(i, j - i)).to_numpy()
        if len(owners) > 1:
            order = order[np.argsort(own[order], kind="stable")]
        own, some = own[order], plain.slice(i, j - i).take(pa.array(order))
        again = pc.equal(some.slice(1), some.slice(0, j - i - 1)).to_numpy(zero_copy_only=False) & (own[1:] == own[:-1])
        new = np.append(True, ~again)
        own, (at, data) = own[new], _strings(some.filter(pa.array(new)))
        whose, counts = np.unique(own, return_counts=True)
        raw = np.ascontiguousarray(np.diff(at).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() + data[at[0] : at[-1]]
        out.append((int(bucket[i]), [names[k] for k in whose], [owners[k] for k in whose], counts.tolist(), len(raw), CODEC.compress(raw, asbytes=True)))
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], PACK_NAMES)


def _unpacked(r: dict) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """What is in a pack: stretches, numbers of their owners in it, their lengths and hashes."""
    raw, counts = CODEC.decompress(r["packed"], r["size"], asbytes=True), r["counts"]
    n = sum(counts)
    size = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    at = np.append(0, np.cumsum(size, dtype=np.int64)).astype(np.int32)
    data = np.frombuffer(raw, np.uint8, offset=4 * n)
    length = np.add.reduceat(data & 0xC0 != 0x80, at[:-1], dtype=np.int64)
    start, h = np.cumsum(length) - length, Hashes(_codes([data.tobytes().decode()]))
    who = np.repeat(np.arange(len(counts)), counts)
    whole = np.array(r["owners"], np.int64).view(np.uint64)[who]
    for k in np.unique(length).tolist():
        whole[length == k] ^= h.of(start[length == k], k)
    return pa.StringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(data)), who, length, whole


def _phrases(by: tuple[str, ...]):
    """Phrases, folded, in packs."""
    def run(batches: Iterator[pa.RecordBatch]):
        packer = _Packer()
        for b in batches:
            owners, (at, data) = b.column("_owner").to_numpy(), _strings(b.column("phrase"))
            codes = _codes([str(data[at[0] : at[-1]], "utf-8")])
            plain, owner, _ = folded(codes)
            ends = np.searchsorted(owner, np.cumsum(pc.utf8_length(b.column("phrase")).to_numpy()))
            n = np.diff(ends, prepend=0)
            start, h = ends - n, Hashes(plain)
            whole = owners.view(np.uint64).copy()
            for size in np.unique(n[n > 0]).tolist():
                some = np.flatnonzero(n == size)
                whole[some] ^= h.of(start[some], size)
            some, (names, first, which) = n > 0, _named(b, by)
            packer.add(whole[some], packer.numbered(names, owners[first])[which[some]], _cut(plain, start[some], n[some]), len(codes))
            if packer.full():
                yield from packer.rows()
        yield from packer.rows()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], shift: int = 0):
    """(bucket, its packs) of rows in order of buckets, of which ``shift`` bits are left out."""
    packs = (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows))
    return itertools.groupby(packs, lambda r: r["bucket"] >> shift)


def _united(batches: Iterator[pa.RecordBatch]):
    """Packs of the same bucket as one, in which each phrase is once, and the lengths of its phrases."""
    for bucket, packs in _by_bucket(batches):
        packer, lengths = _Packer(), set()
        for r in packs:
            plain, who, length, _ = _unpacked(r)
            packer.add_packed(bucket, packer.numbered(r["names"], r["owners"])[who], plain)
            lengths.update(np.unique(length).tolist())
        for b in packer.rows():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(lengths)], pa.list_(pa.int32()))], [*PACK_NAMES, "lengths"])


def _owner(by: tuple[str, ...]):
    """A hash of what has to be equal, null where any of it is."""
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("_owner")


def phrase_index(dictionary: DataFrame, phrase: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The different phrases of a dictionary, folded, as a table: a pack for each bucket, and the lengths of its phrases. Null and empty phrases find nothing, nor
    do marks alone."""
    rows = dictionary.select(*by, F.col(phrase).cast("string").alias("phrase")).where("phrase <> ''").withColumn("_owner", _owner(by)).where("_owner is not null")
    packs = rows.mapInArrow(_phrases(by), PACK).repartition("bucket").sortWithinPartitions("bucket")
    return stash(packs.mapInArrow(_united, f"{PACK}, lengths array<int>"), "phrases")


def _of_part(whole: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return (whole & np.uint64(0xFFFF)) % np.uint64(part[1]) == part[0]


def _three(h: np.ndarray) -> np.ndarray:
    a, b, c = (np.uint64(1) << (h >> np.uint64(s) & np.uint64(63)) for s in SHIFTS)
    return a | b | c


def _word(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits) >> np.uint64(6)


def _set(words: np.ndarray, h: np.ndarray, bits: int) -> None:
    """Three bits for each hash, in the word that its first bits name; ``words`` is a map of 2^bits bits, or the piece of it that a bucket has."""
    np.bitwise_or.at(words, _word(h, bits) & np.uint64(len(words) - 1), _three(h))


def _in(words: np.ndarray, h: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Which hashes are in a map, by number. Most are out by the first of their bits."""
    at = h >> np.uint64(64 - (bits or len(words).bit_length() + 5) + 6)
    if bits:
        at &= np.uint64(len(words) - 1)
    found = words.take(at.view(np.int64))
    bit = h >> np.uint64(SHIFTS[0])
    bit &= np.uint64(63)
    np.right_shift(found, bit, out=bit)
    bit &= np.uint64(1)
    first = np.flatnonzero(bit.astype(bool))
    three = _three(h[first])
    return first[found[first] & three == three]


def _whole_map(pieces: pa.Table, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits - 6, np.uint64)
    for at, piece in zip(pieces.column("at").to_pylist(), pieces.column("piece")):
        words = np.frombuffer(piece.as_buffer(), np.uint64)
        out[at : at + len(words)] |= words
    return out


def _pieces(part: tuple[int, int], bits: int):
    """Each bucket's piece of a map of whole phrases, and where it is. The hashes of a bucket share their first bits, so that its piece has no others."""
    def run(batches: Iterator[pa.RecordBatch]):
        for bucket, packs in _by_bucket(batches):
            piece = np.zeros(1 << max(0, bits - 6 - BUCKETS), np.uint64)
            for r in packs:
                whole = _unpacked(r)[3]
                _set(piece, whole[_of_part(whole, part)], bits)
            yield pa.RecordBatch.from_arrays([pa.array([(bucket << bits - 6) >> BUCKETS]), pa.array([piece.tobytes()])], ["at", "piece"])

    return run


def _heads(part: tuple[int, int], bits: int):
    """The words of a map of heads that are not zero, of a task's phrases."""
    def run(batches: Iterator[pa.RecordBatch]):
        words = np.zeros(1 << bits - 6, np.uint64)
        for _, packs in _by_bucket(batches):
            for r in packs:
                plain, _, length, whole = _unpacked(r)
                some = _of_part(whole, part)
                at, data = _strings(pc.utf8_slice_codeunits(plain.filter(pa.array(some)), 0, HEAD))
                size, h = np.minimum(length[some], HEAD), Hashes(_codes([str(data[at[0] : at[-1]], "utf-8")]))
                start = np.cumsum(size) - size
                for k in np.unique(size).tolist():
                    _set(words, np.unique(h.of(start[size == k], k)), bits)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "bits"])

    return run


def _maps(index: DataFrame, part: tuple[int, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases of a part, a map of heads and one of whole phrases, of 2^bits bits whatever the dictionary."""
    of_heads = min(bits, MOST_HEADS)
    got = index.select(*PACK_NAMES).mapInArrow(_heads(part, of_heads), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    heads = np.zeros(1 << of_heads - 6, np.int64)
    heads[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return heads.view(np.uint64), _whole_map(index.select(*PACK_NAMES).mapInArrow(_pieces(part, bits), "at long, piece binary").toArrow(), bits)


def _bits(count: int) -> int:
    return min(MOST, max(LEAST, (BITS * count - 1).bit_length()))


def _among(ordered: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of ``h`` is in sorted hashes, or the number of these."""
    at = np.searchsorted(ordered, h)
    inside = at < len(ordered)
    inside[inside] = ordered[at[inside]] == h[inside]
    return np.where(inside, at, len(ordered))


def _first_of_overlapping(group: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the sorted matches (group, start) stay when one that begins within another of its group goes, from left to right."""
    keep = np.ones(len(start), bool)
    near = np.append(False, (group[1:] == group[:-1]) & (start[1:] < start[:-1] + n[:-1]))
    i = 0
    for i in np.flatnonzero(near):
        last = i - 1
        while not keep[last]:
            last -= 1
        keep[i] = group[last] != group[i] or start[i] >= start[last] + n[last]
    return keep


class _Slice:
    """Some texts, folded, and the stretches of them that pass the maps: their text, place in the folded texts, length and hash."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, owners: np.ndarray, part: tuple[int, int], lengths: dict[int, list[int]], heads: np.ndarray, wholes: np.ndarray):
        self.codes, self.size, self.ends = codes, size, np.cumsum(size)
        self.plain, self.owner, several = folded(codes)
        plain_ends = np.searchsorted(self.owner, self.ends)
        count = np.diff(plain_ends, prepend=0)
        of, stop = np.repeat(np.arange(len(size)), count), np.repeat(plain_ends, count)
        if several:  # phrases begin and end with whole characters, however many a character folds to
            opens = np.append(self.owner[1:] != self.owner[:-1], True)
            begins = np.append(True, opens[:-1])
        h, out, owned = Hashes(self.plain, beyond=max(map(max, lengths.values()))), [], owners.any()
        for size, every in lengths.items():
            at = _in(heads, h.of(slice(0, max(0, len(of) - size + 1)), size))
            if several:
                at = at[begins[at]]
            first, back, left = h.upto[at], h.back[at], stop[at] - at
            own = owners[of[at]] if owned else None
            for n in every:
                whole = h.between(first, h.upto[at + n], back, n)
                if owned:
                    whole ^= own
                ok = _in(wholes, whole)
                ok = ok[left[ok] >= n]
                if several:
                    ok = ok[opens[at[ok] + n - 1]]
                if part[1] > 1:
                    ok = ok[_of_part(whole[ok], part)]
                out.append((at[ok], np.full(len(ok), n), whole[ok]))
        self.start, self.n, self.whole = (np.concatenate(x) for x in zip(*out))
        self.doc = of[self.start]

    def keep(self, some: np.ndarray) -> None:
        self.start, self.n, self.whole, self.doc = (x[some] for x in (self.start, self.n, self.whole, self.doc))

    def said(self) -> pa.StringArray:
        return _cut(self.plain, self.start, self.n)

    def each_once(self, which: np.ndarray) -> np.ndarray:
        """Which stretches stay where one overlaps with itself. Their places ascend for each length."""
        order = np.argsort(self.whole, kind="stable")
        w, start, n, doc = self.whole[order], self.start[order], self.n[order], self.doc[order]
        near = (w[1:] == w[:-1]) & (start[1:] < start[:-1] + n[:-1]) & (start[1:] >= start[:-1]) & (doc[1:] == doc[:-1])
        keep = np.ones(len(order), bool)
        if near.any():
            some = np.flatnonzero(np.isin(self.whole, w[1:][near]))
            some = some[np.lexsort((self.start[some], self.n[some], self.whole[some], which[some], self.doc[some]))]
            s, n, w, k, d = (x[some] for x in (self.start, self.n, self.whole, which, self.doc))
            same = (d[1:] == d[:-1]) & (w[1:] == w[:-1]) & (n[1:] == n[:-1]) & (k[1:] == k[:-1])
            keep[some] = _first_of_overlapping(np.cumsum(np.append(True, ~same)), s, n)
        return keep


def _slices(b: pa.RecordBatch, text: str):
    """(number of the first text, code points of texts, their lengths, hashes of their owners) of a batch, SLICE characters or so at once. Nothing is sought where the owner is null."""
    owned, texts = b.column("_owner"), b.column(text).cast(pa.string())
    if owned.null_count or texts.null_count:
        texts = pc.if_else(pc.and_(owned.is_valid(), texts.is_valid()), texts, pa.scalar("", pa.string()))
    owners = owned.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    size, (place, data), at = pc.utf8_length(texts).to_numpy().astype(np.int64), _strings(texts), 0
    upto = np.cumsum(size)
    while at < len(size):
        stop = min(len(size), int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE)) + 1)
        yield at, _codes([str(data[place[at] : place[stop]], "utf-8")]), size[at:stop], owners[at:stop]
        at = stop


class _Sent:
    """Stretches that a task has sent, by two hashes each, in a table in which one takes the place of another."""

    def __init__(self, most: int):
        self.slots = np.uint64(max(2, 1 << most.bit_length() - 1) - 1)
        self.whole = (np.arange(self.slots + np.uint64(1), dtype=np.uint64) ^ np.uint64(1)) << np.uint64(16)  # of no stretch that comes to this place
        self.check, self.last = np.zeros(len(self.whole), np.uint64), np.zeros(len(self.whole), np.int32)

    def new(self, whole: np.ndarray, check: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Those that were not sent, as far as is known, each once; all that are not short."""
        slot = (whole >> np.uint64(16) & self.slots).astype(np.int64)
        fresh = np.flatnonzero((self.whole[slot] != whole) | (self.check[slot] != check) | ~short)
        slot, w, c, numbers = slot[fresh], whole[fresh], check[fresh], np.arange(len(fresh))
        self.whole[slot], self.check[slot], self.last[slot] = w, c, numbers
        last = self.last[slot]
        return fresh[(last == numbers) | (w[last] != w) | (c[last] != c) | ~short[fresh]]


def _stretches(sent, part: tuple[int, int], lengths: dict[int, list[int]], text: str, by: tuple[str, ...], most: int):
    """Different stretches of a task's texts that may be phrases, in packs. Of ``most`` that it has sent a task knows two hashes, so as to send each once; long
    ones are sent with each pack."""
    def run(batches: Iterator[pa.RecordBatch]):
        known, packer = _Sent(most), _Packer()
        for b in batches:
            names = _names(b, by)
            for at, codes, size, owners in _slices(b, text):
                s = _Slice(codes, size, owners, part, lengths, *sent.value)
                other = Hashes(s.plain, OTHER)
                check = np.zeros(len(s.n), np.uint64)
                for n in np.unique(s.n).tolist():
                    some = np.flatnonzero(s.n == n)
                    check[some] = other.of(s.start[some], n)
                check ^= owners[s.doc]
                s.keep(known.new(s.whole, check, s.n <= SHORT))
                if len(s.doc):
                    docs, of = np.unique(s.doc, return_inverse=True)
                    who = packer.numbered([names[at + d] for d in docs], owners.view(np.int64)[docs])[of]
                    packer.add(s.whole, who, s.said(), int(s.n.sum()))
                if packer.full():
                    yield from packer.rows()
        yield from packer.rows()

    return run


class _Phrases:
    """The phrases of a bucket, against which stretches are held."""

    def __init__(self, packs: list[dict], part: tuple[int, int]):
        self.numbers: dict[str, int] = {}
        whole, who, plain = [], [], []
        for r in packs:
            p, w, _, h = _unpacked(r)
            some = _of_part(h, part)
            whole.append(h[some])
            who.append(self.numbered(r["names"])[w[some]])
            plain.append(p.filter(pa.array(some)))
        whole, who, plain = np.concatenate([np.zeros(0, np.uint64), *whole]), np.concatenate([np.zeros(0, np.int64), *who]), pa.concat_arrays([pa.array([], pa.string()), *plain])
        order = np.argsort(whole, kind="stable")
        self.whole, self.who, self.plain = whole[order], who[order], plain.take(pa.array(order))
        self.odd = [self.whole[1:][self.whole[1:] == self.whole[:-1]]]

    def numbered(self, names: list[str]) -> np.ndarray:
        return np.array([self.numbers.setdefault(x, len(self.numbers)) for x in names], np.int64)

    def others(self, r: dict) -> np.ndarray:
        """Hashes of a pack's stretches that no phrase has. Those that a phrase has and a stretch that differs from it are ``odd``, as are those that different phrases share."""
        plain, who, _, whole = _unpacked(r)
        place = _among(self.whole, whole)
        hit = np.flatnonzero(place < len(self.whole))
        at = place[hit]
        same = pc.equal(plain.take(pa.array(hit)), self.plain.take(pa.array(at))).to_numpy(zero_copy_only=False) & (self.numbered(r["names"])[who[hit]] == self.who[at])
        self.odd.append(whole[hit[~same]])
        return whole[place == len(self.whole)]

    def odd_ones(self) -> list[dict]:
        names = list(self.numbers)
        some = np.flatnonzero(np.isin(self.whole, np.concatenate(self.odd)))
        return [{"whole": int(h), "name": names[w], "plain": p} for h, w, p in zip(self.whole[some].view(np.int64), self.who[some], self.plain.take(pa.array(some)).to_pylist())]


JUDGED = "at long, piece binary, spared binary, odd array<struct<whole: bigint, name: string, plain: string>>"


def _verdicts(part: tuple[int, int], bits: int):
    """For each bucket its piece of a map of stretches that are no phrases, the hashes of its phrases that are in this piece, too, and the phrases of odd hashes."""
    shared = min(BUCKETS, bits - 6)

    def run(batches: Iterator[pa.RecordBatch]):
        for bucket, rows in _by_bucket(batches, BUCKETS - shared):
            packs, rest = [], []
            for r in rows:
                if r["found"]:
                    rest.append(r)
                    break
                packs.append(r)
            known, piece = _Phrases(packs, part), np.zeros(1 << bits - 6 - shared, np.uint64)
            for r in itertools.chain(rest, rows):
                _set(piece, known.others(r), bits)
            spared = np.unique(known.whole[_in(piece, known.whole, bits)])
            odd = pa.array([known.odd_ones()], pa.list_(pa.struct([("whole", pa.int64()), ("name", pa.string()), ("plain", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([bucket << bits - 6 - shared]), pa.array([piece.tobytes()]), pa.array([spared.tobytes()]), odd], ["at", "piece", "spared", "odd"])

    return run


PLACE = {"plain": "string", "start": "int", "end": "int", "value": "string", "same": "long"}
FOUND = "start long, end long, kind string, value string"


class _Places:
    """Where the phrases of a part are in some texts: the number of the text, and code points and UTF-16 code units of all texts from and to."""

    def __init__(self, s: _Slice):
        after = np.append(s.owner, len(s.codes))[s.start + s.n]
        self.s, self.doc, self.a, self.z = s, s.doc, s.owner[s.start], np.minimum(after, s.ends[s.doc])  # marks behind the last character come along
        wide = s.codes > 0xFFFF
        self.units = np.append(0, np.cumsum(1 + wide)) if wide.any() else np.arange(len(s.codes) + 1)
        self.begin = self.units[s.ends - s.size]
        self.start, self.end = self.units[self.a], self.units[self.z]

    def values(self, some: np.ndarray | slice = slice(None)) -> pa.StringArray:
        return _cut(self.s.codes, self.a[some], self.z[some] - self.a[some])

    def same(self) -> np.ndarray:
        """For each place the first one, counted in its text, that has the same value."""
        if not len(self.doc):
            return self.doc
        value = self.values().dictionary_encode().indices.to_numpy()
        _, first, which = np.unique(self.doc * (int(value.max()) + 1) + value, return_index=True, return_inverse=True)
        return first[which] - np.searchsorted(self.doc, self.doc)

    def listed(self, fields: tuple[str, ...], part: tuple[int, int]) -> pa.ListArray:
        """The places of each text."""
        begin = self.begin[self.doc]
        of = {"plain": self.s.said, "start": lambda: pa.array((self.start - begin).astype(np.int32)), "end": lambda: pa.array((self.end - begin).astype(np.int32)), "value": self.values, "same": lambda: pa.array(self.same() * part[1] + part[0])}
        offsets = np.append(0, np.cumsum(np.bincount(self.doc, minlength=len(self.begin))))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([of[f]() for f in fields], list(fields)))

    def resolved(self, others: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
        """Of these places and other spans of the texts, in order of start, then longest, then priority, those that touch none kept before: the texts that they
        are in, and start, end, kind and value."""
        count = pc.fill_null(pc.list_value_length(others), 0).to_numpy()
        x, docs = others.flatten(), np.append(self.doc, np.repeat(np.arange(len(count)), count))
        start = np.append(self.start - self.begin[self.doc], x.field("start").to_numpy())
        end = np.append(self.end - self.begin[self.doc], x.field("end").to_numpy())
        less = np.append(np.full(len(self.doc), -PRIORITY["custom"]), x.field("lessPriority").to_numpy())
        room = np.zeros(len(count), np.int64)  # texts in which no phrase is sought are empty here, and have other spans
        np.maximum.at(room, docs, end)
        start, end = (y + (np.cumsum(room) - room)[docs] for y in (start, end))
        order = np.lexsort((less, start - end, start))
        # the next one that is free begins where this one ends, or behind
        following, kept, i, n = np.searchsorted(start[order], end[order]).tolist(), [], 0, len(order)
        while i < n:
            kept.append(i)
            i = following[i]
        kept = order[kept] if kept else order[:0]
        mine = kept < len(self.doc)
        values, kinds, own = self.values(kept[mine]), pa.array(["custom"]).take(pa.array(np.zeros(mine.sum(), np.int64))), docs[kept]
        if not mine.all():
            theirs, place = pa.array(kept[~mine] - len(self.doc)), np.empty(len(kept), np.int64)
            place[mine], place[~mine] = np.arange(mine.sum()), np.arange(mine.sum(), len(kept))
            values = pa.concat_arrays([values, x.field("value").take(theirs).cast(pa.string())]).take(pa.array(place))
            kinds = pa.concat_arrays([kinds, x.field("kind").take(theirs).cast(pa.string())]).take(pa.array(place))
        return own, [*(pa.array((y[kept] - (np.cumsum(room) - room)[own]).astype(np.int64)) for y in (start, end)), kinds, values]


def _placed(sent, judged, part: tuple[int, int], lengths: dict[int, list[int]], text: str, by: tuple[str, ...], kept: list[str], fields: tuple[str, ...], spans: str | None = None):
    """Adds the places of a round's phrases to texts, in UTF-16 code units, and what is there; or, with a column of other ``spans``, a row for each of what is left
    of both without overlaps."""
    def found(b: pa.RecordBatch, first: int, s: _Slice) -> _Places:
        refuted, spared, odd = judged.value
        doubted = _in(refuted, s.whole)
        ok = np.ones(len(s.doc), bool)
        ok[doubted] = _among(spared, s.whole[doubted]) < len(spared)
        s.keep(ok)
        which = np.zeros(len(s.doc), np.int64)
        if odd:
            said, names = s.said().to_pylist(), _names(b, by)
            for i in np.flatnonzero(np.isin(s.whole, np.array(list(odd), np.uint64))):
                which[i] = odd[int(s.whole[i])].get((names[first + s.doc[i]], said[i]), -1)
            s.keep(which >= 0)
            which = which[which >= 0]
        s.keep(s.each_once(which))
        s.keep(np.argsort(s.start, kind="stable"))
        return _Places(s)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at, codes, size, owners in _slices(b, text):
                places = found(b, at, _Slice(codes, size, owners, part, lengths, *sent.value))
                rows = [b.column(c).slice(at, len(size)) for c in kept]
                if spans is None:
                    yield pa.RecordBatch.from_arrays([*rows, places.listed(fields, part)], [*kept, f"_places{part[0]}"])
                else:
                    own, out = places.resolved(b.column(spans).slice(at, len(size)))
                    yield pa.RecordBatch.from_arrays([*(x.take(pa.array(own)) for x in rows), *out], [*kept, "start", "end", "kind", "value"])

    return run


def _judged(rows: DataFrame, index: DataFrame, sent, part: tuple[int, int], bits: int, lengths: dict[int, list[int]], text: str, by: tuple[str, ...]):
    """What tells phrases from other stretches among all that pass the maps: a map of those that are none, hashes of phrases that are in this map, too, and
    phrases of hashes that different stretches share, numbered."""
    stretches = rows.mapInArrow(_stretches(sent, part, lengths, text, by, SENT), PACK)
    both = index.select(*PACK_NAMES, F.lit(False).alias("found")).unionByName(stretches.withColumn("found", F.lit(True)))
    coarse = F.col("bucket").bitwiseAND(-1 << BUCKETS - min(BUCKETS, bits - 6))
    got = both.repartition(coarse).sortWithinPartitions(coarse, "found").mapInArrow(_verdicts(part, bits), JUDGED).toArrow()  # a map, and of ROUND phrases those in it
    spared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("spared"))]))
    odd: dict[int, dict[tuple, int]] = {}
    for x in itertools.chain.from_iterable(got.column("odd").to_pylist()):  # of hashes shared by chance
        same_hash = odd.setdefault(x["whole"] % (1 << 64), {})
        same_hash.setdefault((x["name"], x["plain"]), len(same_hash))
    return rows.sparkSession.sparkContext.broadcast((_whole_map(got, bits), spared, odd))  # 2^MOST bits at most


class _Passes:
    """The phrases of a table, in as many parts as there are passes over texts, and what is sent to find them."""

    def __init__(self, texts: DataFrame, dictionary: DataFrame, text: str, phrase: str, by: tuple[str, ...]):
        self.text, self.by, self.lengths = text, by, {}
        index = phrase_index(dictionary, phrase, by)
        count = index.select(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda n, x: n + x)), F.lit(0))).first()[0]
        for r in index.select(F.explode("lengths").alias("n")).distinct().orderBy("n").collect():  # the different lengths
            self.lengths.setdefault(min(r.n, HEAD), []).append(r.n)
        self.parts, self.sent = max(1, -(-count // ROUND)) if self.lengths else 0, []
        for i in range(self.parts):
            bits = _bits(count // self.parts)
            maps = texts.sparkSession.sparkContext.broadcast(_maps(index, (i, self.parts), bits))  # 2^MOST bits at most
            self.sent.append((maps, _judged(texts.select(text, *by, _owner(by)), index, maps, (i, self.parts), bits, self.lengths, text, by)))
        unstash(index)

    def over(self, rows: DataFrame, i: int, kept: list[str], fields: tuple[str, ...], spans: str | None = None) -> DataFrame:
        found = FOUND if spans else f"_places{i} array<struct<{', '.join(f'{f}: {PLACE[f]}' for f in fields)}>>"
        schema = T.StructType([*(rows.schema[c] for c in kept), *T.StructType.fromDDL(found)])
        return rows.mapInArrow(_placed(*self.sent[i], (i, self.parts), self.lengths, self.text, self.by, kept, fields, spans), schema)


def with_places(texts: DataFrame, dictionary: DataFrame, text: str, phrase: str, by: tuple[str, ...] = (), kept: tuple[str, ...] | None = None, fields: tuple[str, ...] = ("plain", "start", "end", "value")) -> DataFrame:
    """``kept`` columns of ``texts`` (all) and ``places``, an array of (plain, start, end, value): where the phrases of a table are, without overlaps of a phrase with itself.
    Other ``fields`` may be asked for; ``same`` is a number that the places of a text have in common if their values are the same.

    Phrases and texts compare decomposed, without case and marks, sharp s and ligatures written out; columns ``by`` (an owner, say) have to be equal. Offsets are UTF-16 code units. Texts are
    read twice and never shuffled: from everywhere that the first HEAD characters may begin a phrase, stretches of each length that phrases have are tested
    against a map of whole phrases. The different stretches of each task that pass go to the phrases of their bucket, sorted and compressed, and are compared;
    those that are none make another map. What passes the first map and not the second is a phrase, and phrases that pass both are listed. A map has 2^MOST bits at
    most; where there are more than ROUND phrases, they are dealt by hash, and each part has maps and passes of its own.
    """
    kept = list(texts.columns if kept is None else kept)
    passes = _Passes(texts, dictionary, text, phrase, by)
    rows, added = texts.withColumn("_owner", _owner(by)), []
    for i in range(passes.parts):
        on = list(dict.fromkeys([*kept, text, *by, "_owner", *added])) if i + 1 < passes.parts else [*kept, *added]
        rows = passes.over(rows, i, on, fields)
        added.append(f"_places{i}")
    none = f"array<struct<{', '.join(f'{f}: {PLACE[f]}' for f in fields)}>>"
    return rows.select(*kept, F.concat(*added, F.array().cast(none)).alias("places"))


def phrase_matches(texts: DataFrame, dictionary: DataFrame, key: str, text: str, phrase: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``by``, plain, start, end, value: the places of ``with_places``, a row each."""
    return with_places(texts.select(key, *by, text), dictionary, text, phrase, by, (key, *by)).select(key, *by, F.inline("places"))


def _spans(places: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"], (x["start"] - x["end"]).alias("lessLength"), F.lit(-PRIORITY["custom"]).alias("lessPriority"), x["end"], F.lit("custom").alias("kind"), x["value"]).cast(SPAN))


def with_dictionary(df: DataFrame, dictionary: DataFrame, key: str, text: str, phrase: str, kinds: tuple, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``detections`` of ``kinds`` and of a table's phrases, overlaps resolved. A text's phrases are one array; ``key`` is not needed any more."""
    both = with_candidates(with_places(df, dictionary, text, phrase, by), text, kinds)
    return both.withColumn("detections", resolved(F.concat("candidates", _spans("places"), F.expr(NONE)))).drop("candidates", "places")


def spans_with_dictionary(df: DataFrame, dictionary: DataFrame, key: str, text: str, phrase: str, kinds: tuple, by: tuple[str, ...] = ()) -> DataFrame:
    """``key``, start, end, kind, value: the detections of ``with_dictionary``, a row each, by text and in order. Overlaps are resolved where phrases are found, so
    that only what is left comes out."""
    passes = _Passes(df, dictionary, text, phrase, by)
    rows, on = df.select(*dict.fromkeys([key, text, *by]), _owner(by)), list(dict.fromkeys([key, text, *by, "_owner"]))
    for i in range(passes.parts - 1):
        rows = passes.over(rows, i, [*on, *(f"_places{k}" for k in range(i))], ("start", "end", "value"))
    rows = with_candidates(rows, text, kinds).withColumn("candidates", F.concat("candidates", *(_spans(f"_places{i}") for i in range(passes.parts - 1)), F.expr(NONE)))
    if not passes.parts:
        return detected(rows.withColumn("candidates", resolved(F.col("candidates"))), key, "candidates")
    return passes.over(rows.select(*on, "candidates"), passes.parts - 1, [key], (), "candidates")
