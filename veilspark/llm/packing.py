"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import id_text, stash, table

LENGTH, END = 2048, 0
#: Pieces packed together, about; words whose ids a worker keeps, and as many met before those.
GROUP, WORDS = 40_000, 1 << 17

# The word pattern of byte-level vocabularies, for texts of the characters below alone.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
SPLIT = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^ \\t\\n\\r\\xa0{_L}{_N}]+|[ \\t\\n\\r\\xa0]+(?![^ \\t\\n\\r\\xa0])|[ \\t\\n\\r\\xa0]+")
PLAIN = re.compile("[\\t\\n\\r -~\\xa0-ɏ]*")
SPECIAL = "<|endoftext|>"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of words, as bytes of unsigned 32-bit numbers; the library's model gives those not met yet.

    When full, the words met last stay on as ``before``: those met again are taken over from there.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.split = self.tokenizer.model.tokenize
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        """A word of the pattern, free of the special string, is one piece of work for the vocabulary's merges."""
        out = self.before.get(word)
        if out is None:
            letters = word.encode().decode("latin-1").translate(LETTERS)
            out = array("I", [x.id for x in self.split(letters)]).tobytes()
        self[word] = out
        return out

    def make_room(self) -> None:
        if len(self) > WORDS:
            self.before = dict(self)
            self.clear()


_ids: dict[str, WordIds] = {}


def encode(texts: list[str | None], tokenizer_file: str) -> list[bytes]:
    """The ids of each text (null: empty), as the library gives them.

    The vocabulary's merges stay within words, so a text's ids are those of its words in turn, and most words are met again. Texts
    with the special string, or with characters whose class may differ between libraries, go to the library whole.
    """
    ids = _ids.get(tokenizer_file) or _ids.setdefault(tokenizer_file, WordIds(tokenizer_file))
    ids.make_room()
    plain = [bool(t) and SPECIAL not in t and PLAIN.fullmatch(t) for t in texts]
    return [b"".join(map(ids.__getitem__, SPLIT.findall(t))) if p else ids.whole(t) if t else b"" for t, p in zip(texts, plain)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(tokenizer_file: str | None, length: int, end: int):
    def run(batches):
        path = tokenizer_file or tokenizer_path()  # where this worker has it
        for b in batches:
            rows, doc_ids, texts = [], b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 2 << 20):
                    size += len(texts[stop] or "")
                    stop += 1
                for doc_id, ids in zip(doc_ids[at:stop], encode(texts[at:stop], path)):
                    ids += np.uint32(end).tobytes()
                    n = len(ids) // 4
                    first = (n - 1) % length + 1
                    cuts = [0, *range(first, n + 1, length)]
                    rows += [(doc_id, k, i, j - i, zlib.crc32(memoryview(ids)[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
                at = stop
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the order given where the squared counts of open bins per gap become smallest.

    Putting a length into a bin with gap g takes that bin from the count at g to that at g less the length: the squares change by
    2 (1 + count[g - length] - count[g]), less one at a full bin; a new bin changes them by 2 count[capacity - length] + 1. Ties go
    to the smallest gap, a new bin last.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        if size == capacity:
            place[k], offset[k], bins = bins, 0, bins + 1
            continue
        before, after = count[size:], count[: capacity + 1 - size]
        change = np.where(before > 0, 2 * (1 + after - before), 1 << 40)
        if count[size]:
            change[0] = 1 - 2 * count[size]
        change[-1] = 2 * after[-1] + 1
        gap = size + int(change.argmin())
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        place[k], offset[k] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return place, offset


def _packed(length: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        place, offset = sum_of_squares(t.column("length").to_numpy(), length)
        sequence = t.column("part").to_numpy() * (1 << 32) + place
        return t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer_file: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece of every row of ``docs``, with its sequence and place.

    A document's ids end with ``end``; only longer ones than ``length`` are cut, into full pieces after a first that may be shorter.
    Pieces are dealt by hash into groups of about ``group``, longest first within a group, each packed by the sum-of-squares rule: a
    group leaves few part-filled sequences against the thousands that it fills. Null and empty texts are one id. Repeated rows
    are packed each; a null doc_id stays null; other columns are ignored; an empty table gives no rows. A given
    tokenizer file has to be readable on every executor.
    """
    pieces = stash(id_text(docs).mapInArrow(_cut(tokenizer_file, length, end), PIECES), "pieces")
    parts = max(1, round(pieces.count() / group))
    # the place in the stored table keeps repeated rows apart, and stays the same if a task runs again
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(_packed(length), PIECES + ", sequence_id long, offset long")


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
