"""Cross-tokenizer alignment: arrays that say which token of each tokenizer owns a byte."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import id_text, stash, table
from veilspark.llm.packing import LETTERS, PLAIN, SPLIT, tokenizer_path
from veilspark.llm.tokens import SPACE, check_model, model_path

#: Characters of texts that are encoded together, about, bytes whose owners are held at once, and words that a worker remembers for each tokenizer.
SLICE, WINDOW, KEPT = 1 << 19, 1 << 20, 1 << 17
#: What a piece tokenizer encodes by itself: spaces with the word behind them, or the spaces at the end.
PIECE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class Ids(dict):
    """Ids of words, as bytes of unsigned 32-bit numbers, asked of the library once while they are remembered: the last KEPT words, and of as many before those
    the ones met again."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = array("I", self.encoded(word)).tobytes()
        self[word] = out
        return out

    def make_room(self) -> None:
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()


class PlainIds(Ids):
    """The byte-level vocabulary, special strings being plain text. It has all bytes and changes no text, so it gives every word back."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        if self.library.normalizer is not None or not all(x in vocabulary for x in LETTERS.values()):
            raise ValueError("alignment needs a byte-level vocabulary of all bytes without a normalizer")
        back = str.maketrans({v: chr(k) for k, v in LETTERS.items()})
        tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.tokens = [(t or "").translate(back).encode("latin-1", "replace") for t in tokens]

    def encoded(self, word: str) -> list[int]:
        return [x.id for x in self.library.model.tokenize(word.encode().decode("latin-1").translate(LETTERS))]

    def ids(self, text: str) -> bytes | None:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, SPLIT.findall(text)))
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if b"".join(map(self.tokens.__getitem__, ids)) == text.encode() else None


class PieceIds(Ids):
    """The piece vocabulary, for spaces with the word behind them. It falls back to bytes and changes no text but for spaces, so it gives every word back."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        with open(model_file, "rb") as f:
            check_model(f.read())  # no piece goes on past the end of a word, so words are encoded one by one
        m = self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.tokens = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.get_piece_size())]
        if sum(map(m.is_byte, range(m.get_piece_size()))) != 256:
            raise ValueError("alignment needs a piece model with all bytes")

    def encoded(self, word: str) -> list[int]:
        # the library puts a space in front of whatever isn't empty
        return self.library.encode(word[1:].replace(SPACE, " ")) if len(word) > 1 else [self.library.piece_to_id(word)]

    def ids(self, text: str) -> bytes | None:
        """None for texts with the sign that stands for a space: it would be given back as one."""
        return None if SPACE in text else b"".join(map(self.__getitem__, PIECE.findall(SPACE + text.replace(" ", SPACE))))


class Pair:
    """The two tokenizers: A reads a space and the text, B the text, before which it puts a space itself."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = PlainIds(a_file), PieceIds(b_file)
        self.bytes_a, self.bytes_b = self.a.tokens, self.b.tokens
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: Decimal ids, with what follows them in a group: a comma, or the end of a side.
        ends = [("A", "|", self.bytes_a), ("B", ";", self.bytes_b)]
        self.shown = [f"{i}{end}".encode() for _, last, x in ends for i in range(len(x)) for end in (",", last)]
        #: Ids a * |B| + b of all links that can be, in order.
        self.links = pd.Index(self._links())

    def _links(self) -> np.ndarray:
        """All ids a * |B| + b of which one's bytes end the other's, in order: no others can end together. Tokens of n bytes have at most
        n ends, so there are fewer of them than bytes in both vocabularies, times ids of the same bytes."""
        found, n = [], len(self.bytes_b)
        by_bytes = [{}, {}]
        for table_, tokens in zip(by_bytes, (self.bytes_a, self.bytes_b)):
            for i, t in enumerate(tokens):
                table_.setdefault(t, []).append(i)
        for i, t in enumerate(self.bytes_a):
            found += [i * n + j for k in range(len(t)) for j in by_bytes[1].get(t[k:], ())]
        for j, t in enumerate(self.bytes_b):
            found += [i * n + j for k in range(len(t)) for i in by_bytes[0].get(t[k:], ())]
        return np.unique(np.array(found, np.int64))

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids by A and by B; none where the tokens' bytes aren't those of a space and the text."""
        if not text:
            return b"", b""
        b = self.b.ids(text)
        a = self.a.ids(" " + text) if b is not None else None
        return (b"", b"") if a is None else (a, b)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_file: str | None = None, b_file: str | None = None) -> Pair:
    """The tokenizers of two files, or of those that this machine has, kept by the worker."""
    key = a_file or tokenizer_path(), b_file or model_path()
    return _pairs.get(key) or _pairs.setdefault(key, Pair(*key))


def owned(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, bytes, cut) of every overlap of tokens of these sizes, in order; cut says that both tokens end with it.

    Every byte has an owner among the tokens of A and one among those of B. Bytes in a row with the same two owners are an overlap; where both
    owners change at once the bytes are cut.
    """
    a, b = np.repeat(np.arange(len(size_a), dtype=np.int32), size_a), np.repeat(np.arange(len(size_b), dtype=np.int32), size_b)
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    ends = np.append(np.flatnonzero(new_a | new_b), len(a) - 1)
    cut = np.append((new_a & new_b)[ends[:-1]], True)
    return a[ends], b[ends], np.diff(ends, prepend=-1), cut


def _windows(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of tokens of A and of B over the same bytes, about WINDOW of them: from one common end to another."""
    a0 = b0 = at = 0
    n = int(ends_a[-1]) if len(ends_a) else 0
    while at < n:
        size, a1, b1 = WINDOW, len(ends_a), len(ends_b)
        while at + size < n:
            a1, b1 = (int(np.searchsorted(x, at + size, "right")) for x in (ends_a, ends_b))
            both = np.intersect1d(ends_a[a0:a1], ends_b[b0:b1], assume_unique=True)
            if len(both):
                a1, b1 = (int(np.searchsorted(x, both[-1], "right")) for x in (ends_a, ends_b))
                break
            size, a1, b1 = 2 * size, len(ends_a), len(ends_b)
        yield a0, a1, b0, b1
        a0, b0, at = a1, b1, int(ends_a[a1 - 1])


@dataclass
class Aligned:
    """Some documents: how many tokens each has, all their tokens' ids, and the overlaps of these as places among the ids."""

    doc_ids: pa.Array
    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    size: np.ndarray
    cut: np.ndarray

    def per_document(self) -> tuple[np.ndarray, np.ndarray]:
        """(overlaps, cuts) of each document."""
        at = np.searchsorted(self.over_a, np.append(0, np.cumsum(self.n_a)))
        return np.diff(at), np.diff(np.append(0, np.cumsum(self.cut))[at])


def _aligned(batches, a_file: str | None, b_file: str | None) -> Iterator[Aligned]:
    both = pair(a_file, b_file)
    for batch in batches:
        texts, at = batch.column("text").to_pylist(), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < SLICE):
                size += len(texts[stop] or "")
                stop += 1
            both.a.make_room()
            both.b.make_room()
            ids = [both.encode(t) for t in texts[at:stop]]
            n_a, n_b = (np.array([len(x[k]) // 4 for x in ids], np.int64) for k in (0, 1))
            a, b = (np.frombuffer(b"".join(x[k] for x in ids), np.uint32).astype(np.int64) for k in (0, 1))
            size_a, size_b = both.size_a[a], both.size_b[b]
            parts = []
            for a0, a1, b0, b1 in _windows(np.cumsum(size_a), np.cumsum(size_b)):
                x, y, n, cut = owned(size_a[a0:a1], size_b[b0:b1])
                parts.append((x.astype(np.int64) + a0, y.astype(np.int64) + b0, n, cut))
            over = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
            yield Aligned(batch.column("doc_id")[at:stop], n_a, n_b, a, b, *over)
            at = stop


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


ALIGNMENT = "doc_id long, a array<int>, b array<int>, overlaps array<struct<a:int,b:int,bytes:int>>, groups array<struct<a:int,b:int>>"


def alignments(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """doc_id, a, b (ids by the byte-level tokenizer and by the piece tokenizer), overlaps (places among the ids, and the bytes that both tokens own) and
    groups (how many ids of each lie before the end of a group: the shortest runs of tokens that cover the same bytes) for every row of ``docs``.

    Offsets count the bytes of a space and the text, which is what A is given; B puts the space there itself. Special strings are plain text. Null and
    empty texts, and texts that a tokenizer doesn't give back byte for byte, have empty lists. Long texts are read whole, in windows that end where tokens of both
    do. Repeated rows each get a row; other columns are ignored; an empty table gives no rows. Files that are named have to be readable on every
    executor; models whose pieces don't end with words are refused.
    """
    def run(batches):
        for x in _aligned(batches, a_file, b_file):
            overlaps, groups = x.per_document()
            first_a, first_b = np.repeat(np.cumsum(x.n_a) - x.n_a, overlaps), np.repeat(np.cumsum(x.n_b) - x.n_b, overlaps)
            at_a, at_b = ((y - first).astype(np.int32) for y, first in ((x.over_a, first_a), (x.over_b, first_b)))
            over = pa.StructArray.from_arrays([pa.array(at_a), pa.array(at_b), pa.array(x.size.astype(np.int32))], ["a", "b", "bytes"])
            ends = pa.StructArray.from_arrays([pa.array(at_a[x.cut] + 1), pa.array(at_b[x.cut] + 1)], ["a", "b"])
            a, b = (_lists(pa.array(ids.astype(np.int32)), n) for ids, n in ((x.a, x.n_a), (x.b, x.n_b)))
            yield pa.RecordBatch.from_arrays([x.doc_ids, a, b, _lists(over, overlaps), _lists(ends, groups)], ["doc_id", "a", "b", "overlaps", "groups"])

    return id_text(docs).mapInArrow(run, ALIGNMENT)


def _digests(x: Aligned, shown: list[bytes], n_ids_a: int, groups: np.ndarray) -> list[str]:
    """Of each document, the hash of its groups' ids: those of A, a bar, those of B, and a semicolon between groups."""
    group = np.cumsum(x.cut) - x.cut  # of each overlap
    of_a, of_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    of_a[x.over_a], of_b[x.over_b] = group, group
    n = int(x.cut.sum())
    before_a, before_b = (np.append(0, np.cumsum(np.bincount(of, minlength=n))) for of in (of_a, of_b))
    line = np.zeros(len(x.a) + len(x.b), np.int64)  # all tokens, group by group, A's before B's
    line[np.arange(len(x.a)) + before_b[of_a]] = 2 * x.a + np.append(of_a[1:] != of_a[:-1], [True] * (len(x.a) > 0))
    line[np.arange(len(x.b)) + before_a[of_b + 1]] = 2 * n_ids_a + 2 * x.b + np.append(of_b[1:] != of_b[:-1], [True] * (len(x.b) > 0))
    ends = np.cumsum(x.n_a + x.n_b)
    return [hashlib.sha256(b"".join(map(shown.__getitem__, line[i:j].tolist()))[:-1]).hexdigest() if j > i else "" for i, j in zip(ends - x.n_a - x.n_b, ends)]


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, links array<int>, groups_sha256 string"


def _digested(a_file: str | None, b_file: str | None):
    def run(batches):
        both = pair(a_file, b_file)
        for x in _aligned(batches, a_file, b_file):
            groups = x.per_document()[1]
            links = both.links.get_indexer(x.a[x.over_a[x.cut]] * len(both.bytes_b) + x.b[x.over_b[x.cut]])
            yield pa.RecordBatch.from_arrays(
                [x.doc_ids, pa.array(x.n_a), pa.array(x.n_b), pa.array(groups), _lists(pa.array(links.astype(np.int32)), groups), pa.array(_digests(x, both.shown, len(both.bytes_a), groups), pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"])

    return run


def link_counts(rows: DataFrame, both: Pair) -> tuple[np.ndarray, np.ndarray]:
    """(how many links of the corpus hold it linked, whether that's the most that its token of B has) for each possible link of the two
    vocabularies: as many numbers as ``Pair.links`` has, whatever the corpus."""
    got = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")).toArrow()
    counts, of_b = np.zeros(len(both.links), np.int64), both.links.to_numpy() % len(both.bytes_b)
    counts[got.column("link").to_numpy()] = got.column("n").to_numpy()
    most = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(most, of_b, counts)
    return counts, counts == most[of_b]


def alignment_digests(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of the ``alignments`` of every row of ``docs``, with its defined cases.

    A link is an occurrence of a token of A and one of B that end with the same byte: the last ones of a group. The links of the whole corpus are counted by
    their two ids; n_best counts a document's links whose ids no other token of A beats for that token of B, and count_sum adds up the counts.
    """
    rows = stash(id_text(docs).mapInArrow(_digested(a_file, b_file), DIGEST), "links")
    sent = docs.sparkSession.sparkContext.broadcast(link_counts(rows, pair(a_file, b_file)))  # a number per possible link: some bytes of both vocabularies

    def run(batches):
        counts, best = sent.value
        for x in batches:
            lists = x.column("links")
            links, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            sums = np.zeros((2, len(x)), np.int64)
            for at in range(0, len(links), WINDOW):
                some = links[at : at + WINDOW]
                here = np.clip(ends, at, at + len(some)) - at
                for total, values in zip(sums, (best, counts)):
                    total += np.diff(np.append(0, np.cumsum(values[some], dtype=np.int64))[here])
            more = [pa.array(np.diff(ends)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("n_a"), x.column("n_b"), x.column("n_groups"), *more, x.column("groups_sha256")], OUT)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in OUT[:-1]) + ", groups_sha256 string")


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"))
