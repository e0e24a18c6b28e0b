"""Token counts: a tokenizer compiled to a finite-state transducer whose transitions carry counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import id_text, table

LIMIT = 4096
#: Characters in a chunk, about; a chunk ends at the first word end after so many, or where it must. Characters read before a chunk that
#: begins elsewhere, to guess its state; rounds in which maps are completed for every state before only states of the texts at hand count.
CHUNK, WARM, ROUNDS = 512, 48, 40
#: Characters handled at once; states compiled before all start anew, and pairs of pieces remembered.
SLICE, STATES, PAIRS = 4 << 20, 1 << 20, 1 << 19
SPACE = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Transitions by state and character, in arrays that are searched for many of them at once."""

    def __init__(self, size: int = 1 << 16):
        self.size, self.n = size, 0
        self.keys, self.to, self.emits = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where ``keys`` are, or where a search for them ends."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self.size - 1)
        got = self.keys[at]
        on = np.flatnonzero((got != keys) & (got >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (self.size - 1)
            got = self.keys[at[on]]
            on = on[(got != keys[on]) & (got >= 0)]
        return at

    def add(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """Distinct new keys; those that end at one place take turns."""
        while 2 * (self.n + len(keys)) > self.size:
            old, new = self, Table(2 * self.size)
            some = old.keys >= 0
            new.add(old.keys[some], old.to[some], old.emits[some])
            self.__dict__ = new.__dict__
        self.n += len(keys)
        while len(keys):
            at = self.slots(keys)
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            self.keys[at[first]], self.to[at[first]], self.emits[at[first]] = keys[first], to[first], emits[first]
            keys, to, emits = keys[~first], to[~first], emits[~first]


class Transducer:
    """A merge-ranked piece vocabulary as a deterministic transducer, compiled as far as texts ask for.

    For any text, the last piece of its encoding is the one piece that ends it, follows a prefix whose own last piece it
    may follow (the two together encode as the two), and so on. Hence a state is the longest end of what was read
    that pieces may still grow from, with the last piece and the relative count at each start of growth. Reading a character
    moves to the next state and emits by how much the count of the prefix changes. No piece holds a space after another
    character, so the state after such a character followed by a space is that after a space at the start; characters
    outside the vocabulary emit their bytes and go to the start state. Models for which that doesn't hold are refused.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        with open(model_file, "rb") as f:
            check_model(f.read())
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        turn = {s: k for k, s in enumerate(sorted({self.score[p] for p in self.score if len(p) > 1}, reverse=True), 1)}
        self.rank = {p: turn[s] if len(p) > 1 else 0 for p, s in self.score.items()}
        self.grows = {p[:k] for p in self.score for k in range(1, len(p))}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.class_of = np.full(0x110000, -1, np.int32)
        self.chars: list[str] = []
        start = ("", ((0, "", 0),))
        self.number, self.states, self.shared, self.table = {start: 0}, [start], {}, Table()
        self.known: dict[tuple[str, str], bool] = {}  # the pairs of pieces tried so far

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that are merged last into ``piece``; None if merging its characters doesn't end in it."""
        if piece not in self.parts:
            parts, last = list(piece), None
            while len(parts) > 1:
                ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
                if not ranked:
                    break
                i = min(ranked)[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.parts[piece] = last if len(parts) == 1 and last else (piece, "") if len(piece) == 1 else None
        return self.parts[piece]

    def may_follow(self, piece: str, before: str) -> bool:
        """Whether ``before`` and ``piece`` together encode as the two: undoing their merges, the latest first, no merge across
        the border between them comes before the one just undone. Merges of one rank are made from the left."""
        key = (before, piece)
        if key not in self.known:
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[key] = self._may_follow(piece, before)
        return self.known[key]

    def _may_follow(self, piece: str, before: str) -> bool:
        if not self.halves(piece):
            return False
        rank, limit = self.rank, 1 << 60
        while before:
            if rank.get(before + piece, limit) < limit:
                return False
            a, b = rank[before], rank[piece]
            if a == b == 0:
                return True
            if a > b:
                limit, before = a, self.halves(before)[1]
            else:
                limit, piece = b + 1, self.halves(piece)[0]
        return True

    def classes(self, codes: np.ndarray) -> np.ndarray:
        got = self.class_of[codes]
        if got.min(initial=0) < 0:
            for code in np.unique(codes[got < 0]).tolist():
                self.class_of[code] = len(self.chars)
                self.chars.append(SPACE if code == 32 else chr(code))
            got = self.class_of[codes]
        return got

    def compile(self, state: int, cls: int) -> tuple[int, int]:
        """The transition from ``state`` on a character of class ``cls``: state and count."""
        share = self.shared.setdefault
        end, starts = self.states[state]
        c = self.chars[cls]
        if c not in self.score:
            to, count = ("", ((0, "", 0),)), len(c.encode("utf-8", "surrogatepass"))
        else:
            read = end + c
            for size, before, count in starts:
                piece = read[len(read) - 1 - size :]
                if piece in self.score and self.may_follow(piece, before):
                    break
            count += 1
            kept = [(size + 1, before, n - count) for size, before, n in starts if read[len(read) - 1 - size :] in self.grows]
            kept.append((0, piece, 0))
            end = read[len(read) - kept[0][0] :] if kept[0][0] else ""
            to = (share(end, end), tuple(share(x, x) for x in kept))
        n = self.number.setdefault(to, len(self.states))
        if n == len(self.states):
            self.states.append(to)
        return n, count

    def run(self, cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, last state) of stretches of ``cls``, each read from its state of ``begin``; all step together."""
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], sizes[order]
        state, total = begin[order].astype(np.int64), np.zeros(len(at), np.int64)
        alive = len(at) - np.cumsum(np.bincount(left)) if len(at) else []
        for k, live in enumerate(alive[:-1].tolist() if len(at) else ()):
            key = state[:live] << 21 | cls[at[:live] + k]
            slot = self.table.slots(key)
            miss = self.table.keys[slot] < 0
            if miss.any():
                new = np.unique(key[miss])
                made = [self.compile(x >> 21, x & 0x1FFFFF) for x in new.tolist()]
                self.table.add(new, *(np.array(c) for c in zip(*made)))
                slot = self.table.slots(key)
            total[:live] += self.table.emits[slot]
            state[:live] = self.table.to[slot]
        out, last = np.empty_like(total), np.empty_like(state)
        out[order], last[order] = total, state
        return out, last

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text.

        Texts are cut into chunks. A chunk that begins at a text's start or at a word end has a constant map of states: it starts from the start
        state whatever came before. Another is read from the state that a few characters before it lead to, and from every state that the maps
        of the chunk before it end in, until none is missing. Maps are then composed by a parallel prefix scan, from which follows what each
        chunk started from, so what it emitted.
        """
        if len(self.states) > STATES:
            self.reset()
        # the library puts one space before a text; a space after a character can only begin a piece
        whole = "".join(" " + t for t in texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes == ord(SPACE), np.uint32(32), codes)
        size = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(size) - size
        cls, space = self.classes(codes), codes == 32
        ends = np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, 1 << 60)
        most = np.arange(CHUNK, len(codes), CHUNK)
        word = ends[np.searchsorted(ends, most)]
        near = word < most + CHUNK // 2
        sure = np.concatenate([first, word[near]])
        cuts = np.unique(np.concatenate([sure, most[~near]]))
        constant = np.isin(cuts, sure)
        sizes = np.diff(np.append(cuts, len(codes)))
        return np.add.reduceat(self.emitted(cls, cuts, sizes, constant, first), np.searchsorted(cuts, first))

    def emitted(self, cls: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, constant: np.ndarray, first: np.ndarray) -> np.ndarray:
        n, free = len(cuts), np.flatnonzero(~constant)
        fixed = np.append(np.flatnonzero(constant), n)
        stop = fixed[np.searchsorted(fixed, np.arange(n))]  # the first chunk from each on whose map is constant
        begin = np.zeros(n, np.int64)
        warm = np.maximum(cuts[free] - WARM, first[np.searchsorted(first, cuts[free], "right") - 1])
        begin[free] = self.run(cls, warm, cuts[free] - warm, np.zeros(len(free), np.int64))[1]
        lanes, entries, rounds = np.arange(n) << 32 | begin, [], 0  # a lane is a chunk and a state that it is read from
        while len(lanes):
            chunk, state = lanes >> 32, lanes & 0xFFFFFFFF
            total, last = self.run(cls, cuts[chunk], sizes[chunk], state)
            entries.append((lanes, total, last))
            have, rounds = np.concatenate([x[0] for x in entries]), rounds + 1
            if rounds < ROUNDS:
                follow = chunk + 1
                some = (follow < n) & ~constant[np.minimum(follow, n - 1)]
                need = follow[some] << 32 | last[some]
            else:
                need = self.scanned(entries, constant)[1]
            # a state that chunk after chunk passes on would take a round for each: so it goes to ever more of those that follow
            chunk, state = np.unique(need) >> 32, np.unique(need) & 0xFFFFFFFF
            far = np.minimum(stop[chunk] - chunk, max(1, min(1 << max(0, rounds - 3), 4 * n // max(1, len(chunk)))))
            ahead = np.arange(far.sum()) - np.repeat(np.cumsum(far) - far, far)
            lanes = np.unique(np.repeat(chunk, far) + ahead << 32 | np.repeat(state, far))
            lanes = lanes[~np.isin(lanes, have)]
        return self.scanned(entries, constant)[0]

    @staticmethod
    def scanned(entries: list, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each chunk emits, lanes that the texts' own states need and the maps lack), by a prefix scan over the chunks' maps."""
        lane, total, last = (np.concatenate(x) for x in zip(*entries))
        order = np.argsort(lane)
        lane, total, last = lane[order], total[order], last[order]
        n, chunk = len(constant), lane >> 32
        place = np.arange(len(lane)) - np.searchsorted(chunk, np.arange(n))[chunk]
        width = int(place.max()) + 1
        # maps from places in a chunk's list of states to places in the next one's; the last place stands for states that the list lacks
        need = (chunk + 1) << 32 | last
        at = np.searchsorted(lane, need).clip(max=len(lane) - 1)
        to = np.where(lane[at] == need, place[at], width)
        to[constant[np.minimum(chunk + 1, n - 1)]] = 0
        step = np.full((n, width + 1), width)
        step[chunk, place] = to
        step[np.append(constant[1:], True)] = 0
        upto, d = step.copy(), 1
        while d < n:
            upto[d:] = np.take_along_axis(upto[d:], upto[:-d], axis=1)
            d *= 2
        at = np.append(0, upto[:-1, 0])  # each chunk's place, from the first chunk's only one
        counts, ended = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
        counts[chunk, place], ended[chunk, place] = total, last
        lost = np.flatnonzero((at[1:] == width) & (at[:-1] < width)) + 1
        return counts[np.arange(n), at], lost << 32 | ended[lost - 1, at[lost - 1]]


def check_model(model: bytes) -> None:
    """Refuse models whose encoding isn't what the transducer computes: merges by rank over texts as they are, in which no piece but one of spaces
    holds a space after its start, with bytes for characters that no piece has."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    normal, kind = m.normalizer_spec, type(m).SentencePiece
    fits = (
        m.trainer_spec.model_type == m.trainer_spec.BPE and m.trainer_spec.byte_fallback and not m.trainer_spec.treat_whitespace_as_suffix
        and not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        and not any(p.type == kind.USER_DEFINED or (p.type == kind.NORMAL and SPACE in p.piece.lstrip(SPACE)) for p in m.pieces))
    if not fits:
        raise ValueError("token counts need a merge-ranked piece model with byte fallback, no normalizer, and no spaces within pieces")


_compiled: dict[str, Transducer] = {}


def count_tokens(texts: list[str | None], model_file: str) -> np.ndarray:
    """Tokens of each text (null: empty), none added; the compiled transducer stays with the worker."""
    machine = _compiled.get(model_file) or _compiled.setdefault(model_file, Transducer(model_file))
    out, some, size = np.zeros(len(texts), np.int64), [], 0
    for i, t in enumerate(texts):
        if t:
            some.append(i)
            size += len(t)
        if some and (size >= SLICE or i == len(texts) - 1):
            out[some] = machine.count([texts[j] for j in some])
            some, size = [], 0
    return out


def token_counts(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, as the piece model at ``model_file`` counts.

    Null and empty texts have 0 bytes and 0 tokens. Long texts are read in chunks side by side. A given model file has to be readable on every
    executor. Repeated rows each get a row; other
    columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        path = model_file or model_path()  # where this worker has it
        for b in batches:
            texts = b.column("text").to_pylist()
            n = count_tokens(texts, path)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
