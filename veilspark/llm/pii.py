"""Personal data: base patterns, and a character-level BiLSTM-CRF trained on their spans that adds what they miss."""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.bilstm import Tagger
from veilspark.llm.common import id_text, stash, table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds. A run of digits that fails for ip fails from each of its digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")

#: Characters in a window, between windows, and kept on either side of a digit or at sign.
WINDOW, STRIDE, AROUND = 64, 32, 24
#: Windows to train on at most, epochs and updates at least, and the least mean probability of an added span's tags.
TRAIN, EPOCHS, UPDATES, SURE = 1200, 8, 600, 0.95
#: Characters of texts that are read at once, about.
SLICE = 1 << 20
#: Of so many windows of a kind one is held out to measure recall; the recall below which training warns.
HELD, POOR = 6, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str, luhns: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and not overlapping within a kind, in order; cards of any digits without ``luhns``."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", at + 1)
    if TRIGGER.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and (luhn(d) or not luhns)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _classes() -> np.ndarray:
    """Class of each code point up to 127: itself for printable ones, 1 for white space; 2 stands for all others, 0 for none."""
    c = np.full(128, 2, np.int16)
    c[[9, 10, 11, 12, 13, 32]] = 1
    c[33:127] = np.arange(3, 97)
    return c


CLASS = _classes()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, CLASS[np.minimum(codes, 127)], np.int16(2))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs: no span lies outside them."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tags_of(spans, a: int, b: int) -> np.ndarray:
    """Tags of text[a:b]: 0 outside, 2k + 1 where a span of kind k begins, 2k + 2 within."""
    t = np.zeros(b - a, np.int8)
    for s, k, e in spans:
        if s < b and e > a:
            t[max(s, a) - a : min(e, b) - a] = 2 * k + 2
            if s >= a:
                t[s - a] = 2 * k + 1
    return t


def _labelled(batches):
    """Windows of texts with their tags: of each text one with a span of each kind it has (kind 1 and up), and one with a digit or at sign but no span (0), by its hash.

    A number that only fails the card checksum is tagged like a card: characters can't tell the two apart, and decoded spans are checked.
    """
    import zlib

    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            if not text or not TRIGGER.search(text):
                continue
            spans, h = base_spans(text, False), zlib.crc32(text.encode("utf-8", "surrogatepass"))
            picks = []
            for k in sorted({k for _, k, _ in spans}):
                own = [s for s, kind, _ in spans if kind == k]
                picks.append((k + 1, own[h % len(own)]))
            free = [r for r in regions(text) if not any(s < r[1] and e > r[0] for s, _, e in spans)]
            picks += [(0, free[h % len(free)][0])] if free else []
            for kind, at in picks:
                a = max(0, at - h % 48)
                z = min(len(text), a + WINDOW)
                rows.append((h, kind, text[a:z], tags_of(spans, a, z).tobytes()))
        if rows:
            h, kind, text, tags = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind, pa.int32()), pa.array(text), pa.array(tags, pa.binary())], ["h", "kind", "w", "tags"])


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that begin within ``tags``."""
    out, at = [], 0
    while at < len(tags):
        end = at + 1
        if tags[at] % 2:
            while end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            out.append((at, (int(tags[at]) - 1) // 2, end))
        at = end
    return out


def rewritten(kind: int, value: str, r: np.random.Generator) -> str:
    """A value as people also write it, though the base patterns miss it: a spaced at sign, a number without plus or country, a card with dots."""
    if kind == 0:
        return value.replace("@", " @ ") if r.random() < 0.5 else value
    if kind == 2:
        digits, gap = _digits(value), str(r.choice(["", " ", "-", ".", "."]))
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        return re.sub(r"^\+[0-9]+[ .-]*(?=[(0-9])" if r.random() < 0.6 else r"^\+", "", value)
    return value


def altered(text: str, tags: np.ndarray, r: np.random.Generator, values: list[tuple[int, str]] = ()) -> tuple[str, np.ndarray]:
    """A window with its spans rewritten, some of them with another of ``values`` (kind, value) right behind, and other digits throughout; and its tags.

    The base patterns read on into a neighbour, and then drop both for their number of digits.
    """
    words, marks, at = [], [], 0
    for s, k, e in spans_of(tags):
        parts = [(k, rewritten(k, text[s:e], r))]
        if values and r.random() < 0.3:
            parts.append(values[r.integers(len(values))])
        words.append(text[at:s])
        marks.append(tags[at:s])
        for i, (kind, value) in enumerate(parts):
            words += [" " * (i > 0), value]
            marks += [np.zeros(int(i > 0), np.int8), np.array([2 * kind + 1] + [2 * kind + 2] * (len(value) - 1), np.int8)]
        at = e
    other = "".join(str(r.integers(10)) if "0" <= c <= "9" else c for c in "".join([*words, text[at:]]))
    return other[:WINDOW], np.concatenate([*marks, tags[at:]])[:WINDOW]


def is_valid(kind: int, value: str) -> bool:
    """Whether a decoded span has the parts and the digits of its kind."""
    digits = _digits(value)
    if kind == 0:
        local, _, host = value.partition("@")
        return bool(local.strip()) and "." in host.strip(" .") and "@" not in host
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def train(docs: DataFrame, windows: int = TRAIN, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger fitted on at most ``windows`` windows labelled by the base patterns, the lowest hashes of each kind first; None without any.

    A quarter of them have no span. The kinds share the others equally; what a kind has too few windows for goes to those that have more. Of HELD windows of a kind one
    is held out: the model's ``recall`` is the part of their spans that it finds exactly, and training warns where that is poor. Where windows are few
    there are more altered copies of each, so that there are UPDATES all the same.
    """
    got = stash(docs.select("text").mapInArrow(_labelled, "h long, kind int, w string, tags binary"), "windows")

    def lowest(kind: int, share: int) -> list:
        return got.where(F.col("kind") == kind).distinct().orderBy("h", "w", "tags").limit(share).collect() if share else []

    drawn = sorted((lowest(k + 1, windows * 3 // 4) for k in range(len(KINDS))), key=len)
    rows, left = [], windows * 3 // 4
    for k, some in enumerate(drawn):
        some = some[: left // (len(drawn) - k)]
        rows += some
        left -= len(some)
    rows += lowest(0, windows // 4)
    if not any(r.kind for r in rows):
        return None
    return fitted([(r.w, np.frombuffer(r.tags, np.int8)) for r in rows], epochs)


def copies(windows: int, epochs: int) -> int:
    """Altered copies of each window: one, or as many as make UPDATES of 32 windows each."""
    return max(1, -(-32 * UPDATES // max(1, windows * epochs)) - 1) if epochs else 1


def fitted(rows: list[tuple[str, np.ndarray]], epochs: int = EPOCHS) -> Tagger:
    """A tagger for (text, tags) windows, and altered copies of them."""
    r = np.random.default_rng(5)
    nth, drawn = [0] * (len(KINDS) + 1), ([], [])
    for text, tags in rows:
        kind = next((k + 1 for _, k, _ in spans_of(tags)), 0)
        nth[kind] += 1
        drawn[nth[kind] % HELD == 0].append((text, tags))
    rows, held = list(drawn[0]), drawn[1]
    values = [(k, text[s:e]) for text, tags in rows for s, k, e in spans_of(tags) if e < len(tags)]
    rows += [altered(text, tags, r, values) for _ in range(copies(len(rows), epochs)) for text, tags in rows]
    x, y = np.zeros((len(rows), WINDOW), np.int16), np.zeros((len(rows), WINDOW), np.int8)
    for at, (w, t) in enumerate(rows):
        x[at, : len(w)], y[at, : len(t)] = classes(w), t
    model = Tagger(97, 2 * len(KINDS) + 1)
    model.losses = model.fit(x, y, epochs)
    spans = [spans_of(tags) for _, tags in held]
    model.recall = None
    if any(spans):
        x = np.zeros((len(held), WINDOW), np.int16)
        for row, (w, _) in zip(x, held):
            row[: len(w)] = classes(w)
        paths = model.decode_all(list(model.scores(x).transpose(1, 0, 2)))
        found = [set(spans_of(path[: len(tags)])) for path, (_, tags) in zip(paths, held)]
        model.recall = sum(s in f for some, f in zip(spans, found) for s in some) / sum(map(len, spans))
        if model.recall < POOR:
            warnings.warn(f"the tagger finds {model.recall:.2f} of the spans held out: {len(drawn[0])} windows are too few to learn from, so little is added to the base spans", stacklevel=3)
    return model


def tagged_spans(model: Tagger, texts: list[str]) -> list[list]:
    """Spans that the model finds in each text by itself.

    Regions around digits and at signs are read in overlapping windows; where windows overlap their scores are averaged, the
    middle of a window weighing most, and one best path is decoded over the whole region. A span must be sure, and have the parts and digits of
    its kind.
    """
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    cut = [(k, s) for k, (_, a, b) in enumerate(where) for s in range(0, max(1, b - a - WINDOW + STRIDE), STRIDE)]
    lines = {i: classes(texts[i]) for i in {w[0] for w in where}}
    weight = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)
    total = [np.zeros((b - a, 2 * len(KINDS) + 1), np.float32) for _, a, b in where]
    seen = [np.zeros(b - a, np.float32) for _, a, b in where]
    for at in range(0, len(cut), 512):
        some = cut[at : at + 512]
        x = np.zeros((len(some), WINDOW), np.int16)
        for row, (k, s) in zip(x, some):
            i, a, b = where[k]
            part = lines[i][a + s : min(b, a + s + WINDOW)]
            row[: len(part)] = part
        scores = model.scores(x).transpose(1, 0, 2)
        for got, (k, s) in zip(scores, some):
            n = min(WINDOW, len(seen[k]) - s)
            total[k][s : s + n] += got[:n] * weight[:n, None]
            seen[k][s : s + n] += weight[:n]
    out: list[list] = [[] for _ in texts]
    total = [s / n[:, None] for s, n in zip(total, seen)]
    for (i, a, b), s, path in zip(where, total, model.decode_all(total)):
        if not path.any():
            continue
        p = model.marginals(s)[np.arange(len(s)), path]
        for at, kind, end in spans_of(path):
            if p[at:end].mean() >= SURE and is_valid(kind, texts[i][a + at : a + end]):
                out[i].append((a + at, kind, a + end))
    return out


def _slices(texts: list[str]):
    """(from, to) of runs of texts of about SLICE characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def added_spans(tagged: list[list], known: list[list]) -> list[list]:
    """Of each text's tagged spans those that touch none of its base spans."""
    return [[(s, k, e) for s, k, e in some if not any(x < e and s < y for x, _, y in base)] for some, base in zip(tagged, known)]


SCHEMA = "doc_id long, " + ", ".join(f"{c} array<struct<s:int,k:int,e:int>>" for c in ("base", "tagged", "found"))


def _found(model: Tagger | None):
    kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            tagged = [x for a, z in _slices(texts) for x in (tagged_spans(model, texts[a:z]) if model else [[]] * (z - a))]
            both = [sorted(x + y) for x, y in zip(base, added_spans(tagged, base))]
            rows = [pa.array([[dict(zip("ske", x)) for x in spans] for spans in some], kind) for some in (base, tagged, both)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *rows], ["doc_id", "base", "tagged", "found"])

    return run


def find_pii(docs: DataFrame, windows: int = TRAIN, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, base, tagged and found (arrays of start, kind number, end) for every row of ``docs``; offsets are code points, ends exclusive.

    Base spans come from the patterns and always stay; ``tagged`` are the tagger's own, of which those that touch no base span are added. Whole texts are
    read. Null and empty texts have none; repeated rows each get a row; other columns are ignored; an empty table gives no rows. Where no text has a base span
    nothing is learned and nothing added; where few have one, training warns if the tagger doesn't find those held out.
    """
    return id_text(docs).mapInArrow(_found(train(docs, windows, epochs)), SCHEMA)


def masked(docs: DataFrame, windows: int = TRAIN, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; all columns and rows stay.

    Null and empty texts stay as they are, and long ones are masked whole; repeated rows each stay; an empty table gives no rows; columns of any names
    and nulls in them are left alone.
    """
    model, names = train(docs, windows, epochs), docs.columns

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t and TRIGGER.search(t)]
            sub = [texts[i] for i in some]
            base = [base_spans(t) for t in sub]
            more = added_spans([x for a, z in _slices(sub) for x in tagged_spans(model, sub[a:z])], base) if model else [[] for _ in sub]
            for i, t, x, y in zip(some, sub, base, more):
                if not x and not y:
                    continue
                out, at = [], 0
                for s, k, e in sorted(x + y):
                    if s >= at:
                        out += [t[at:s], f"[{KINDS[k]}]"]
                    at = max(at, e)
                texts[i] = "".join([*out, t[at:]])
            at = names.index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(spans: str):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.array_join(F.expr(f"transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e))"), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("found").alias("spans"), digest("tagged").alias("tagged"))
