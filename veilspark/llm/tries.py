"""Source divergence audit: byte tries with counters per source, merged by ranges of terms and walked in the order of UTF-8."""

from __future__ import annotations

import gc
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import stash, table

#: Documents that a term is in at least; what counts are raised by; the unit of shares; ranks reported of a group's terms.
LEAST, RAISE, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms counted before they go to the tries, leaves of a task's tries before they are written, terms of a merged block, sources compared at once.
FRESH, LEAVES, BLOCK, TILE = 1 << 20, 1 << 18, 1 << 13, 256
#: Bytes of a text that are cut into terms at once.
SLICE = 4 << 20
#: Terms are runs of letters and of bytes past ASCII; A-Z count as a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Node:
    """A run of bytes, the nodes below it by their first byte, and what is counted at its end: documents, and sources in turn with their occurrences."""

    __slots__ = ("label", "below", "docs", "counts")

    def __init__(self, label: bytes):
        self.label, self.below, self.docs, self.counts = label, None, 0, None

    def cut(self, n: int) -> "Node":
        """A new node of the first ``n`` bytes, above this one, which keeps the rest, and stays the leaf that it is."""
        above = Node(self.label[:n])
        self.label = self.label[n:]
        above.below = {self.label[0]: self}
        return above


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two runs begin with alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _alike(terms: list[bytes], width: int = 24) -> list[int]:
    """How many bytes each of some distinct sorted terms begins with that the one before begins with as well."""
    if not terms:
        return []
    table = np.array(terms, f"S{width}").view(np.uint8).reshape(len(terms), width)
    same = table[1:] == table[:-1]
    n = np.where(same.all(axis=1), -1, same.argmin(axis=1)).tolist()
    return [0, *(x if x >= 0 else _shared(a, b) for x, a, b in zip(n, terms, terms[1:]))]


def _add(counts: list, more) -> None:
    """Add (source, occurrences) pairs to a leaf's."""
    for source, n in more:
        for k in range(0, len(counts), 2):
            if counts[k] == source:
                counts[k + 1] += n
                break
        else:
            counts += (source, n)


class Trie:
    """A radix trie of terms as bytes. Its root stands for the empty term, at which sources are noted that have none."""

    def __init__(self):
        self.root, self.leaves = Node(b""), 0

    def at(self, term: bytes, path: list[tuple[bytes, Node]] | None = None) -> Node:
        """The leaf of a term, made if there is none. A ``path`` of (term, leaf) that lead to a smaller term shortens the way, and is kept up."""
        while path and not term.startswith(path[-1][0]):
            path.pop()
        node, i = (path[-1][1], len(path[-1][0])) if path else (self.root, 0)
        while i < len(term):
            if node.below is None:
                node.below = {}
            kid = node.below.get(term[i])
            if kid is None:
                kid = node.below[term[i]] = Node(term[i:])
                i = len(term)
            elif term.startswith(kid.label, i):
                i += len(kid.label)
            else:
                n = _shared(kid.label, term[i:])
                kid = node.below[term[i]] = kid.cut(n)
                i += n
            node = kid
            if path is not None:
                path.append((term[:i], node))
        if node.counts is None:
            node.counts = []
            self.leaves += 1
        return node

    @classmethod
    def of(cls, terms: list[bytes]) -> tuple["Trie", list[Node]]:
        """A trie of distinct terms in order, none of them empty, and their leaves: every term branches off the path of the one before."""
        trie, leaves = cls(), []
        path = [(0, trie.root)]
        for term, n in zip(terms, _alike(terms)):
            while path[-1][0] > n:
                node = path.pop()[1]
            end, above = path[-1]
            if end < n:
                node = above.below[term[end]] = node.cut(n - end)
                path.append((n, node))
                above = node
            leaf = Node(term[n:])
            leaf.counts = []
            if above.below is None:
                above.below = {}
            above.below[term[n]] = leaf
            path.append((len(term), leaf))
            leaves.append(leaf)
        trie.leaves = len(leaves)
        return trie, leaves

    def add(self, term: bytes, docs: int, counts, path: list | None = None) -> None:
        """Add to a term's leaf: documents, and (source, occurrences) pairs."""
        leaf = self.at(term, path)
        leaf.docs += docs
        _add(leaf.counts, counts)

    def merge(self, other: "Trie") -> None:
        """Take over all of ``other``, which is used up: branches that only it has are hung in whole, leaves of both are added up."""
        both = [(self.root, other.root)]
        while both:
            mine, new = both.pop()
            if new.counts is not None:
                if mine.counts is None:
                    mine.docs, mine.counts = new.docs, new.counts
                    self.leaves += 1
                else:
                    mine.docs += new.docs
                    _add(mine.counts, zip(new.counts[::2], new.counts[1::2]))
            for first, kid in (new.below or {}).items():
                if mine.below is None:
                    mine.below = {}
                here = mine.below.get(first)
                if here is None:
                    mine.below[first] = kid
                    self.leaves += sum(1 for _ in _walk(kid, b""))
                    continue
                n = _shared(here.label, kid.label)
                if n < len(here.label):
                    here = mine.below[first] = here.cut(n)
                both.append((here, kid.cut(n) if n < len(kid.label) else kid))

    def walk(self):
        """(term, leaf) of all terms in the order of their bytes."""
        return _walk(self.root, b"")


def _walk(node: Node, before: bytes):
    stack = [(node, before)]
    while stack:
        node, before = stack.pop()
        term = before + node.label
        if node.counts is not None:
            yield term, node
        if node.below:
            stack += [(node.below[b], term) for b in sorted(node.below, reverse=True)]


def _pieces(text: bytes):
    """The terms of a text, slice by slice; slices end between terms."""
    plain, at = text.translate(LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if len(plain) - at > SLICE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Counted:
    """A task's tries, one per language. New terms are counted by hash and poured into a trie of their own, which is merged into the language's."""

    def __init__(self):
        self.tries: dict[str, Trie] = {}
        self.sources: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.counts, self.docs = defaultdict(Counter), defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, seen = self.counts[lang, source], set()
        for words in _pieces(text):
            counts.update(words)
            seen.update(words)
        self.docs[lang].update(seen)

    def fresh(self) -> int:
        return sum(map(len, self.counts.values())) + sum(map(len, self.docs.values()))

    def pour(self) -> None:
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            trie, leaves = Trie.of(terms)
            at = dict(zip(terms, leaves))
            for term, leaf in at.items():
                leaf.docs = docs[term]
            for (lang_, source), counts in self.counts.items():
                if lang_ == lang:
                    code = self.sources.setdefault(source, len(self.sources))
                    trie.add(b"", 0, [(code, 0)])  # noted even without terms
                    for term, n in counts.items():
                        at[term].counts += (code, n)
            if lang in self.tries:
                self.tries[lang].merge(trie)
            else:
                self.tries[lang] = trie
        self.clear()

    def leaves(self) -> int:
        return sum(t.leaves for t in self.tries.values())

    def written(self):
        """Record batches of all leaves, which are forgotten."""
        for lang, trie in self.tries.items():
            yield from _leaf_batches(lang, trie, list(self.sources))
        self.tries = {}


LEAF = "lang string, term binary, docs long, sources array<string>, counts array<long>"


def _leaf_batches(lang: str, trie: Trie, names: list[str], block: bool = False):
    """Record batches of a trie's leaves; with the first term that isn't empty as their ``block``, which is empty for the empty term."""
    leaves, first = trie.walk(), None
    while some := list(itertools.islice(leaves, BLOCK)):
        terms = [t for t, _ in some]
        flat = np.array([x for _, leaf in some for x in leaf.counts], np.int64).reshape(-1, 2)
        sizes = np.fromiter((len(leaf.counts) // 2 for _, leaf in some), np.int32, len(some))
        at = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        sources = pa.array(names, pa.string()).take(pa.array(flat[:, 0]))
        cols = [pa.array([lang] * len(some), pa.string()), pa.array(terms, pa.binary()), pa.array([leaf.docs for _, leaf in some], pa.int64()), pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, pa.array(flat[:, 1]))]
        if block:
            first = first or next(filter(None, terms), None)
            cols.insert(0, pa.array([t and first for t in terms], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, ["block", "lang", "term", "docs", "sources", "counts"][not block :])


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Nodes hold no cycles, so searching millions of them for cycles is time lost."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _count(batches):
    """The leaves of the task's tries; they are written and begun anew whenever there are LEAVES of them."""
    task = Counted()
    with _no_cycles():
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                task.add(lang, source, text)
                if task.fresh() >= FRESH:
                    task.pour()
                    if task.leaves() >= LEAVES:
                        yield from task.written()
        task.pour()
        yield from task.written()


def _whole_terms(batches):
    """The rows of sorted batches, with those of a term together, and where its rows begin."""
    left = None
    for b in batches:
        b = b if left is None else pa.concat_batches([left, b])
        left = None
        if b.num_rows:
            new = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (b.column("lang"), b.column("term"))]
            starts = np.append(0, np.flatnonzero(new[0] | new[1]) + 1)
            left = b.slice(starts[-1])  # may go on
            if len(starts) > 1:
                yield b.slice(0, starts[-1]), starts[:-1]
    if left is not None:
        yield left, np.zeros(1, np.int64)


def _added(rows: pa.RecordBatch, of: np.ndarray, codes: dict[str, int]) -> tuple[np.ndarray, list[int]]:
    """The counters of ``rows`` (the leaves of the terms ``of``) added up: where each term's begin in a list of sources in turn with their occurrences."""
    lists = rows.column("sources")
    found = lists.flatten().dictionary_encode()
    source = np.array([codes.setdefault(s, len(codes)) for s in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]
    key, at = np.unique(np.repeat(of, np.diff(lists.offsets.to_numpy())) << 32 | source, return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, rows.column("counts").flatten().to_numpy())
    return 2 * np.searchsorted(key, np.arange(of[-1] + 2) << 32), np.stack([key & 0xFFFFFFFF, n], axis=1).ravel().tolist()


def _merge(least: int):
    """Tries of the terms of a range, as their leaves come in order: those in too few documents go, and blocks of BLOCK terms are merged and written."""
    def written(lang, terms, names):
        trie = Trie()
        if terms and not terms[0][0]:
            trie.add(b"", 0, zip(terms[0][2][::2], terms[0][2][1::2]))
            yield from _leaf_batches(lang, trie, names, True)
            terms = terms[1:]
        trie, leaves = Trie.of([t for t, _, _ in terms])
        for leaf, (_, docs, counts) in zip(leaves, terms):
            leaf.docs, leaf.counts = docs, counts
        yield from _leaf_batches(lang, trie, names, True)

    def run(batches):
        lang, block, codes = None, [], {}
        with _no_cycles():
            for b, starts in _whole_terms(batches):
                docs = np.add.reduceat(b.column("docs").to_numpy(), starts)
                keep = (docs >= least) | (pc.binary_length(b.column("term")).to_numpy()[starts] == 0)
                if not keep.any():
                    continue
                size = np.diff(np.append(starts, b.num_rows))
                at, counts = _added(b.filter(pa.array(np.repeat(keep, size))), np.repeat(np.arange(keep.sum()), size[keep]), codes)
                heads = b.take(pa.array(starts[keep]))
                for i, (lang_, term, n) in enumerate(zip(heads.column("lang").to_pylist(), heads.column("term").to_pylist(), docs[keep].tolist())):
                    if lang_ != lang or len(block) >= BLOCK:
                        yield from written(lang, block, list(codes))
                        lang, block = lang_, []
                    block.append((term, n, counts[at[i] : at[i + 1]]))
            yield from written(lang, block, list(codes))

    return run


def merged_tries(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """block, lang, term, docs, sources, counts: the terms in at least ``least`` documents of their language, in blocks of neighbouring terms; the
    empty term, a block of its own, has all of a language's sources.

    Every task counts into tries of its own and writes their leaves, a row per term. These are dealt by ranges of (language, term) and sorted, and the
    tries of a range merged as its leaves stream by. A term has a row per task and flush at most, however often it occurs.
    """
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    leaves = stash(rows.mapInArrow(_count, LEAF), "leaves")
    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return stash(ranged.mapInArrow(_merge(least), "block binary, " + LEAF), "terms")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * count / total), digit by digit in base 1000, so that longs hold every step exactly (totals up to 9e15)."""
    whole, rest = np.divmod(count, total)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


OUT = "lang string, source string, other string, term binary, value long"


def _compared(top: int):
    """Of a block's terms and two tiles of sources: sums of the shares' differences, and each source's first ``top`` terms over its language."""
    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        lang, tile, against = key[0].as_py(), key[2].as_py(), key[3].as_py()
        groups = groups.sort_by("source")
        names, tiles = groups.column("source").to_pylist(), groups.column("tile").to_numpy()
        terms = terms.filter(pc.not_equal(terms.column("term"), pa.scalar(b"", pa.binary()))).sort_by("term")
        place = {s: i for i, s in enumerate(names)}
        lists = terms.column("sources").combine_chunks() if len(terms) else pa.array([], pa.list_(pa.string()))
        sizes = np.diff(np.asarray(lists.offsets)) if len(terms) else np.zeros(0, np.int64)
        counts = np.zeros((len(terms), len(names)), np.int64)
        if len(terms):
            flat = terms.column("counts").combine_chunks().flatten().to_numpy()
            row, col = np.repeat(np.arange(len(terms)), sizes), np.array([place.get(s, -1) for s in lists.flatten().to_pylist()], np.int64)
            counts[row[col >= 0], col[col >= 0]] = flat[col >= 0]
            every = np.add.reduceat(flat, np.cumsum(sizes) - sizes)
            v = groups.column("v").to_numpy()[0]
            p = share(counts + RAISE, (groups.column("n").to_numpy() + RAISE * v)[None, :])
            q = share(every + RAISE, groups.column("n_lang").to_numpy()[0] + RAISE * v)
        out = []
        for i in np.flatnonzero(tiles == tile):
            others = np.flatnonzero(tiles == against)
            others = others[others > i] if tile == against else others
            sums = np.abs(p[:, others] - p[:, [i]]).sum(axis=0) if len(terms) else np.zeros(len(others), np.int64)
            out += [(lang, names[i], names[j], None, int(f)) for j, f in zip(others, sums)]
            if tile == against and len(terms):
                over = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                f = p[over, i] - q[over]
                first = np.argsort(-f, kind="stable")[:top]  # terms are in order, so ties stay in it
                out += [(lang, names[i], None, t, int(x)) for t, x in zip(terms.column("term").take(pa.array(over[first])).to_pylist(), f[first])]
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "source", "other", "term", "value"])

    return run


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms differ from those of its language's other sources, and which lead.

    Terms are runs of letters and characters past ASCII, A-Z as a-z; a language keeps those in at least ``least`` of its documents. A source gives each kept
    term the share 1 + floor(10^9 (count + 5) / (all + 5 kept)), and so does the language. Part ``pair`` has the other sources with the sum of the
    shares' differences over all kept terms (0 where none is kept), part ``term`` the source's own terms whose share passes the language's, the
    first ``top``. Ranks go by value, the highest first, then by the item's bytes.

    Null texts, languages and sources count as empty; a source without terms is one all the same; texts of any length are read whole, in slices; repeated
    rows each count; other columns, doc_id too, are ignored; an empty table gives no rows. All numbers are whole and exact.
    """
    kept = merged_tries(docs, least)
    groups = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    size = kept.groupBy("lang").agg(F.count_if(F.octet_length("term") > 0).alias("v"))
    of = Window.partitionBy("lang")
    tile = F.floor((F.row_number().over(of.orderBy("source")) - 1) / TILE).cast("long")
    groups = stash(groups.join(size, "lang").withColumns({"n_lang": F.sum("n").over(of), "tile": tile}), "groups")
    last = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    pairs = last.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("tile_a"), "last")
    pairs = pairs.select("lang", "tile_a", F.explode(F.sequence("tile_a", "last")).alias("tile_b"))
    key = ["lang", "block", "tile_a", "tile_b"]
    here = kept.select("lang", "block").distinct().join(pairs, "lang").join(groups, "lang").where("tile = tile_a or tile = tile_b")
    here = stash(here.select(*key, "source", "n", "v", "n_lang", "tile"), "tiles")
    terms = kept.join(pairs, "lang").select(*key, "term", "sources", "counts")
    found = stash(terms.groupBy(*key).cogroup(here.groupBy(*key)).applyInArrow(_compared(top), OUT), "compared")
    sums = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", F.inline(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    own = found.where("other is null").select("lang", "source", F.col("term").cast("string").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top)
    out = sums.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_divergence_audit(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with d as (select row_number() over () as row_no, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select row_no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*)::hugeint as n from t group by 1, 2 having count(distinct row_no) >= {LEAST}),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from t join (select lang, term from kept) using (lang, term) group by 1, 2, 3),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by 1),
ng as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n from g left join c using (lang, source) group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + {RAISE})) // (ng.n + {RAISE} * v.v) as p, 1 + ({UNIT}::hugeint * (k.n + {RAISE})) // (v.n + {RAISE} * v.v) as q
      from g join ng using (lang, source) join kept k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
every as (select a.lang, a.source, b.source as item, coalesce(pairs.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
own as (select lang, source, term as item, (p - q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from every
union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from own) where rank <= {TOP}
"""
