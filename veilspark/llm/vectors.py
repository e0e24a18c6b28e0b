"""Embedding near-dedup: a pigeonhole range join over blocks of rotated vectors, verified exactly."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import components, spanning_edges, stash, table

#: Least cosine, blocks, dimensions of a block that its grid has, and vectors that meet as one side at most.
COSINE, BLOCKS, GRID, CHUNK = 0.9, 4, 2, 32768
#: Sides that a table is cut into where it's small, and vectors of a side at least, so that all tasks have work.
SIDES, LEAST = 8, 4096
SLACK = 1e-4
#: The grid is used where it leaves less than this part of all pairs to compare, over all blocks.
PRUNES = 0.25
ALL = -1


def _units(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares from running over or under
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches):
    total = 0
    for b in batches:
        if b.num_rows:
            x = _units(b.column("e"))
            total = total + x.T @ x
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])


class Grid:
    """Rotation, blocks, budgets and cells. Blocks get every ``blocks``-th principal axis; budgets go by their variance."""

    def __init__(self, second: np.ndarray, cosine: float, blocks: int, grid: int):
        value, axes = np.linalg.eigh(second)
        order = np.argsort(-value)
        self.axes = axes[:, order]
        parts = [list(range(b, len(order), blocks)) for b in range(min(blocks, len(order)))]
        share = np.array([max(value[order][p].sum(), 1e-12) for p in parts])
        self.parts, self.budget = parts, (2 - 2 * cosine) * share / share.sum()
        self.grid = [p[:grid] for p in parts]
        #: cells are no narrower than the budget's radius, so that near rows are in the same or adjoining cells; nor than 1/64.
        self.width = np.maximum(np.sqrt(self.budget + SLACK), 1 / 64)

    def cells(self, x: np.ndarray, b: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each row in block ``b``, as a number (coordinates in base 256), and the adjoining ones within the radius of each row."""
        at = x @ self.axes[:, self.grid[b]] / self.width[b]
        home = np.floor(at)
        reach = np.sqrt(self.budget[b] + SLACK) / self.width[b] + 1e-9
        gap = [np.maximum(at - home, 0), np.zeros_like(at), np.maximum(home + 1 - at, 0)]  # to the cells before, of and after each coordinate
        base = 256 ** np.arange(at.shape[1])
        number, near = (home.astype(np.int64) + 128) @ base, []
        for steps in itertools.product((-1, 0, 1), repeat=at.shape[1]):
            if any(steps):
                far = sum(gap[s + 1][:, k] ** 2 for k, s in enumerate(steps))
                near.append((number + int(np.dot(steps, base)), far <= reach**2))
        return number, near


def _placed(grid: Grid):
    """Rows with their cell in each block (``home``), and the adjoining cells that may hold rows near them (``visits``)."""
    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, n = _units(t.column("e")), t.num_rows
            homes, visits, sizes = [], [], []
            for b in range(len(grid.parts)):
                number, near = grid.cells(x, b)
                cell, there = np.stack([c for c, _ in near], axis=1), np.stack([m for _, m in near], axis=1)
                homes.append(number)
                visits.append([c[m] for c, m in zip(cell, there)])
                sizes.append(there.sum(axis=1))
            k = len(homes)
            flat = np.concatenate([v for row in zip(*visits) for v in row])
            inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.stack(sizes, axis=1).ravel())), pa.int32()), pa.array(flat, pa.int64()))
            outer = pa.array(np.arange(n + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [t.column("rep"), t.column("n"), t.column("e"), pa.ListArray.from_arrays(outer, pa.array(np.stack(homes, axis=1).ravel())), pa.ListArray.from_arrays(outer, inner)], ["rep", "n", "e", "home", "visits"])

    return run


def _pairs_left(counts: list, grid: Grid) -> float:
    """Pairs that the grid leaves to compare, over all blocks, if every row visited all adjoining cells."""
    size = {(r.b, r.cell): r.n for r in counts}
    steps = {b: [int(np.dot(s, 256 ** np.arange(len(d)))) for s in itertools.product((-1, 0, 1), repeat=len(d))] for b, d in enumerate(grid.grid)}
    return sum(n * size.get((b, c + s), 0) / 2 for (b, c), n in size.items() for s in steps[b])


def _met(rows: DataFrame, counts: DataFrame | None, chunk: int, n: int) -> DataFrame:
    """Rows once for every (b, lo, hi, i, j) at which they meet others; side 0 meets side 1, and where there is but one chunk all meet all.

    Chunk i of cell lo meets chunk j of cell hi. Without ``counts`` there is one cell for all blocks.
    """
    if counts is None:
        cells = rows.select("rep", "n", "e", F.lit(ALL).alias("b"), F.lit(0).cast("long").alias("cell"))
        cells = cells.withColumns({"k": F.lit(-(-n // chunk)), "other": F.lit(0).cast("long"), "ks": F.lit(-(-n // chunk))})
    else:
        chunks = F.broadcast(counts.select(F.col("b").alias("at_b"), F.col("cell").alias("at_cell"), F.ceil(F.col("n") / chunk).cast("int").alias("k")))  # at most blocks * 129 ** dimensions
        cells = rows.select("rep", "n", "e", F.posexplode(F.arrays_zip("home", "visits")).alias("b", "x"))
        cells = cells.select("rep", "n", "e", "b", F.col("x.home").alias("cell"), F.explode(F.concat(F.array("x.home"), "x.visits")).alias("other"))
        mine = chunks.withColumnRenamed("k", "own")
        cells = cells.join(mine, (F.col("b") == F.col("at_b")) & (F.col("cell") == F.col("at_cell"))).select("rep", "n", "e", "b", "cell", "other", F.col("own").alias("k"))
        cells = cells.join(chunks.withColumnRenamed("k", "ks"), (F.col("b") == F.col("at_b")) & (F.col("other") == F.col("at_cell")))
    c, j = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"), F.col("j")
    cells = cells.withColumn("c", c).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ks") - 1)))
    same, first = F.col("cell") == F.col("other"), F.col("cell") < F.col("other")
    left = F.when(same, F.least("c", "j")).when(first, F.col("c")).otherwise(j)
    right = F.when(same, F.greatest("c", "j")).when(first, j).otherwise(F.col("c"))
    side = F.when(same, F.col("c") > j).otherwise(~first).cast("int")
    return cells.select("b", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), left.alias("i"), right.alias("j"), side.alias("side"), "rep", "n", "e")


def _compared(grid: Grid, cosine: float):
    def run(t: pa.Table) -> pa.Table:
        alone = t.column("lo")[0] == t.column("hi")[0] and t.column("i")[0] == t.column("j")[0]
        at = t.column("b")[0].as_py()
        x, rep, n, side = _units(t.column("e")), t.column("rep").to_numpy(), t.column("n").to_numpy(), t.column("side").to_numpy()
        y = x @ grid.axes
        left = np.arange(len(x)) if alone else np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        starts = np.cumsum([0, *map(len, grid.parts[:-1])])
        deal = np.concatenate(grid.parts)
        links, us, vs, held = np.zeros(len(x), np.int64), [], [], 0
        for b in range(len(grid.parts)) if at == ALL else [at]:
            own = y[:, grid.parts[b]].astype(np.float32)
            square = (own * own).sum(axis=1)
            for lo in range(0, len(left), 512):
                p = left[lo : lo + 512]
                q = right[lo:] if alone else right
                gap = own[p] @ own[q].T
                gap *= -2
                gap += square[q]
                r, c = np.nonzero(gap <= (grid.budget[b] + SLACK - square[p])[:, None])
                u, v = p[r], q[c]
                if alone:
                    u, v = u[u < v], v[u < v]
                for k in range(0, len(u), 50_000):
                    i, j = u[k : k + 50_000], v[k : k + 50_000]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    i, j = i[near], j[near]
                    # a link counts in the block that uses the least of its budget, so once among all blocks
                    part = np.add.reduceat(((y[i] - y[j]) ** 2)[:, deal], starts, axis=1) / grid.budget
                    mine = part.argmin(axis=1) == b
                    i, j = i[mine], j[mine]
                    links += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
                    us.append(i)
                    vs.append(j)
                    held += len(i)
                    if held > max(1 << 20, len(x)):  # pairs are folded into a forest as they are found
                        node, root = spanning_edges(np.concatenate(us), np.concatenate(vs), len(x))
                        us, vs, held = [node], [root], 0
        has = np.flatnonzero(links)
        node, root = spanning_edges(np.concatenate(us), np.concatenate(vs), len(x)) if us else (np.empty(0, int),) * 2
        empty = pa.nulls(len(has), pa.int64())
        return pa.table({"a": pa.array(np.concatenate([rep[has], rep[node]])), "links": pa.array(np.concatenate([links[has], np.zeros(len(node), np.int64)])), "b": pa.concat_arrays([empty, pa.array(rep[root], pa.int64())])})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid_dims: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding): all links with at least ``cosine``.

    Equal vectors form a class, compared once. Unit vectors are rotated onto the principal axes of all classes and split
    into blocks. A squared distance of 2 - 2 cosine leaves some block within its proportional part, so each block is range-joined
    within that: rows go to grid cells no narrower than the radius, and meet those of their own cell and, near a border, of adjoining ones, in chunks of
    bounded size. Where vectors spread so evenly that the grids leave most pairs, all blocks are joined over one cell instead: the
    same comparisons, of which a row then needs far fewer copies. Candidates are verified by the cosine in double precision, and a link counts in one block only. Tasks
    return counts and spanning trees, never all pairs. Vectors of different lengths don't link; each length is joined by itself.
    Vectors that are null, empty, zero, or with null or non-finite values link with nothing, nor do rows without vec_id. Repeated rows count as vectors of their own; other columns
    are ignored; an empty table gives no rows.
    """
    e = F.col("embedding")
    sound = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)") & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), e).alias("e"))
    done = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in rows.where("e is not null").select(F.size("e").alias("d")).distinct().orderBy("d").collect():  # a row per length
        done = done.unionAll(_linked(rows.where(F.size("e") == r.d), r.d, cosine, blocks, grid_dims, chunk))
    return done.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _linked(rows: DataFrame, dim: int, cosine: float, blocks: int, grid_dims: int, chunk: int) -> DataFrame:
    """vec_id, n_links, component_id for every row of ``rows`` (vec_id, e), sound vectors of ``dim`` components."""
    whole = stash(rows.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    second = whole.select("e").mapInArrow(_moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    grid = Grid(np.array([r.v for r in second]).reshape(dim, dim), cosine, blocks, grid_dims)
    kind = dict(whole.dtypes)["e"]
    placed = stash(whole.mapInArrow(_placed(grid), f"rep long, n long, e {kind}, home array<long>, visits array<array<long>>"), "placed")
    counts = placed.select(F.posexplode("home").alias("b", "cell")).groupBy("b", "cell").agg(F.count("*").alias("n"))
    sizes = counts.collect()  # at most blocks * 129 ** grid_dims cells
    total = sum(r.n for r in sizes if r.b == 0)
    side = min(chunk, max(min(chunk, LEAST), -(-total // SIDES)))
    prunes = _pairs_left(sizes, grid) < PRUNES * total * total / 2 * len(grid.parts)
    met = _met(placed, counts if prunes else None, side, total)
    found = stash(met.groupBy("b", "lo", "hi", "i", "j").applyInArrow(_compared(grid, cosine), "a long, links long, b long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("at")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b is not null").select("a", "b"))
    of = whole.join(links, F.col("rep") == F.col("at"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = of.select(F.col("e").alias("k"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of, F.col("e") == F.col("k")).select("vec_id", "n_links", "component_id")


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on p.a = r.b),
c as (select a, min(b) as component_id from r group by a), n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
