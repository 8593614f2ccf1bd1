"""Problem 4: the k most similar vectors of every vector, by NN-descent.

Anchors fitted to a bounded sample part the vectors into cells; a cell over its
limit is parted further by hash.  The graph starts at random: every vector gets
some members of its own cell, compared with nothing.  Rounds of joins improve
it: the lists, with a bounded sample of reverse neighbours, are joined with the
lists of their members, and what that reaches is compared; only paths with a
new edge count.  After the first rounds every vector also searches the graph of
its second cell greedily, which gives the lists their first edges between
cells; the rounds then go on across cells until few edges change.

Rounds compare eight-bit codes of the vectors, a quarter of their size.  A code
or a list goes once to each cell that needs it, so a task holds its cell and
what two edges reach from it.  The best of every list are compared exactly, in
double precision rounded to 6 decimals, ties to the smaller id.

A graph can miss a neighbour, so the lists are then made complete: about the k-th
similarity of a list is what its neighbours must reach.  Cells are cut
into small balls; what a vector can have in common with the members of a ball is
bounded from both centers, and only balls that can hold a neighbour are compared
member by member.  Every vector meets every ball, so this part grows with the
square of the table, divided by the size of a ball.  No neighbour is lost.

New vectors search the finished graph greedily, from members of their cells, and
their lists are as good as the walk.

Defined results: vectors that are null, of another length, not finite or all
zero, and ids that are null or not among the ids asked for, have no rows;
repeated rows count once; of copies of one vector only the k + 1 smallest ids
can be neighbours, the others share the list of the last of these; with fewer
than k other vectors the lists are shorter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import Cut, read

SAMPLE = 8192  #: vectors the anchors are fitted to
ANCHORS = 8192  #: most anchors
CELL, PART = 600, 1500  #: vectors a cell is meant to have, and may have before it is parted by hash
START, SEEDS = 12, 64  #: random neighbours at first, and nodes a walk begins at
KEEP, REVERSE = 12, 8  #: neighbours in a list, and the most reverse neighbours joined with it
EXACT = 10  #: neighbours of a list that are compared exactly
ROUNDS, VISIT = 6, 2  #: most rounds, and after how many the second cells are searched
ENOUGH = 0.005  #: the rounds end when fewer of the edges are new
BITS = 1 << 27  #: most bits of the filter of needed ids
BALL, CHUNK = 10, 8192  #: vectors a ball is meant to have, and the most that are held against as many
PAIRS = 1 << 18  #: pairs found before they are compared exactly
GUESS = 0.002  #: what similarities by codes may be over the exact ones; where more, a search is repeated without
ERROR = 1e-4  #: more than the error of bounds and similarities in single precision
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the valid vectors and which rows those are."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    at = col.offsets.to_numpy()
    ok = (np.diff(at) == dim) & col.is_valid().to_numpy(zero_copy_only=False)
    flat = col.values.to_numpy(zero_copy_only=False)
    rows = np.nonzero(ok)[0]
    x = np.stack([flat[at[i] : at[i] + dim] for i in rows]) if len(rows) and not ok.all() else flat[at[0] : at[0] + len(rows) * dim].reshape(-1, dim)
    x = x.astype(np.float64)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good]
    return x / np.linalg.norm(x, axis=1, keepdims=True), rows[good]


def _fit(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(6):
        a = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        n = np.linalg.norm(s, axis=1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _two(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second anchor of every row."""
    first, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ c.T
        i = np.arange(len(s))
        b = s.argmax(1)
        first[a : a + 4096] = b
        s[i, b] = -np.inf
        second[a : a + 4096] = s.argmax(1) if s.shape[1] > 1 else b
    return first, second


def _salt(ids: np.ndarray, parts: np.ndarray, table: int = 0) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(table * 7919)) * _MIX
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


class Leaves:
    """Anchors, and the number of hash parts of cells that anchors cannot part."""

    def __init__(self, anchors: np.ndarray, parts: np.ndarray):
        self.anchors, self.parts = anchors.astype(np.float32), parts
        self.start = np.concatenate([[0], np.cumsum(parts)[:-1]])

    def __call__(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every row and the cell it visits, as numbers of hash parts."""
        a, b = _two(x.astype(np.float32), self.anchors)
        return self.start[a] + _salt(ids, self.parts[a]), self.start[b] + _salt(ids, self.parts[b])

    def again(self, home: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The parts of the same cells under another hash, so that random edges lead from part to part."""
        a = np.searchsorted(self.start, home, side="right") - 1
        return self.start[a] + _salt(ids, self.parts[a], 1)


def _code(x: np.ndarray) -> np.ndarray:
    """Eight-bit codes of unit rows, each scaled by its largest value."""
    return np.round(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)


def _binary(rows: np.ndarray) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _place(vectors: DataFrame, leaves: Leaves, dim: int, code: bool = True) -> DataFrame:
    """(id, home, visit, code) of the valid vectors; without ``code`` the vector itself."""
    shared = vectors.sparkSession.sparkContext.broadcast(leaves)  # at most ANCHORS x dim floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x, rows = _matrix(rb.column("vec"), dim)
            if not len(rows):
                continue
            ids = rb.column("id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            a, b = shared.value(x, ids)
            last = _binary(_code(x)) if code else rb.column("vec").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), last], names=["id", "home", "visit", "x"])

    return vectors.mapInArrow(run, "id long, home int, visit int, x " + ("binary" if code else "array<float>"))


def plant(vectors: DataFrame, dim: int) -> Leaves:
    """Anchors for all vectors: fitted to a sample, with more where cells come out too large."""
    n = vectors.count()
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    got = vectors.where(part).limit(2 * SAMPLE).toArrow()
    x = _matrix(got.column("vec"), dim)[0] if got.num_rows else np.zeros((0, dim))
    if not len(x):
        return Leaves(np.zeros((1, dim)), np.ones(1, np.int64))
    anchors = _fit(x, max(1, min(ANCHORS // 2, len(x) // 8, -(-n // CELL))))
    sizes = np.zeros(0)
    for level in range(3):
        by = _place(vectors, Leaves(anchors, np.ones(len(anchors), np.int64)), dim).groupBy("home").count()
        sizes = np.zeros(len(anchors))
        for r in by.collect():  # at most one row an anchor
            sizes[r["home"]] = r["count"]
        large = np.nonzero(sizes > PART)[0]
        if not len(large) or len(anchors) >= ANCHORS or level == 2:
            break
        a, new = _two(x, anchors)[0], [anchors[np.setdiff1d(np.arange(len(anchors)), large)]]
        for j in large:
            own = x[a == j]
            new.append(_fit(own, max(1, min(len(own) // 4, int(sizes[j] // CELL) + 1))) if len(own) > 8 else anchors[[j]])
        anchors = np.concatenate(new)[:ANCHORS]
    return Leaves(anchors, np.maximum(1, -(-sizes // PART)).astype(np.int64))


# ---- what a cell's task does ----------------------------------------------

#: A cell's rows: lists to improve (``own``, null if none; an empty one starts at random), lists to follow (``adj``), codes.
_ROW = "cell int, id long, home int, own array<long>, new array<boolean>, adj array<long>, adj_home array<int>, adj_new array<boolean>, x binary"
_LIST = "v long, home int, n array<long>, nh array<int>, s array<float>, f array<boolean>"


def _flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    a = col.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) and a.num_chunks else a
    at = a.offsets.to_numpy()
    return np.diff(at), a.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


class Cell:
    """The codes and lists that met in one task."""

    def __init__(self, t: pa.Table, dim: int):
        code = t.filter(t.column("x").is_valid())
        ids, first = np.unique(code.column("id").to_numpy().astype(np.int64), return_index=True)
        raw = b"".join(code.column("x").take(pa.array(first)).to_pylist())
        self.ids, m = ids, np.frombuffer(raw, np.int8).reshape(-1, dim).astype(np.float32)
        self.m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        adj = t.filter(t.column("adj").is_valid())
        owner, first = np.unique(adj.column("id").to_numpy().astype(np.int64), return_index=True)
        adj = adj.take(pa.array(first))
        self.owner, self.owner_home = owner, adj.column("home").to_numpy()
        self.n, to = _flat(adj.column("adj"))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.to, self.new = self.where(to), _flat(adj.column("adj_new"))[1].astype(bool)
        known, first = np.unique(np.concatenate([owner, to]), return_index=True)
        home = np.concatenate([self.owner_home, _flat(adj.column("adj_home"))[1]])[first]
        self.home = np.zeros(len(ids), np.int32)
        hit = self.where(known)
        self.home[hit[hit >= 0]] = home[hit >= 0]

    def where(self, ids: np.ndarray) -> np.ndarray:
        """Positions among the codes; -1 where there is none."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        p = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[p] == ids, p, -1)

    def follow(self, row: np.ndarray, pos: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of the members of the lists of ``pos``, on paths with a new edge."""
        if not len(self.owner) or not len(pos):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = np.minimum(np.searchsorted(self.owner, self.ids[pos]), len(self.owner) - 1)
        ok = self.owner[q] == self.ids[pos]
        row, q, new = row[ok], q[ok], new[ok]
        n = self.n[q]
        j = np.repeat(self.at[q] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        keep = (np.repeat(new, n) | self.new[j]) & (self.to[j] >= 0)
        return np.repeat(row, n)[keep], self.to[j][keep]

    def best(self, v: np.ndarray, row: np.ndarray, pos: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` best of each row's candidates, as positions (-1: none) and similarities; ties of 4 decimals to the smaller id."""
        met, at = np.unique(pos, return_inverse=True)
        if not len(met):
            return np.full((len(v), 0), -1), np.zeros((len(v), 0))
        allowed = np.zeros((len(v), len(met)), bool)
        allowed[row, at] = True
        allowed &= met[None, :] != v[:, None]
        s = np.round((self.m[v] @ self.m[met].T).astype(np.float64) * 1e4)
        order = np.where(allowed, s * (1 << 24) - np.arange(len(met)), -1e18)
        k = min(keep, len(met))
        top = np.argpartition(-order, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(order, top, 1), axis=1), 1)
        good = np.take_along_axis(allowed, top, 1)
        return np.where(good, met[top], -1), np.take_along_axis(s, top, 1) / 1e4


def _improve(dim: int, keep: int, walk: int) -> Callable[[pa.Table], pa.Table]:
    """A cell's lists after one round; rows that start at random walk ``walk`` steps here, where all the lists of their cell are."""

    def run(t: pa.Table) -> pa.Table:
        c = Cell(t, dim)
        own = t.filter(t.column("own").is_valid())
        ids = own.column("id").to_numpy().astype(np.int64)
        v, homes = c.where(ids), own.column("home").to_numpy()
        size, flat = _flat(own.column("own"))
        new = _flat(own.column("new"))[1].astype(bool)
        at = np.concatenate([[0], np.cumsum(size)])
        cell = t.column("cell")[0].as_py()
        here = c.where(c.owner[c.owner_home == cell])
        here = here[here >= 0]
        rng = np.random.default_rng(cell)
        out: dict[str, list] = {x: [] for x in ("v", "home", "n", "nh", "s", "f")}
        todo = np.nonzero(v >= 0)[0]
        for b in range(0, len(todo), 128):
            rows = todo[b : b + 128]
            who = np.repeat(np.arange(len(rows)), size[rows])
            held = c.where(np.concatenate([flat[at[r] : at[r + 1]] for r in rows]) if len(rows) else np.zeros(0, np.int64))
            fresh = np.concatenate([new[at[r] : at[r + 1]] for r in rows])
            who, fresh, held = who[held >= 0], fresh[held >= 0], held[held >= 0]
            before = np.zeros((len(rows), len(c.ids)), bool)
            before[who, held] = True
            lost = np.nonzero(size[rows] == 0)[0]
            if walk and len(lost) and len(here):
                top, _ = c.best(v[rows], np.repeat(lost, SEEDS), rng.choice(here, len(lost) * SEEDS), keep)
                i, j = np.nonzero(top >= 0)
                who, held, fresh = np.concatenate([who, i]), np.concatenate([held, top[i, j]]), np.concatenate([fresh, np.ones(len(i), bool)])
            for _ in range(max(1, walk)):
                r, p = c.follow(who, held, fresh)
                top, sim = c.best(v[rows], np.concatenate([who, r]), np.concatenate([held, p]), keep)
                was = np.zeros((len(rows), len(c.ids)), bool)
                was[who, held] = True
                who, j = np.nonzero(top >= 0)
                held = top[who, j]
                fresh = ~was[who, held]
                if not fresh.any():
                    break
            for i, r in enumerate(rows):
                g = top[i][top[i] >= 0]
                out["v"].append(ids[r])
                out["home"].append(homes[r])
                out["n"].append(c.ids[g])
                out["nh"].append(c.home[g])
                out["s"].append(sim[i][top[i] >= 0].astype(np.float32))
                out["f"].append(~before[i, g])
        kinds = {"v": pa.int64(), "home": pa.int32(), "n": pa.list_(pa.int64()), "nh": pa.list_(pa.int32()), "s": pa.list_(pa.float32()), "f": pa.list_(pa.bool_())}
        return pa.table({k: pa.array(x, kinds[k]) for k, x in out.items()})

    return run


# ---- rounds ---------------------------------------------------------------


def _null(kind: str, name: str):
    return F.lit(None).cast(kind).alias(name)


def _own(df: DataFrame, cell: str, n, f) -> DataFrame:
    """Rows of lists to improve."""
    return df.select(F.col(cell).alias("cell"), F.col("v").alias("id"), "home", n.cast("array<long>").alias("own"), f.cast("array<boolean>").alias("new"), _null("array<long>", "adj"), _null("array<int>", "adj_home"), _null("array<boolean>", "adj_new"), _null("binary", "x"))


def _adj(df: DataFrame, cell: str) -> DataFrame:
    """Rows of lists to follow."""
    return df.select(F.col(cell).alias("cell"), F.col("v").alias("id"), "home", _null("array<long>", "own"), _null("array<boolean>", "new"), "adj", "adj_home", "adj_new", _null("binary", "x"))


def _codes(df: DataFrame, cell: str) -> DataFrame:
    return df.select(F.col(cell).alias("cell"), "id", "home", _null("array<long>", "own"), _null("array<boolean>", "new"), _null("array<long>", "adj"), _null("array<int>", "adj_home"), _null("array<boolean>", "adj_new"), "x")


def _start(spots: DataFrame, leaves: Leaves) -> DataFrame:
    """Lists of random members of the own cell; where a cell has parts, half of them from its parts under another hash."""
    shared = spots.sparkSession.sparkContext.broadcast(leaves)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf.assign(g=pdf["home"], t=0)
            other = pdf.assign(g=shared.value.again(pdf["home"].to_numpy(), pdf["id"].to_numpy()), t=1)
            yield pd.concat([own, other])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        rng = np.random.default_rng(int(pdf["g"].iloc[0]) * 2 + int(pdf["t"].iloc[0]))
        j = rng.integers(0, max(n - 1, 1), (n, START // 2 if n > 1 else 0))
        j += j >= np.arange(n)[:, None]
        ids, home = pdf["id"].to_numpy(), pdf["home"].to_numpy()
        return pd.DataFrame({"v": ids, "home": home, "n": list(ids[j]), "nh": list(home[j])})

    x = spots.select("id", "home").mapInPandas(tables, "id long, home int, g int, t int").groupBy("g", "t").applyInPandas(pick, "v long, home int, n array<long>, nh array<int>")
    x = x.groupBy("v", "home").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("n", "nh")))).alias("e"))  # two rows a vector
    return x.select("v", "home", "e.n", "e.nh", F.transform("e", lambda z: F.lit(-2.0).cast("float")).alias("s"), F.transform("e", lambda z: F.lit(True)).alias("f"))


def _links(lists: DataFrame) -> DataFrame:
    """(v, home, adj, adj_home, adj_new): every list with at most REVERSE of the vectors that name its owner."""
    e = lists.select("v", "home", F.explode(F.arrays_zip("n", "nh", "f")).alias("e")).select(F.col("e.n").alias("u"), F.col("v").alias("m"), F.col("home").alias("mh"), F.col("e.f").alias("mf"))
    w = Window.partitionBy("u").orderBy(F.xxhash64("u", "m"), "m")  # a hub's row limit is kept before the shuffle
    back = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= REVERSE).groupBy("u").agg(F.collect_list(F.struct("m", "mh", "mf")).alias("b"))
    both = F.concat(F.transform(F.arrays_zip("n", "nh", "f"), lambda z: F.struct(z["n"].alias("m"), z["nh"].alias("mh"), z["f"].alias("mf"))), F.coalesce("b", F.array()))
    x = lists.join(back, F.col("v") == F.col("u"), "left").select("v", "home", both.alias("b"))
    return x.select("v", "home", F.col("b.m").alias("adj"), F.col("b.mh").alias("adj_home"), F.col("b.mf").alias("adj_new"))


def _round(lists: DataFrame, links: DataFrame, codes: DataFrame, own_codes: DataFrame, dim: int, keep: int = KEEP) -> DataFrame:
    """Lists joined with the lists of their members; codes and lists from other cells go once to each cell that needs them."""
    here = lists.select("home", F.explode(F.arrays_zip("n", "nh", "f")).alias("e")).select("home", "e.*")
    back = links.select("home", F.explode(F.arrays_zip("adj", "adj_home", "adj_new")).alias("e")).select("home", F.col("e.adj").alias("n"), F.col("e.adj_home").alias("nh"), F.col("e.adj_new").alias("f"))
    near = Cut(here.unionByName(back).where("nh <> home").groupBy("home", "n").agg(F.max("f").alias("f")), "near")
    rows = [_own(lists, "home", F.col("n"), F.col("f")), _adj(links, "home"), _codes(own_codes, "home")]
    drops = [near]
    if near.df.limit(1).count():
        far = near.df.withColumnRenamed("home", "cell").join(links, F.col("n") == F.col("v"))
        two = far.select("cell", "f", F.explode(F.arrays_zip("adj", "adj_home", "adj_new")).alias("e")).where("e.adj_home <> cell and (f or e.adj_new)").select("cell", F.col("e.adj").alias("id"))
        need = near.df.select(F.col("home").alias("cell"), F.col("n").alias("id")).unionByName(two).distinct()
        rows += [_adj(far, "cell"), _codes(need.join(codes, "id"), "cell")]
    x = rows[0]
    for y in rows[1:]:
        x = x.unionByName(y)
    out = Cut(x.groupBy("cell").applyInArrow(_improve(dim, keep, 0), _LIST), "lists")
    for y in drops:
        y.drop()
    return out


def _visits(who: DataFrame, links: DataFrame, codes: DataFrame, own_codes: DataFrame, dim: int, keep: int = KEEP) -> DataFrame:
    """(v, home, n, nh, s, f) found by a greedy walk of (v, home, visit) in the graph of the cell visited."""
    x = _own(who, "visit", F.array(), F.array()).unionByName(_adj(links, "home")).unionByName(_codes(codes, "home")).unionByName(_codes(own_codes, "visit"))
    return x.groupBy("cell").applyInArrow(_improve(dim, keep, 4), _LIST)


def _merge(lists: DataFrame, found: DataFrame, keep: int = KEEP) -> DataFrame:
    """Lists with what was found besides, the ``keep`` best."""
    e = F.transform(F.arrays_zip("n", "nh", "s", "f"), lambda z: F.struct((-z["s"]).alias("d"), z["n"].alias("n"), z["nh"].alias("nh"), z["f"].alias("f")))
    have = F.transform(F.col("n"), lambda z: z)
    more = found.select("v", e.alias("y"))
    x = lists.withColumn("x", e).withColumn("have", have).join(more, "v", "left")
    add = F.filter(F.coalesce("y", F.array()), lambda z: ~F.array_contains("have", z["n"]))
    x = x.select("v", "home", F.slice(F.array_sort(F.concat("x", add)), 1, keep).alias("x"))
    return x.select("v", "home", "x.n", "x.nh", F.transform("x.d", lambda d: -d).alias("s"), "x.f")


def _needed(ids: DataFrame) -> np.ndarray:
    """A filter of ids, in words of 64 bits: sized by their number up to BITS, put together by all tasks."""
    bits = min(BITS, max(1 << 16, 1 << (8 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, int(pmod(pmod(xxhash64(id), {bits}), 64)))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return out


def _exact(vectors: DataFrame, lists: DataFrame, leaves: Leaves, dim: int, own: DataFrame | None = None) -> DataFrame:
    """(v, n, s) lists with exact cosines, best first; ``own`` has the vectors of lists that are not of ``vectors``."""
    x = lists.select("v", "home", F.slice("n", 1, EXACT).alias("n"), F.slice("nh", 1, EXACT).alias("nh"))
    need = x.select("home", F.explode(F.arrays_zip("n", "nh")).alias("e")).where("e.nh <> home" if own is None else "true").select(F.col("home").alias("cell"), F.col("e.n").alias("id")).distinct()
    need = Cut(need, "need")
    placed = _place(vectors, leaves, dim, code=False).select("id", F.col("home").alias("cell"), F.col("x").alias("vec"))
    if own is not None:
        placed = _place(own, leaves, dim, code=False).select("id", F.col("home").alias("cell"), F.col("x").alias("vec"))
    words = vectors.sparkSession.sparkContext.broadcast(_needed(need.df.select("id").distinct()))
    size = len(words.value) * 64
    marked = vectors.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(size)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        for rb in batches:
            slot = rb.column("slot").to_numpy()
            on = (w[slot >> 6] >> (slot & 63)) & 1
            yield rb.filter(pa.array(on.astype(bool))).select(["id", "vec"])

    far = need.df.join(marked.select("id", "vec", "slot").mapInArrow(some, "id long, vec array<float>"), "id").select("id", "cell", "vec")
    rows = placed.unionByName(far)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m, valid = _matrix(right.column("vec"), dim) if right.num_rows else (np.zeros((0, dim)), np.zeros(0, np.int64))
        ids, first = np.unique(right.column("id").to_numpy().astype(np.int64)[valid], return_index=True)
        m, first = m[first], valid[first]
        v = left.column("v").to_numpy().astype(np.int64)
        size, flat = _flat(left.column("n"))
        row = np.repeat(np.arange(len(v)), size)
        p, q = (np.minimum(np.searchsorted(ids, z), max(len(ids) - 1, 0)) for z in (v[row], flat))
        ok = (ids[p] == v[row]) & (ids[q] == flat) if len(ids) else np.zeros(len(row), bool)
        row, p, q, flat = row[ok], p[ok], q[ok], flat[ok]
        s = np.concatenate([(m[p[i : i + 4096]] * m[q[i : i + 4096]]).sum(1) for i in range(0, len(p), 4096)]) if len(p) else np.zeros(0)
        s = np.round(s, 6)
        order = np.lexsort((flat, -s, row))
        at = np.searchsorted(row[order], np.arange(len(v) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(z[order])) for z in (flat, s)]
        return pa.table({"v": pa.array(v), "n": lists[0], "s": lists[1]})

    return x.select("home", "v", "n").groupBy("home").cogroup(rows.groupBy("cell")).applyInArrow(score, "v long, n array<long>, s array<double>")


# ---- complete lists -------------------------------------------------------


def _balls(x: np.ndarray) -> np.ndarray:
    """The ball of every unit row: centers far from each other, then those of what fell to them."""
    if not len(x):
        return np.zeros(0, np.int64)
    ball, near, at = np.zeros(len(x), np.int64), np.full(len(x), -9.0), 0
    for b in range(max(1, len(x) // BALL)):
        s = x @ x[at]
        ball[s > near] = b
        near = np.maximum(near, s)
        at = int(near.argmin())
    c = np.zeros((int(ball.max()) + 1, x.shape[1]), np.float32)
    np.add.at(c, ball, x)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return (x @ c.T).argmax(1)


def _gather(vectors: DataFrame, lists: DataFrame, leaves: Leaves, dim: int, k: int) -> DataFrame:
    """(v, least, ball, norm, x): every vector with a list, what its ``k``-th neighbour is about as similar as, and its ball; balls are together."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m, valid = _matrix(right.column("vec"), dim) if right.num_rows else (np.zeros((0, dim)), np.zeros(0, np.int64))
        ids, first = np.unique(right.column("id").to_numpy().astype(np.int64)[valid], return_index=True)
        v = left.column("v").to_numpy().astype(np.int64)
        at = first[np.searchsorted(ids, v)]
        ball = _balls(m[at].astype(np.float32))
        order = np.argsort(ball, kind="stable")
        raw = _flat(right.column("vec").take(pa.array(valid[at[order]])))[1].reshape(-1, dim)
        norm = np.linalg.norm(raw.astype(np.float64), axis=1)
        return pa.table({"v": pa.array(v[order]), "least": left.column("least").take(pa.array(order)), "ball": pa.array(ball[order].astype(np.int32)), "norm": pa.array(norm), "x": _binary(raw)})

    least = F.when(F.size("s") >= k, F.element_at("s", k).cast("double") - GUESS).otherwise(-2.0)  # by codes
    x = lists.select("home", "v", least.alias("least"))
    placed = _place(vectors, leaves, dim, code=False).select("id", F.col("home").alias("cell"), F.col("x").alias("vec"))
    return x.groupBy("home").cogroup(placed.groupBy("cell")).applyInArrow(run, "v long, least double, ball int, norm double, x binary")


class Balls:
    """Vectors in runs of one ball: their centers, distances from them, and the widest of a run."""

    def __init__(self, t: pa.Table | pa.RecordBatch, dim: int):
        self.ids, self.norm, ball = (t.column(c).to_numpy() for c in ("v", "norm", "ball"))
        x = t.column("x").combine_chunks() if isinstance(t, pa.Table) else t.column("x")
        start = np.frombuffer(x.buffers()[1], np.int32)[x.offset]
        self.raw = np.frombuffer(x.buffers()[2], np.float32, len(x) * dim, start).reshape(-1, dim)
        usual = len(self.norm) and 1e-30 < self.norm.min() and self.norm.max() < 1e30
        self.x = self.raw * (1 / self.norm).astype(np.float32)[:, None] if usual else self.unit(np.arange(len(self.ids))).astype(np.float32)
        self.at = np.nonzero(np.concatenate([[True], ball[1:] != ball[:-1]]))[0]
        self.end = np.append(self.at[1:], len(ball))
        n = self.end - self.at
        self.run = np.repeat(np.arange(len(n)), n)
        self.center = np.add.reduceat(self.x, self.at) / n[:, None].astype(np.float32)
        d = self.x - self.center[self.run]
        self.off = np.sqrt(np.einsum("ij,ij->i", d, d))
        self.wide = np.maximum.reduceat(self.off, self.at)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return self.raw[rows].astype(np.float64) / self.norm[rows, None]


def _reach(a: Balls, b: Balls, least: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, cosine in single precision), some at a time: all pairs whose cosine may be ``least`` of the row of a or more; where that is 1, with an id up to ``last``.

    With p and q the centers of x and y, xy = xq + (py - pq) + (x - p)(y - q); of the run of y
    the second has a maximum, and the last is at most the product of the distances.
    """
    more = np.maximum.reduceat(a.center @ b.x.T, b.at, axis=1) - a.center @ b.center.T
    may = a.x @ b.center.T
    may += more[a.run]
    may += a.off[:, None] * b.wide
    may = may >= (least - ERROR).astype(np.float32)[:, None]
    held: list[tuple] = []
    for j in np.nonzero(may.any(0))[0]:
        rows = np.nonzero(may[:, j])[0]
        s = a.x[rows] @ b.x[b.at[j] : b.end[j]].T
        late = (least[rows, None] >= 1) & (b.ids[b.at[j] : b.end[j]] > last[rows, None])  # no better than what is held
        i, y = np.nonzero((s >= least[rows, None] - ERROR) & ~late)
        held.append((rows[i], y + b.at[j], s[i, y]))
        if sum(len(z[0]) for z in held[-64:]) > PAIRS or len(held) == 4096:
            yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def _first(row: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, best first, ties to the smaller id, and the place each has in its row."""
    order = np.lexsort((n, -s, row))
    return order, np.arange(len(row)) - np.searchsorted(row[order], row[order])


def _complete(balls: Cut, k: int, dim: int) -> DataFrame:
    """(v, n, s): the ``k`` best of every vector of a written table of balls, which every task reads from the shared folder."""
    path = balls.path

    def every() -> Iterator[Balls]:
        fs, root = (pa.fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else pa.fs.FileSystem.from_uri(path)
        for f in sorted(x.path for x in fs.get_file_info(pa.fs.FileSelector(root)) if x.path.endswith(".parquet")):
            with fs.open_input_file(f) as file:
                for rb in pq.ParquetFile(file).iter_batches(CHUNK, columns=["v", "ball", "norm", "x"]):
                    if rb.num_rows:
                        yield Balls(rb, dim)

    def search(t: pa.Table, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, cosine) of the best of all rows, in order."""
        a, guess = Balls(t, dim), least
        last = np.full(len(least), np.iinfo(np.int64).max)
        row, n, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        here = np.sort(a.ids)
        for z, b in enumerate(chain([a], every())):  # most neighbours are near, so few others are compared exactly
            for i, j, about in _reach(a, b, least, last):
                new = a.ids[i] != b.ids[j]
                if z:
                    new &= here[np.minimum(np.searchsorted(here, b.ids[j]), len(here) - 1)] != b.ids[j]
                i, j, about = i[new], j[new], about[new].astype(np.float64)
                rows = np.concatenate([row, i])
                order, nth = _first(rows, np.concatenate([n, b.ids[j]]), np.concatenate([s, about]))
                kth = order[nth == k - 1]
                least = least.copy()
                least[rows[kth]] = np.maximum(least[rows[kth]], np.concatenate([s, about])[kth] - ERROR)
                new = about >= least[i] - ERROR
                i, j = i[new], j[new]
                c = [np.zeros(0), *((a.unit(i[y : y + 4096]) * b.unit(j[y : y + 4096])).sum(1) for y in range(0, len(i), 4096))]
                row, n, s = np.concatenate([row, i]), np.concatenate([n, b.ids[j]]), np.concatenate([s, np.round(np.concatenate(c), 6)])
                order, nth = _first(row, n, s)
                kth = order[nth == k - 1]
                least[row[kth]], last[row[kth]] = np.maximum(least[row[kth]], s[kth]), n[kth]
                order = order[nth < k]
                row, n, s = row[order], n[order], s[order]
        # where too few were found, more was asked for than there is
        short = np.nonzero((np.bincount(row, minlength=len(guess)) < k) & (guess > -2))[0]
        if len(short):
            rest = search(t.take(pa.array(short)), np.full(len(short), -2.0))
            keep = ~np.isin(row, short)
            row, n, s = (np.concatenate(z) for z in ((row[keep], short[rest[0]]), (n[keep], rest[1]), (s[keep], rest[2])))
            order = _first(row, n, s)[0]
            row, n, s = row[order], n[order], s[order]
        return row, n, s

    def lists(t: pa.Table) -> pa.RecordBatch:
        row, n, s = search(t, t.column("least").to_numpy())
        at = pa.array(np.searchsorted(row, np.arange(t.num_rows + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([t.column("v").combine_chunks(), *(pa.ListArray.from_arrays(at, pa.array(z)) for z in (n, s))], names=["v", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in batches:
            held += [rb] if rb.num_rows else []
            if sum(x.num_rows for x in held) >= CHUNK:
                yield from map(lists, _tables(held))
                held = []
        yield from map(lists, _tables(held))

    def _tables(held: list[pa.RecordBatch]) -> list[pa.Table]:
        t = pa.Table.from_batches(held) if held else None
        return [t.slice(z, CHUNK) for z in range(0, t.num_rows, CHUNK)] if t else []

    return balls.df.mapInArrow(run, "v long, n array<long>, s array<double>")


class Graph:
    """A finished graph: its anchors, the codes of its vectors, the lists (v, home, n, nh, s, f) by codes, and the share of new edges by round."""

    def __init__(self, leaves: Leaves, codes: DataFrame, spots: DataFrame, lists: DataFrame, rounds: list[float]):
        self.leaves, self.codes, self.spots, self.lists, self.rounds = leaves, codes, spots, lists, rounds


def _clean(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null").where(F.size("vec") == dim)


def neighbour_graph(vectors: DataFrame, id_col: str, vec_col: str, wanted: DataFrame, wanted_col: str, dim: int, rounds: int = ROUNDS) -> Graph:
    """The graph of the valid vectors whose id is asked for."""
    vectors = _clean(vectors, id_col, vec_col, dim)
    leaves = plant(vectors, dim)
    ask = wanted.select(F.col(wanted_col).cast("long").alias("id")).where("id is not null").distinct()
    codes = Cut(_place(vectors, leaves, dim), "codes").df
    spots = Cut(codes.select("id", "home", "visit").distinct().join(ask, "id", "left_semi"), "spots").df
    n = spots.count()
    lists, shares = Cut(_start(spots, leaves), "lists"), []
    for r in range(rounds):
        links = Cut(_links(lists.df), "links")
        if r == VISIT:
            who = spots.where("visit <> home").withColumnRenamed("id", "v")
            after = Cut(_merge(lists.df, _visits(who, links.df, codes, codes.where("visit <> home"), dim)), "lists")
            for x in (lists, links):
                x.drop()
            lists = after
            links = Cut(_links(lists.df), "links")
        after = _round(lists.df, links.df, codes, codes, dim)
        for x in (lists, links):
            x.drop()
        lists = after
        share = lists.df.agg(F.sum(F.size(F.filter("f", lambda z: z)))).first()[0] or 0
        shares.append(share / max(1, n * KEEP))
        if r >= VISIT and shares[-1] < ENOUGH:
            break
    return Graph(leaves, codes, spots, lists.df, shares)


def nearest(vectors: DataFrame, id_col: str, vec_col: str, wanted: DataFrame, wanted_col: str, k: int = 5, dim: int = 384) -> DataFrame:
    """(v, n, s, rank): the k most similar other vectors of every vector asked for."""
    bare = _clean(vectors, id_col, vec_col, dim)
    ask = wanted.select(F.col(wanted_col).cast("long").alias("id")).where("id is not null").distinct()
    # of copies of one vector the k + 1 smallest ids stand for all; what is best for the last of these is so for the others
    marks = bare.select("id", F.xxhash64("vec").alias("h"), F.xxhash64(F.reverse("vec")).alias("g")).distinct().join(ask, "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))
    first = Cut(marks.withColumn("r", rank).where(F.col("r") <= k + 1), "first").df
    g = neighbour_graph(vectors, id_col, vec_col, first, "id", dim)
    balls = Cut(_gather(bare, g.lists, g.leaves, dim, k), "balls")
    graph = Cut(_complete(balls, k, dim), "graph").df
    own = graph.select("v", F.posexplode(F.slice(F.arrays_zip("n", "s"), 1, k)).alias("p", "e")).select("v", "e.n", "e.s", (F.col("p") + 1).alias("rank"))
    first = first.join(graph.select(F.col("v").alias("id")), "id", "left_semi")  # invalid vectors have no list, their copies get none
    copies = marks.join(first.select("id"), "id", "left_anti")
    last = first.where(F.col("r") == k + 1).select("h", "g", F.col("id").alias("v"))
    tied = last.join(own, "v").select("h", "g", "n", "s")
    held = last.select("h", "g").join(first.where(F.col("r") <= k), ["h", "g"]).select("h", "g", F.col("id").alias("n"), F.lit(1.0).alias("s"))
    best = F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("s"), "n"))
    lists = tied.unionByName(held).groupBy("h", "g", "n").agg(F.max("s").alias("s")).withColumn("rank", best).where(F.col("rank") <= k)
    theirs = copies.join(lists, ["h", "g"])
    return own.unionByName(theirs.select(F.col("id").alias("v"), "n", "s", "rank"))


def greedy_search(graph: Graph, vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_col: str, k: int = 5, dim: int = 384, beam: int = 24, steps: int = 3) -> DataFrame:
    """(q, n, s, rank) of (id, vector) queries: a greedy walk over a finished graph; a vector is no hit of the query of its own id.

    The walk begins at random members of the query's two nearest cells and goes
    on where it finds better nodes, in the cells first, then by joins of the
    lists across cells, until no query finds a better one or ``steps`` is over.
    """
    asked = _clean(queries, query_col, vec_col, dim).withColumn("id", -1 - F.col("id"))  # no id of the graph's
    codes = Cut(_place(asked, graph.leaves, dim), "queries")
    links = Cut(_links(graph.lists), "links")
    inside = graph.codes.join(graph.spots.select("id"), "id", "left_semi")
    who = codes.df.select(F.col("id").alias("v"), "home", "visit").distinct()
    own = codes.df
    first = _visits(who.withColumn("visit", F.col("home")), links.df, inside, own.withColumn("visit", F.col("home")), dim, beam)
    second = _visits(who.where("visit <> home"), links.df, inside, own.where("visit <> home"), dim, beam)
    lists = Cut(_merge(who.join(first.drop("home"), "v", "left").select("v", "home", *[F.coalesce(c, F.array()).alias(c) for c in ("n", "nh", "s", "f")]), second, beam), "beam")
    for _ in range(steps):
        # only the lists of nodes in a beam are followed, and only the codes of what they name are compared
        some = links.df.join(lists.df.select(F.explode("n").alias("v")).distinct(), "v", "left_semi").withColumn("adj_new", F.transform("adj", lambda z: F.lit(False)))
        ids = some.select("v", "adj").select(F.explode(F.concat(F.array("v"), "adj")).alias("id")).distinct()
        after = _round(lists.df, some, graph.codes, own.unionByName(graph.codes.join(ids, "id", "left_semi")), dim, beam)
        lists.drop()
        lists = after
        if not lists.df.where(F.exists("f", lambda z: z)).limit(1).count():
            break
    got = _exact(_clean(vectors, id_col, vec_col, dim), lists.df, graph.leaves, dim, asked)
    flat = got.select((-1 - F.col("v")).alias("q"), F.posexplode(F.arrays_zip("n", "s")).alias("p", "e")).select("q", "p", "e.n", "e.s").where("q <> n")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("p"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "n", "s", "rank")


def _nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "madurai_vectors"), "vector_index", "vector", read(spark, sf_dir, "madurai_semantic_meta"), "vector_index")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(F.least("v", "n").alias("vector_a"), F.greatest("v", "n").alias("vector_b")).distinct()


def p4_search(spark, sf_dir: str) -> DataFrame:
    """Greedy search of the graph for every vector whose index is divisible by 50, against all the others."""
    v = read(spark, sf_dir, "madurai_vectors")
    graph = neighbour_graph(v, "vector_index", "vector", read(spark, sf_dir, "madurai_semantic_meta"), "vector_index", 384)
    got = greedy_search(graph, v, "vector_index", "vector", v.where("vector_index % 50 = 0"), "vector_index")
    return got.select(F.col("q").alias("vector_index"), F.col("n").alias("neighbour"), F.col("rank").cast("int").alias("rank"), F.col("s").alias("cosine"))


def p4_neighbours(spark, sf_dir: str) -> DataFrame:
    """The neighbours of every vector with rank and cosine."""
    return _nearest(spark, sf_dir).select(F.col("v").alias("vector_index"), F.col("n").alias("neighbour"), F.col("rank").cast("int").alias("rank"), F.col("s").alias("cosine"))


_NEAR = """
with v as (select vector_index i, any_value(vector)::double[] e from madurai_vectors where len(vector) = 384 and vector_index in (select vector_index from madurai_semantic_meta) group by 1),
u as (select i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
s as (select a.i a, b.i b, round(list_dot_product(a.e, b.e), 6) s from u a, u b where a.i <> b.i),
t as (select *, row_number() over (partition by a order by s desc, b) r from s qualify r <= 5)
"""
SQL = {
    "p4_found": _NEAR + "select distinct least(a, b) as vector_a, greatest(a, b) as vector_b from t",
    "p4_neighbours": _NEAR + "select a as vector_index, b as neighbour, r::int as rank, s as cosine from t",
}
QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_search": p4_search}
