"""Problem 6: near-duplicate records, by universe partition and pigeonhole.

A text is the set of its (word, nth occurrence) elements, so that the overlap of
two sets counts every word as often as both have it.  Equal sets form a class;
only one set of each class is compared.

Sets are put into size bands.  In a band the elements are hashed into m
segments.  Two sets of similarity t differ in at most H = (1-t)/(1+t)·(n1+n2)
elements.  If a set spends H+1 units on its segments, 0, 1 or 2 on each, then for
some segment the difference is below what was spent on it: with 1 unit the
segments are equal, with 2 they differ in at most one element.  So every set
indexes its segments and their one-deletion neighbourhoods, probes its own and
the lower bands it can reach, and spends its units where the index is cheapest:
counts of all index keys, folded into a table sized by the sets up to a bound, give the costs, and
hot segments (empty ones, frequent words) get no units.

Candidates must first agree in a parity sketch carried with the key (its
differing bits never exceed the true difference), then their sets are compared
exactly.  No link is lost, none is invented.

Defined results: null texts and texts of fewer than ``min_words`` words have no
links; repeated rows count once; an id with several texts is linked if one of
them is; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import Cut, cut, read, spread

WORDS = r"[\p{L}\p{M}\p{Nd}]+"
CELLS = 1 << 18, 1 << 22  #: fewest and most counters of index keys; eight a set between
BAND = 1.45  #: widest ratio of sizes in a band
WIDE = 30  #: words from which a set carries a wider sketch
LEVELS = np.array([85, 170, 340, 680, 1360])  #: sizes at which that sketch doubles
SLACK = 1.5  #: segments beyond the fewest that units can be spent on
_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)
_S = np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> _S)


class Bands:
    """Size bands from ``least`` on: highest size and number of segments of each."""

    def __init__(self, t: float, least: int, most: int = 1 << 31):
        f = Fraction(t).limit_denominator(1000)
        self.t, self.c = f, (1 - f) / (1 + f)
        lo, hi, m = [], [], []
        a = max(1, least)
        while a <= most:
            b = max(a, int(a * BAND))
            h = int(self.c * (b + b / f))
            lo.append(a)
            hi.append(b)
            m.append(max(1, int((h + 2) // 2 * SLACK) + 1))
            a = b + 1
        self.lo, self.hi, self.m = np.array(lo), np.array(hi), np.array(m)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hi, n)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most elements in which sets of these sizes may differ."""
        return ((a + b) * self.c.numerator) // self.c.denominator


class Batch:
    """The elements of a batch of sets, laid end to end."""

    def __init__(self, elems: pa.ListArray):
        at = elems.offsets.to_numpy()
        self.n = np.diff(at).astype(np.int64)
        self.e = _mix(elems.values.to_numpy()[at[0] : at[-1]].view(np.uint64))
        self.rec = np.repeat(np.arange(len(self.n)), self.n)

    def sketch(self) -> np.ndarray:
        """52 parity bits of the elements above 12 bits of the size (at most 4095)."""
        bit = np.left_shift(np.uint64(1), (self.e % np.uint64(52)) + np.uint64(12))
        out = np.zeros(len(self.n), np.uint64)
        np.bitwise_xor.at(out, self.rec, bit)
        return (out | np.minimum(self.n, 4095).astype(np.uint64)).view(np.int64)

    def wide(self) -> pa.ListArray:
        """For sets the short sketch says little about: parity bits in words, twice as many a level up; null for the others."""
        words = np.where(self.n < WIDE, 0, 2 << np.searchsorted(LEVELS, self.n, side="right"))
        start = np.concatenate([[0], np.cumsum(words)])
        own = words[self.rec] > 0
        bit = (self.e[own] >> np.uint64(7)) % (words[self.rec[own]] * 64).astype(np.uint64)
        flat = np.zeros(start[-1], np.uint64)
        np.bitwise_xor.at(flat, start[self.rec[own]] + (bit >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), bit & np.uint64(63)))
        return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.view(np.int64)), mask=pa.array(words == 0))

    def segments(self, pick: np.ndarray, band: np.ndarray, bands: Bands):
        """For the picked sets cut as in the given bands: sums of segments and of segments less one element."""
        m = bands.m[band]
        start = np.concatenate([[0], np.cumsum(m)])
        where = np.full(len(self.n), -1)
        where[pick] = np.arange(len(pick))
        own = where[self.rec] >= 0
        e, r = self.e[own], where[self.rec[own]]
        seg = (_mix(e ^ (band[r].astype(np.uint64) * _N)) % m[r].astype(np.uint64)).astype(np.int64)
        g = start[r] + seg
        total = np.zeros(start[-1], np.uint64)
        np.add.at(total, g, e)
        which = np.repeat(np.arange(len(pick)), m)
        salt = _mix(np.arange(start[-1]).astype(np.uint64) - np.repeat(start[:-1], m).astype(np.uint64) + (band[which].astype(np.uint64) << np.uint64(32)))
        return total, which, salt, g, r, total[g] - e


def _full(total: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return _mix(total + salt)


def _less(total: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return _mix((total + salt) ^ _M)


def index_keys(b: Batch, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of every segment and of every segment less one element."""
    everyone = np.arange(len(b.n))
    total, which, salt, g, r, less = b.segments(everyone, bands.of(b.n), bands)
    return np.concatenate([_full(total, salt), _less(less, salt[g])]), np.concatenate([which, r])


def probe_keys(b: Batch, bands: Bands, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of the segments each set spends its units on, in every band it can reach."""
    keys, sets = [], []
    top, c = bands.of(b.n), len(counts)
    least = np.ceil(b.n * float(bands.t) - 1e-9).astype(np.int64)
    down = 0
    while True:
        pick = np.nonzero((top >= down) & (bands.hi[np.maximum(top - down, 0)] >= least))[0]
        if not len(pick):
            break
        band = top[pick] - down
        total, which, salt, g, r, less = b.segments(pick, band, bands)
        full, deleted, shorter = _full(total, salt), _less(total, salt), _full(less, salt[g])
        cost = lambda k: counts[(k % np.uint64(c)).astype(np.int64)]
        one = cost(full).astype(np.float64)
        two = one + cost(deleted) + np.bincount(g, weights=cost(shorter), minlength=len(total))
        first = np.minimum(one, two / 2)  # where the second unit costs less, both count at their mean
        step = np.concatenate([first, two - first])
        owner = np.concatenate([which, which])
        order = np.lexsort((step, owner))
        n = np.bincount(owner, minlength=len(pick))
        rank = np.arange(len(order)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        units = bands.bound(np.minimum(bands.hi[band], b.n[pick]), b.n[pick]) + 1
        chosen = order[rank < units[owner[order]]] % len(total)
        spent = np.bincount(chosen, minlength=len(total))
        a = spent > 0
        two_units = spent > 1
        keys += [full[a], deleted[two_units], shorter[two_units[g]]]
        sets += [pick[which[a]], pick[which[two_units]], pick[r[two_units[g]]]]
        down += 1
    return (np.concatenate(keys), np.concatenate(sets)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _elements(hashes: np.ndarray) -> np.ndarray:
    """Sorted word hashes with repetitions -> one element per (word, occurrence)."""
    h = np.sort(hashes.astype(np.int64))
    start = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(start, at, 0))
    return (h.view(np.uint64) + nth.astype(np.uint64) * _N).view(np.int64)


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(rec, set) of every text with enough words and (set, id, elems) of every different set.

    ``id`` is short, as it goes with every key; it holds once the table is written.
    """
    x = df.select(F.col(id_col).alias("rec"), F.col(text_col).alias("t")).where("t is not null")
    words = F.expr(f"sort_array(transform(regexp_extract_all(lower(t), '{WORDS.replace(chr(92), chr(92) * 2)}', 0), w -> xxhash64(w)))")
    x = x.select("rec", words.alias("h")).where(F.size("h") >= min_words)

    def elems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_elements)

    x = x.select("rec", F.xxhash64("h").alias("set"), "h")
    one = x.groupBy("set").agg(F.first("h").alias("h"))
    sets = one.select("set", F.monotonically_increasing_id().alias("id"), F.pandas_udf(elems, "array<bigint>")("h").alias("elems"))  # type: ignore[call-overload]
    return x.select("rec", "set").distinct(), sets


_ROW = "key long, id long, m long, w array<bigint>"


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join without broadcast: what the planner knows of a side is the size of a small written file, not of the keys and elements made of it."""
    return left.join(right.hint("merge"), on, how)


def similar_sets(sets: DataFrame, t: float, min_words: int) -> DataFrame:
    """(a, b, shared, n_a, n_b): all pairs of different sets (of a written table) of similarity ``t`` or more, a < b."""
    bands = Bands(t, min_words)
    cells = min(CELLS[1], max(CELLS[0], 1 << (8 * sets.count()).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for rb in batches:
            if rb.num_rows:
                k, _ = index_keys(Batch(rb.column("elems")), bands)
                n += np.bincount((k % np.uint64(cells)).astype(np.int64), minlength=cells)
        c = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"c": pa.array(c.astype(np.int32)), "n": pa.array(n[c])})

    counts = np.zeros(cells, np.int64)
    got = sets.select("elems").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()  # at most a row a counter
    counts[got["c"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def emit(keys):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for at in range(0, rb.num_rows, 2000):
                    part = rb.slice(at, 2000)
                    b = Batch(part.column("elems"))
                    k, r = keys(b)
                    order = np.argsort(r, kind="stable")  # rows of a set together compress well
                    r = pa.array(r[order])
                    cols = [pa.array(k.view(np.int64)[order]), part.column("id").take(r), pa.array(b.sketch()).take(r), b.wide().take(r)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "m", "w"])

        return run

    src = sets.select("id", "elems")
    ix = src.mapInArrow(emit(lambda b: index_keys(b, bands)), _ROW)
    pr = src.mapInArrow(emit(lambda b: probe_keys(b, bands, shared.value)), _ROW)
    ix = ix.select("key", F.col("id").alias("a"), F.col("m").alias("ma"), F.col("w").alias("wa"))
    pr = pr.select("key", F.col("id").alias("b"), F.col("m").alias("mb"), F.col("w").alias("wb"))
    c = bands.c
    na, nb = "(ma & 4095)", "(mb & 4095)"
    most = f"({na} + {nb}) * {c.numerator}"
    lower = f"({na} < {nb} or {na} = {nb} and (a < b or {na} = 4095 and a <> b))"
    near = f"({nb} = 4095 or ({most} >= bit_count(shiftrightunsigned(ma ^ mb, 12)) * {c.denominator} and {na} * {bands.t.denominator} >= {nb} * {bands.t.numerator}))"
    half = "(size(wb) div 2)"  # the larger set's sketch may be wider: its halves are folded, at more than one level all its parts
    once = f"zip_with(slice(wb, 1, {half}), slice(wb, {half} + 1, {half}), (x, y) -> x ^ y)"
    parts = "aggregate(sequence(1, size(wb) div size(wa) - 1), slice(wb, 1, size(wa)), (z, i) -> zip_with(z, slice(wb, i * size(wa) + 1, size(wa)), (x, y) -> x ^ y))"
    folded = f"case when size(wb) > 2 * size(wa) then {parts} when size(wb) > size(wa) then {once} else wb end"
    differ = f"aggregate(zip_with(wa, {folded}, (x, y) -> bit_count(x ^ y)), 0, (z, x) -> z + x)"
    wide = f"case when wa is null or wb is null or {nb} = 4095 then true else {most} >= {differ} * {c.denominator} end"
    pairs = _join(ix, pr, "key").where(f"{lower} and {near}").where(wide).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    left = sets.select(F.col("id").alias("x"), F.col("set").alias("sx"), F.col("elems").alias("ex"))
    right = sets.select(F.col("id").alias("y"), F.col("set").alias("sy"), F.col("elems").alias("ey"))
    z = _join(_join(pairs, left, "x"), right, "y").withColumn("shared", F.size(F.array_intersect("ex", "ey"))).withColumn("swap", F.expr("sx > sy"))
    z = z.where(F.col("shared") / (F.size("ex") + F.size("ey") - F.col("shared")) >= t)
    pick = lambda p, q: F.when(F.col("swap"), q).otherwise(p)
    return z.select(pick(F.col("sx"), F.col("sy")).alias("a"), pick(F.col("sy"), F.col("sx")).alias("b"), "shared", pick(F.size("ex"), F.size("ey")).alias("n_a"), pick(F.size("ey"), F.size("ex")).alias("n_b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b) links: smallest label, pointers doubled each round."""
    both = Cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links").df
    labels = Cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = _join(both, labels.df.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        low = _join(labels.df, near, "node").select("node", F.least("root", "r").alias("root"))
        jump = _join(low, labels.df.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        new = Cut(jump.select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = _join(new.df, labels.df.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        labels.drop()
        labels = new
        if not changed:
            return labels.df


def near_duplicates(df: DataFrame, id_col: str, text_col: str, t: float = 0.8, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(membership, links): ``id, set`` of every record, and ``a, b, shared, n_a, n_b`` between sets."""
    members, sets = word_sets(df, id_col, text_col, min_words)
    members, sets = cut(members, "members"), cut(sets, "sets")
    return members.withColumnRenamed("rec", id_col), similar_sets(sets, t, min_words)


def _units(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(spread(read(spark, sf_dir, "chunks").select("chunk_id", "normalized_text")), "chunk_id", "normalized_text", 0.6, 12)


def p6_found(spark, sf_dir: str) -> DataFrame:
    members, links = _units(spark, sf_dir)
    one = members.select(F.col("chunk_id").alias("x"), F.col("set").alias("a"))
    two = members.select(F.col("chunk_id").alias("y"), F.col("set").alias("b"))
    same = _join(one, two.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    near = _join(_join(links.select("a", "b"), one, "a"), two, "b").select("x", "y")
    both = same.unionByName(near).where("x <> y")
    return both.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()


def p6_groups(spark, sf_dir: str) -> DataFrame:
    """The group of every unit that has a near copy, with the copies and links of its set; groups and classes bear their smallest chunk_id."""
    members, links = _units(spark, sf_dir)
    members, links = members.distinct(), cut(links.select("a", "b"), "near")
    size = members.groupBy("set").agg(F.count("*").alias("n_copies"), F.min("chunk_id").alias("class_id"))
    n = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("set")).agg(F.count("*").alias("n_links"))
    roots = components(links).select(F.col("node").alias("set"), "root")
    sets = cut(_join(_join(size, n, "set", "left"), roots, "set", "left").withColumn("root", F.coalesce("root", "set")), "classes")
    group = sets.groupBy("root").agg(F.min("class_id").alias("group_id"))
    x = _join(_join(members, sets, "set"), group, "root").where("n_copies > 1 or n_links > 0")
    return x.select("chunk_id", "group_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


SQL = {
    "p6_found": r"""
with w as (select chunk_id, unnest(regexp_extract_all(lower(normalized_text), '[\p{L}\p{M}\p{Nd}]+')) w from (select distinct chunk_id, normalized_text from chunks)),
c as (select chunk_id, w, count(*) c from w group by all), n as (select chunk_id, sum(c) n from c group by 1 having sum(c) >= 12),
j as (select a.chunk_id x, b.chunk_id y, sum(least(a.c, b.c)) s from c a join c b using (w) where a.chunk_id < b.chunk_id group by all)
select x as chunk_a, y as chunk_b from j join n p on p.chunk_id = x join n q on q.chunk_id = y where 10 * s >= 6 * (p.n + q.n - s)
"""
}
SQL["p6_groups"] = r"""
with recursive t as (select distinct chunk_id, normalized_text from chunks), l as (select chunk_id, list_sort(regexp_extract_all(lower(normalized_text), '[\p{L}\p{M}\p{Nd}]+')) ws from t),
m as materialized (select distinct chunk_id, array_to_string(ws, ' ') k from l where len(ws) >= 12), k as (select k, count(*) n_copies, min(chunk_id) class_id from m group by 1),
c as (select k, w, count(*) c from (select k, unnest(string_split(k, ' ')) w from k) group by all), n as (select k, sum(c) n from c group by 1),
j as (select a.k x, b.k y, sum(least(a.c, b.c)) s from c a join c b using (w) where a.k < b.k group by all),
e as materialized (select x, y from j join n p on p.k = x join n q on q.k = y where 10 * s >= 6 * (p.n + q.n - s)), b as materialized (select x, y from e union select y, x from e),
r as (select k a, k z from k union select b.x, r.z from r join b on b.y = r.a), g as (select a k, min(class_id) group_id from r join k on k.k = r.z group by 1),
d as (select x k, count(*) n_links from b group by 1)
select chunk_id, group_id, class_id, n_copies, coalesce(n_links, 0) as n_links from m join k using (k) join g using (k) left join d using (k) where n_copies > 1 or n_links > 0
"""
QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
