"""Problem 8: filling containers of fixed capacity, by minimum bin slack.

Only the *histogram* of sizes is packed, not the items: a size is at most the
capacity, so the histogram has at most ``capacity`` rows however many items
there are.  Each step takes the largest size left, finds by a bitset subset-sum
which multiset of the remaining sizes fills the container closest to capacity,
and repeats that pattern as often as the remaining counts allow; every step uses
up at least one size, so there are at most ``capacity`` patterns or so.  Items
then take the pattern slots of their size by rank.  The rank inside a size is a
salted row number plus a prefix sum of salt counts, so a size that a third of
the items share is not one task's work.

Defined results: a null text is not packed; an empty text has size one (the end
token); equal ids are separate items only if their rows differ; an item over the
capacity is cut into full pieces and one rest, cut between characters; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import Cut, read

CAPACITY = 4096
RANKED = 100_000  #: items of one size that are ranked in one task


def byte_tokens(text: Column | str) -> Column:
    """Tokens under the byte-level ByT5 tokenizer: UTF-8 bytes and one end token."""
    return (F.octet_length(text) + 1).cast("int")


def fill(sizes: dict[int, int], goal: int) -> list[int]:
    """The multiset of ``sizes`` (size -> count) whose sum is nearest to ``goal`` from below.

    Bit w of ``reach`` says that w can be made from the sizes seen so far; the
    states before each size are kept so that the counts can be traced back.
    Larger sizes come first, and the search ends once ``goal`` itself is reached.
    """
    mask, reach = (1 << (goal + 1)) - 1, 1
    trail: list[tuple[int, int, int]] = []
    for w in sorted((x for x in sizes if x <= goal and sizes[x] > 0), reverse=True):
        left, k = min(sizes[w], goal // w), 1
        before = reach
        while left > 0:  # binary splitting of the count
            k = min(k, left)
            step = reach
            reach |= (reach << (w * k)) & mask
            trail.append((w, k, step))
            left -= k
            k *= 2
        if reach >> goal & 1:
            break
        if reach == before:
            continue
    at = reach.bit_length() - 1
    out: list[int] = []
    for w, k, before in reversed(trail):
        if not before >> at & 1:
            out += [w] * k
            at -= w * k
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(sizes in one container, number of such containers) until nothing is left."""
    left = {s: n for s, n in counts.items() if n > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        one = sorted([top, *fill(left, capacity - top)], reverse=True)
        left[top] += 1
        used: dict[int, int] = {}
        for s in one:
            used[s] = used.get(s, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((one, times))
    return out


def _cut(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, text in zip(pdf["id"], pdf["h"], pdf["text"]):
                b, at, own = text.encode(), 0, []
                total = len(b) + 1  # the end token belongs to the last piece
                while total - at > capacity:
                    end = at + capacity
                    while end < len(b) and b[end] & 0xC0 == 0x80:
                        end -= 1
                    own.append((at, end - at))
                    at = end
                own.append((at, total - at))
                rows += [(i, h, k, start, size, len(own)) for k, (start, size) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["id", "h", "piece", "start", "size", "n_pieces"])

    return run


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, h, piece, start, size, n_pieces): whole items, and the cut ones' pieces; ``h`` tells texts of one id apart.

    Repeated rows are found by id and hash, so no text is shuffled.
    """
    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("n_tokens", byte_tokens("text")).withColumn("h", F.xxhash64("text"))
    kind = dict(x.dtypes)["id"]
    whole = x.where(F.col("n_tokens") <= capacity).select("id", "h", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.col("n_tokens").alias("size"), F.lit(1).alias("n_pieces"))
    parts = x.where(F.col("n_tokens") > capacity).select("id", "h", "text").mapInPandas(_cut(capacity), f"id {kind}, h long, piece int, start int, size int, n_pieces int")
    return whole.unionByName(parts).distinct()


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, n_pieces, start, size, container) of every item or piece."""
    spark = df.sparkSession
    t = Cut(pieces(df, id_col, text_col, capacity), "pieces").df
    counts = {r["size"]: r["count"] for r in t.groupBy("size").count().collect()}  # at most ``capacity`` rows
    # a size of many items is ranked in as many parts as it takes; the parts are at most capacity + items / RANKED
    hot = [(s, -(-n // RANKED)) for s, n in counts.items() if n > RANKED]
    many = F.broadcast(spark.createDataFrame(hot, "size int, parts int"))  # at most ``capacity`` rows
    t = t.join(many, "size", "left").withColumn("salt", F.pmod(F.xxhash64("id", "h", "piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    by = t.groupBy("size", "salt").count()
    # One run per pattern and size: pattern p has `times` containers from `first` on, `per` slots
    # of this size in each, and the slots start at rank `lo` of the size.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for one, times in patterns(counts, capacity):
        for s in set(one):
            per = one.count(s)
            runs.setdefault(s, []).append((taken.get(s, 0), first, per))
            taken[s] = taken.get(s, 0) + per * times
        first += times
    shared = spark.sparkContext.broadcast({s: np.array(r, dtype=np.int64).T for s, r in runs.items()})  # at most a few runs a pattern
    offset = by.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "h", "piece")) - 1
    ranked = t.withColumn("r", rank).join(offset, ["size", "salt"]).select("id", "piece", "n_pieces", "start", "size", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.zeros(len(pdf), np.int64)
            sizes, ranks = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(sizes, kind="stable")
            for rows in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1) if len(order) else ():
                lo, start, per = shared.value[int(sizes[rows[0]])]
                k = np.searchsorted(lo, ranks[rows], side="right") - 1
                at[rows] = start[k] + (ranks[rows] - lo[k]) // per[k]
            yield pdf.drop(columns="rank").assign(container=at)

    kind = dict(t.dtypes)["id"]
    y = ranked.mapInPandas(place, f"id {kind}, piece int, n_pieces int, start int, size int, container long")
    return y.withColumnRenamed("id", id_col)


def _packed(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark, sf_dir: str) -> DataFrame:
    """The texts whose pieces were put into more than one container."""
    by = _packed(spark, sf_dir).where("n_pieces > 1").groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return by.where("a < b").select("doc_id")


def p8_audit(spark, sf_dir: str) -> DataFrame:
    """What must hold of a packing: every token is in it once, no container is over its capacity, and hardly more are used than needed."""
    x = _packed(spark, sf_dir)
    by = x.groupBy("container").agg(F.sum("size").alias("used"))
    a = by.agg(F.sum("used").alias("tokens"), F.count_if(F.col("used") > CAPACITY).alias("over_capacity"), (F.count("*") <= 1.05 * F.sum("used") / CAPACITY + 2).alias("tight"))
    b = x.groupBy("doc_id", "piece").agg(F.countDistinct("container").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    return a.crossJoin(b)  # one row each


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """The container of every text or piece."""
    return _packed(spark, sf_dir)


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """How well the containers are filled, against the fewest there could be."""
    by = _packed(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    a = by.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("items").alias("pieces"))
    return a.withColumn("least_containers", F.ceil(F.col("tokens") / CAPACITY)).withColumn("filled", F.round(F.col("tokens") / F.col("containers") / CAPACITY, 6))


SQL = {
    "p8_found": f"select distinct doc_id from documents where strlen(text) + 1 > {CAPACITY}",
    "p8_audit": "select sum(strlen(text) + 1)::bigint as tokens, 0::bigint as over_capacity, true as tight, 0::bigint as twice from (select distinct doc_id, text from documents where text is not null)",
}
QUERIES = {"p8_audit": p8_audit, "p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill}
