"""Problem 3: frequency of every distinct term, counted in burst tries.

Occurrences and records of every term are counted exactly.  Repeated rows go
first (two hash exchanges in the JVM, both with map-side combine, so neither a
hot term nor a hot record meets in one task).  Each task then folds its
(term, occurrences, records) rows into a burst trie whose containers are emitted
as compact rows.  Prefixes that hold many terms are split further, the others
stay short: that routing table decides where equal subtrees meet and is bounded
by a parameter, not by the data.  Matching subtrees are merged by route.

Defined results: a null or empty term is left out; a null record counts as an
occurrence but not as a record; a null id is no occurrence; repeated rows count
once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import Cut, read

BURST = 256  #: terms a container holds before it bursts into a node
FLUSH = 400_000  #: terms a task keeps before it emits its trie and starts another
ROUTE_TERMS = 2_000  #: terms above which a prefix is split for routing
MAX_SPLIT = 20_000  #: most prefixes that may be split, whatever the data
DEPTH = 12  #: longest routing prefix; a still larger group is salted by term


class BurstTrie:
    """Terms with two counters; a container bursts into one child per next letter."""

    __slots__ = ("root", "size", "burst")

    def __init__(self, burst: int = BURST):
        self.root: dict = {}
        self.size = 0
        self.burst = burst

    def add(self, term: str, a: int, b: int) -> None:
        node, i, n = self.root, 0, len(term)
        while True:
            c = term[i : i + 1]  # "" marks the term that ends at this node
            child = node.get(c)
            if child is None:
                node[c] = ("", {term[i + 1 :]: [a, b]}) if i < n else ("", {"": [a, b]})
                self.size += 1
                return
            if isinstance(child, dict):
                node, i = child, i + 1
                continue
            held = child[1]
            key = term[i + 1 :]
            got = held.get(key)
            if got is not None:
                got[0] += a
                got[1] += b
                return
            held[key] = [a, b]
            self.size += 1
            if len(held) > self.burst:
                deeper: dict = {}
                for k, v in held.items():
                    deeper.setdefault(k[:1], ("", {}))[1][k[1:]] = v
                node[c] = deeper
            return

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, {suffix: counters}) of every container."""
        stack: list[tuple[str, dict]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for c, child in node.items():
                if isinstance(child, dict):
                    stack.append((prefix + c, child))
                else:
                    yield prefix + c, child[1]


def _emit(trie: BurstTrie) -> pd.DataFrame:
    rows = [(p, list(h), [v[0] for v in h.values()], [v[1] for v in h.values()]) for p, h in trie.containers()]
    return pd.DataFrame(rows, columns=["prefix", "suffixes", "occ", "rec"])


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = BurstTrie()
    for pdf in batches:
        for t, a, b in zip(pdf["term"].tolist(), pdf["occ"].tolist(), pdf["rec"].tolist()):
            trie.add(t, a, b)
        if trie.size >= FLUSH:
            yield _emit(trie)
            trie = BurstTrie()
    if trie.size:
        yield _emit(trie)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by route, so a task holds the trie of one route at a time; counters of equal terms add up."""
    trie, at = BurstTrie(), None

    def out(trie: BurstTrie) -> pd.DataFrame:
        rows = [(p + s, *v) for p, held in trie.containers() for s, v in held.items()]
        return pd.DataFrame(rows, columns=["term", "n_occurrences", "n_records"])

    done: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        for route, salt, p, ss, aa, bb in zip(pdf["route"], pdf["salt"], pdf["prefix"], pdf["suffixes"], pdf["occ"], pdf["rec"]):
            if (route, salt) != at:
                if trie.size:
                    done.append(out(trie))
                    size += trie.size
                trie, at = BurstTrie(), (route, salt)
                if size >= 10_000:  # small routes leave together
                    yield pd.concat(done)
                    done, size = [], 0
            for s, a, b in zip(ss, aa, bb):
                trie.add(p + s, int(a), int(b))
    if trie.size:
        done.append(out(trie))
    if done:
        yield pd.concat(done)


def _splits(terms: DataFrame, route_terms: int, max_split: int) -> list[str]:
    """Prefixes that hold too many terms to be one route.

    Terms under a prefix are counted over all tasks' tries; only prefixes over
    the limit reach the driver.  If there are more than ``max_split``, the largest
    are split and the others stay one route each: none has more terms than the
    first that was not split, about DEPTH / max_split of all.
    """
    at = F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(DEPTH))))
    n = terms.select("term", at.alias("k")).groupBy(F.substring("term", F.lit(1), F.col("k")).alias("p")).count().where(F.col("count") > route_terms)
    held = [(r["p"], r["count"]) for r in n.orderBy(F.desc("count"), "p").limit(max_split + 1).collect()]
    if len(held) > max_split:
        least = held[max_split][1]
        held = [x for x in held if x[1] > least]
    return [p for p, _ in held]


def term_frequency(df: DataFrame, term: str, record: str, occurrence: str) -> DataFrame:
    """(term, n_occurrences, n_records) of every distinct term, exactly."""
    rows = df.select(F.col(term).alias("term"), F.col(record).alias("r"), F.col(occurrence).alias("o")).where("term is not null and term <> ''").distinct()
    pairs = rows.groupBy("term", "r").agg(F.count("o").alias("occ")).select("term", "occ", F.col("r").isNotNull().cast("long").alias("rec"))
    tries = Cut(pairs.mapInPandas(_build, "prefix string, suffixes array<string>, occ array<bigint>, rec array<bigint>"), "tries")
    flat = tries.df.select(F.explode("suffixes").alias("s"), "prefix").select(F.concat("prefix", "s").alias("term"))
    split = set(_splits(flat, ROUTE_TERMS, MAX_SPLIT))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cuts containers where the routing prefixes cut, so equal subtrees meet."""
        for pdf in batches:
            out: dict[tuple[str, int], tuple[list, list, list]] = {}
            for p, ss, aa, bb in zip(pdf["prefix"], pdf["suffixes"], pdf["occ"], pdf["rec"]):
                for s, a, b in zip(ss, aa, bb):
                    t, k = p + s, 1
                    while k < len(t) and t[:k] in split:
                        k += 1
                    salt = sum(map(ord, t)) % 64 if k >= DEPTH else 0
                    x = out.setdefault((t[:k], salt), ([], [], []))
                    x[0].append(t[k:])
                    x[1].append(a)
                    x[2].append(b)
            yield pd.DataFrame([(r, salt, r, *x) for (r, salt), x in out.items()], columns=["route", "salt", "prefix", "suffixes", "occ", "rec"])

    routed = tries.df.mapInPandas(route, "route string, salt int, prefix string, suffixes array<string>, occ array<bigint>, rec array<bigint>")
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartition(n, "route", "salt").sortWithinPartitions("route", "salt").mapInPandas(_merge, "term string, n_occurrences bigint, n_records bigint")


def mark_terms(freq: DataFrame, n_records: int, rare: int = 2, common: float = 0.1) -> DataFrame:
    """Adds ``mark``: rare (at most ``rare`` records), common (in more than the share ``common`` of all records) or null."""
    return freq.withColumn("mark", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") / F.lit(max(n_records, 1)) > common, "common"))


def published(spark, sf_dir: str) -> DataFrame:
    """One published frequency a word: the highest of its rows; 0 counts as none."""
    return read(spark, sf_dir, "frequency_index").where("freq > 0").groupBy(F.col("word_unicode").alias("token")).agg(F.max("freq").cast("bigint").alias("published_freq"))


def _counted(spark, sf_dir: str) -> tuple[DataFrame, int]:
    t = read(spark, sf_dir, "verse_tokens")
    n = t.agg(F.countDistinct("verse_id")).first()[0]
    return mark_terms(term_frequency(t, "token", "verse_id", "id"), n), n


def p3_found(spark, sf_dir: str) -> DataFrame:
    freq, _ = _counted(spark, sf_dir)
    return freq.where("mark is not null").select(F.col("term").alias("token"), "n_occurrences", F.col("n_records").alias("n_verses"), "mark")


def p3_frequency(spark, sf_dir: str) -> DataFrame:
    """Every token with its counts, its mark and the frequency once published."""
    freq, _ = _counted(spark, sf_dir)
    f = freq.select(F.col("term").alias("token"), "n_occurrences", F.col("n_records").alias("n_verses"), F.coalesce("mark", F.lit("")).alias("mark"))
    return f.join(published(spark, sf_dir), "token", "left")


_COUNTS = """
with c as (select token, count(distinct id) n_occurrences, count(distinct verse_id) n_verses from verse_tokens where token <> '' group by token),
n as (select count(distinct verse_id) n from verse_tokens),
m as (select c.*, case when n_verses <= 2 then 'rare' when n_verses * 10 > n then 'common' else '' end as mark from c, n)
"""
SQL = {
    "p3_found": _COUNTS + "select token, n_occurrences, n_verses, mark from m where mark <> ''",
    "p3_frequency": _COUNTS + "select m.*, p.published_freq from m left join (select word_unicode token, max(freq)::bigint published_freq from frequency_index where freq > 0 group by 1) p using (token)",
}
QUERIES = {"p3_found": p3_found, "p3_frequency": p3_frequency}
