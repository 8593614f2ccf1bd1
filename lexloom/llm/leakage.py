"""Problem 9: held-out test passages inside a large corpus, by size-partitioned MinHash containment.

A leak is a run of ``n`` words of a passage.  As a share of a long document that
is next to nothing, so documents are cut into overlapping blocks of 2n - 1 words,
one every n words: a run lies whole in one of them.  The sets compared are the
word pairs of a block (each counted as often as it occurs) and those of every
run of a passage; a leaked run has containment one in its block.  Blocks are
partitioned by their size, as texts and their ends leave shorter ones: the
containment asked for and the largest size in a partition bound the Jaccard
similarity from below, and from that bound the partition gets as many rows a
band as keep the chance to miss a run under MISS.  Bands of the passages' runs
stand in a filter of fixed size, so the corpus is read once whatever the number
of passages.  The runs of a block with a common band are verified by their exact
words in a join.

Defined results: null texts and passages match nothing, nor do passages of
fewer than ``n`` words; repeated rows count once; case, punctuation, marks of
emphasis, line breaks and look-alike characters are ignored; every item that
shares a run is reported; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalikes import ALIKE_STRINGS, Rewriter, _styled, classes, representatives
from lexloom.session import Cut, read, spread

RUN = 10  #: consecutive words that make a leak
HASHES = 32  #: hash functions of a signature
MISS = 1e-9  #: most chance to miss a run of a passage
PARTS = 4  #: partitions of block sizes
BITS = 1 << 28  #: most bits of a filter
PROBES = 4
PILE = 20_000  #: words whose blocks are signed at once

_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M")
WORD = re.compile(rf"[\w{re.escape(_MARKS)}]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBE = np.arange(1, PROBES + 1, dtype=np.uint64) * _A
_TIMES = np.arange(64, dtype=np.uint64) * _B
_SALTS = (np.arange(1, 2 * HASHES, 2, dtype=np.uint64) * _A) | np.uint64(1)


class Words:
    """The words of a text in the form in which texts are compared."""

    def __init__(self) -> None:
        self.form = Rewriter(representatives({}, classes()))

    def __call__(self, t: str | None) -> list[str]:
        return self.plain(self.form(t)) if t else []  # type: ignore[arg-type]

    @staticmethod
    def plain(t: str) -> list[str]:
        """The words of a text that is in the consistent form already."""
        return WORD.findall(t.lower().replace("_", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class Index:
    """The runs of a bounded set of passages, for texts that are at hand: exact, by word numbers."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        words, self.n = Words(), n
        self.ids: dict[str, int] = {}
        self.windows: dict[bytes, list[int]] = {}
        for item, text in items:
            a = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], dtype=np.int32)
            for k in range(len(a) - n + 1):
                held = self.windows.setdefault(a[k : k + n].tobytes(), [])
                if item not in held:
                    held.append(item)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, item) of every run of the text that is a passage's."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k in np.nonzero(known[self.n :] - known[: -self.n] == self.n)[0] if len(ids) >= self.n else ():
            for item in self.windows.get(ids[k : k + self.n].tobytes(), ()):
                yield int(k), item


def partitions(n: int, parts: int = PARTS, hashes: int = HASHES, miss: float = MISS) -> list[tuple[int, int]]:
    """(largest number of pairs, rows a band) of the partitions of block sizes, smallest first."""
    least, most = n - 1, 2 * n - 2
    tops = sorted({least + (most - least) * k // (parts - 1) for k in range(parts)}) if parts > 1 else [most]
    out = []
    for top in tops:
        s = least / top  # containment one: the Jaccard similarity is the ratio of the sizes
        out.append((top, max(r for r in (1, 2, 4, 8) if r == 1 or (1 - s**r) ** (hashes // r) <= miss)))
    return out


def elements(words: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The word pairs of every block as rows; a repeated pair is another element, past a block's size stands _NONE."""
    at = start[:, None] + np.arange(width)
    inside = np.arange(width)[None, :] < size[:, None]
    at = np.minimum(at, len(words) - 2)
    e = np.where(inside, _mix(words[at] * _A + words[at + 1]), _NONE)
    e.sort(axis=1)
    same = (e[:, 1:] == e[:, :-1]) & inside[:, 1:]
    for r in np.nonzero(same.any(1))[0]:
        nth = 0
        for j in range(1, int(size[r])):
            nth = nth + 1 if same[r, j - 1] else 0
            e[r, j : j + 1] += _TIMES[nth : nth + 1]
    return e


def minima(e: np.ndarray) -> np.ndarray:
    """The signature of every row: the least hash under each function."""
    gone = e == _NONE
    out = np.empty((len(e), HASHES), np.uint64)
    for i, salt in enumerate(_SALTS):
        h = _mix(e * salt + _B)
        h[gone] = _NONE
        out[:, i] = h.min(axis=1)
    return out


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    """One key a band of ``rows`` functions."""
    k = np.zeros((len(m), HASHES // rows), np.uint64)
    for j in range(rows):
        k = _mix(k * _A + m[:, j::rows])
    return k + np.uint64(rows) * (np.arange(HASHES // rows, dtype=np.uint64) + np.uint64(1)) * _A


def run_keys(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    k = np.zeros(len(start), np.uint64)
    for j in range(n):
        k = _mix(k * _A + words[start + j] + np.uint64(j))
    return k


class Filter:
    """A Bloom filter, as words of 64 bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words.view(np.uint64), len(words) * 64

    @staticmethod
    def probes(keys: np.ndarray, bits: int) -> np.ndarray:
        return np.stack([_mix(keys ^ p) & np.uint64(bits - 1) for p in _PROBE], axis=-1)

    def __contains__(self, keys) -> bool:
        return bool(self.test(np.array([keys], np.uint64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        on = np.ones(keys.shape, bool)
        for salt in _PROBE:
            at = np.nonzero(on)
            p = _mix(keys[at] ^ salt) & np.uint64(self.bits - 1)
            on[at] = (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return on


class Signer:
    """Words of a text and their hashes."""

    def __init__(self) -> None:
        self.words, self.memo = Words(), {}

    def hash(self, w: str) -> int:
        h = self.memo.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(self.memo) < 500_000:
                self.memo[w] = h
        return h

    def __call__(self, t: str) -> tuple[list[str], np.ndarray]:
        w = self.words(t)
        return w, np.fromiter(map(self.hash, w), np.uint64, len(w))


def _filter(keys: DataFrame, per: int) -> np.ndarray:
    """A filter of the column ``k`` of long keys, sized by their number up to BITS and put together by all tasks."""
    bits = min(BITS, max(1 << 16, 1 << (per * keys.count()).bit_length()))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = Filter.probes(pdf["k"].to_numpy().astype(np.int64).view(np.uint64), bits).ravel()
            yield pd.DataFrame({"w": (p >> np.uint64(6)).astype(np.int64), "b": np.left_shift(np.uint64(1), p & np.uint64(63)).view(np.int64)})

    got = keys.mapInPandas(probe, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_shared, containment): runs of the item in the document, and their share of all the item's."""
    spark = docs.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null").distinct()
    parts = partitions(n)
    used = sorted({r for _, r in parts})

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = Signer()
        for pdf in batches:
            rows = []
            for i, p in zip(pdf["i"].tolist(), pdf["p"]):
                w, h = sign(p)
                start = np.arange(len(h) - n + 1)
                if len(start):
                    m = minima(elements(h, start, np.full(len(start), n - 1), n - 1))
                    keys = [bands(m, r).view(np.int64) for r in used]
                    own = run_keys(h, start, n).view(np.int64).tolist()
                    rows += [(i, own[k], " ".join(w[k : k + n]), np.concatenate([x[k] for x in keys]), len(start)) for k in range(len(start))]
            yield pd.DataFrame(rows, columns=["i", "k", "w", "bands", "size"])

    table = Cut(held.mapInPandas(runs, "i long, k long, w string, bands array<long>, size long"), "runs").df
    band = spark.sparkContext.broadcast(_filter(table.select(F.explode("bands").alias("k")).distinct(), 24))
    exact = spark.sparkContext.broadcast(_filter(table.select("k").distinct(), 24))
    tops = np.array([t for t, _ in parts])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign, known, run = Signer(), Filter(band.value), Filter(exact.value)

        def flush(pile: list) -> list[tuple]:
            """(document, key, words) of the runs in blocks that share a band with a passage."""
            h = np.concatenate([x for _, _, x in pile])
            base = np.concatenate([[0], np.cumsum([len(x) for _, _, x in pile])])
            start = np.concatenate([np.arange(0, len(x) - n + 1, n) + base[j] for j, (_, _, x) in enumerate(pile)])
            of = np.searchsorted(base, start, side="right") - 1
            size = np.minimum(2 * n - 1, base[of + 1] - start) - 1
            part = np.searchsorted(tops, size)
            m = minima(elements(h, start, size, 2 * n - 2))
            near = np.zeros(len(start), bool)
            for j, (_, r) in enumerate(parts):
                at = np.nonzero(part == j)[0]
                if len(at):
                    near[at] = known.test(bands(m[at], r)).any(1)
            at = np.nonzero(near)[0]
            s = (start[at][:, None] + np.arange(n)).ravel()
            s = s[(np.arange(n)[None, :] <= (size[at] - (n - 1))[:, None]).ravel()]
            k = run_keys(h, s, n)
            ok = run.test(k)
            out = []
            for at, key in zip(s[ok].tolist(), k[ok].view(np.int64).tolist()):
                j = int(np.searchsorted(base, at, side="right")) - 1
                d, w, _ = pile[j]
                out.append((d, key, " ".join(w[at - base[j] : at - base[j] + n])))
            return out

        for pdf in batches:
            pile, size, rows = [], 0, []
            for d, t in zip(pdf["d"].tolist(), pdf["t"]):
                w, h = sign(t)
                if len(h) < n:
                    continue
                pile.append((d, w, h))
                size += len(h)
                if size >= PILE:
                    rows += flush(pile)
                    pile, size = [], 0
            if pile:
                rows += flush(pile)
            yield pd.DataFrame(rows, columns=["d", "k", "w"])

    kind = dict(docs.dtypes)[doc_id]
    found = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null").mapInPandas(search, f"d {kind}, k long, w string")
    both = found.distinct().join(table.select("i", "k", "w", "size").distinct(), ["k", "w"])
    g = both.groupBy("d", "i").agg(F.countDistinct("w").alias("n_shared"), F.max("size").alias("size"))
    return g.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "n_shared", F.round(F.col("n_shared") / F.greatest("size", F.lit(1)), 6).alias("containment"))


def _leaks(spark, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return find_leaks(docs, "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "passage")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_leaks(spark, sf_dir: str) -> DataFrame:
    """Every leak with how much of the item's passage the document holds."""
    return _leaks(spark, sf_dir)


def _form_sql(t: str) -> str:
    """Words in lower case, look-alikes as the first of their class wherever they stand, which is the same on both sides."""
    groups = [[m for m in g if len(m) == 1] for g in classes()]
    pairs = {c: g[0] for g in groups for c in g[1:]} | {c: r for c, r in _styled().items() if len(r) == 1}
    pairs = {c: pairs.get(r, r) for c, r in pairs.items() if "'" not in c + r}
    t = f"regexp_replace(nfc_normalize({t}), '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}]', '', 'g')"
    for first, *others in ALIKE_STRINGS:
        for m in others:
            t = f"replace({t}, '{m}', '{first}')"
    t = f"lower(translate({t}, '{''.join(pairs)}', '{''.join(pairs.values())}'))"
    return f"regexp_extract_all(nfc_normalize({t}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


_RUNS = lambda rows: f"select id, unnest(list_transform(generate_series(1, len(w) - {RUN - 1}), lambda k: array_to_string(w[k:k + {RUN - 1}], ' '))) r from ({rows}) where len(w) >= {RUN}"
SQL = {
    "p9_found": f"""
with d as (select distinct doc_id id, {_form_sql('text')} w from documents where text is not null), i as (select distinct item_id id, {_form_sql('passage')} w from eval_items where passage is not null),
dr as ({_RUNS('select * from d')}), ir as ({_RUNS('select * from i')})
select distinct dr.id as doc_id, ir.id as item_id from dr join ir using (r)
"""
}
SQL["p9_leaks"] = f"""
with d as (select distinct doc_id id, {_form_sql('text')} w from documents where text is not null), i as (select distinct item_id id, {_form_sql('passage')} w from eval_items where passage is not null),
dr as ({_RUNS('select * from d')}), ir as ({_RUNS('select * from i')}), n as (select id, max(len(w) - {RUN - 1}) n from i group by 1)
select dr.id as doc_id, ir.id as item_id, count(distinct r) as n_shared, round(count(distinct r)::double / max(n), 6) as containment from dr join ir using (r) join n on n.id = ir.id group by 1, 2
"""
QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
