"""Problem 7: one consistent form of text that looks the same.

Pairs of strings or code points that look alike are closed transitively by
union-find.  The representative of a class is the member the corpus uses most
(counted over all rows).  Texts are then rewritten greedily, longest match
first, with a multi-pattern automaton.  A member is rewritten only where it
stands in for the representative: a letter inside a word of the representative's
script, a numeral joined to letters; full-width and styled forms always.
Invisible characters go, other white space becomes a blank or a line end, and
the result is canonically composed.

Defined results: null stays null, empty stays empty; double blanks, free-standing
numerals and composed accented letters stay; words wholly in another script stay
unless every letter of theirs is a look-alike and the text has no other letter
of that script; the form of a form is itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import read, spread

# Pairs of letters that look alike, as listed script by script; union-find closes the chains they form
# (Latin A - Greek Alpha - Cyrillic A - Cherokee Go).  The first of a class is its representative on a tie.
PAIRS = (
    # Latin and Greek
    "AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ iι oο uυ vν cϲ CϹ",
    # Greek and Cyrillic
    "ΑА ΒВ ΕЕ ΗН ΙІ ΚК ΜМ ΟО ΡР ΤТ ΧХ ΥҮ ιі οо νѵ ϲс ϹС",
    # Latin and Cyrillic
    "SЅ JЈ jј aа eе pр sѕ xх yу hһ dԁ qԛ wԝ",
    # Latin and phonetic letters, Cyrillic and Cherokee, Cyrillic and Armenian
    "aɑ gɡ", "АᎪ", "оօ uս",
    # Tamil letters, and numerals and the AU length mark that mimic them
    "க௧ உ௨ எ௭ அ௮ ய௰ ளௗ",
)
ALIKE = tuple(x for row in PAIRS for x in row.split())
#: Look-alike strings of several code points, pair by pair: split and joined vowel signs (which composition joins too, but not
#: under marks between) and the two spellings of SRI.
ALIKE_STRINGS: tuple[tuple[str, ...], ...] = (
    ("\u0bcc", "\u0bc6\u0bd7"), ("\u0bca", "\u0bc6\u0bbe"), ("\u0bcb", "\u0bc7\u0bbe"), ("\u0bb8\u0bcd\u0bb0\u0bc0", "\u0bb6\u0bcd\u0bb0\u0bc0"),
)

_POINTS = (*range(0x10000), *range(0x11000, 0x1E000), *range(0xE0000, 0xE0200))
_INVISIBLE = {c for c in _POINTS if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85"}
_INVISIBLE |= {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180E), *range(0xE0100, 0xE01F0)}
_SPACE = {c: " " for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \t\n\r"} | {0x2800: " "}
_SPACE |= {c: "\n" for c in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x2028, 0x2029)}
_STRIP = {c: None for c in _INVISIBLE} | _SPACE


def _styled() -> dict[str, str]:
    """Full-width, half-width and mathematical forms, by their compatibility mapping."""
    out = {}
    for a, b in ((0xFF01, 0xFFEF), (0x1D400, 0x1D800)):
        for c in range(a, b):
            n = unicodedata.normalize("NFKC", chr(c))
            if n != chr(c) and n.strip():
                out[chr(c)] = n
    return out


def classes(rows: tuple = ALIKE, strings: tuple = ALIKE_STRINGS) -> list[list[str]]:
    """The transitive look-alike classes of the pairs given, by union-find."""
    parent: dict[str, str] = {}
    order: dict[str, int] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        order.setdefault(x, len(order))
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in (*rows, *strings):
        first = find(r[0])
        for x in r[1:]:
            a, b = find(x), find(first)
            if a != b:
                parent[max(a, b, key=order.get)] = min(a, b, key=order.get)
    out: dict[str, list[str]] = {}
    for x in order:
        out.setdefault(find(x), []).append(x)
    return list(out.values())


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] in "LM" else ""


def representatives(counts: dict[str, int], groups: list[list[str]]) -> dict[str, str]:
    """member -> representative: the most frequent letter, the earlier one on a tie."""
    out = {}
    for g in groups:
        letters = [m for m in g if unicodedata.category(m[0])[0] == "L"] or g
        rep = max(letters, key=lambda m: (counts.get(m, 0), -g.index(m)))
        out |= {m: rep for m in g if m != rep}
    return out


class Rewriter:
    """Rewrites texts to their consistent form for given representatives."""

    def __init__(self, reps: dict[str, str]):
        self.reps, self.styled = reps, _styled()
        self.auto = ahocorasick.Automaton()
        for m, r in (reps | self.styled).items():
            self.auto.add_word(m, (len(m), r, m in self.styled))
        self.auto.make_automaton()
        odd = "".join(sorted({*map(chr, _STRIP), *(m for m in (*reps, *self.styled) if len(m) == 1)}))
        safe = [c for c in reps if ord(c[0]) < 128]  # a plain letter is rewritten only into another script
        # one set of the basic plane is a table lookup; with characters beyond it the set would be walked
        self.suspect = re.compile("[" + re.escape("".join(c for c in odd if c not in safe and ord(c) < 0x10000)) + "]")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.long = [m for m in (*reps, *safe) if len(m) > 1 or m in safe]
        self.mimics = {m for m in reps if len(m) == 1}

    def __call__(self, t: str | None) -> str | None:
        if t is None or not (self.suspect.search(t) or self.beyond.search(t) or not unicodedata.is_normalized("NFC", t) or any(m in t for m in self.long)):
            return t
        t = t.translate(_STRIP)
        if "ௌ" in t:  # before another sign the second half is a letter, not the sign AU
            t = re.sub("ௌ(?=[ா-்])", "ெள", t)
        t = unicodedata.normalize("NFC", t)
        hits = list(self.auto.iter_long(t))
        if not hits:
            return t
        out, at = [], 0
        foreign: dict[str, bool] = {}
        for end, (n, rep, always) in hits:
            a, b = end + 1 - n, end + 1
            if always or self._mimics(t, a, b, rep, foreign):
                out += [t[at:a], rep]
                at = b
        new = unicodedata.normalize("NFC", "".join(out) + t[at:])
        return new if new == t else self(new)

    def _mimics(self, t: str, a: int, b: int, rep: str, foreign: dict[str, bool]) -> bool:
        script, own = _script(rep[0]), _script(t[a])
        i, j = a, b
        while i > 0 and (_script(t[i - 1]) or t[i - 1] in self.mimics or t[i - 1] in self.styled):
            i -= 1
        while j < len(t) and (_script(t[j]) or t[j] in self.mimics or t[j] in self.styled):
            j += 1
        if any(_script(c) == script and c not in self.mimics for c in t[i:a] + t[b:j]):
            return True
        if own and own != script and all(c in self.mimics for c in t[i:j]) and script == "LATIN":
            if own not in foreign:  # a genuine letter of that script elsewhere keeps its words
                foreign[own] = any(_script(c) == own and c not in self.mimics for c in t)
            return not foreign[own] and any(_script(c) == script for c in t)
        return own == script  # the mark standing alone


def member_counts(frames: list[DataFrame], groups: list[list[str]]) -> dict[str, int]:
    """How often every class member, a character or a string, occurs in all rows of ``t`` of the frames."""
    points = np.array(sorted({ord(m) for g in groups for m in g if len(m) == 1}), dtype=np.uint32)
    strings = sorted({m for g in groups for m in g if len(m) > 1})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, long = np.zeros(len(points), dtype=np.int64), np.zeros(len(strings), dtype=np.int64)
        for pdf in batches:
            text = "\0".join(v for v in pdf["t"] if v)
            x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
            total += np.bincount(np.minimum(x, points[-1] + 1), minlength=int(points[-1]) + 2)[points]
            long += [text.count(m) for m in strings]
        yield pd.DataFrame({"m": [*map(chr, points), *strings], "n": [*total, *long]})

    both = [f.mapInPandas(count, "m string, n long") for f in frames]
    union = both[0]
    for b in both[1:]:
        union = union.unionByName(b)
    return {r["m"]: r["n"] for r in union.groupBy("m").agg(F.sum("n").alias("n")).collect()}  # a row a class member


def consistent_form(frames: list[tuple[DataFrame, list[str], list[str]]]) -> list[DataFrame]:
    """For each (table, keys, text columns): (keys..., field, stored, form), one row a text.

    Representatives are chosen over all the tables together.
    """
    groups = classes()
    long = []
    for df, keys, cols in frames:
        both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in cols])).alias("x")
        long.append(spread(df.select(*keys, *cols)).select(*[F.col(k) for k in keys], both).select(*keys, "x.field", "x.t"))
    reps = representatives(member_counts([x.select("t") for x in long], groups), groups)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        form = Rewriter(reps)
        for s in batches:
            at, distinct = pd.factorize(s)  # a batch's repeated words are rewritten once
            yield pd.Series([*map(form, distinct), None], dtype=object).iloc[at].reset_index(drop=True)

    form = F.pandas_udf(run, "string")  # type: ignore[call-overload]
    return [x.withColumn("form", form("t")).withColumnRenamed("t", "stored") for x in long]


def _frames(spark, sf_dir: str) -> list[DataFrame]:
    chunks, tokens = read(spark, sf_dir, "chunks"), read(spark, sf_dir, "verse_tokens")
    return consistent_form([(chunks, ["chunk_id"], ["original_text", "normalized_text"]), (tokens, ["id"], ["normalized_token"])])


def _odd(spark, sf_dir: str) -> DataFrame:
    a, b = _frames(spark, sf_dir)
    a = a.select(F.lit("chunks").alias("tab"), "field", F.col("chunk_id").alias("record_id"), "stored", "form")
    b = b.select(F.lit("verse_tokens").alias("tab"), "field", F.col("id").cast("string").alias("record_id"), "stored", "form")
    return a.unionByName(b).where("not stored <=> form")


def p7_found(spark, sf_dir: str) -> DataFrame:
    return _odd(spark, sf_dir).select("tab", "field", "record_id").distinct()


def p7_forms(spark, sf_dir: str) -> DataFrame:
    """The consistent form of every text that was not in it."""
    return _odd(spark, sf_dir).distinct()


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms}
