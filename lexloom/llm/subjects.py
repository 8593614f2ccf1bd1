"""Problem 10: the subject areas of every document, from labelling functions.

Sentences get votes from labelling functions that look at different things:
words that nearly all their labelled documents tie to one subject, words that
most of them do, beginnings of words in neither lexicon, Latin forms of Tamil
entries, the section heading a sentence stands under, addresses in the text, and
the document's source.  How often each votes on sentences with and without a
subject, and how far it can be trusted, is learned without labels: a
latent-class model is fitted by expectation maximisation to the table of vote
patterns, counted over all sentences.  It gives every sentence a posterior over
the subjects and none; a document has a subject if, by these posteriors, it is
more probable than not that at least a quarter of its sentences treat it, else
the subject for the rest.  Sentences of held-out passages are set aside.

Defined results: a null or wordless text has the subject for the rest; labels of
unknown documents are ignored, repeated ones count once; without labels every
document has the subject for the rest; repeated documents give the same rows
once, and the texts of one id are judged one by one; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.leakage import RUN, WORD, Index, Words
from lexloom.session import Cut, read, spread

LABELLED = 20_000  #: most labelled documents the lexicon is learned from
MIN_SHARE, MIN_GAIN = 0.6, 9.0  #: share of an entry's labelled documents with its subject; k ln(share / subject's share) at least
TELLING = 0.9  #: share from which an entry belongs to the first lexicon
SHARE = 0.25  #: of a document's sentences
SURE = 0.5  #: probability that a document's sentences reach that share
ITEMS = 20_000  #: most held-out passages
REST = "miscellany"
PREFIXES = (4, 5, 6)
HEADING = re.compile(r"^\s{0,3}(?:#{1,6}\s+\S.*|={1,6}[^=]+={1,6}|[^.?!;:]{1,60}:)\s*$")
SENTENCE = re.compile(r"(?<=[.?!;])[\"'”’)\]*_]*\s+|[\r\n]+")
ADDRESS = re.compile(r"(?:https?://|www\.|@)([\w.\-]+\.[a-z]{2,})", re.I)
ABSTAIN = -1


# How Tamil letters are written in Latin ones in romanised texts.
_CONSONANTS = dict(zip("கஙசஞடணதநபமயரலவழளறனஷஸஜஹ", "k ng s nj t n th n p m y r l v zh l r n sh s j h".split()))
_VOWELS = dict(zip("அஆஇஈஉஊஎஏஐஒஓஔ", "a aa i ii u uu e ee ai o oo au".split()))
_SIGNS = dict(zip("ாிீுூெேைொோௌ", "aa i ii u uu e ee ai o oo au".split()))


def romanise(word: str) -> str:
    """A Tamil word as romanised texts write it: a consonant without sign or dot keeps its a."""
    out = []
    for c, after in zip(word, word[1:] + " "):
        if c in _CONSONANTS:
            out.append(_CONSONANTS[c] + ("" if after in _SIGNS or after == "்" else "a"))
        elif c != "்":
            out.append(_VOWELS.get(c) or _SIGNS.get(c) or c)
    return "".join(out)


#: The labelling functions; a vote is the number of a subject from 1 on, or ABSTAIN.
FUNCTIONS = ("telling", "likely", "start", "roman", "section", "address", "origin")


class Lexicon:
    """The entries of the word functions: word -> number of the subject."""

    def __init__(self, telling: dict[str, int], likely: dict[str, int], starts: dict[str, int]):
        self.telling, self.likely, self.starts = telling, likely, starts
        forms: dict[str, set[int]] = {}
        for w, s in {**likely, **telling}.items():
            if w and w[0] in _CONSONANTS | _VOWELS:
                forms.setdefault(romanise(w), set()).add(s)
        self.roman = {f: next(iter(s)) for f, s in forms.items() if len(s) == 1 and f not in telling and f not in likely}

    def __call__(self, w: str) -> tuple[int, int]:
        """(function, subject) of a word: the first lexicon that has it; (0, 0) if none has."""
        for j, held in enumerate((self.telling, self.likely)):
            if s := held.get(w):
                return j, s
        if s := self.roman.get(w):
            return 3, s
        for k in PREFIXES[::-1]:
            if len(w) >= k and (s := self.starts.get(w[:k])):
                return 2, s
        return 0, 0


def learn(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[Lexicon, dict[str, int]]:
    """The lexicons, and the subject most labelled documents of a source have, from at most LABELLED labelled documents."""
    known = labels.where(F.col("subject").isin([*subjects, REST])).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    held = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    t = docs.join(F.broadcast(held), "doc_id").select("labels", "source", F.lower("text").alias("t"))
    words = F.array_distinct(F.expr(r"regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}]+', 0)"))
    x = t.select("labels", "source", words.alias("w"))
    cuts = [F.transform(F.filter("w", lambda z, k=k: F.length(z) >= k), lambda z, k=k: F.concat(F.lit("~"), F.substring(z, 1, k))) for k in PREFIXES]
    mine = F.when(F.col("source").isNotNull(), F.array(F.concat(F.lit("@"), "source"))).otherwise(F.array().cast("array<string>"))
    x = x.select("labels", F.explode(F.array_distinct(F.concat("w", mine, *cuts))).alias("f"))
    by = [F.sum(F.array_contains("labels", s).cast("int")).alias(f"s{i}") for i, s in enumerate(subjects, 1)]
    n = x.groupBy("f").agg(F.count("*").alias("n"), *by)
    top = F.greatest(*[F.col(f"s{i}") for i in range(1, len(subjects) + 1)], F.lit(0), F.lit(0))
    total = held.agg(F.count("*").alias("n"), *by).first()
    at_top = [(F.col(f"s{i}") == top, i) for i in range(1, len(subjects) + 1)]
    best = F.coalesce(*[F.when(c, F.lit(i)) for c, i in at_top], F.lit(0))
    share = F.coalesce(*[F.when(c, F.lit((total[f"s{i}"] or 0) / max(1, total["n"]))) for c, i in at_top], F.lit(0.0))
    good = n.where((F.col("n") >= 3) & (top >= MIN_SHARE * F.col("n"))).where(top * F.log(top / F.col("n") / share) >= MIN_GAIN)
    held_by: dict[str, dict[str, int]] = {"telling": {}, "likely": {}, "start": {}, "origin": {}}
    for f, s, r in good.select("f", best, top / F.col("n")).collect():  # entries of at most LABELLED documents that say something
        kind = "start" if f[0] == "~" else "origin" if f[0] == "@" else "telling" if r >= TELLING else "likely"
        held_by[kind][f[1:] if f[0] in "~@" else f] = s
    return Lexicon(held_by["telling"], held_by["likely"], held_by["start"]), held_by["origin"]


def fit(patterns: dict[tuple[int, ...], int], k: int, rounds: int = 60) -> dict[tuple[int, ...], np.ndarray]:
    """The posterior over none (0) and the k subjects of every vote pattern, by expectation maximisation.

    Each function has an accuracy, learned from where it meets the others; its
    wrong votes fall evenly on the other subjects and on sentences with none, and
    its silence says nothing.  A sentence of which no function says anything has
    none.  Nothing is fixed but where the rounds start.
    """
    out = {p: np.eye(k + 1)[0] for p in patterns}
    keys = [p for p in patterns if max(p) > 0]
    if not keys:
        return out
    v, w = np.array(keys), np.array([patterns[x] for x in keys], dtype=float)
    accuracy, prior, classes = np.full(v.shape[1], 0.8), np.full(k + 1, 1.0 / (k + 1)), np.arange(k + 1)
    post = np.zeros((len(keys), k + 1))
    for _ in range(rounds):
        log = np.tile(np.log(prior), (len(keys), 1))
        for j, a in enumerate(accuracy):
            log += np.where(v[:, [j]] == ABSTAIN, 0.0, np.log(np.where(v[:, [j]] == classes, a, (1 - a) / k)))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * w[:, None]
        prior = np.clip(mass.sum(0), 1e-6, None)
        prior /= prior.sum()
        for j in range(v.shape[1]):
            voted = np.nonzero(v[:, j] != ABSTAIN)[0]
            if len(voted):  # better than chance at least, short of certainty
                accuracy[j] = np.clip(mass[voted, v[voted, j]].sum() / max(mass[voted].sum(), 1e-9), 1.2 / (k + 1), 0.995)
    return out | dict(zip(keys, post))


def at_least(p: np.ndarray, n: np.ndarray, need: int) -> float:
    """P(at least ``need`` of sum(n) sentences), where n[i] sentences have probability p[i]: exact, from the characteristic function."""
    total = int(n.sum())
    z = np.exp(2j * np.pi * np.arange(total + 1) / (total + 1))
    phi = np.ones(total + 1, complex)
    for q, c in zip(p, n):
        phi *= (1 - q + q * z) ** c
    return float(1 - np.fft.fft(phi).real[:need].sum() / (total + 1))


def vote(texts: list[tuple[str | None, str | None]], lexicon: Lexicon, origin: dict[str, int], held: Index, words: Words) -> Iterator[dict[tuple[int, ...], int]]:
    """The vote patterns of each (text, source)'s sentences and how often each occurs; held-out passages set aside."""
    memo: dict[str, int] = {}
    ids = held.ids.get

    def know(w: str) -> int:
        """Item word, function and subject of a word in one number."""
        got = memo.get(w)
        if got is None:
            j, s = lexicon(w)
            got = (ids(w, 0) << 16) + (s << 3) + j
            if len(memo) < 500_000:
                memo[w] = got
        return got

    def top(found: list[int]) -> int:
        if len(found) < 2:
            return found[0] if found else ABSTAIN
        c = Counter(found).most_common(2)
        return ABSTAIN if len(c) > 1 and c[0][1] == c[1][1] else c[0][0]

    for t, source in texts:
        t = words.form(t) or ""
        low = t.lower().replace("_", " ")
        parts = [(s, w) for s in SENTENCE.split(low) if (w := WORD.findall(s))]
        codes = np.fromiter(map(know, (x for _, w in parts for x in w)), np.int64)
        item = (codes >> 16).astype(np.int32)
        cover = None
        if len(item) >= RUN and np.count_nonzero(item) >= RUN:
            aside = np.zeros(len(item) + 1, np.int64)
            for p, _i in held.search(item):
                aside[p : p + RUN] = 1
            cover = np.concatenate([[0], np.cumsum(aside)])
        said = codes & 0xFFFF
        at = np.concatenate([[0], np.cumsum([len(w) for _, w in parts])]).astype(np.int64)
        spoke = np.nonzero(said >> 3)[0]
        of = np.searchsorted(at, spoke, side="right") - 1
        by: dict[int, list[int]] = {}
        for i, x in zip(of.tolist(), said[spoke].tolist()):
            by.setdefault(i, []).append(x)
        address = top([lexicon(p)[1] for h in ADDRESS.findall(low) for p in re.split(r"[.\-]", h) if lexicon(p)[1]]) if "@" in low or "://" in low or "www." in low else ABSTAIN
        home, section = origin.get(source or "", ABSTAIN), ABSTAIN
        out: Counter = Counter()
        for i, (s, w) in enumerate(parts):
            got = by.get(i, ())
            if s[-1:] == ":" or "#" in s[:10] or "=" in s[:1]:
                if HEADING.match(s):
                    section = top([x >> 3 for x in got])
            if cover is not None and 2 * (cover[at[i + 1]] - cover[at[i]]) >= len(w):
                continue
            out[(*[top([x >> 3 for x in got if x & 7 == j]) for j in range(4)], section, address, home)] += 1
        yield out


def _votes(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, origin, items = shared.value
        words, held = Words(), Index(items, RUN)
        for pdf in batches:
            found = vote(list(zip(pdf["text"], pdf["source"])), lexicon, origin, held, words)
            yield pd.DataFrame([(d, list(n.values()), *[[x[j] for x in n] for j in range(len(FUNCTIONS))]) for d, n in zip(pdf["doc_id"].tolist(), found)], columns=["doc_id", "n", *FUNCTIONS])

    return run


def assign_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame, model=fit) -> DataFrame:
    """(doc_id, subject, share) of every document: its subjects and the expected share of its sentences that treat them."""
    spark = docs.sparkSession
    subjects = sorted(r["subject"] for r in areas.select("subject").where("subject is not null").distinct().collect() if r["subject"] != REST)  # a list of subjects, not of documents
    if len(subjects) > 8000:
        raise ValueError("more subjects than a vote can name")
    lexicon, origin = learn(docs.where("text is not null"), labels.select("doc_id", "subject").distinct(), subjects)
    passages = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    held = [(r[0], r[1]) for r in passages.limit(ITEMS + 1).collect()]
    if len(held) > ITEMS:
        raise ValueError(f"more than {ITEMS} held-out passages: take the leaked ones out of the documents first")
    shared = spark.sparkContext.broadcast((lexicon, origin, sorted(held)))  # entries of LABELLED documents, at most ITEMS passages
    kind = dict(docs.dtypes)["doc_id"]
    x = docs.select("doc_id", "text", "source").mapInPandas(_votes(shared), f"doc_id {kind}, n array<int>, " + ", ".join(f"{c} array<int>" for c in FUNCTIONS))
    t = Cut(x, "votes").df
    flat = t.select(F.explode(F.arrays_zip("n", *FUNCTIONS)).alias("v")).select("v.*")
    table = {tuple(r[c] for c in FUNCTIONS): r["n"] for r in flat.groupBy(*FUNCTIONS).agg(F.sum("n").alias("n")).collect()}  # patterns of the functions, bounded by the subjects
    posterior = spark.sparkContext.broadcast(model(table, len(subjects)))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = posterior.value
        for pdf in batches:
            rows = []
            for d, n, *votes in pdf[["doc_id", "n", *FUNCTIONS]].itertuples(index=False, name=None):
                got = len(rows)
                if len(n):
                    p = np.stack([of[x] for x in zip(*[v.tolist() for v in votes])])
                    n = np.asarray(n, np.int64)
                    total = int(n.sum())
                    mean = n @ p / total
                    for c in np.nonzero(mean[1:] > SHARE / 4)[0] + 1:
                        if at_least(p[:, c], n, -(-total // round(1 / SHARE))) >= SURE:
                            rows.append((d, subjects[c - 1], float(mean[c])))
                if len(rows) == got:
                    rows.append((d, REST, None))
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    return t.mapInPandas(decide, f"doc_id {kind}, subject string, share double").withColumn("share", F.round("share", 6)).distinct()


def _subjects(spark, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return assign_subjects(docs, read(spark, sf_dir, "subject_labels"), read(spark, sf_dir, "subject_areas"), read(spark, sf_dir, "eval_items"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_shares(spark, sf_dir: str) -> DataFrame:
    """The subjects of every document with the share of its sentences that treat them."""
    return _subjects(spark, sf_dir)


def p10_composition(spark, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents and their share."""
    by = _subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"))
    return by.withColumn("share", F.round(F.col("n_documents") / F.sum("n_documents").over(Window.partitionBy()), 6))


SQL: dict[str, str] = {}
QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_composition": p10_composition}
