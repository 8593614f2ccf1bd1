"""Term frequency, look-alikes, packing and leakage against brute force on small tables."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import leakage, lookalikes, packing, term_frequency


def test_trie_counts():
    rnd = random.Random(1)
    trie, want = term_frequency.BurstTrie(burst=4), defaultdict(lambda: [0, 0])
    for _ in range(5000):
        w = "".join(rnd.choice("abஅ") for _ in range(rnd.randint(1, 7)))
        trie.add(w, 1, 2)
        want[w][0] += 1
        want[w][1] += 2
    got = {p + s: v for p, h in trie.containers() for s, v in h.items()}
    assert got == dict(want) and trie.size == len(want)


def test_term_frequency(spark, monkeypatch):
    monkeypatch.setattr(term_frequency, "ROUTE_TERMS", 3)
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "ab", "abc", "abcd", "b", "", None, "hot", "hot", "hot"]) or None, rnd.choice(["v1", "v2", None])) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:50], "id int, term string, r string")
    got = {r.term: (r.n_occurrences, r.n_records) for r in term_frequency.term_frequency(df, "term", "r", "id").collect()}
    want = {t: (sum(x[1] == t for x in rows), len({x[2] for x in rows if x[1] == t} - {None})) for t in {x[1] for x in rows} if t}
    assert got == want
    assert term_frequency.term_frequency(df.limit(0), "term", "r", "id").count() == 0


FORM = lookalikes.Rewriter(lookalikes.representatives({}, lookalikes.classes()))


def test_forms():
    cases = {"நக்௧ொறுக்கு": "நக்கொறுக்கு", "வரி ௧௨": "வரி ௧௨", "௧": "௧", "முௗிரி": "முளிரி", "கௌதம்": "கௌதம்", "Κaikal": "Kaikal", "привет сор": "привет сор", "cор": "cop", "ａｂ，": "ab,", "a b": "a b", "ந​க": "நக", "ொ": "ொ", "a  b\t\r\n": "a  b\t\r\n", "é": "é", "": ""}
    for raw, want in cases.items():
        assert FORM(raw) == want, raw
    assert FORM(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aаΑкக௧௨ௗளெொா் ​ ａ\n1é́", max_size=12))
def test_the_form_is_stable(t):
    assert FORM(FORM(t)) == FORM(t)


def test_representatives_follow_frequency():
    g = [["க", "௧"], ["a", "а"]]
    assert lookalikes.representatives({"а": 9, "a": 1, "௧": 99}, g) == {"௧": "க", "a": "а"}


def test_forms_of_tables(spark):
    df = spark.createDataFrame([("1", "அ௧ம்", None), ("2", None, "x"), ("2", None, "x")], "k string, a string, field string")
    got = {(r.k, r.field): r.form for r in lookalikes.consistent_form([(df, ["k"], ["a"])])[0].collect()}
    assert got == {("1", "a"): "அகம்", ("2", "a"): None}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=12), st.integers(0, 40))
def test_fill_is_the_best_subset(sizes, goal):
    got = packing.fill(Counter(sizes), goal)
    reach = {0}
    for s in sizes:
        reach |= {x + s for x in reach}
    assert sum(got) == max(x for x in reach if x <= goal) and not Counter(got) - Counter(sizes)


def test_patterns_use_everything():
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 64) for _ in range(500)]
    used, bins = Counter(), 0
    for one, times in packing.patterns(Counter(sizes), 64):
        assert sum(one) <= 64
        bins += times
        for s in one:
            used[s] += times
    assert used == Counter(sizes) and bins <= 1.02 * sum(sizes) / 64 + 2


@pytest.mark.parametrize("ranked", [2, 100_000])
def test_pack(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    texts = [None, "", "a" * 15, "a" * 16, "அ" * 20, "b" * 7, "b" * 7]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, "a" * 15, "x")], "id int, t string, size string")
    got = packing.pack(df, "id", "t", 16).collect()
    assert {r.id for r in got} == {1, 2, 3, 4, 5, 6} and max(Counter(r.id for r in got if r.n_pieces == 1).values()) == 1
    fill = Counter()
    for r in got:
        fill[r.container] += r.size
    assert max(fill.values()) <= 16
    whole = {r.id: sum(x.size for x in got if x.id == r.id) for r in got}
    assert whole == {i: len(t.encode()) + 1 for i, t in enumerate(texts) if t is not None}
    cut = sorted((r for r in got if r.id == 4), key=lambda r: r.piece)
    assert [r.start for r in cut] == [0, 15, 30, 45] and len(cut) == cut[0].n_pieces  # never inside a character
    assert packing.pack(df.limit(0), "id", "t", 16).count() == 0


def test_leaks(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["அறம்", "செய"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate((5, 10, 14, 30, 30))] + [(9, None), (10, "உரை " * 12), (11, "a b " * 7)]
    docs = [(100, None), (101, ""), (102, items[1][1]), (103, "x " * 5000 + items[3][1].upper().replace(" ", ", ") + " y" * 9000)]
    w = items[4][1].split()
    docs += [(104, "*" + "*\n*".join(w[3:13]) + "*"), (105, " ".join(w[3:12])), (106, "q " * 255 + " ".join(w[:10])), (107, " ".join(w[:12]) + " " + items[2][1]), (108, "z " * 33 + "உரை " * 10), (109, "b a " * 6), (110, "உரை " * 9)]
    d = spark.createDataFrame(docs + docs[2:3], "doc_id int, text string")
    i = spark.createDataFrame(items + items[1:2], "item_id int, passage string")
    got = {(r.doc_id, r.item_id): r.n_shared for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "passage").collect()}
    words = leakage.Words()
    want = {}
    for a, t in docs:
        grams = {tuple(words(t)[k : k + 10]) for k in range(len(words(t)) - 9)}
        for b, p in items:
            own = {tuple(words(p)[k : k + 10]) for k in range(len(words(p)) - 9)}
            if grams & own:
                want[a, b] = len(grams & own)
    assert got == want and (105, 4) not in got and {(102, 1), (103, 3), (104, 4), (106, 4), (107, 2)} <= set(got)
    assert leakage.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert leakage.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0


def test_partitions_miss_next_to_nothing():
    parts = leakage.partitions(10)
    assert parts[0][0] == 9 and parts[-1][0] == 18 and parts[0][1] > 1
    assert all(r == 1 and (1 - 9 / top) ** 32 < 1e-9 or (1 - (9 / top) ** r) ** (32 // r) <= 1e-9 for top, r in parts)


def test_classes_close_chains_and_count_strings(spark):
    groups = lookalikes.classes()
    assert any({"A", "Α", "А", "Ꭺ"} <= set(g) for g in groups) and max(map(len, lookalikes.PAIRS[0].split())) == 2
    assert FORM("ஶ்ரீ") == FORM("ஸ்ரீ") == "ஸ்ரீ"
    n = lookalikes.member_counts([spark.createDataFrame([("ஶ்ரீ ஶ்ரீ",), (None,), ("aа",)], "t string")], groups)
    assert n["ஶ்ரீ"] == 2 and n["ஸ்ரீ"] == 0 and n["а"] == 1
    assert lookalikes.representatives(n, [["ஸ்ரீ", "ஶ்ரீ"]]) == {"ஸ்ரீ": "ஶ்ரீ"}
