import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.splitting import BLANK, coarsest, cut_text, split, split_files


def brute(t, limit):
    """The definition, written plainly: cut, trim, compare."""
    import re

    pats = [r"(?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))+", r"\r\n|\r|\n", r"(?<=[.?!])[ \t\r\n]+", r"[ \t\r\n]+"]
    if len(t.strip(BLANK)) <= limit:
        return None
    for k in range(4):
        segs = [t]
        for p in pats[: k + 1]:
            segs = [y for x in segs for y in re.split(p, x)]
        if all(len(x.strip(BLANK)) <= limit for x in segs):
            return ("stanza", "line", "sentence", "word")[k]
    return "none"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .?\n\r\t", max_size=120))
def test_coarsest_is_the_definition(t):
    assert coarsest(t, 10) == brute(t, 10)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd .?\n\r", max_size=300))
def test_pieces_cover_the_text(t):
    p = cut_text(t, 20, 5)
    assert "".join("".join(t[x:y] for _, x, y, _ in p).split()) == "".join(t.split())
    last = None
    for back, x, y, _ in p:
        assert 0 < y - x <= 20 and back <= x
        if last:
            assert last[0] <= back <= last[1] <= x and last[1] - back <= 5 and not t[last[1] : x].strip(BLANK)
        last = (x, y)


def test_rows(spark):
    long = "\n\n".join("வரி ஒன்று இரண்டு. " * 20 for _ in range(12))
    rows = [("a", None, 1), ("b", "short", 2), ("c", "  \n", 3), ("d", long, 4), ("d", long, 4), ("e", "x" * 3000, None)]
    df = spark.createDataFrame(rows, "id string, t string, text int")
    got = split(df, "id", "t", ("text",)).collect() if False else split(df.withColumnRenamed("text", "no"), "id", "t", ("no",)).collect()
    assert {r.id for r in got} == {"d", "e"}
    assert all(r.piece_end - r.new_start <= 1200 and r.text == {"d": long, "e": "x" * 3000}[r.id][r.piece_start : r.piece_end] for r in got)
    assert {r.needs for r in got if r.id == "e"} == {"none"} and {r.no for r in got if r.id == "d"} == {4}
    assert split(df.limit(0), "id", "t").count() == 0
    assert split(df, "id", "t", every=True).select("id").distinct().count() == 3


def test_ranges_agree_with_the_whole(spark):
    rnd = random.Random(3)
    t = "".join(rnd.choice(["word ", "சொல் ", "end. ", "line\n", "stanza\n\n"]) for _ in range(4000))
    df = spark.createDataFrame([("a", t)], "id string, t string")
    got = sorted(split(df, "id", "t", limit=200, overlap=20, size=3000).collect(), key=lambda r: r.new_start)
    assert "".join("".join(t[r.new_start : r.piece_end] for r in got).split()) == "".join(t.split())
    assert all(len(r.text) <= 220 + 5 and r.piece_end - r.new_start <= 200 for r in got)
    for a, b in zip(got, got[1:]):
        assert a.piece_end <= b.new_start and b.text.endswith(t[b.new_start : b.piece_end])
        assert b.first_line == 1 + t.count("\n", 0, b.new_start)


def test_files_by_byte_range(spark, tmp_path):
    rnd = random.Random(5)
    t = "".join(rnd.choice(["word ", "சொல் ", "end. ", "line\n", "stanza\n\n", "é"]) for _ in range(20_000))
    (tmp_path / "a.txt").write_bytes(t.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = sorted(split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], limit=200, overlap=20, size=16_384).collect(), key=lambda r: r.new_start)
    b = t.encode()
    assert "".join("".join(b[r.new_start : r.piece_end].decode() for r in got).split()) == "".join(t.split())
    for x, y in zip(got, got[1:]):
        assert x.piece_end <= y.new_start and y.text.endswith(b[y.new_start : y.piece_end].decode())
    assert all(r.char_start == len(b[: r.new_start].decode()) and r.first_line == 1 + b.count(b"\n", 0, r.new_start) for r in got)
    assert split_files(spark, []).count() == 0


def test_needs_of_ranges_is_that_of_the_whole(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(["ab", "c" * rnd.randint(1, 12), " ", ". ", "\n", "\r\n", "\r", "\n\n", "\n \n", " " * 9, "\n" * rnd.randint(1, 60)][: rnd.choice([4, 5, 8, 11])]) for _ in range(rnd.randint(30, 150))) for _ in range(400)]
    short = ("x" * 900 + "\n\n") * 72
    texts.append(short[:65_000].rstrip("\n") + "\n\n" + "y" * 100 + "\n" + "z" * 1150 + "\n\n" + short[:6000])
    for t, limit, size in [(texts[:-1], 20, 40), (texts[:-1], 12, 30), (texts[-1:], 1200, 65_536)]:
        df = spark.createDataFrame(list(enumerate(t)), "id int, t string")
        got = {(r.id, r.needs) for r in split(df, "id", "t", limit=limit, overlap=5, size=size, every=True).select("id", "needs").distinct().collect()}
        assert got == {(i, coarsest(x, limit)) for i, x in enumerate(t) if x.strip(BLANK)}
