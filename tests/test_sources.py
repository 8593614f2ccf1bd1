import bz2
import json

from pyspark.sql import functions as F

from lexloom.sources import dictionaries as D
from lexloom.sources import pages
from lexloom.streaming.refresh import maintain


def _write(p, text):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_headword_files(spark, tmp_path):
    _write(tmp_path / "d" / "அகம்", "# இசையினி தமிழ் அகராதி\n## பெயர்\n. மனம் (பிங்.)\nயா.\nவீடு;\nபார். வேறு\n.\nஉள்\n")
    _write(tmp_path / "d" / "காலி", "[x]\n.\n")
    got = {r.headword: r.meaning for r in D.headword_files(spark, str(tmp_path / "d")).collect()}
    assert got == {"அகம்": "மனம், வீடு;\nஉள்"}


def test_blocks_and_lines(spark, tmp_path):
    p = _write(tmp_path / "pav.txt", "note\nஅன்பு\n==\nlove\nmore\nமரம்\n==\ntree\n///skip\n==\nno\n")
    assert [(r.headword, r.meaning) for r in D.marked_blocks(spark, p).orderBy("n").collect()] == [("அன்பு", "love"), ("மரம்", "tree")]
    p = _write(tmp_path / "lines.txt", "# head\nஅ, ஆ - first-letter\n\nplain\n- x\n")
    assert sorted((r.headword, r.meaning) for r in D.head_lines(spark, p).collect()) == [("அ", "first-letter"), ("ஆ", "first-letter")]


def test_json_map_and_manifest(spark, tmp_path):
    e = {"headword": "அ", "meaning": "m", "source_file": "f", "source_name": "n", "entry_format": "x", "raw_entry": "r", "source_id": "1"}
    p = _write(tmp_path / "map.json", json.dumps({"metadata": {"n": 2}, "headword_index": {"அ": [e, {**e, "meaning": "k"}]}}))
    assert sorted(r.meaning for r in D.headword_map(spark, p).collect()) == ["k", "m"]
    p = _write(tmp_path / "man.json", json.dumps({"works": [{"work": "b", "work_id": "B"}, {"work": "a", "work_id": "A"}]}))
    assert [r.work_id for r in D.manifest(spark, p).orderBy("pos").collect()] == ["B", "A"] and D.manifest(spark, p, 1).count() == 1


def test_wiki_dump(spark, tmp_path):
    xml = '<mediawiki><page><title>மரம்</title><revision><text bytes="9">==x==\n# [[tree|the tree]]\n#: no\n# {{q}}\n#* a.b\n</text></revision></page><page><title>Help:x</title><revision><text bytes="1"># hidden</text></revision></page></mediawiki>'
    p = tmp_path / "d.xml.bz2"
    p.write_bytes(bz2.compress(xml.encode()))
    assert sorted(r.meaning for r in D.wiki_dump(spark, str(p)).collect()) == ["a. b", "the tree"]


def test_sql_dump(spark, tmp_path):
    p = _write(tmp_path / "x.sql", "INSERT INTO `t` VALUES (1,'a,b','it\\'s',NULL);\nINSERT INTO `u` VALUES (2,'x');\n-- c\n")
    assert [tuple(r) for r in D.sql_inserts(spark, p, "t", ["i", "a", "b", "c"]).collect()] == [("1", "a,b", "it's", None)]


def test_benchmark_table_and_bytes(spark, tmp_path):
    p = _write(tmp_path / "b.md", "### 3.1 Roots\n| ID | Word |\n|---|---|\n| L001 | அ | x |\n### 3.2 Forms\n| M001 | ஆ |\n| L001 | again |\n")
    assert sorted((r.id, r.word, r.category) for r in D.benchmark_table(spark, p).collect()) == [("L001", "அ", "Roots"), ("M001", "ஆ", "Forms")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes(b"ok \xff")
    r = D.source_files(spark, str(tmp_path / "raw")).first()
    assert r.text == "ok �" and len(r.digest) == 64


def test_sections(spark):
    df = spark.createDataFrame([("pre START a END b", "START", "END"), ("START a", "START", "END"), ("none", "START", "END"), ("x START y", "START", None)], "t string, a string, b string")
    assert [r.x for r in df.select(pages.section("t", "a", "b").alias("x")).collect()] == ["START a ", "START a", "none", "START y"]


def test_stanzas(spark):
    t = "பால காண்டம்\n\nஅறம் செய விரும்பு\nஆறுவது சினம் 12\n-ஔவையார்.\n\n1. அறம் செய\n2. ஆறுவது சினம்\n\nabc\n\n7. குறிஞ்சி\nவரி ஒன்று இங்கே\n\nமூன்றாம் படலம்\n\nகடைசி வரி இது"
    df = spark.createDataFrame([("w", t), ("n", None), ("e", "")], "id string, t string")
    got = pages.stanzas(df, "id", "t").orderBy("stanza_number").collect()
    assert [(r.stanza_number, r.verse_number, r.poet, r.canto) for r in got] == [(1, "12", "ஔவையார்", "பால காண்டம்"), (2, "1", None, "பால காண்டம்"), (3, "2", None, "பால காண்டம்"), (4, "7", None, "பால காண்டம்"), (5, "5", None, "மூன்றாம் படலம்")]
    assert got[0].original_text == "அறம் செய விரும்பு\nஆறுவது சினம்" and got[3].original_text == "வரி ஒன்று இங்கே"


def test_couplets(spark):
    t = "முன்னுரை\nஅகர முதல எழுத்தெல்லாம் ஆதி\nபகவன் முதற்றே உலகு 1\n1.2 வான் சிறப்பு\nவானின்று உலகம் வழங்கி வருதலால்\nதான்அமிழ்தம் என்றுணரற் பாற்று 11\nபொருட்பால்\nகடைசி வரி ஒன்று இங்கே\nஇரண்டாம் வரி இங்கே 1330\nபின்னுரை"
    got = pages.couplets(spark.createDataFrame([("k", t)], "id string, t string"), "id", "t", "அகர முதல").orderBy("stanza_number").collect()
    assert [(r.stanza_number, r.canto, r.chapter, r.line_range) for r in got] == [(1, "அறத்துப்பால்", "கடவுள் வாழ்த்து", "1-2"), (2, "அறத்துப்பால்", "வான் சிறப்பு", "3-4"), (3, "பொருட்பால்", "வான் சிறப்பு", "5-6")]
    assert got[0].original_text == "அகர முதல எழுத்தெல்லாம் ஆதி\nபகவன் முதற்றே உலகு"


def test_stream_keeps_the_index(spark, tmp_path):
    src = str(tmp_path / "units")
    spark.createDataFrame([("a", "one two", 1), ("b", "three", 1)], "id string, t string, o int").coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", "four", 2), ("c", None, 2)], "id string, t string, o int").coalesce(1).write.mode("append").parquet(src)
    got = {(r.id, r.token) for r in maintain(spark, src, str(tmp_path / "ix"), "id", "t", "o", files_per_batch=8).collect()}
    assert got == {("a", "four"), ("b", "three")}


def test_carry_and_number(spark):
    df = spark.createDataFrame([("x", 0, "# A"), ("x", 1, "a"), ("x", 2, "# B"), ("x", 3, "b"), ("y", 0, "c")], "id string, n int, l string")
    got = pages.number(pages.carry(df, "id", "n", "l", F.startswith("l", F.lit("#"))), "id", "n").orderBy("id", "n").collect()
    assert [(r.l, r.heading, r.stanza_number) for r in got] == [("a", "# A", 1), ("b", "# B", 2), ("c", None, 1)]
