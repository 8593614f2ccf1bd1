"""Engine passes and errors, WordNet, answers, build, sinks, stream order, exact quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import compose, evaluate, vectors, wsd
from lexloom.operators.evidence import Engine, lookup_definitions, lookup_wordnet
from lexloom.sources import build, dictionaries, sinks
from lexloom.streaming.refresh import maintain


def _chunks(spark, rows):
    cols = "chunk_id string, normalized_text string, original_text string, work string, author string, period string, genre string, verse_number string, stanza_number int"
    return spark.createDataFrame(rows, cols)


def test_third_pass(spark):
    c = _chunks(spark, [("c1", "அறம் செய", "அறம்\nசெய", "", None, "Sangam", "g", None, 4), ("c2", "வேறு வரி", "வேறு வரி", "w2", "a", "", None, "7", 1), ("c3", "தொலை", "தொலை", "w", "a", "p", "g", "1", 1)])
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.95, 0.05])], "vector_index long, vector array<float>")
    m = spark.createDataFrame([(0, "c1", "m1"), (1, "c2", "m2"), (2, "c3", "m3"), (3, "gone", "m4")], "vector_index long, chunk_id string, work_name string").withColumns({x: F.lit("from meta") for x in ("author", "period", "genre")}).withColumn("stanza_number", F.lit(9))
    q = spark.createDataFrame([("1", "அறம்"), ("2", "இல்லை")], "query_id string, query string")
    qv = spark.createDataFrame([("1", [1.0, 0.0]), ("9", [1.0, 0.0])], "query_id string, vec array<float>")
    e = Engine(chunks=c, semantic=(v, m, qv), k=3, tau=0.9).search(q).where("resource = 'corpus' and status = 'FOUND'")
    got = {(r.query_id, r.source_id): r for r in e.collect()}
    assert set(got) == {("1", "c1"), ("1", "c2"), ("1", "gone")}
    assert got["1", "c1"].retrieval == "exact" and got["1", "c1"].score == 1.0  # seen before: only the score comes
    two, gone = got["1", "c2"], got["1", "gone"]
    assert (two.retrieval, two.work, two.period, two.verse, two.passage) == ("semantic", "w2", "from meta", "7", "வேறு வரி")
    assert (gone.work, gone.author, gone.verse, gone.passage) == ("m4", "from meta", "9", None)
    many = _chunks(spark, [(f"d{i:02d}", "அறம்", "அறம்", "w", None, None, None, None, i) for i in range(30)])
    e = Engine(chunks=many, semantic=(v, m, qv), k=3, tau=0.9)
    assert e.search(q).where("retrieval = 'semantic'").count() == 0  # 25 exact hits: the pass is needless
    assert e.search(q, force=True).where("retrieval = 'semantic'").count() == 3


def test_a_failing_resource_is_isolated(spark):
    defs = spark.createDataFrame([(7, "அ", "first")], "def_id long, headword string, meaning string")

    def bad(keys):
        return lookup_definitions(keys.withColumn("key", F.raise_error(F.lit("disk gone")).cast("string")), defs, "bad")

    q = spark.createDataFrame([("1", "அ"), ("2", "ஆ")], "query_id string, query string")
    e = Engine(defs, resources={"bad": bad, "gone": lambda k: spark.read.parquet("/no/such/place")})
    got = {(r.query_id, r.resource, r.status) for r in e.search(q).collect()}
    assert got == {("1", "definitions", "FOUND"), ("2", "definitions", "NOT_FOUND"), *[(i, r, "ERROR") for i in "12" for r in ("bad", "gone")]}
    assert set(e.failed) == {"bad", "gone"} and e.errors(q).count() == 4
    v = spark.createDataFrame([(0, [1.0])], "vector_index long, vector array<float>")
    e = Engine(defs, chunks=_chunks(spark, []), semantic=(v, spark.range(1), v.select(F.lit("1").alias("query_id"), F.col("vector").alias("vec"))))
    assert e.search(q).where("status = 'FOUND'").count() == 1 and "semantic" in e.failed


def test_wordnet(spark):
    keys = spark.createDataFrame([(k, k, 1, k) for k in ("மரம்", "maram", "மரத்தை", "சொல்", "இல்லை")], "query_id string, query string, pass int, key string")
    twn = spark.createDataFrame([("n1", "மரம்", "maram", "noun"), ("n2", "மரம்", "maram", "verb"), ("n3", "மரம்", None, "")], "nodeindex string, unicode_label string, raw_label string, pos string")
    senses = spark.createDataFrame([(2, "மரம்", "maram", "noun", "second"), (1, "மரம்", "maram", "noun", "plant")], "id int, unicode_label string, raw_label string, pos string, hypernym string")
    morph = spark.createDataFrame([("மரத்தை", "marattai", "மரம்", "maram")] * 2, "inflated_unicode string, inflated_raw string, root_unicode string, root_raw string")
    freq = spark.createDataFrame([("சொல்", 3, "col"), ("மரம்", 9, "maram")], "word_unicode string, freq int, word_raw string")
    got = {(r.query_id, r.source_id, r.meaning) for r in lookup_wordnet(keys, twn, senses, morph, freq).collect()}
    want = {(k, f"wordnet:twn:n{i}", m) for k in ("மரம்", "maram") for i, m in ((1, "plant"), (2, None), (3, "plant")) if (k, i) != ("maram", 3)}
    assert got == want | {("மரத்தை", "wordnet:morph:மரம்", None), ("சொல்", "wordnet:freq:சொல்", None)}
    assert lookup_wordnet(keys.limit(0), twn, senses, morph, freq).count() == 0


def test_quantiles_are_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.5, 2.5, 2.5, rnd.random() * 9, None])) for _ in range(700)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in evaluate.percentiles(df, "v", ["g"]).collect()}
    import numpy as np

    for g in ("a", "b", None, "one"):
        v = np.array([x for k, x in rows if k == g and x is not None])
        r = got[g]
        assert (r.n, r.p50, r.p99) == (len(v), round(float(np.percentile(v, 50)), 6), round(float(np.percentile(v, 99)), 6)), g
        assert abs(r.mean - v.mean()) < 1e-6 and r.max == round(float(v.max()), 6)
    assert set(got) == {"a", "b", None, "one"}


def test_stream_keeps_the_newest_whatever_comes_first(spark, tmp_path):
    src, schema = str(tmp_path / "units"), "id string, t string, o int"
    for rows in ([("a", "new", 5), ("b", "one", 1), ("c", None, 4)], [("a", "old", 2), ("b", "two", 2), ("c", "older", 3)], [("d", "last", None), ("b", "again", 2), ("a", "newest", 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    target = str(tmp_path / "ix")
    got = {(r.id, r.token) for r in maintain(spark, src, target, "id", "t", "o", files_per_batch=1, buckets=4).collect()}
    assert got == {("a", "newest"), ("b", "two"), ("d", "last")}
    spark.createDataFrame([("d", "later", 1), ("e", "more", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    got = {(r.id, r.token) for r in maintain(spark, src, target, "id", "t", "o", files_per_batch=1, buckets=4).collect()}
    assert got == {("a", "newest"), ("b", "two"), ("d", "later"), ("e", "more")}


@pytest.mark.parametrize(
    "text, title, want",
    [("In Tamil Script, x", None, True), ("உள்ளடக்கம்", None, True), ("அறம்", "அறம்", True), ("அறம்", "பொருள்", False), ("இத்தலம் சோழ நாட்டிலுள்ளது.", None, True), ("அறம் செய விரும்பு", None, False),
     ("(பதினென் கீழ்க்கணக்கு நூல்)", None, True), ("(பதினென் கீழ்க்கணக்கு நூல்)" + " வரி" * 40, None, False), (None, None, None)],
)
def test_boilerplate(spark, text, title, want):
    df = spark.createDataFrame([(text, title)], "t string, w string")
    assert df.select(T.is_boilerplate("t", "w").alias("x")).first().x is want


def test_gloss(spark):
    rows = [("நான்கில் ஒரு பங்கு", "கிலோ"), ("பாதி", "படி"), ("பாதி", "பங்கு"), ("நான்கில் ஒரு பங்கு", "பகுதி"), ("வேறு; x", "கஜம்"), ("\\frac{1}{4} x 1/4", "மணி")]
    df = spark.createDataFrame(rows, "s string, u string")
    got = [r.x for r in df.select(T.fraction_gloss(F.lit("கால்"), F.col("u"), F.col("s")).alias("x")).collect()]
    assert got[0] == "நான்கில் ஒரு பங்கு — இங்கு 'கால் கிலோ' என்பது ஒரு கிலோவின் நான்கில் ஒரு பங்கு (¼ kg / 250g)."
    assert got[1].endswith("என்பது ஒரு படியின் பாதி (இரண்டில் ஒரு பங்கு).") and got[2].endswith("என்பது பாதி (இரண்டில் ஒரு பங்கு) (½).")
    assert got[3].endswith("என்பது நான்கில் ஒரு பகுதி (¼).") and got[4] == "வேறு — இங்கு 'கால் கஜம்' என்பது ஒரு கஜம்-ன் வேறு." and "15 நிமிடங்கள்" in got[5]
    q = spark.createDataFrame([("f", "கால்", "கால் கிலோ அரிசி"), ("a", "கால்", "நடக்கும்போது கால் வலிக்கிறது")], "query_id string, query string, context string")
    c = q.select("query_id", "query").crossJoin(spark.createDataFrame([(1, "நான்கில் ஒரு பங்கு"), (2, "பாதம்")], "cand int, definition string"))
    got = {r.query_id: r.sense for r in wsd.decide(q, c).collect()}
    assert "'கால் கிலோ'" in got["f"] and got["a"] == "உடல் உறுப்பு / பாதம் — பாதம்"


def test_build_and_sinks(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "one.html").write_bytes("<p>பால காண்டம்</p><p>அறம் செய விரும்பு<br>ஆறுவது சினம் 12</p><p>This webpage presents அறம் செய</p>".encode())
    (raw / "many.txt").write_bytes("1.  ஆத்திசூடி\n\n1. அறம் செய விரும்பு\n2. ஆறுவது சினம்\n\n2.  கொன்றை வேந்தன்\n\n1. அன்னையும் பிதாவும்".encode() + b"\xff")
    works = [("ONE", "ஒன்று", "one.html", "short_stanza", "ஒருவர்"), ("AATHI", "ஆத்திசூடி", "many.txt", None, None), ("LOST", "இல்லை", "none.txt", None, None)]
    m = spark.createDataFrame(works, "work_id string, work string, file_name string, chunk_strategy string, author string")
    p = build.load_pages(spark, m, str(raw)).cache()
    u = build.build_units(p)
    got = {r.chunk_id: r for r in u.collect()}
    assert set(got) == {"PM-ONE-0001", "PM-AATHI-0001", "PM-AATHI-0002"}
    one = got["PM-ONE-0001"]
    assert (one.verse_number, one.canto, one.author, one.normalized_text) == ("12", "பால காண்டம்", "ஒருவர்", "அறம் செய விரும்பு ஆறுவது சினம்")
    assert {(r.work_id, r.status, r.n_units) for r in build.build_status(p, u).collect()} == {("ONE", "OK", 1), ("AATHI", "OK", 2), ("LOST", "FAILED", 0)}
    for _ in range(2):  # a rebuild replaces
        sinks.write_units(u, str(tmp_path / "units"))
        sinks.write_index(u, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "units")).count() == 3 and spark.read.parquet(str(tmp_path / "index")).where("token = 'அறம்'").count() == 2
    sinks.write_manifest(p, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).where("length(checksum_sha256) = 64").count() == 2
    d = sinks.concat_dictionaries([spark.createDataFrame([("ஆ", "2"), ("அ", "1")], "headword string, meaning string"), spark.createDataFrame([("அ", "x", "f")], "headword string, meaning string, source_file string")], ["p", "q"])
    assert [(r.n, r.source_id) for r in d.orderBy("n").collect()] == [(0, "p:p:அ:0"), (1, "p:p:ஆ:1"), (2, "q:f:அ:2")]
    sinks.write_dictionary(d, str(tmp_path / "dict"))
    assert spark.read.json(str(tmp_path / "dict/metadata")).first().asDict() == {"total_entries": 3, "unique_headwords": 2}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vector_index long, vector array<float>")
    items = spark.createDataFrame([(0, "a"), (1, "b")], "vector_index long, chunk_id string")
    sinks.write_vectors(v, items, str(tmp_path / "vec"), "m", "r", "f", 2)
    meta = spark.read.json(str(tmp_path / "vec/metadata"))
    ok = vectors.validate_artifacts(v, items, meta, "m", "r", 2).first()
    assert not any(ok)
    bad = vectors.validate_artifacts(v.union(v.limit(1)), items.withColumn("chunk_id", F.lit("a")), meta, "m2", "r2", 2).first()
    assert bad.wrong_model and bad.wrong_revision and bad.repeated_chunk_id and bad.items_not_vectors and bad.count_not_vectors and bad.n_repeated and not bad.wrong_dimension
    sinks.write_report(ok and items, str(tmp_path / "report"))


def test_readers(spark, tmp_path):
    (tmp_path / "x.sql").write_text("INSERT INTO `t` VALUES (1,'a,(b)','it\\'s',NULL),(x,'q''r','',3);\nINSERT INTO t VALUES (7);\n", encoding="utf-8")
    got = [tuple(r) for r in dictionaries.sql_inserts(spark, str(tmp_path / "x.sql"), "t", ["i", "a", "b", "c"], ("i",), 4).collect()]
    assert got == [(1, "a,(b)", "it's", None), (0, "q'r", "", "3")]
    (tmp_path / "g.json").write_text('[{"query": "அ", "category": "c", "gold_chunk_ids": ["1", "2"]}, {"category": "d"}]', encoding="utf-8")
    assert [(r.query, r.gold_chunk_ids) for r in dictionaries.gold_set(spark, str(tmp_path / "g.json")).collect()] == [("அ", ["1", "2"])]
    (tmp_path / "v.json").write_text('[{"verse_id": "1", "text": "x"}, {"text": "y"}]', encoding="utf-8")
    assert dictionaries.verse_json(spark, str(tmp_path / "v.json"), "verse_id string, text string, more string").first().more is None


def test_pipeline(spark):
    defs = spark.createDataFrame([(1, "கால்", "நான்கில் ஒரு பங்கு; பாதம்"), (2, "கால்", "காற்று, மரம்")], "def_id long, headword string, meaning string")
    q = spark.createDataFrame([("1", " கால் ", "கால் கிலோ அரிசி"), ("2", "இல்லை", None), ("3", " ", None)], "query_id string, query string, context string")
    r = compose.process(Engine(defs, chunks=_chunks(spark, [("c", "ஒரு கால் உண்டு", "x", "குறள்", None, None, None, "1", 1)])), q, defs)
    got = {x.query_id: x for x in r.collect()}
    assert set(got) == {"1", "2"} and got["2"].unknown and got["2"].uncertainties == ["no evidence found"] and got["2"].meaning is None
    one = got["1"]
    assert one.lemma == "கால்" and one.meaning == "நான்கில் ஒரு பங்கு; பாதம்; காற்று, மரம்" and one.sense_status == "selected" and "passages" in one.interpretation and one.sources == "definitions,corpus"
    assert one.related_words == ["பாதம்", "காற்று", "மரம்"] or "பாதம்" in one.related_words
    two = compose.shown(r.where("query_id = '1'")).first()
    assert len(two.senses) == 2 and len(two.related_words) <= 3
    items = spark.createDataFrame([("q", "k", None, "w", "Sangam", "corpus", "first\nwith k here", 1), ("q", "k", None, "திருக்குறள்", "Epic", "verses", "வரி\n" + "k" * 100, 2)], "query_id string, query string, lemma string, work string, period string, resource string, passage string, rank int")
    assert compose.header_quote(items).first().quote == "k" * 80 + "..."
    assert compose.filter_literary(items, "sangam").count() == 1 and compose.filter_literary(items, "All", "verses").count() == 1 and compose.filter_literary(items, None, "All").count() == 2


def test_coverage(spark):
    cases = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "d")], "case_id string, category string")
    hits = spark.createDataFrame([("1", "m", "a", True), ("2", "m", "a", True), ("2", "l", "b", False), ("2", "x", "a", False)], "case_id string, resource string, lemma string, guessed boolean")
    got = {r.category: r for r in evaluate.resource_coverage(hits, cases, {"m": "morphological", "l": "lexical", "x": "lexical"}).collect()}
    assert got["c"].in_1_pct == 100 and got["c"].in_3_pct == 50 and got["c"].conflict_pct == 50 and got["c"].guesser_only_pct == 50 and got["d"].in_1_pct == 0 and got["all"].n_cases == 3
    assert {(r.resource, r.category, r.n_found) for r in evaluate.single_coverage(hits, cases).collect()} == {("m", "c", 2), ("m", "d", 0), ("l", "c", 1), ("l", "d", 0), ("x", "c", 1), ("x", "d", 0)}
    e = spark.createDataFrame([("1", "அற"), ("2", "பொருள்"), ("3", "x")], "case_id string, expected_lemma string")
    g = spark.createDataFrame([("1", "அறம்"), ("2", "வேறு")], "case_id string, lemma string")
    assert {(r.case_id, r.found, r.matched) for r in evaluate.lemma_match(e, g).collect()} == {("1", True, True), ("2", True, False), ("3", False, False)}
