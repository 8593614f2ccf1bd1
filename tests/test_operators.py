import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluate, index, rank, vectors, wsd
from lexloom.operators.evidence import Engine, gate, ranked, sentinels, summary, support


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([("c1", "அறம் செய விரும்பு"), ("c2", "அறத்தை செய்"), ("c3", "செய விரும்பு அறம்"), ("c4", None), ("c1", "அறம் செய விரும்பு")], "id string, t string")


def test_index_and_phrases(spark, units):
    pos = index.positions(units, "id", "t")
    assert pos.count() == 8
    q = spark.createDataFrame([("q1", "செய விரும்பு"), ("q2", "விரும்பு செய"), ("q3", "")], "query_id string, phrase string")
    assert {(r.query_id, r.id) for r in index.phrase_lookup(pos, q).collect()} == {("q1", "c1"), ("q1", "c3")}
    t = spark.createDataFrame([("q", "அறம்")], "query_id string, term string")
    assert [r.id for r in index.term_lookup(pos, t).orderBy("rank").collect()] == ["c1", "c3"]  # the root is not its inflection


def test_cap_and_order(spark):
    u = spark.range(34).select(F.format_string("c%02d", "id").alias("id"), F.lit("word").alias("t"))
    t = spark.createDataFrame([("q", "word")], "query_id string, term string")
    got = [r.id for r in index.term_lookup(index.positions(u, "id", "t"), t).orderBy("rank").collect()]
    assert got == [f"c{i:02d}" for i in range(25)]


def test_refresh_replaces(spark, units):
    pos = index.positions(units, "id", "t")
    new = spark.createDataFrame([("c1", "புதிய")], "id string, t string")
    assert {(r.id, r.token) for r in index.refresh(pos, new, "id", "t").where("id = 'c1'").collect()} == {("c1", "புதிய")}


def test_dedupe_is_idempotent_and_order_free(spark):
    x = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, o int")
    a = rank.first_wins(x, ["k"], ["o"])
    assert a.collect() and sorted(map(tuple, a.collect())) == sorted(map(tuple, rank.first_wins(a.repartition(5), ["k"], ["o"]).collect()))
    assert {tuple(r) for r in rank.last_wins(x.repartition(3, "o"), ["k"], ["o"]).collect()} == {(i % 7, i) for i in range(93, 100)}


def test_diverse(spark):
    x = spark.createDataFrame([("q", f"w{i % 4}", 10 - i, f"{i:02d}") for i in range(6)], "q string, work string, s int, o string")
    got = rank.diverse(x, "q", "work", "s", "o", 4).collect()
    assert len({r.work for r in got}) == 4
    assert rank.diverse(x.limit(0), "q", "work", "s", "o", 4).count() == 0


def test_engine(spark):
    tokens = spark.createDataFrame([(1, "மரத்தை", "மரத்தை", "v1", "s"), (2, "மரம்", "மரம்", "v2", "s")], "id long, token string, normalized_token string, verse_id string, source_text string")
    verses = spark.createDataFrame([("v1", "மரத்தை கண்டான்", "a"), ("v2", "மரம்", "b")], "verse_id string, classical_tamil string, layer string").withColumns({c: F.lit(None).cast("string") for c in ("modern_tamil", "source_text", "speaker_role")})
    defs = spark.createDataFrame([(7, "மரம்", "tree")], "def_id long, headword string, meaning string")
    morph = spark.createDataFrame([("மரத்தை", "மரம்", "noun", "acc"), ("மரத்தை", "மர", "noun-guess", None)], "surface string, lemma string, model string, tags string")
    q = spark.createDataFrame([("1", " மரத்தை "), ("2", "இல்லாதது"), ("3", "  ")], "query_id string, query string")
    e = Engine(defs, tokens, verses, None, morph).search(q).cache()
    got = {(r.query_id, r.resource, r.status, r["pass"]) for r in e.collect()}
    assert ("1", "morphology", "FOUND", 1) in got and ("1", "definitions", "FOUND", 2) in got and ("1", "verses", "FOUND", 2) in got
    assert {x for x in got if x[0] == "2"} == {("2", r, "NOT_FOUND", 1) for r in ("morphology", "definitions", "verses")}
    assert not [x for x in got if x[0] == "3"]
    top = ranked(e).where("query_id = '1'").orderBy("rank").collect()
    assert top[0].status == "FOUND" and top[-1].status == "NOT_FOUND" and [r["rank"] for r in top] == list(range(1, len(top) + 1))
    assert {r.target: r.sources for r in support(e).where("query_id = '1'").collect()}["மரம்"] == "definitions,morphology,verses"
    assert not support(e).where("query_id = '2'").count()
    s = {(r.query_id, r.resource): r for r in summary(e, q).collect()}
    assert s["1", "morphology"].core_analyses == 1 and s["1", "morphology"].guesser_analyses == 1 and s["2", "wordnet"].status == "NOT_FOUND" and s["1", "definitions"].core_analyses is None
    assert not any(r.skip for r in gate(e, q).collect())


def test_gate_saturates(spark):
    rows = [("q", "corpus", "FOUND", "exact", "literary_context")] * 25
    e = spark.createDataFrame(rows, "query_id string, resource string, status string, retrieval string, evidence_type string")
    assert gate(e, e).first().skip
    assert sentinels(spark.createDataFrame([("q", "w", 1, "w")], "query_id string, query string, pass int, key string"), e, "corpus").count() == 0


def test_vectors(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i == j) + 0.01 * i * j for j in range(4)]) for i in range(1, 12)], "id long, v array<float>")
    q = v.where("id <= 3")
    monkeypatch.setattr(vectors, "BYTES", 64)
    big = {(r.query_id, r.rank): r.id for r in vectors.topk(v, "id", "v", q, "id", 5).collect()}
    monkeypatch.setattr(vectors, "BYTES", 1 << 26)
    small = {(r.query_id, r.rank): r.id for r in vectors.topk(v.repartition(3), "id", "v", q, "id", 3).collect()}
    assert all(big[k] == small[k] for k in small) and len(big) == 15
    bad = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [3.0, 0.0]), (6, [3.0, 0.0])], "id long, v array<float>")
    r = vectors.validate(bad, "id", "v", 2).first()
    assert (r.n_rows, r.n_null, r.n_wrong_length, r.n_not_finite, r.n_zero, r.n_not_unit, r.n_repeated) == (7, 1, 1, 1, 1, 2, 1)
    p = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[5.0, 6.0]], [1])], "t array<array<double>>, m array<int>")
    assert [r[0] for r in p.select(vectors.mean_pool("t", "m")).collect()] == [[2.0, 3.0], [5.0, 6.0]]
    ex = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string")
    se = spark.createDataFrame([("q", "b", 0.9), ("q", "c", 0.8)], "query_id string, id string, score double")
    assert {tuple(r) for r in vectors.merge(ex, se).select("id", "score", "retrieval").collect()} == {("a", None, "exact"), ("b", 0.9, "exact"), ("c", 0.8, "semantic")}


def test_wsd(spark):
    q = spark.createDataFrame([("f", "கால்", "கால் கிலோ அரிசி வாங்கினான்"), ("a", "கால்", "நடக்கும்போது கால் வலிக்கிறது"), ("b", "கால்", " "), ("u", "கால்", "வானம் நீலம்")], "query_id string, query string, context string")
    senses = [(1, "நான்கில் ஒரு பங்கு"), (2, "உடல் உறுப்பு"), (3, "நாற்காலி தாங்கி")]
    c = q.select("query_id", "query").crossJoin(spark.createDataFrame(senses, "cand int, definition string"))
    got = {r.query_id: r for r in wsd.decide(q, c).collect()}
    assert (got["f"].status, got["f"].cand, got["f"].confidence) == ("selected", 1, "high") and got["f"].score >= 35
    assert (got["a"].status, got["a"].cand) == ("selected", 2)
    assert got["b"].status == "no_context" and got["u"].status == "insufficient_evidence" and got["u"].cand is None
    one = wsd.decide(q.where("query_id = 'f'"), c.where("cand = 1 and query_id = 'f'")).first()
    assert (one.status, one.score, one.confidence) == ("single_sense", 1.0, "medium")


def test_measures(spark):
    r = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.5), ("p", "z", 1, 0.1)], "query_id string, id string, rank int, score double")
    g = spark.createDataFrame([("q", "b"), ("q", "x"), ("p", "y")], "query_id string, id string")
    rel = evaluate.relevance(r, g)
    k = {x.k: x for x in evaluate.k_sweep(rel, [1, 2]).collect()}
    assert k[1].recall == 0 and k[2].recall == 0.25 and k[2].mrr == 0.25
    t = {x.tau: x for x in evaluate.threshold_sweep(rel, [0.0, 0.95]).collect()}
    assert t[0.95].rejected == 1.0 and t[0.95].precision == 0.0 and t[0.0].gold_retention == round(1 / 3, 6)


def test_answers(spark):
    from lexloom.operators import answer

    rows = [
        ("q", "மரம்", "definitions", "1", "மரம்", "மரம்", " tree ", None, "", None, "lexical", "FOUND", 2), ("q", "மரம்", "definitions", "2", "மரம்", "மரம்", "tree", None, "", None, "lexical", "FOUND", 3),
        ("q", "மரம்", "definitions", "3", "மரம்", "மரம்", "wood", None, "", None, "lexical", "FOUND", 1), ("q", "மரம்", "corpus", "c1", "மரம்", None, None, "ஒரு மரம் நின்றது. வேறு\nவரி", "w", "Sangam", "literary_context", "FOUND", 4),
        ("z", "இல்லை", "corpus", "", "இல்லை", None, None, None, None, None, "lexical", "NOT_FOUND", 1),
    ]
    e = spark.createDataFrame(rows, "query_id string, query string, resource string, source_id string, surface string, lemma string, meaning string, passage string, work string, period string, evidence_type string, status string, rank int").withColumn("verse", F.lit("1")).withColumn("analysis_type", F.lit(None).cast("string"))
    q = e.select("query_id", "query").distinct()
    assert [tuple(r) for r in answer.meanings(e).collect()] == [("q", "wood; tree")]
    assert tuple(answer.counts(e).first()) == ("q", 4, 0, 3, 1, 2)
    item = answer.literary(e).first()
    assert item.line == "ஒரு மரம் நின்றது." and item.is_featured and item.can_expand and [(s.start, s.end) for s in item.spans] == [(4, 8)]
    got = {r.query_id: r.answer for r in answer.answers(q, e, summary(e, q)).collect()}
    assert '"unknown":true' in got["z"] and '"meaning":"wood; tree"' in got["q"] and '"sources":"definitions,corpus"' in got["q"]
    t = spark.createDataFrame([("abcdef", [(4, 6), (0, 2), (1, 3)]), ("x", [])], "t string, s array<struct<start:int,end:int>>")
    assert [[(r.text, r.marked) for r in x[0]] for x in t.select(answer.runs("t", "s")).collect()] == [[("ab", True), ("c", True), ("d", False), ("ef", True)], [("x", False)]]


def test_lines_of_verses(spark, tmp_path):
    from lexloom.plans import catalogue

    long = "a " * 70 + "key" + " b" * 70
    spark.createDataFrame([("v1", "one. two key\nthree"), ("v1", "one. two key\nthree"), ("v2", long), ("v3", None)], "verse_id string, classical_tamil string").write.parquet(str(tmp_path / "verses.parquet"))
    words = [("v1", "three"), ("v1", "three"), ("v1", "KEY"), ("v1", "no"), ("v1", None), ("v2", "key"), ("v3", "x")]
    spark.createDataFrame(words, "verse_id string, token string").write.parquet(str(tmp_path / "verse_tokens.parquet"))
    got = {q: sorted(map(tuple, catalogue.queries()[q](spark, str(tmp_path)).collect())) for q in ("relevant_line_verses", "context_window_verses", "highlight_spans_verses")}
    assert got["relevant_line_verses"] == [("v1", "KEY", "two key"), ("v1", "no", "one."), ("v1", "three", "three"), ("v2", "key", long)]
    assert [x for x in got["context_window_verses"] if x[0] == "v2"] == [("v2", "key", "... " + "a " * 20 + "key" + " b" * 30 + " ...")]
    assert got["highlight_spans_verses"] == [("v1", "KEY", 4, 7), ("v1", "three", 0, 5), ("v2", "key", 140, 143)]
