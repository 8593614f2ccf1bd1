"""Batched evidence retrieval: lookups, lemma expansion, gate to the vector pass, merge and rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.index import CAP, phrase_lookup, positions
from lexloom.operators.rank import first_wins, priority
from lexloom.operators.vectors import topk
from lexloom.session import cut

#: Resources in lookup order; the position is part of the ordinal.
RESOURCES = ("morphology", "definitions", "dictionary", "wordnet", "verses", "corpus")
LEXICAL, LITERARY = ("definitions", "dictionary", "wordnet"), ("verses", "corpus")
COLUMNS = (
    "query_id query pass resource row_key surface lemma meaning passage work author period genre verse source_id evidence_type analysis_type status retrieval error score"
).split()
SEMANTIC_K, SEMANTIC_TAU = 25, 0.845  #: candidates of the vector pass, and the least similarity that counts


def _row(df: DataFrame, resource: str, **given) -> DataFrame:
    fixed = {"resource": F.lit(resource), "status": F.lit("FOUND"), "retrieval": F.lit("exact"), **given}
    none = lambda c: F.lit(None).cast("double" if c == "score" else "string")
    return df.select(*[(fixed[c] if c in fixed else F.col(c) if c in df.columns else none(c)).alias(c) for c in COLUMNS])


def _asked(keys: DataFrame) -> DataFrame:
    """The distinct keys: tables are cut down to them before anything else is done with their rows."""
    return keys.select("key").distinct()


def lookup_definitions(keys: DataFrame, definitions: DataFrame, resource: str = "definitions") -> DataFrame:
    """Exact headword lookup; ``keys`` has (query_id, query, pass, key)."""
    d = definitions.select(F.col("headword").alias("key"), "meaning", F.col("def_id").cast("string").alias("row_key")).where("meaning is not null and meaning <> ''")
    x = keys.join(d.join(_asked(keys), "key", "left_semi").distinct(), "key")
    source = F.concat(F.lit(f"{resource}:"), "row_key")
    return _row(x, resource, surface=F.col("key"), lemma=F.col("key"), source_id=source, evidence_type=F.lit("lexical"))


def lookup_verses(keys: DataFrame, tokens: DataFrame, verses: DataFrame) -> DataFrame:
    """Verses with a token equal to the key in its raw or its normalised form; each verse once.

    The two-column condition is an equi-join on the exploded forms.
    """
    t = tokens.select("verse_id", F.explode(F.array_distinct(F.array("token", "normalized_token"))).alias("key")).where("key <> ''")
    hits = keys.join(t.join(_asked(keys), "key", "left_semi").distinct(), "key")
    v = verses.select("verse_id", "classical_tamil", "modern_tamil", "source_text", "speaker_role", "layer")
    x = hits.join(v.join(hits.select("verse_id").distinct(), "verse_id", "left_semi").dropDuplicates(["verse_id"]), "verse_id")
    return _row(
        x, "verses", row_key=F.col("verse_id"), surface=F.col("key"), passage=F.col("classical_tamil"), meaning=F.col("modern_tamil"), work=F.col("source_text"), author=F.col("speaker_role"),
        genre=F.col("layer"), verse=F.col("verse_id"), source_id=F.concat(F.lit("verses:"), "verse_id"), evidence_type=F.lit("literary_context"),
    )


def _units(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The units of the ids, each once."""
    c = chunks.select("chunk_id", "normalized_text", "original_text", "work", "author", "period", "genre", "verse_number", "stanza_number")
    return c.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])


def lookup_corpus(keys: DataFrame, pos: DataFrame, chunks: DataFrame, cap: int = CAP) -> DataFrame:
    """Units of the corpus that hold the key as a phrase, the first ``cap`` ids of every key."""
    k = keys.select(F.col("key").alias("query_id"), F.col("key").alias("phrase")).distinct()
    hits = phrase_lookup(pos, k, cap).select(F.col("query_id").alias("key"), F.col("id").alias("chunk_id"))
    x = keys.join(hits, "key").join(_units(chunks, hits), "chunk_id")
    verse = F.coalesce("verse_number", F.col("stanza_number").cast("string"))
    return _row(x, "corpus", row_key=F.col("chunk_id"), surface=F.col("key"), passage=F.col("normalized_text"), verse=verse, source_id=F.col("chunk_id"), evidence_type=F.lit("literary_context"))


def lookup_semantic(asked: DataFrame, vectors: DataFrame, meta: DataFrame, chunks: DataFrame, k: int = SEMANTIC_K, tau: float = SEMANTIC_TAU) -> DataFrame:
    """Units whose vectors are most similar to those of (query_id, query, lemma, vec): the first ``k``, of them those of ``tau`` or more.

    Fields come from the unit, where it has none (or it is missing) from the
    vector's metadata; ties go to the smaller unit id.
    """
    m = meta.where("chunk_id is not null").groupBy("vector_index").agg(F.min(F.struct("chunk_id", "work_name", "author", "period", "genre", "stanza_number")).alias("m")).select("vector_index", "m.*")
    v = vectors.join(m.select("vector_index", "chunk_id"), "vector_index").select("chunk_id", "vector").groupBy("chunk_id").agg(F.max("vector").alias("vector"))
    best = topk(v, "chunk_id", "vector", asked.select("query_id", F.col("vec").alias("vector")), "query_id", k, own=False).where(F.col("score") >= tau)
    best = best.select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score")).join(asked.drop("vec").dropDuplicates(["query_id"]), "query_id")
    item = m.drop("vector_index").join(best.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    item = item.select("chunk_id", *[F.col(c).alias(f"m_{c}") for c in ("work_name", "author", "period", "genre", "stanza_number")])
    x = best.join(item, "chunk_id", "left").join(_units(chunks, best), "chunk_id", "left")
    field = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    verse = F.coalesce("verse_number", F.col("stanza_number").cast("string"), F.col("m_stanza_number").cast("string"))
    return _row(
        x.withColumn("pass", F.lit(3)), "corpus", row_key=F.col("chunk_id"), surface=F.col("query"), lemma=F.col("lemma"), passage=F.col("original_text"), work=field("work", "m_work_name"),
        author=field("author", "m_author"), period=field("period", "m_period"), genre=field("genre", "m_genre"), verse=verse, source_id=F.col("chunk_id"), evidence_type=F.lit("literary_context"),
        retrieval=F.lit("semantic"), score=F.col("score"),
    )


def lookup_morphology(keys: DataFrame, analyses: DataFrame) -> DataFrame:
    """Precomputed analyses (surface, lemma, tags, model); core models before guessers."""
    a = analyses.select(F.col("surface").alias("key"), "lemma", "model", "tags").distinct()
    x = keys.join(a, "key")
    kind = F.when(F.lower("model").contains("guess"), "guesser").otherwise("core")
    return _row(x, "morphology", row_key=F.concat_ws("|", kind, "model", "lemma", F.coalesce("tags", F.lit(""))), surface=F.col("key"), analysis_type=kind, source_id=F.concat(F.lit("morphology:"), "model"), evidence_type=F.lit("morphology"))


def _forms(df: DataFrame, unicode: str, raw: str) -> DataFrame:
    """``df`` once for each of its two spellings, as ``key``."""
    return df.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(unicode, raw)))))


def lookup_wordnet(keys: DataFrame, twn: DataFrame, senses: DataFrame, morph: DataFrame, freq: DataFrame) -> DataFrame:
    """Lexical rows with their first sense of the same part of speech, roots of inflected forms, a frequency row if there is neither."""
    asked = _asked(keys)
    forms = _forms(twn.select("nodeindex", "unicode_label", "raw_label", "pos"), "unicode_label", "raw_label").join(asked, "key", "left_semi")
    lex = first_wins(keys.join(forms, "key"), ["query_id", "pass", "key", "nodeindex", "unicode_label", "pos"], ["raw_label"])
    s = _forms(senses.select("unicode_label", "raw_label", F.col("pos").alias("sense_pos"), "hypernym", "id"), "unicode_label", "raw_label").join(asked, "key", "left_semi")
    s = s.select(F.col("key").alias("sense_key"), "sense_pos", "hypernym", "id")
    fits = (F.col("key") == F.col("sense_key")) & ((F.coalesce("pos", F.lit("")) == "") | (F.col("sense_pos") == F.col("pos")))
    one = first_wins(lex.join(s, fits, "left"), ["query_id", "pass", "key", "nodeindex", "unicode_label", "pos"], [F.asc_nulls_last("id")])
    a = _row(
        one, "wordnet", row_key=F.concat(F.lit("1"), F.col("nodeindex").cast("string")), surface=F.col("key"), lemma=F.col("unicode_label"), meaning=F.col("hypernym"),
        source_id=F.concat(F.lit("wordnet:twn:"), F.col("nodeindex").cast("string")), evidence_type=F.lit("lexical"),
    )
    m = _forms(morph.select("root_unicode", "inflated_unicode", "inflated_raw"), "inflated_unicode", "inflated_raw").select("key", "root_unicode").join(asked, "key", "left_semi").distinct()
    b = _row(
        keys.join(m, "key"), "wordnet", row_key=F.concat(F.lit("2"), "root_unicode"), surface=F.col("key"), lemma=F.col("root_unicode"), source_id=F.concat(F.lit("wordnet:morph:"), "root_unicode"),
        evidence_type=F.lit("morphology"),
    )
    both = a.unionByName(b)
    f = freq.select(F.col("word_unicode").alias("key")).join(asked, "key", "left_semi").distinct()
    rest = keys.join(both.select("query_id", "pass", F.col("surface").alias("key")).distinct(), ["query_id", "pass", "key"], "left_anti").join(f, "key")
    c = _row(rest, "wordnet", row_key=F.lit("3"), surface=F.col("key"), lemma=F.col("key"), source_id=F.concat(F.lit("wordnet:freq:"), "key"), evidence_type=F.lit("frequency"))
    return both.unionByName(c)


def sentinels(keys: DataFrame, found: DataFrame, resource: str) -> DataFrame:
    """Absence is a row: one NOT_FOUND row for every query without a hit in the resource."""
    miss = keys.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return _row(miss, resource, row_key=F.lit(""), surface=F.col("query"), status=F.lit("NOT_FOUND"), evidence_type=F.lit("lexical"), retrieval=F.lit(None).cast("string"))


def lemmas(evidence: DataFrame) -> DataFrame:
    """(query_id, query, lemma) discovered by the first pass, other than the query itself."""
    x = evidence.where("status = 'FOUND'").select("query_id", "query", F.explode(F.array("lemma", "surface")).alias("lemma"))
    return x.where("lemma is not null and trim(lemma) <> '' and lemma <> query").distinct()


def dedupe(evidence: DataFrame) -> DataFrame:
    """First wins in order of pass, lemma, resource and row: corpus rows by unit, then all by six fields."""
    order = [F.col("pass"), F.coalesce("surface", F.lit("")), F.array_position(F.array(*[F.lit(r) for r in RESOURCES]), F.col("resource")), F.col("row_key")]
    corpus = (F.col("resource") == "corpus") & (F.col("status") == "FOUND")
    a = first_wins(evidence.where(corpus), ["query_id", "source_id"], order).unionByName(evidence.where(~corpus))
    keys = ["query_id", *[F.coalesce(c, F.lit("\0")) for c in ("resource", "evidence_type", "surface", "lemma", "passage", "source_id")]]
    return first_wins(a, keys, order)


def ranked(evidence: DataFrame) -> DataFrame:
    """Evidence with its rank in the query: the priority keys, then the order of retrieval."""
    from pyspark.sql import Window

    k = priority(F.col("status"), F.coalesce("analysis_type", F.lit("")), F.col("surface"), F.col("lemma"), F.col("query"), F.col("evidence_type"))
    order = [*[x.desc() for x in k], "pass", F.array_position(F.array(*[F.lit(r) for r in RESOURCES]), F.col("resource")), "row_key", F.coalesce("surface", F.lit(""))]
    return evidence.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))


def gate(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_corpus, n_literary, n_lexical, n_morphology, skip): whether the vector pass is needless."""
    ok = F.col("status") == "FOUND"
    n = lambda c: F.count_if(ok & c)
    g = evidence.groupBy("query_id").agg(
        n((F.col("resource") == "corpus") & (F.col("retrieval") == "exact")).alias("n_corpus"),
        n(F.col("resource").isin(*LITERARY) & (F.col("evidence_type") == "literary_context")).alias("n_literary"),
        n(F.col("resource").isin(*LEXICAL)).alias("n_lexical"),
        n(F.col("resource") == "morphology").alias("n_morphology"),
    )
    x = queries.select("query_id").distinct().join(g, "query_id", "left").na.fill(0)
    return x.withColumn("skip", (F.col("n_corpus") >= CAP) | ((F.col("n_literary") >= 10) & ((F.col("n_lexical") > 0) | (F.col("n_morphology") > 0))))


def support(evidence: DataFrame) -> DataFrame:
    """(query_id, target, sources): the resources with evidence for the query or one of its lemmas."""
    ok = evidence.where("status = 'FOUND'")
    targets = ok.select("query_id", F.explode(F.array("query", "lemma")).alias("target")).where("trim(target) <> ''").distinct()
    has = ok.where("coalesce(retrieval, '') <> 'semantic'").select("query_id", "resource", F.explode(F.array_distinct(F.array_compact(F.array("surface", "lemma")))).alias("target")).distinct()
    return has.join(targets, ["query_id", "target"]).groupBy("query_id", "target").agg(F.array_join(F.array_sort(F.collect_set("resource")), ",").alias("sources"))


def summary(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query and resource, zero-filled: status, entries, core and guessed analyses (morphology only)."""
    r = queries.sparkSession.createDataFrame([(x,) for x in RESOURCES], "resource string")
    g = evidence.where("status = 'FOUND'").groupBy("query_id", "resource").agg(F.count("*").alias("n"), F.count_if(F.col("analysis_type") == "core").alias("core"), F.count_if(F.col("analysis_type") == "guesser").alias("guess"))
    e = evidence.where("status = 'ERROR'").select("query_id", "resource").distinct().withColumn("error", F.lit(True))
    x = queries.select("query_id").distinct().crossJoin(F.broadcast(r)).join(g, ["query_id", "resource"], "left").join(e, ["query_id", "resource"], "left")  # six fixed rows
    fst = F.col("resource") == "morphology"
    return x.select(
        "query_id", "resource", F.when(F.col("n") > 0, "FOUND").when(F.col("error"), "ERROR").otherwise("NOT_FOUND").alias("status"), F.coalesce("n", F.lit(0)).alias("total_entries"),
        F.when(fst, F.coalesce("core", F.lit(0))).alias("core_analyses"), F.when(fst, F.coalesce("guess", F.lit(0))).alias("guesser_analyses"),
    )


class Engine:
    """All three passes over a batch of queries; resources that are not given have no hits.

    ``resources`` may name further (or replace these) lookups: name -> function of
    the keys.  ``semantic`` has the vectors, their metadata and the vectors of the
    queries (query_id, vec).
    """

    def __init__(
        self, definitions=None, tokens=None, verses=None, chunks=None, analyses=None, dictionary=None, wordnet: tuple | None = None, semantic: tuple | None = None,
        resources: dict | None = None, k: int = SEMANTIC_K, tau: float = SEMANTIC_TAU,
    ):
        self.chunks, self.semantic, self.k, self.tau, self.failed = chunks, semantic, k, tau, {}
        res: dict = {}
        if analyses is not None:
            res["morphology"] = lambda keys: lookup_morphology(keys, analyses)
        if definitions is not None:
            res["definitions"] = lambda keys: lookup_definitions(keys, definitions)
        if dictionary is not None:
            res["dictionary"] = lambda keys: lookup_definitions(keys, dictionary, "dictionary")
        if wordnet is not None:
            res["wordnet"] = lambda keys: lookup_wordnet(keys, *wordnet)
        if verses is not None:
            res["verses"] = lambda keys: lookup_verses(keys, tokens, verses)
        if chunks is not None:
            pos = positions(chunks, "chunk_id", "normalized_text")
            res["corpus"] = lambda keys: lookup_corpus(keys, pos, chunks)
        res |= resources or {}
        self.res = {n: res[n] for n in (*RESOURCES, *sorted(set(res) - set(RESOURCES))) if n in res}

    def _each(self, keys: DataFrame, names: list[str], stage: str) -> tuple[DataFrame | None, dict[str, str]]:
        """The hits of the resources as a written table, and the errors of those that failed; the others' hits stay."""
        try:
            parts = [self.res[n](keys) for n in names]
            return (cut(reduce(DataFrame.unionByName, parts), stage) if parts else None), {}
        except Exception:  # noqa: BLE001 - some resource fails; each is tried alone
            done, errors = [], {}
            for n in names:
                try:
                    done.append(cut(self.res[n](keys), f"{stage}-{n}"))
                except Exception as e:  # noqa: BLE001 - isolated: the error becomes a row
                    errors[n] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
            return (reduce(DataFrame.unionByName, done) if done else None), errors

    def search(self, queries: DataFrame, force: bool = False) -> DataFrame:
        """Evidence of (query_id, query): surface lookups with sentinels and errors, lookups of every lemma, vectors where these are thin; deduplicated.

        ``failed`` then holds the errors by resource.
        """
        q = cut(queries.where("trim(query) <> ''").select("query_id", F.trim("query").alias("query")).distinct(), "queries")
        keys = q.withColumn("pass", F.lit(1)).withColumn("key", F.col("query"))
        # written once: the sentinels and the lemmas of the second pass are taken from it
        found, self.failed = self._each(keys, list(self.res), "pass1")
        empty = _row(keys.limit(0), "")
        found = empty if found is None else found
        rows = [found, *[sentinels(keys, found.where(F.col("resource") == n), n) for n in self.res if n not in self.failed]]
        rows += [_row(keys, n, row_key=F.lit(""), surface=F.col("query"), status=F.lit("ERROR"), evidence_type=F.lit(""), retrieval=F.lit(None).cast("string"), error=F.lit(e)) for n, e in self.failed.items()]
        more = cut(lemmas(found).select("query_id", "query", F.lit(2).alias("pass"), F.col("lemma").alias("key")), "lemmas")
        two, _ = self._each(more, [n for n in self.res if n != "morphology" and n not in self.failed], "pass2")  # what fails only here is left out
        if two is not None:
            rows.append(two)
        out = cut(dedupe(reduce(DataFrame.unionByName, rows)), "evidence")
        return out if self.semantic is None else self._escalate(out, q, more, force)

    def _escalate(self, evidence: DataFrame, q: DataFrame, more: DataFrame, force: bool) -> DataFrame:
        """The third pass, for queries the gate lets through: new units come, units seen before only gain their score."""
        vectors, meta, asked = self.semantic
        lemma = more.groupBy("query_id").agg(F.when(F.countDistinct("key") == 1, F.min("key")).alias("lemma"))
        go = gate(evidence, q).where(F.lit(force) | ~F.col("skip")).select("query_id")
        asked = asked.join(q, "query_id").join(go, "query_id", "left_semi").join(lemma, "query_id", "left").select("query_id", "query", "lemma", "vec")
        try:
            hits = cut(lookup_semantic(asked, vectors, meta, self.chunks, self.k, self.tau), "semantic")
        except Exception as e:  # noqa: BLE001 - the deterministic evidence stands
            self.failed["semantic"] = f"{type(e).__name__}"
            return evidence
        old = F.col("resource") == "corpus"
        score = hits.select("query_id", "source_id", F.col("score").alias("found"))
        seen = evidence.where(old).join(score, ["query_id", "source_id"], "left").withColumn("score", F.coalesce("score", "found")).select(*COLUMNS)
        new = hits.join(evidence.where(old & (F.col("status") == "FOUND")).select("query_id", "source_id"), ["query_id", "source_id"], "left_anti").select(*COLUMNS)
        return cut(evidence.where(~old).unionByName(seen).unionByName(new), "evidence")

    def errors(self, queries: DataFrame) -> DataFrame:
        """(query_id, resource, error) of the last search."""
        spark = queries.sparkSession
        e = spark.createDataFrame(sorted(self.failed.items()), "resource string, error string")
        return queries.select("query_id").distinct().crossJoin(F.broadcast(e))  # a row a resource at most
