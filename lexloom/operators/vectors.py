"""Dense vectors: validation, cosine top-k in blocks, thresholds, merge with exact hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BYTES = 1 << 26  #: bytes of query vectors broadcast at once


def validate(df: DataFrame, id_col: str, vec_col: str, dim: int, tol: float = 1e-3) -> DataFrame:
    """One row of counts: rows, nulls, wrong lengths, not finite, zero, not of unit length, repeated ids."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double")))
    x = df.select(F.col(id_col).alias("id"), F.col(vec_col).isNull().alias("null"), (F.size(vec_col) != dim).alias("len"), bad.alias("bad"), norm.alias("norm"))
    fit = ~F.col("null") & ~F.col("len") & ~F.col("bad")
    return x.agg(
        F.count("*").alias("n_rows"), F.count_if("null").alias("n_null"), F.count_if(~F.col("null") & F.col("len")).alias("n_wrong_length"), F.count_if(~F.col("null") & ~F.col("len") & F.col("bad")).alias("n_not_finite"),
        F.count_if(fit & (F.col("norm") == 0)).alias("n_zero"), F.count_if(fit & (F.col("norm") > 0) & (F.abs(F.col("norm") - 1) > tol)).alias("n_not_unit"), (F.count("*") - F.countDistinct("id")).alias("n_repeated"),
        F.round(F.min(F.when(fit, F.col("norm"))), 6).alias("min_norm"), F.round(F.max(F.when(fit, F.col("norm"))), 6).alias("max_norm"),
    )


def validate_artifacts(vectors: DataFrame, items: DataFrame, meta: DataFrame, model_id: str, revision: str, dim: int, tol: float = 1e-3) -> DataFrame:
    """One row of violations of a stored index; all are 0 if it may be used.

    ``vectors`` (vector_index, vector), ``items`` (vector_index, chunk_id), ``meta``
    one row (schema_version, model_id, model_revision, dimension, vector_count).
    """
    m = meta.agg(
        F.count_if(F.col("schema_version").isNull()).alias("no_schema_version"), F.count_if(~F.col("model_id").eqNullSafe(F.lit(model_id))).alias("wrong_model"),
        F.count_if(~F.col("model_revision").eqNullSafe(F.lit(revision))).alias("wrong_revision"), F.count_if(~F.col("dimension").eqNullSafe(F.lit(dim))).alias("wrong_dimension"),
        (F.count("*") != 1).cast("long").alias("no_metadata"), F.max("vector_count").alias("said"),
    )
    i = items.agg(
        F.count("*").alias("n_items"), F.count_if(F.coalesce("chunk_id", F.lit("")) == "").alias("no_chunk_id"), (F.count("chunk_id") - F.countDistinct("chunk_id")).alias("repeated_chunk_id"),
        F.countDistinct("vector_index").alias("n_indexes"), F.min("vector_index").alias("low"), F.max("vector_index").alias("high"),
    )
    v = validate(vectors, "vector_index", "vector", dim, tol)
    x = m.crossJoin(i).crossJoin(v)  # one row each
    gap = ~((F.col("low") == 0) & (F.col("high") == F.col("n_items") - 1) & (F.col("n_indexes") == F.col("n_items")))
    return x.select(
        "no_metadata", "no_schema_version", "wrong_model", "wrong_revision", "wrong_dimension", (F.col("n_items") != F.col("n_rows")).cast("long").alias("items_not_vectors"),
        (~F.col("said").eqNullSafe(F.col("n_rows"))).cast("long").alias("count_not_vectors"), F.coalesce(gap, F.lit(True)).cast("long").alias("not_contiguous"), "no_chunk_id", "repeated_chunk_id",
        "n_null", "n_wrong_length", "n_not_finite", "n_zero", "n_not_unit", "n_repeated",
    )


def unit(vec_col: str):
    """The vector in double precision, divided by its length."""
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double")))
    return F.transform(vec_col, lambda x: x.cast("double") / norm)


def mean_pool(tokens: str, mask: str):
    """Masked mean over token vectors: ``array<array<double>>`` and ``array<int>`` -> one vector."""
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda z, x: z + x), F.lit(1))
    kept = F.filter(F.arrays_zip(F.col(tokens).alias("t"), F.col(mask).alias("m")), lambda z: z["m"] > 0)
    total = F.aggregate(F.transform(kept, lambda z: z["t"]), F.array_repeat(F.lit(0.0), F.size(F.get(tokens, F.lit(0)))), lambda z, x: F.zip_with(z, x, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def topk(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_col: str, k: int = 25, own: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the k highest cosines of every query against all rows; with ``own`` a row is no hit of its own id.

    Query vectors go to the scan by BYTES at a time; a task keeps its k best of a
    query while it reads, so the shuffle carries k rows a task and query.  Score
    descending, then id ascending.
    """
    q = queries.select(F.col(query_col).alias("q"), unit(vec_col).alias("v")).where("v is not null").dropDuplicates(["q"])
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").dropDuplicates(["id"])
    (q_kind, id_kind), out = (dict(q.dtypes)["q"], dict(src.dtypes)["id"]), None
    dim, n = q.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.count("*")).first()
    blocks = max(1, -(-n * dim * 8 // BYTES))
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        rows = part.where(F.size("v") == dim).collect()
        held = src.sparkSession.sparkContext.broadcast(([r["q"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, dim)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            asked, m = held.value
            names = np.array(asked)
            best: pd.DataFrame | None = None
            kth = np.full(len(asked), -np.inf)
            for pdf in batches:
                pdf = pdf[pdf["v"].map(len) == dim]
                if not len(pdf) or not len(asked):
                    continue
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                fit = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
                x, ids = x[fit] / norm[fit], pdf["id"].to_numpy()[fit]
                if not len(ids):
                    continue
                for a in range(0, len(asked), 1000):
                    s = np.round(m[a : a + 1000] @ x.T, 6)
                    if own:
                        s[names[a : a + 1000, None] == ids[None, :]] = -np.inf
                    at = max(0, s.shape[1] - k)
                    low = np.maximum(kth[a : a + 1000], np.partition(s, at, axis=1)[:, at])
                    i, j = np.nonzero((s >= low[:, None]) & np.isfinite(s))
                    if len(i):
                        more = pd.DataFrame({"q": i + a, "id": ids[j], "score": s[i, j]})
                        best = more if best is None else pd.concat([best, more])
                if best is None:
                    continue
                best = best.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
                best = best[best.groupby("q").cumcount() < k]
                full = best.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                kth[full.index.to_numpy(dtype=np.int64)] = full["min"].to_numpy()
            if best is not None:
                yield pd.DataFrame({"query_id": [asked[i] for i in best["q"]], "id": best["id"].to_list(), "score": best["score"].to_numpy()})

        x = src.mapInPandas(run, f"query_id {q_kind}, id {id_kind}, score double")
        out = x if out is None else out.unionByName(x)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)  # type: ignore[union-attr]


def merge(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """Exact hits keep their row and gain a score; semantic hits come only for units not seen exactly."""
    old = exact.join(semantic.select("query_id", "id", "score"), ["query_id", "id"], "left").withColumn("retrieval", F.lit("exact"))
    new = semantic.join(exact.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "score").withColumn("retrieval", F.lit("semantic"))
    return old.select("query_id", "id", "score", "retrieval").unionByName(new)
