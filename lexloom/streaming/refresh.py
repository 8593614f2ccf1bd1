"""The index kept up to date by a stream of new and changed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import index_tokens
from lexloom.session import remove

BUCKETS = 64  #: parts of the index; a batch rewrites those its units fall into


def _postings(units: DataFrame) -> DataFrame:
    """(bucket, id, at, pos, token): a row a token, and one of position -1 that keeps the unit's time whatever its text holds."""
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("token")))
    tokens = F.transform(index_tokens("t"), lambda w, i: F.struct(i.alias("pos"), w.alias("token")))
    return units.select("bucket", "id", "at", F.explode(F.concat(mark, F.coalesce(tokens, F.array()))).alias("p")).select("bucket", "id", "at", "p.pos", "p.token")


def maintain(spark: SparkSession, source: str, target: str, id_col: str, text_col: str, order_col: str, files_per_batch: int = 4, buckets: int = BUCKETS) -> DataFrame:
    """Reads units from the files of the folder ``source`` as they come, keeps their index under ``target`` and returns it: (id, pos, token).

    Of one unit the row of the highest ``order_col`` counts (null is the lowest),
    in whatever order rows arrive: a late older row changes nothing, a row of the
    same time neither.  The index is parted by hash of the unit; a micro-batch
    rewrites only the parts its units fall into, then writes a marker that names
    the version of every part.  A batch that is run again after a failure starts
    from the marker before it, so it changes nothing; parts that two markers no
    longer name are removed.
    """
    schema = spark.read.parquet(source).schema
    kind = schema[order_col].dataType.simpleString()
    table = f"bucket int, id {schema[id_col].dataType.simpleString()}, at {kind}, pos int, token string"

    def marker(s: SparkSession, n: int) -> dict[int, int]:
        """Version of every part after batch n; at most ``buckets`` rows."""
        return {r["bucket"]: r["version"] for r in s.read.schema("bucket int, version long").json(f"{target}/marker/{n}").collect()} if n >= 0 else {}

    def parts(s: SparkSession, versions: dict[int, int]) -> DataFrame:
        out = s.createDataFrame([], table)
        for v in sorted(set(versions.values())):
            paths = [f"{target}/v{v}/bucket={b}" for b, w in versions.items() if w == v]
            out = out.unionByName(s.read.schema(table).option("basePath", f"{target}/v{v}").parquet(*paths).select("bucket", "id", "at", "pos", "token"))
        return out

    def step(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
        units = batch.where(F.col(id_col).isNotNull()).select(bucket.alias("bucket"), F.col(id_col).alias("id"), F.col(order_col).alias("at"), F.col(text_col).alias("t"))
        w = Window.partitionBy("id").orderBy(F.desc_nulls_last("at"), F.desc("t"))
        new = units.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").persist()
        before = marker(s, n - 1)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = parts(s, {b: before[b] for b in touched if b in before})
        have = old.where("pos = -1").select("id", F.col("at").alias("was"))
        newer = F.col("was").isNull() & F.col("at").isNotNull() | (F.col("at") > F.col("was"))
        fresh = new.join(have.withColumn("known", F.lit(True)), "id", "left").where(F.col("known").isNull() | newer).select("bucket", "id", "at", "t")
        kept = old.join(fresh.select("id"), "id", "left_anti").select("bucket", "id", "at", "pos", "token")
        kept.unionByName(_postings(fresh)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{n}")
        now = before | {b: n for b in touched}
        s.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{target}/marker/{n}")
        new.unpersist()
        older = marker(s, n - 2) if n > 1 else {}
        for b, v in older.items():
            if before.get(b) != v:
                remove(s, f"{target}/v{v}/bucket={b}")

    q = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        .writeStream.foreachBatch(step).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = max([x["batchId"] for x in q.recentProgress if x["numInputRows"]], default=-1)
    return parts(spark, marker(spark, last)).where("pos >= 0").select("id", "pos", "token")
