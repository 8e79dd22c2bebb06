"""Incremental clusters: a stream of events folded into Parquet tables, batch by batch.

Every table is appended to, a partition for each micro-batch, which is written over if the batch comes
again; so a batch counts once, and nothing that was written before is written anew. Within a batch rows are
dealt into buckets, by what they are looked up by, and only the buckets that a batch touches are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import KEY, advance, append_new, dirty_groups, in_groups, rollup
from ..storage import kept

DEDUP = ["source", "stable_id", "scope_kind", "owner"]
#: Buckets of a table; so many partitions at most does a batch write.
BUCKETS = 64


def _bucket(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _write(df: DataFrame, root: str, table: str, batch: int, columns: list[str]) -> None:
    df.withColumn("bucket", _bucket(columns)).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{table}/batch={batch}")


def _read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A table's rows with their batch and bucket."""
    return spark.read.schema(f"{schema}, batch long, bucket int").option("basePath", f"{root}/{table}").parquet(f"{root}/{table}/batch=*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _touched(df: DataFrame, columns: list[str]) -> list[int]:
    """The buckets that rows fall into: BUCKETS numbers at most."""
    return [r[0] for r in df.select(_bucket(columns)).distinct().collect()]


def fold_batch(root: str, batch: DataFrame, number: int) -> None:
    """Append a batch's new events, and the clusters of the groups that they touch, folded anew from all
    their events. Late events are never dropped, and a batch that comes again changes nothing."""
    spark = batch.sparkSession
    batch = batch.persist()
    schema, keys = _ddl(batch), _ddl(batch.select(*DEDUP))
    if number > 0:
        known = _read(spark, root, "key", keys).filter((F.col("batch") < number) & F.col("bucket").isin(_touched(batch, DEDUP))).select(*DEDUP)
    else:
        known = spark.createDataFrame([], batch.select(*DEDUP).schema)
    _write(append_new(known, batch, DEDUP), root, "event", number, KEY)
    fresh = _read(spark, root, "event", schema).filter(F.col("batch") == number)
    _write(fresh.select(*DEDUP), root, "key", number, DEDUP)
    groups = fresh.select(*KEY).distinct()
    mine = _read(spark, root, "event", schema).filter((F.col("batch") <= number) & F.col("bucket").isin(_touched(groups, KEY))).drop("batch", "bucket")
    _write(rollup(in_groups(mine, groups)), root, "cluster", number, ["cluster_id"])
    batch.unpersist()


def events(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The events so far."""
    return _read(spark, root, "event", schema).drop("batch", "bucket")


def clusters(spark: SparkSession, root: str) -> DataFrame:
    """The clusters so far: of each, what the last batch that touched it made of it."""
    return _latest(spark, root, "cluster")


def _latest(spark: SparkSession, root: str, table: str) -> DataFrame:
    found = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}/batch=*")
    columns = [c for c in found.columns if c not in ("batch", "bucket")]
    last = found.groupBy("cluster_id").agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select("x.*")


def run_available(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Fold what a stream of events has, then stop. The checkpoint stands for the cursor."""
    query = events.writeStream.foreachBatch(lambda batch, number: fold_batch(root, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def poll_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captured responses of a source, one JSON object a line, as a stream: each file is read once, and the
    query's checkpoint is the cursor."""
    return spark.readStream.schema(schema).json(path)


def bounds(through: Column, now: Column, grace_secs: int = 90) -> tuple[Column, Column]:
    """(lo, hi] of the next build on ingest time: from the watermark to now less a grace."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.coalesce(through, epoch), now - F.expr(f"interval {grace_secs} seconds")


def build_tick(spark: SparkSession, root: str, schema: str, now: Column, grace_secs: int = 90) -> bool:
    """One build up to now less a grace, from the watermark on; whether there was anything to build.

    Groups that got events in between are folded anew from all events up to there, and the watermark moves. The
    clusters are written before the watermark, so a tick that is lost in between is done again over the same
    bounds, in the same place. What comes in within the grace waits for the next tick, so an event that is
    stamped before now but lands a little later isn't passed over.
    """
    ticks = _watermark(spark, root)
    number, through = ticks if ticks is not None else (0, None)
    lo, hi = spark.range(1).select(*bounds(F.lit(through).cast("timestamp_ntz"), now, grace_secs)).first()
    if hi <= lo:
        return False
    mark = lambda t: F.lit(t).cast("timestamp_ntz")
    known = events(spark, root, schema).filter(F.col("ingest_time") <= mark(hi))
    dirty = kept(dirty_groups(known, mark(lo), mark(hi)))
    waiting = not dirty.isEmpty()
    if waiting:
        _write(rollup(in_groups(known, dirty)), root, "built", number + 1, ["cluster_id"])
    spark.range(1).select(advance(mark(through), mark(hi)).alias("through")).write.mode("overwrite").parquet(f"{root}/watermark/tick={number + 1}")
    return waiting


def _watermark(spark: SparkSession, root: str) -> tuple | None:
    """The last tick's number and how far it came."""
    try:
        found = spark.read.schema("through timestamp_ntz, tick long").option("basePath", f"{root}/watermark").parquet(f"{root}/watermark/tick=*")
    except AnalysisException:  # no tick was yet
        return None
    last = found.agg(F.max(F.struct("tick", "through")).alias("x")).first()["x"]
    return None if last is None else tuple(last)


def built(spark: SparkSession, root: str) -> DataFrame:
    """Clusters as the last build that touched them left them."""
    return _latest(spark, root, "built")
