"""The operation log as a stream that keeps a change-run store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiverlake.functions.tenants import tenant_of
from quiverlake.operators.change_runs import ChangeRuns, changes_of
from quiverlake.session import list_names, written

POSITIONS = "tenant_id string, shard int, seq bigint"


def read_log_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """New Parquet files of a folder of log records, as a stream; a trigger takes up to max_files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


class MissingRecords(RuntimeError):
    """A log goes on beyond the record that has to come next."""


def next_records(batch: DataFrame, applied: DataFrame) -> DataFrame:
    """(tenant_id, shard, last_seq, next_seq): how far each log of a batch may be applied, and the
    record that it lacks next (null if it lacks none).

    batch: tenant_id, shard, seq; applied: tenant_id, shard, seq of the last record applied (none: 0).
    Repeats of applied records are no matter. last_seq is where the records that follow each other
    from applied + 1 on end.
    """
    rows = batch.where(F.col("shard").isNotNull() & F.col("seq").isNotNull()).select(tenant_of().alias("tenant_id"), "shard", F.col("seq").cast("bigint").alias("seq"))
    done = applied.select(tenant_of().alias("tenant_id"), "shard", F.col("seq").cast("bigint").alias("q_done"))
    zero = F.lit(0).cast("bigint")
    new = rows.join(done, ["tenant_id", "shard"], "left").withColumn("q_done", F.coalesce("q_done", zero))
    mark = lambda seq, here: F.struct(seq.alias("seq"), F.lit(here).alias("here"))
    later = F.filter(F.array(mark(F.col("seq"), True), mark(F.col("seq") + 1, False), mark(F.col("q_done") + 1, False)), lambda m: m["seq"] > F.col("q_done"))
    seqs = new.select("tenant_id", "shard", F.explode(later).alias("m")).groupBy("tenant_id", "shard", "m.seq").agg(F.bool_or("m.here").alias("here"))
    ends = seqs.groupBy("tenant_id", "shard").agg(F.min(F.when(~F.col("here"), F.col("seq"))).alias("q_gap"), F.max(F.when(F.col("here"), F.col("seq"))).alias("q_most"))
    return ends.select("tenant_id", "shard", (F.col("q_gap") - 1).alias("last_seq"), F.when(F.col("q_most") > F.col("q_gap"), F.col("q_gap")).alias("next_seq"))


def _positions(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """(number, rows) of the newest written positions."""
    names = [n for n in list_names(spark, root) if n.isdigit() and "_SUCCESS" in list_names(spark, f"{root}/{n}")]
    if not names:
        return 0, spark.createDataFrame([], POSITIONS)
    last = max(names, key=int)
    return int(last), spark.read.schema(POSITIONS).parquet(f"{root}/{last}")


def follow(log: DataFrame, store: ChangeRuns, checkpoint: str, available_now: bool = True, strict: bool = False) -> StreamingQuery:
    """Append each micro-batch of the log to the store as one run.

    strict: a batch in which a log lacks the record after the last one applied ends the query with
    MissingRecords before anything of it is applied; positions are kept beside the checkpoint.

    A batch that Spark delivers again after a failure repeats its records, which changes no state, as
    the store keeps the latest record of each kind by sequence number. The store compacts by itself.
    """

    def take(batch: DataFrame, _: int) -> None:
        if not strict:
            store.append(changes_of(batch, store.payload))
            return
        root = f"{checkpoint.rstrip('/')}-positions"
        number, applied = _positions(store.spark, root)
        reached = written(next_records(batch, applied), "positions")
        gap = reached.where("next_seq IS NOT NULL").first()
        if gap is not None:
            raise MissingRecords(f"log {gap['tenant_id']}/{gap['shard']} lacks record {gap['next_seq']}")
        store.append(changes_of(batch, store.payload))
        every = applied.unionByName(reached.select("tenant_id", "shard", F.col("last_seq").alias("seq")))
        every.groupBy("tenant_id", "shard").agg(F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{root}/{number + 1}")

    writer = log.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def lagging(log: DataFrame, state_seq: DataFrame) -> DataFrame:
    """(tenant_id, shard, applied_seq, last_seq): logs with records beyond what was applied."""
    last = log.groupBy("tenant_id", "shard").agg(F.max("seq").alias("last_seq"))
    return last.join(state_seq, ["tenant_id", "shard"], "left").select("tenant_id", "shard", F.coalesce("applied_seq", F.lit(0).cast("bigint")).alias("applied_seq"), "last_seq").where("last_seq > applied_seq")
