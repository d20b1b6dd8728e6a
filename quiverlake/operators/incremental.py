"""The records a run has to process after the last successful one (problem 7).

A run rereads each log from the oldest run that was still open at the last success, and removes
what was processed before by grouping its (log, sequence) pairs with the ledger of processed
pairs. The ledger is a table: a run's pairs are added when its work is done, so that a run that
dies in between is repeated as a whole. The contiguity test is distributed too: a log that holds a
third of all records is spread over all tasks by (log, sequence).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions.tenants import tenant_of
from quiverlake.session import delete_path, list_names

LOG = ["tenant_id", "shard"]
PAIRS = "tenant_id string, shard int, seq bigint"
#: Statuses of runs that have ended without success; other runs than these and the successful ones
#: are open until they have a finished_at.
ENDED = ("failed", "aborted")
_ZERO = "cast(0 as bigint)"


class Ledger:
    """(tenant_id, shard, seq) of processed records, below a folder that all executors share: one
    folder a run, which counts once its ``_SUCCESS`` file exists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def runs(self) -> list[int]:
        """Numbers of the committed runs."""
        found = (int(n[4:]) for n in list_names(self.spark, self.root) if re.fullmatch(r"run-\d+", n))
        return sorted(n for n in found if "_SUCCESS" in list_names(self.spark, self._path(n)))

    def _path(self, run: int) -> str:
        return f"{self.root}/run-{run}"

    def commit(self, run: int, records: DataFrame) -> None:
        """Note a run's records; the same run again takes the place of what it noted before."""
        records.select("tenant_id", F.col("shard").cast("int").alias("shard"), F.col("seq").cast("bigint").alias("seq")).write.mode("overwrite").parquet(self._path(run))

    def pairs(self) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], PAIRS)
        return self.spark.read.schema(PAIRS).parquet(*map(self._path, runs))

    def forget(self, positions: DataFrame, run: int) -> None:
        """Fold all runs into one without the pairs that are never reread; positions: as from
        last_success. run: number of the folded run, larger than all others."""
        old = self.runs()
        kept = self.pairs().join(positions.select(*LOG, "reread_from"), LOG, "left").where(F.col("seq") > F.coalesce("reread_from", F.expr(_ZERO)))
        self.commit(run, kept)
        for n in old:
            delete_path(self.spark, self._path(n))


def _column(df: DataFrame, name: str, kind: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def last_success(runs: DataFrame) -> DataFrame:
    """Per log: ``done_seq`` of its successful run with the highest run_no, and ``reread_from``.

    runs: tenant_id, shard, run_no, snapshot_seq, status, and started_at and finished_at if known.
    Only status ok, in any letter case and without outer blanks, is a success; runs without run_no
    or shard can't be ordered and don't count, a success without snapshot_seq covers nothing (0).
    The runs open at the last success are itself and those before it that ended after it began, or
    are not known to have ended. ``reread_from`` is the position from which the oldest of them
    started: that of the success before it (0 without one), or done_seq if the snapshot was put
    back to an older state. Logs without a success have no row.
    """
    status = F.coalesce(F.lower(F.trim("status")), F.lit(""))
    r = runs.where(F.col("run_no").isNotNull() & F.col("shard").isNotNull()).select(
        tenant_of().alias("tenant_id"),
        "shard",
        F.col("run_no").cast("bigint").alias("run_no"),
        F.when(status == "ok", F.coalesce(F.col("snapshot_seq").cast("bigint"), F.expr(_ZERO))).alias("ok_seq"),
        F.when(status.isin(*ENDED) | (status == "ok"), F.coalesce(_column(runs, "finished_at", "timestamp"), _column(runs, "started_at", "timestamp"))).otherwise(_column(runs, "finished_at", "timestamp")).alias("ended_at"),
        status.isin(*ENDED, "ok").alias("ended"),
        _column(runs, "started_at", "timestamp").alias("began_at"),
    )
    ok_no = F.when(F.col("ok_seq").isNotNull(), F.col("run_no"))
    top = r.groupBy(*LOG).agg(F.max(ok_no).alias("q_last"), F.max(F.when(F.col("ok_seq").isNotNull(), F.struct("run_no", "ok_seq"))).alias("q_top"), F.max(F.when(F.col("ok_seq").isNotNull(), F.struct("run_no", "began_at"))).alias("q_began")).where("q_last IS NOT NULL")
    r = r.join(top, LOG)
    is_open = F.coalesce(F.col("ended_at") > F.col("q_began.began_at"), ~F.col("ended"))
    oldest = r.where((F.col("run_no") <= F.col("q_last")) & ((F.col("run_no") == F.col("q_last")) | is_open)).groupBy(*LOG).agg(F.min("run_no").alias("q_open"))
    before = r.join(oldest, LOG).where(F.col("ok_seq").isNotNull() & (F.col("run_no") < F.col("q_open"))).groupBy(*LOG).agg(F.max(F.struct("run_no", "ok_seq")).alias("q_before"))
    done = F.col("q_top.ok_seq")
    return top.join(before, LOG, "left").select(*LOG, done.alias("done_seq"), F.least(done, F.coalesce("q_before.ok_seq", F.expr(_ZERO))).alias("reread_from"))


def _placed(log: DataFrame, positions: DataFrame) -> DataFrame:
    """The log's records with the positions of their log (0 without a success)."""
    records = log.where(F.col("shard").isNotNull() & F.col("seq").isNotNull()).select(tenant_of().alias("tenant_id"), F.col("shard"), F.col("seq").cast("bigint").alias("seq"))
    at = positions.select(*LOG, F.col("done_seq").alias("q_done"), F.col("reread_from").alias("q_from"))
    return records.join(at, LOG, "left").select(*LOG, "seq", F.coalesce("q_done", F.expr(_ZERO)).alias("done_seq"), F.coalesce("q_from", F.expr(_ZERO)).alias("reread_from"))


def _reread(log: DataFrame, positions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records beyond reread_from that aren't in the ledger."""
    # The ledger grows with the logs and its size isn't known beforehand, so it is never broadcast.
    return _placed(log, positions).where("seq > reread_from").join(ledger.select(*LOG, "seq").hint("merge"), [*LOG, "seq"], "left_anti")


def covered_records(log: DataFrame, positions: DataFrame) -> DataFrame:
    """(tenant_id, shard, seq), each once, of what the runs up to the last success have processed of
    the reread range: what the ledger of a log that was kept without one has to hold."""
    return _placed(log, positions).where("seq > reread_from AND seq <= done_seq").select(*LOG, "seq").distinct()


def due_records(log: DataFrame, runs: DataFrame, ledger: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """(tenant_id, shard, seq) of the records due in the next run of each log, each once.

    With S the done_seq of the log (0 without a success) these are S+1, S+2, ... as far as the
    log holds them without a gap. log: tenant_id, shard, seq; further columns are ignored. Rows
    without shard or seq are no records. Repeated deliveries count once. ledger: processed pairs;
    one of them is never due again, and counts as held in the test for gaps. With a ledger the log is
    reread from reread_from, and what it holds up to S that no run has noted is due too, whatever is
    missing beside it. Without a ledger S stands for it: nothing up to S is due. positions:
    last_success(runs), if at hand. Empty tables give no rows.
    """
    at = last_success(runs) if positions is None else positions
    held = _placed(log, at).where("seq > done_seq" if ledger is None else "seq > reread_from").withColumn("here", F.lit(True))
    if ledger is not None:
        held = held.unionByName(_placed(ledger, at).where("seq > reread_from").withColumn("here", F.lit(False)))
    # Each record and each ledger pair marks itself, and what has to follow it and the first seq beyond S
    # as possibly missing, so that one grouping by (log, seq) removes repeats and processed records and
    # finds the ends of all contiguous stretches beyond S.
    mark = lambda seq, here, noted: F.struct(seq.alias("seq"), here.alias("here"), noted.alias("noted"))
    no = F.lit(False)
    own, after = mark(F.col("seq"), F.col("here"), ~F.col("here")), mark(F.greatest(F.col("seq"), F.col("done_seq")) + 1, no, no)
    marks = held.select(*LOG, F.explode(F.array(own, after, mark(F.col("done_seq") + 1, no, no))).alias("m"))
    seqs = marks.select(*LOG, "m.*").groupBy(*LOG, "seq").agg(F.bool_or("here").alias("here"), F.bool_or("noted").alias("noted"))
    gaps = seqs.where("NOT here AND NOT noted").groupBy(*LOG).agg(F.min("seq").alias("first_gap"))
    return seqs.where("here AND NOT noted").join(gaps, LOG).where(F.col("seq") < F.col("first_gap")).select(*LOG, "seq")


def late_records(log: DataFrame, runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(tenant_id, shard, seq), each once, of the due records at or before the last success: delivered
    after the runs had passed them, or of a run whose note was lost."""
    return _reread(log, last_success(runs), ledger).where("seq <= done_seq").select(*LOG, "seq").distinct()


def process_new(log: DataFrame, runs: DataFrame, ledger: Ledger, run: int, work: Callable[[DataFrame], None]) -> bool:
    """Do ``work`` on the records due in run number ``run`` and note them in the ledger; False if this
    run is in the ledger already.

    work must write its result as a whole under the run's number: if it, or the note after it,
    fails, the next call with the same number does the same records again, as nothing was noted.
    """
    if run in ledger.runs():
        return False
    due = due_records(log, runs, ledger.pairs())
    work(due)
    ledger.commit(run, due)
    return True
