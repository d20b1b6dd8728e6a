"""Applying a stream of inserts, updates and deletes (problem 3).

A log-structured merge store. Each append adds one immutable run to a bucketed Parquet table: a
file per bucket, sorted by (tenant_id, id, seq). Reading merges the sorted files of each bucket in
one task: the sorter is given k sorted runs, which it finds and merges (and merges again from
disk where they don't fit), and a window over the merged order takes the last record of each kind.
No rows move between tasks and nothing is hashed. Deletes are tombstones; a compaction merges all
runs in the same way into one run of a new version of the table. Runs appear when Spark commits
the job that writes them and a version counts once its ``_SUCCESS`` file exists, so a failed write
leaves nothing behind that a reader could see, and a repeated one does no harm. The version
before the newest stays, so frames read from it live on until the next compaction.

The merge keeps, per id, the latest insert, the latest delete and the latest metadata record.
Taking the later of two records is associative, commutative and idempotent, so late, repeated
and out-of-order deliveries give the same state in whatever run they arrive.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.functions.tenants import tenant_of
from quiverlake.session import delete_path, list_names

INSERT, DELETE, META = 1, 2, 3
KEY = ["tenant_id", "id"]
_FIELDS = {
    "tenant_id": T.StringType(),
    "id": T.LongType(),
    "seq": T.LongType(),
    "op": T.ByteType(),
    "vec": T.ArrayType(T.FloatType()),
    "extra": T.StringType(),
}
PAYLOAD = ["vec", "extra"]
#: Records for which a store gets one more bucket.
BUCKET_RECORDS = 400_000


def buckets_for(records: int, least: int) -> int:
    """Number of buckets of a store that is to hold so many records."""
    return max(1, least, -(-records // BUCKET_RECORDS))


def changes_of(log: DataFrame, payload: Sequence[str] = PAYLOAD, id_type: str = "bigint") -> DataFrame:
    """The log's records in the form that runs hold; ids are BIGINT, or DECIMAL(20,0) for the whole
    unsigned range.

    Rows without id or seq, and operations other than 1, 2 and 3, change nothing and are left
    out. Columns besides the key, seq, op and the payload are ignored.
    """
    return log.where(F.col("id").isNotNull() & F.col("seq").isNotNull() & F.col("op").isin(INSERT, DELETE, META)).select(
        tenant_of().alias("tenant_id"), F.col("id").cast(id_type).alias("id"), *(F.col(c).cast(_FIELDS[c]).alias(c) for c in ["seq", "op", *payload])
    )


class ChangeRuns:
    """A store below ``root``, a folder that all executors share.

    n_buckets is fixed at creation. Bucket contents grow with the data, so choose it for the
    expected size (see buckets_for). payload: the columns kept besides key, seq
    and op; without any, runs are narrow and the state has only its sequence numbers. A compaction
    follows the append that reaches max_runs. id_type is as in changes_of.
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int, payload: Sequence[str] = PAYLOAD, max_runs: int = 8, id_type: str = "bigint"):
        self.spark, self.root, self.n_buckets, self.payload, self.max_runs = spark, root.rstrip("/"), n_buckets, list(payload), max_runs
        self.columns = [*KEY, "seq", "op", *payload]
        self._types = {c: id_type if c == "id" else _FIELDS[c].simpleString() for c in self.columns}
        self._prefix = "q_" + re.sub(r"\W", "_", self.root)[-80:]

    def _names(self, path: str) -> list[str]:
        return list_names(self.spark, path)

    def version(self) -> int:
        """The newest committed version, 0 without one."""
        versions = sorted((int(n[1:]) for n in self._names(self.root) if re.fullmatch(r"v\d{8}", n)), reverse=True)
        return next((v for v in versions if "_SUCCESS" in self._names(self._path(v))), 0)

    def runs(self) -> int:
        """Runs of the newest version; each append names its files by a job id of its own."""
        return len({m[1] for n in self._names(self._path(self.version())) if (m := re.match(r"part-\d+-([0-9a-f-]{36})", n))})

    def _path(self, version: int) -> str:
        return f"{self.root}/v{version:08d}"

    def _table(self, version: int) -> str:
        """The version's table, made known to this session's catalog."""
        name = f"{self._prefix}_v{version:08d}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{c} {t}" for c, t in self._types.items())
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ('parquet.enable.dictionary#vec.list.element' 'false') "
                f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join([*KEY, 'seq'])}) INTO {self.n_buckets} BUCKETS LOCATION '{self._path(version)}'"
            )
        return name

    def _write(self, changes: DataFrame, version: int) -> None:
        changes.select(*self.columns).write.insertInto(self._table(version))

    def append(self, changes: DataFrame) -> None:
        """Add a run of records as from changes_of."""
        version = self.version()
        if not version:
            delete_path(self.spark, self._path(1))  # what a failed first append may have left
        self._write(changes.repartition(self.n_buckets, *KEY), version or 1)
        if self.runs() >= self.max_runs:
            self.compact()

    def changes(self) -> DataFrame:
        """All records of the committed runs, partitioned by key."""
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in self._types.items()))
        table = self._table(version)
        self.spark.catalog.refreshTable(table)
        return self.spark.table(table)

    def state(self, payload: Sequence[str] | None = None) -> DataFrame:
        """The ids now stored: tenant_id, id, vec_seq, meta_seq and the payload asked for.

        vec comes from the latest insert. extra comes from the latest insert or metadata record
        (null there clears it). An id is stored if its latest insert is later than its latest
        delete. A metadata record of an id that isn't stored does nothing.
        """
        return _live(_merged(self.changes()), self.payload if payload is None else payload)

    def compact(self) -> None:
        """Merge all runs into one run of a new version and delete the version before the old one.

        The new run keeps the latest insert, delete and metadata record of every id, tombstones
        included, so that a record delivered late still meets what it has to be compared with.
        """
        old = self.version()
        if not old or self.runs() < 2:
            return
        order = Window.partitionBy(*KEY).orderBy("seq", "op")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last = F.greatest(*(F.when(F.col("op") == op, F.max(F.when(F.col("op") == op, F.col("seq"))).over(whole)) for op in (INSERT, DELETE, META)))
        repeat = (F.lead("seq").over(order) == F.col("seq")) & (F.lead("op").over(order) == F.col("op"))
        marked = self.changes().withColumns({"q_last": last, "q_repeat": F.coalesce(repeat, F.lit(False))})
        delete_path(self.spark, self._path(old + 1))
        self._write(marked.where((F.col("seq") == F.col("q_last")) & ~F.col("q_repeat")), old + 1)
        if old > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old - 1)}")
            delete_path(self.spark, self._path(old - 1))


def _last(*ops: int, of: str = "seq"):
    return F.when(F.col("op").isin(*ops), F.col(of) if of == "seq" else F.struct(of))


def _merged(changes: DataFrame) -> DataFrame:
    """Of each key the sequence numbers and payload that decide its state, from changes partitioned
    by key: one pass over each key's records in order of seq."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = {"vec_seq": F.max(_last(INSERT)), "q_del": F.max(_last(DELETE)), "meta_seq": F.max(_last(INSERT, META))}
    facts |= {f"q_{c}": F.last(_last(*((INSERT,) if c == "vec" else (INSERT, META)), of=c), True) for c in PAYLOAD if c in changes.columns}
    named = changes.select(*KEY, *(f.over(whole).alias(n) for n, f in facts.items()), F.lead(F.lit(True)).over(order).alias("q_more"))
    return named.where("q_more IS NULL")


def _live(keys: DataFrame, payload: Sequence[str]) -> DataFrame:
    live = keys.where(F.col("vec_seq").isNotNull() & (F.col("q_del").isNull() | (F.col("vec_seq") > F.col("q_del"))))
    return live.select(*KEY, "vec_seq", "meta_seq", *(F.col(f"q_{c}")[c].alias(c) for c in payload))


def fold(changes: DataFrame, payload: Sequence[str] = PAYLOAD) -> DataFrame:
    """State after changes that lie in no store and no order, by an aggregation; see
    ChangeRuns.state."""
    facts = [F.max(_last(INSERT)).alias("vec_seq"), F.max(_last(DELETE)).alias("q_del"), F.max(_last(INSERT, META)).alias("meta_seq")]
    if "vec" in payload:
        facts.append(F.max_by(F.struct("vec"), _last(INSERT)).alias("q_vec"))
    if "extra" in payload:
        facts.append(F.max_by(F.struct("extra"), _last(INSERT, META)).alias("q_extra"))
    return _live(changes.groupBy(*KEY).agg(*facts), payload)


def metadata_map(extra: str = "extra"):
    """The metadata of a JSON text as a map; none for null, empty, ``{}`` and unreadable texts."""
    m = F.from_json(F.col(extra), "map<string,string>")
    return F.when(F.size(m) > 0, m)
