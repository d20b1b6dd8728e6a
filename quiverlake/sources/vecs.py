"""Files of vectors: .fvecs and .ivecs (an int32 length, then so many 4-byte items, repeated)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _layout(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes of the file, length of its vectors)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    if not size:
        return 0, 0
    stream = fs.open(p)
    try:
        dim = int(np.array([stream.read() for _ in range(4)], np.uint8).view(np.int32)[0])
    finally:
        stream.close()
    if dim <= 0 or size % (4 * dim + 4):
        raise ValueError(f"{path} doesn't hold vectors of one length")
    return size, dim


def read_vecs(spark: SparkSession, path: str, items: str = "float") -> DataFrame:
    """(row, vec) of an .fvecs (items float) or .ivecs (items int) file, rows numbered from 0.

    All vectors of a file have one length, so that the file is cut into splits of whole records,
    which are read in parallel by Spark's binary record source. A file whose size doesn't fit its
    first length, or a record of another length, is an error.
    """
    dim = _layout(spark, path)[1]
    kind = {"float": np.float32, "int": np.int32}[items]
    if not dim:
        return spark.createDataFrame([], f"row bigint, vec array<{items}>")
    step = 4 * dim + 4
    records = spark.sparkContext.binaryRecords(path, step).zipWithIndex()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32).reshape(-1, dim + 1)
            if (raw[:, 0] != dim).any():
                raise ValueError("a record has another length")
            flat = np.ascontiguousarray(raw[:, 1:]).view(kind).ravel()
            offsets = pa.array(np.arange(0, flat.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["row", "vec"])

    numbered = spark.createDataFrame(records.map(lambda r: (r[1], bytearray(r[0]))), "row bigint, raw binary")
    return numbered.mapInArrow(decode, f"row bigint, vec array<{items}>")


def read_bundle(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The base, query and ground-truth tables of prefix_base.fvecs, _query.fvecs and _groundtruth.ivecs."""
    return (
        read_vecs(spark, f"{prefix}_base.fvecs"),
        read_vecs(spark, f"{prefix}_query.fvecs").withColumnRenamed("row", "query_id"),
        read_vecs(spark, f"{prefix}_groundtruth.ivecs", "int").withColumnRenamed("row", "query_id"),
    )


def vecs_bytes(rows: np.ndarray) -> bytes:
    """The file content of a matrix, for exports and tests."""
    rows = np.ascontiguousarray(rows)
    head = np.full((len(rows), 1), rows.shape[1], np.int32)
    return np.hstack([head, rows.view(np.int32)]).tobytes()


def bundle_truth(truth: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id) of the first k true neighbours."""
    return truth.select("query_id", F.posexplode(F.slice("vec", 1, k)).alias("p", "id")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("id").cast("bigint").alias("id"))
