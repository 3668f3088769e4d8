"""What the operators share: reading inputs, writing intermediate tables where all machines see them."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows on its way to Python; one row may be larger.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: For each byte its lower-case letter or digit or itself beyond ASCII, else a space.
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A to Z lower-cased, in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes: lowers the session's limit to ``BATCH_BYTES`` where it is higher."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on a single machine (master ``local``, as in tests) gets a folder of its own; on a cluster
    it is an error, as a folder of one machine would not be seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder (or at ``path``) and read again.

    It cuts the lineage and survives the loss of executors, as the files do not live with them.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run of an operator, in one folder of the shared one; ``drop`` deletes them all.

    What an operator returns is written outside of it, by ``saved``, before that.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, new_path(spark, name), {}

    def path(self, name: str) -> str:
        self.paths[name] = f"{self.folder}/{len(self.paths):03d}-{name}-{uuid.uuid4().hex[:8]}"
        return self.paths[name]

    def saved(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        return saved(df, name, codec, self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Deletes the last table saved under this name, or all of them."""
        drop_path(self.spark, self.paths[name] if name else self.folder)


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str, rank: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row in the order of all rows, without a task that holds them all.

    Rows are range-sorted and written with their place in their part; the parts' row counts, one for each part, give the offsets.
    """
    place, part = f"_{rank}_place", f"_{rank}_part"
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows = scratch.saved(parts, name).withColumn(part, F.shiftright(place, 33))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    starts, before = [], 0
    for at, n in counts:
        starts.append((at, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} long, _{rank}_before long")
    rows = rows.join(F.broadcast(offsets), part)
    return rows.withColumn(rank, F.col(f"_{rank}_before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1).drop(place, part, f"_{rank}_before")
