"""Tables in the shared folder, and the search index there: versions of tables behind one manifest that is switched at once.

A build writes all tables of a new version beside the live one and switches the manifest last, by one rename, so searches
see either the old or the new index whole, and a build that fails changes nothing. Postings and pairs lie in buckets by a hash
of their term, sorted by it within, so a search reads only the buckets and row groups of the terms it asks for.
"""

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import index as I

TABLES = ["sections", "postings", "lengths", "terms", "corpus", "bigrams", "pairs", "features"]
#: Tables that a search asks for by a term, and the column it asks by.
BUCKETED = {"postings": "term", "bigrams": "pair", "terms": "term", "pairs": "pair"}
MANIFEST = "current.json"
#: What searches need, the most first: pairs and features too, postings and lengths, or the vocabulary alone.
LEVELS = ["all", "postings", "terms"]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session on one machine where it is unset gets its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read again: for small tables that a plan reads several times."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def switch(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file in one step: written beside it, then renamed over it."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    fs, where = _fs(spark, fresh)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(where, jvm.org.apache.hadoop.fs.Path(path), how)


def bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class StoredIndex:
    """The index under ``root``. ``build`` and ``upsert`` make a new version, ``open`` reads the live one."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def manifest(self) -> dict | None:
        """What is live: version, buckets, the one before, and the last batch of each stream. None before the first build."""
        path = f"{self.root}/{MANIFEST}"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else None

    def open(self) -> I.Index:
        live = self.manifest()
        if live is None:
            raise FileNotFoundError(f"no index under {self.root}")
        read = {t: self.spark.read.parquet(f"{self.root}/{live['version']}/{t}") for t in TABLES if t in live["tables"]}
        return I.Index(**{t: read.get(t) for t in TABLES}, buckets=live["buckets"])

    def _write(self, df: DataFrame, version: str, name: str) -> DataFrame:
        path = f"{self.root}/{version}/{name}"
        if key := BUCKETED.get(name):
            df.withColumn("bucket", bucket(key, self.buckets)).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)
        else:
            df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _publish(self, make: Callable[[Callable[[DataFrame, str], DataFrame]], None], streams: dict) -> str:
        """Lets ``make`` write all tables of a new version, then switches to it; what failed is deleted, what is live stays."""
        old = self.manifest()
        version, tables = f"v-{uuid.uuid4().hex}", []

        def write(df: DataFrame, name: str) -> DataFrame:
            tables.append(name)
            return self._write(df, version, name)

        try:
            make(write)
        except BaseException:
            drop(self.spark, f"{self.root}/{version}")
            raise
        switch(self.spark, f"{self.root}/{MANIFEST}", json.dumps({"version": version, "tables": tables, "buckets": self.buckets, "before": old and old["version"], "streams": streams}))
        if old and old["before"]:  # the version before stays for the searches that still read it
            drop(self.spark, f"{self.root}/{old['before']}")
        return version

    def build(self, sections: DataFrame, level: str = "all") -> str:
        """A whole new version from ``sections``, with the tables of a level (``LEVELS``)."""

        def make(write: Callable[[DataFrame, str], DataFrame]) -> None:
            if level == "all":
                self._first(write, sections)
                return
            made = I.build(sections)
            if level == "terms":  # nothing is kept of the sections but their number
                self._terms(write, I.held(made.sections), write(sections.agg(F.count("*").alias("n")), "corpus"))
                return
            kept_ = write(made.sections, "sections")
            made = I.build(kept_)
            write(made.postings, "postings")
            self._terms(write, I.held(kept_), write(write(made.lengths, "lengths").agg(F.count("*").alias("n"), F.avg("length").alias("avg_len")), "corpus"))

        return self._publish(make, (self.manifest() or {}).get("streams", {}))

    def _terms(self, write: Callable[[DataFrame, str], DataFrame], held: DataFrame, corpus: DataFrame) -> None:
        write(I.statistics(held, corpus.select("n"), ["term"]), "terms")

    def _derive(self, write: Callable[[DataFrame, str], DataFrame], sections: DataFrame, postings: DataFrame, bigrams: DataFrame, lengths: DataFrame) -> None:
        from quillspark.operators.search import features

        corpus = write(lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_len")), "corpus")
        self._terms(write, postings, corpus)
        write(I.statistics(bigrams, corpus.select("n"), ["pair"]), "pairs")
        if "path" in sections.columns:
            write(features(sections), "features")

    def upsert(self, changed: DataFrame, removed: DataFrame | None = None, stream: tuple[str, int] | None = None) -> str:
        """A new version with the ``changed`` sections in place of those of their ids, and without the ``removed`` ids.

        Only changed sections are read word by word; all else is carried over. ``stream`` (name and number of a batch) makes a
        batch that is delivered again do nothing.
        """
        live = self.manifest()
        streams = dict((live or {}).get("streams", {}))
        if stream and streams.get(stream[0], -1) >= stream[1]:
            return live["version"]
        if stream:
            streams[stream[0]] = stream[1]
        if live is None:
            return self._publish(lambda write: self._first(write, changed), streams)
        old = self.open()
        new = kept(I.cleaned(changed), "changed")
        gone = new.select("section_id")
        gone = gone.unionByName(removed.select("section_id")) if removed is not None else gone
        gone = kept(gone.distinct(), "gone")

        def make(write: Callable[[DataFrame, str], DataFrame]) -> None:
            def merged(name: str, fresh: DataFrame) -> DataFrame:
                before = getattr(old, name)
                return write(before.drop("bucket").join(gone, "section_id", "left_anti").unionByName(fresh), name)

            self._derive(write, merged("sections", new), merged("postings", I.postings(new)), merged("bigrams", I.bigram_postings(new)), merged("lengths", I.lengths(new)))

        return self._publish(make, streams)

    def _first(self, write: Callable[[DataFrame, str], DataFrame], sections: DataFrame) -> None:
        kept_ = write(I.cleaned(sections), "sections")
        self._derive(write, kept_, write(I.postings(kept_), "postings"), write(I.bigram_postings(kept_), "bigrams"), write(I.lengths(kept_), "lengths"))

    def follow(self, stream: DataFrame, name: str, checkpoint: str):
        """Keeps the index up to date with a stream of sections; of several rows of one id the last by ``at`` counts, if there is such a column."""

        def apply(batch: DataFrame, number: int) -> None:
            if batch.isEmpty():
                return
            if "at" in batch.columns:
                rest = [c for c in batch.columns if c != "section_id"]
                batch = batch.groupBy("section_id").agg(F.max_by(F.struct(*rest), "at").alias("r")).select("section_id", *[f"r.{c}" for c in rest if c != "at"])
            self.upsert(batch, stream=(name, number))

        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def replace_generated(spark: SparkSession, path: str, rows: DataFrame, flag: str = "generated") -> None:
    """Overwrites the generated part of a table of rows and keeps what was written by hand (rows without the flag).

    The whole is written beside the table first and read back, as a table can't be overwritten while it is read.
    """
    fresh = rows.withColumn(flag, F.lit(True))
    if exists(spark, path):
        hand = spark.read.parquet(path)
        fresh = hand.where(~F.coalesce(F.col(flag), F.lit(False))).unionByName(fresh, allowMissingColumns=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    fresh.write.parquet(beside)
    try:
        spark.read.schema(fresh.schema).parquet(beside).write.mode("overwrite").parquet(path)
    finally:
        drop(spark, beside)


def signature(df: DataFrame) -> str:
    """Names, sizes and times of a table's files: the same table has the same."""
    out = []
    for f in sorted(df.inputFiles()):
        fs, where = _fs(df.sparkSession, f)
        status = fs.getFileStatus(where)
        out.append(f"{f}:{status.getLen()}:{status.getModificationTime()}")
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(out)))


def shared_index(sections: DataFrame, name: str, level: str = "all") -> I.Index:
    """The index of these sections in the shared folder with the tables of ``level`` at least, built by the first search that asks for it."""
    spark = sections.sparkSession
    of = lambda x: StoredIndex(spark, f"{shared_dir(spark)}/index-{name}-{x}-{spark.sparkContext.applicationId}-{signature(sections)}")
    for more in LEVELS[: LEVELS.index(level) + 1]:
        if of(more).manifest() is not None:
            return of(more).open()
    of(level).build(sections, level)
    return of(level).open()
