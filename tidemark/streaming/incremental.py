"""Tables kept up to date by dirty keys: a micro-batch rebuilds the states of the keys that it touches, and no others.

Everything a batch writes lies in folders named after it and counts only once the batch's commit is written, which comes
last.  A batch that is run again after a failure writes the same folders again; one that was committed changes nothing.
Folders are cut into buckets of the key, so a batch reads back the buckets of its dirty keys alone.  ``compact`` folds the
batches' many small folders into one, from which later batches go on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _files(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    system, place = _files(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder, so that all its files arrive at once."""
    system, place = _files(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    system.mkdirs(to.getParent())
    if not system.rename(place, to):
        raise OSError(f"{old} could not be moved to {new}")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme."""
    system, place = _files(spark, path)
    return system.makeQualified(place).toString()


def replace_folder(spark: SparkSession, old: str, new: str) -> None:
    """Moves a folder's part files over those of another one, under names that stay the same."""
    system, place = _files(spark, old)
    make = spark._jvm.org.apache.hadoop.fs.Path
    parts = sorted((f.getPath() for f in system.listStatus(place) if f.getPath().getName().startswith("part-")), key=str)
    system.mkdirs(make(new))
    for k, part in enumerate(parts):
        to = make(new, f"export-{k}{part.getName()[part.getName().rindex('.'):]}")
        system.delete(to, False)
        if not system.rename(part, to):
            raise OSError(f"{part} could not be moved to {to}")


class Batch:
    """What a sink sees of one batch: the changed states and what earlier sinks of the batch and earlier batches wrote."""

    def __init__(self, of: Maintained, number: int, buckets: list[int], changed: DataFrame):
        self._of, self.number, self.buckets, self.changed = of, number, buckets, changed

    def now(self, name: str) -> DataFrame:
        """What this batch has written to a sink before."""
        return self._of.read(name).where(F.col("batch") == self.number)

    def before(self, name: str) -> DataFrame:
        """What committed batches wrote to a sink for the dirty buckets."""
        return self._of.read(name).where((F.col("batch") < self.number) & F.col("bucket").isin(self.buckets))


class Maintained:
    """States by key, their versions and deltas, and any number of tables derived from what changed.

    * ``rebuild`` turns rows of some keys into one state a key (the key and other columns); it is given all rows of the keys.
    * A state whose ``compared`` columns are as before gives no version; every column that differs gives a delta.
    * ``sinks`` are (name, columns, function of ``Batch``); they are written in this order, each with the key's column, so a
      later one may read what an earlier one wrote, and one may read what it wrote itself in earlier batches.
    * Rows without a key are kept in the history and belong to no state.
    """

    def __init__(self, spark: SparkSession, root: str, rows: StructType, key: str, rebuild: Callable[[DataFrame], DataFrame], compared: Sequence[str], sinks: Sequence[tuple[str, str, Callable[[Batch], DataFrame]]] = (), buckets: int = 64):
        self.spark, self.root, self.key, self.rebuild, self.compared, self.buckets = spark, root.rstrip("/"), key, rebuild, list(compared), buckets
        self.sinks = list(sinks)
        kind = rows[key].dataType.simpleString()
        state = rebuild(spark.createDataFrame([], rows)).schema
        self._schemas = {"history": rows, "states": StructType(list(state)).add("version", "long"), "deltas": f"`{key}` {kind}, version long, field string, before string, after string"}
        self._schemas |= {name: f"`{key}` {kind}, {columns}" for name, columns, _ in self.sinks}
        self._columns = {name: spark.createDataFrame([], s).columns for name, s in self._schemas.items()}

    def _bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def read(self, name: str) -> DataFrame:
        """All rows of a table's batches with the columns bucket and batch, whether committed or not."""
        return self._read(name, f"{self.root}/{name}")

    def _read(self, name: str, path: str) -> DataFrame:
        schema = self.spark.createDataFrame([], self._schemas[name]).schema
        full = StructType(list(schema)).add("batch", "integer").add("bucket", "integer")
        return self.spark.read.schema(full).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], full)

    def committed(self) -> int:
        """The last batch that counts; -1 before the first."""
        path = f"{self.root}/commits"
        return self.spark.read.parquet(path).agg(F.max("number")).first()[0] if exists(self.spark, path) else -1

    def table(self, name: str) -> DataFrame:
        """The committed rows of a table, with the batch that wrote each (of the history, the compaction that holds it)."""
        return self._since(name, self.committed()) if name == "history" else self.read(name).where(F.col("batch") <= self.committed())

    def states(self) -> DataFrame:
        """The latest version of each key's state."""
        return self._latest(self._since("states", self.committed()))

    def _folded(self) -> int:
        """The last batch that a committed compaction holds; -1 before the first."""
        path = f"{self.root}/folds"
        return self.spark.read.parquet(path).agg(F.max("upto")).first()[0] if exists(self.spark, path) else -1

    def _since(self, name: str, upto: int) -> DataFrame:
        """A table's rows up to a batch: what the last compaction holds of it, and the batches after that."""
        folded = self._folded()
        newer = self.read(name).where((F.col("batch") > folded) & (F.col("batch") <= upto))
        return newer if folded < 0 else self._read(name, f"{self.root}/folded/upto={folded}/{name}").unionByName(newer)

    def compact(self) -> None:
        """Folds what is committed: the history's rows, and each key's latest state (all versions stay in the table of states).

        The fold counts once its commit is written; only then the history's folders and the fold before it go.  A call that
        failed is made good by the next one.  Not to be called while a batch is applied."""
        upto, before = self.committed(), self._folded()
        if upto <= before:
            return
        root = f"{self.root}/folded/upto={upto}"
        for name, rows in (("history", self._since("history", upto)), ("states", self._latest(self._since("states", upto)))):
            out = rows.select(*self._columns[name]).withColumn("bucket", self._bucket()).withColumn("batch", F.lit(upto))
            out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("batch", "bucket").parquet(f"{root}/{name}")
        self.spark.createDataFrame([(upto,)], "upto int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folds/upto_={upto}")
        for number in range(before + 1, upto + 1):
            remove(self.spark, f"{self.root}/history/batch={number}")
        if before >= 0:
            remove(self.spark, f"{self.root}/folded/upto={before}")

    def _latest(self, versions: DataFrame) -> DataFrame:
        columns = self._columns["states"]
        return versions.groupBy(self.key).agg(F.max_by(F.struct(*columns), "version").alias("__s")).select(*(F.col(f"__s.{c}").alias(c) for c in columns))

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        out = rows.select(*self._columns[name]).withColumn("bucket", self._bucket())
        # one file a bucket or so; a bucket with a hot key is split
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={number}")
        return self.read(name).where(F.col("batch") == number)

    def history(self, buckets: Sequence[int], upto: int) -> DataFrame:
        """The rows of some buckets that came up to a batch; other buckets' files are not read."""
        return self._since("history", upto).where(F.col("bucket").isin(list(buckets)))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes one micro-batch; to be given to ``foreachBatch``."""
        if number <= self.committed():
            return
        arrived = self._write(batch, "history", number)
        dirty = arrived.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        buckets = sorted(r.bucket for r in arrived.select("bucket").distinct().collect())  # at most ``buckets`` rows
        rebuilt = self.rebuild(self.history(buckets, number).join(dirty, self.key, "left_semi").drop("batch", "bucket"))
        old = self._latest(self._since("states", number - 1).where(F.col("bucket").isin(buckets)).join(dirty, self.key, "left_semi"))
        held = old.select(F.col(self.key), F.struct(*(F.col(c) for c in self._columns["states"])).alias("__old"))
        both = rebuilt.join(held, self.key, "left")
        differs = {c: ~F.col(c).eqNullSafe(F.col(f"__old.{c}")) for c in self.compared}
        fresh = F.col("__old").isNull()
        any_ = fresh
        for d in differs.values():
            any_ = any_ | d
        changed = both.where(any_).withColumn("version", F.coalesce(F.col("__old.version"), F.lit(0)) + 1)
        written = self._write(changed, "states", number)
        text = lambda c: F.col(c).cast("string")
        pieces = F.array(*(F.when(~fresh & d, F.struct(F.lit(c).alias("field"), text(f"__old.{c}").alias("before"), text(c).alias("after"))) for c, d in differs.items()))
        told = written.join(held, self.key, "left")  # what was written, so that nothing is rebuilt twice
        self._write(told.select(self.key, "version", F.explode(F.array_compact(pieces)).alias("__d")).select(self.key, "version", "__d.*"), "deltas", number)
        seen = Batch(self, number, buckets, written.drop("batch", "bucket"))
        for name, _, make in self.sinks:
            self._write(make(seen), name, number)
        self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={number}")

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Applies all that the stream has; the stream's own checkpoint lies beside the tables."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
