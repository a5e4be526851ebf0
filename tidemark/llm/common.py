"""Helpers shared by the training-data operators: checkpoint folder, narrow scans, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at once inside a task.
SLICE_ROWS = 256
SLICE_BYTES = 8 << 20

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where a local session has none.

    On a cluster a folder of the driver's machine would lose rows unseen, so a session without one is refused there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        jsc = spark.sparkContext._jsc.sc()
        held = jsc.getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            held = jsc.getCheckpointDir()
        named = held.get()
    return named.rstrip("/")


def keep_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as Parquet and read back, and where: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame) -> DataFrame:
    """``keep_at`` for a table that stays."""
    return keep_at(df)[0]


def drop_kept(spark: SparkSession, path: str) -> None:
    """Removes a table of ``keep_at`` that nothing will read again, in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, rows: int, per_task: int, *keys: object) -> DataFrame:
    """``df`` dealt by ``keys`` over at least the session's shuffle partitions, more if ``per_task`` rows ask for it."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
    return df.repartition(n, *keys)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and about bounded bytes, so long texts do not pile up as objects."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(SLICE_ROWS, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices; ``fn`` gives the columns of ``schema`` for one slice."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def raw(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null stays null."""
    return F.col(column).cast("binary")


def crc_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores added where a table already has them (letter case aside)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def key_names(docs: DataFrame, *names: str) -> list[str]:
    """Names of the key columns of ``with_row_key`` that ``docs`` does not have: the hash, then two for each name."""
    return free_names(docs.columns, "__h", *(f"__{kind}{i}" for i in range(len(names)) for kind in "kz"))


def with_row_key(rows: DataFrame, text_hash: Column, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``rows`` with plain, never-null key columns ``keys`` (see ``key_names``) for the text's hash and ``names``.

    Joins and windows on the same plain columns share one exchange; struct keys whose fields differ in nullability are
    cast by the join and would be dealt a second time."""
    made = [F.coalesce(text_hash, F.lit(0))]
    for n in names:
        empty = "" if dict(rows.dtypes)[n] == "string" else 0
        made += [F.coalesce(F.col(n), F.lit(empty)), F.col(n).isNull()]
    return rows.withColumns(dict(zip(keys, made)))
