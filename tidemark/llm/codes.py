"""Vector code compression: product codes whose nearest entries are screened in float32 and settled in whole numbers.

A matrix product in float32 gives |c|^2 - 2 x.c of every entry with an error that is bounded rigorously.  Every entry whose
interval reaches below the least upper end is evaluated again in int64; equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .vectors import add_rows, chunks, matrix, sha_text, whole_vectors

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Unit roundoff of float32, and a bound on the relative error of the few float64 operations around the product.
UNIT = 2.0**-24
SLACK = 2.0**-50
#: Candidates evaluated again at once, and vectors screened at once.
PAIRS = 1 << 17
ROWS = 4096


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends that hold |c|^2 - 2 x.c for every row of ``x`` and entry of ``c`` (whole numbers).

    A float32 product of w terms, in any order of summation, errs by at most g = n u / (1 - n u) times sum |x_i c_i|, where
    n is w plus one for each rounded factor; the sum is at most |x| |c|.  Norms and differences are float64."""
    n = x.shape[1] + 2
    gamma = n * UNIT / (1 - n * UNIT)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    x_norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None]
    c_square = (c * c).sum(axis=1).astype(np.float64)[None, :]
    both = x_norm * np.sqrt(c_square)
    radius = 2 * (1 + SLACK) * gamma * both + SLACK * (c_square + 4 * both)
    middle = c_square - 2 * product
    return middle - radius, middle + radius


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (ties to the lower one) and its squared distance, exact in int64."""
    x, c = x.astype(np.int64), c.astype(np.int64)
    index = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        low, high = intervals(part, c)
        open_ = low <= high.min(axis=1, keepdims=True)
        many = open_.sum(axis=1)
        index[at : at + len(part)] = open_.argmax(axis=1)
        unsettled = np.flatnonzero(many > 1)
        for rows in np.split(unsettled, np.flatnonzero(np.diff(np.cumsum(many[unsettled]) // PAIRS)) + 1) if len(unsettled) else ():
            row, entry = np.nonzero(open_[rows])
            gap = part[rows][row] - c[entry]
            d = (gap * gap).sum(axis=1)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
            best = np.flatnonzero(d == least)
            settled, where = np.unique(row[best], return_index=True)
            index[at + rows[settled]] = entry[best[where]]
    gap = x - c[index]
    return index, (gap * gap).sum(axis=1)


class Codebooks:
    """The entries of every part position: ``entries[part]`` is a matrix of whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @classmethod
    def start(cls, rows: np.ndarray) -> Codebooks:
        return cls(rows.astype(np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2))

    @property
    def dims(self) -> int:
        return PARTS * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(sha_text(self.entries).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors): an index for each row and part, and the squared distances summed over parts."""
        width = self.entries.shape[2]
        got = [nearest(x[:, p * width : (p + 1) * width], self.entries[p]) for p in range(PARTS)]
        return np.stack([g[0] for g in got], axis=1), sum(g[1] for g in got)

    def moved(self, sums: dict[tuple[int, int], int]) -> Codebooks:
        """Every used entry replaced by floor(sum / count); ``sums`` is by (slot, place), a slot being part * entries +
        entry and place -1 the count."""
        k, width = self.entries.shape[1:]
        new = self.entries.copy()
        for (slot, place), s in sums.items():
            if place >= 0:
                new[slot // k, slot % k, place] = s // sums[slot, -1]
        return Codebooks(new)


def _sums(coded: DataFrame, books: Codebooks) -> dict[tuple[int, int], int]:
    """Sums and counts of all entries: a block a task, added up by Spark; ENTRIES * (dims + PARTS) numbers come back."""
    held = coded.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        k, width = books.entries.shape[1:]
        sums, counts = np.zeros((PARTS * k, width), dtype=np.int64), np.zeros(PARTS * k, dtype=np.int64)
        for part in chunks(batches, books.dims * 8):
            x = matrix(part.column(0), books.dims)
            code, _ = books.assign(x)
            for p in range(PARTS):
                add_rows(sums, counts, x[:, p * width : (p + 1) * width], p * k + code[:, p])
        slots = np.flatnonzero(counts)
        block = np.hstack([counts[slots, None], sums[slots]])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(slots, width + 1)), pa.array(np.tile(np.arange(-1, width), len(slots))), pa.array(block.ravel())], names=["slot", "place", "s"])

    found = coded.select("v").mapInArrow(run, "slot long, place long, s long").groupBy("slot", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {(r.slot, r.place): int(r.s) for r in found.collect()}


class Compressed(NamedTuple):
    """Codes of vectors, a written table (vec_id, label, code, error), and the codebooks that they refer to."""

    rows: DataFrame
    books: Codebooks


def encode(embeddings: DataFrame, column: str = "embedding") -> Compressed:
    """Codes of every vector without a null or non-finite component, and their codebooks.

    * Vectors are compared at one length: of those divisible by PARTS, the one that most vectors have (ties: the longer).
      Vectors of other lengths, and those with a component too large for exact distances (``vectors.most``), take no part;
      their code and error are null.
    * The codebooks start from the ENTRIES smallest vec_ids (a null one last; equal ids by their vectors, of equal rows
      each counts), fewer if there are fewer vectors.  An empty table gives no rows; other columns are not read.
    * Each round reads the table once and shuffles one block of sums a task; only codebooks reach driver and broadcast,
      ENTRIES times the length in size.
    """
    spark = embeddings.sparkSession
    vectors = keep(whole_vectors(embeddings, SCALE, ["vec_id", "label"], column))
    size = F.octet_length("v")
    usual = vectors.where((size > 0) & (size % (4 * PARTS) == 0)).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    fits = (size == F.lit(usual.size)) if usual else F.lit(False)
    coded = vectors.where(fits)
    # the order of packed bytes only has to be some fixed order among equal ids
    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    books = Codebooks.start(matrix(pa.array([r.v for r in first], pa.binary()), usual.size // 4)) if usual else Codebooks(np.zeros((PARTS, 0, 0), dtype=np.int64))
    for _ in range(ROUNDS if usual else 0):
        books = books.moved(_sums(coded, books))
    held = spark.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for part in chunks(batches, max(1, books.dims) * 8):
            code, error = books.assign(matrix(part.column(2), books.dims))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bytes(c).hex() for c in code.astype(np.uint8)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    rows = coded.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    left_out = vectors.where(~F.coalesce(fits, F.lit(False))).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Compressed(keep(rows.unionByName(left_out)), books)


def decode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (with the column code) with ``approximation``: the vector that each code stands for, null for a null code."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "approximation")
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = held.value.entries
        for part in chunks(batches, 64 + held.value.dims * 8):
            codes = part.column(part.schema.get_field_index("code")).to_pylist()
            known = [c for c in codes if c is not None]
            index = np.frombuffer(bytes.fromhex("".join(known)), dtype=np.uint8).reshape(-1, PARTS)
            whole = iter((np.concatenate([entries[p][index[:, p]] for p in range(PARTS)], axis=1) / SCALE).tolist() if len(known) else ())
            told = pa.array([None if c is None else next(whole) for c in codes], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, told], names=[*part.schema.names, "approximation"])

    return rows.drop("approximation").mapInArrow(run, f"{kinds}, approximation array<double>")


def compress(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that ``encode`` takes.

    Errors are added up by label, nulls together, before they meet the rows again; label_error passes over null errors."""
    rows, books = encode(embeddings, column)
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
