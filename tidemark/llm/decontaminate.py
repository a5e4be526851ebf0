"""Benchmark decontamination: broadcast hash sets of normalised test n-grams, scanned over whole token streams."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, keep, key_names, map_slices, slices, with_row_key

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: A document is contaminated if hit words times this reach its words.
SHARE = 20
#: Bytes of benchmark text in one broadcast block; a larger benchmark is scanned block by block.  An item longer than a
#: block is a block of its own.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space; other characters stay.
NORMALISE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BLOOM_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMALISE).split() if text else []


class WindowSet:
    """The windows of a block of items: word ids, and for each window length sorted hashes of its different windows.

    A different window is held once, by its first place, with the list of the items that have it: 16 bytes beside the
    items' word ids.  A hash only nominates, the word ids are compared."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        self.ids: dict[bytes, int] = {}
        self.items = ["null" if item is None else str(item) for item, _ in items]
        flat, starts, owners = [], defaultdict(list), defaultdict(list)
        for k, (_, text) in enumerate(items):
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if own:
                width = min(WINDOW, len(own))
                starts[width].append(np.arange(len(flat), len(flat) + len(own) - width + 1))
                owners[width].append(np.full(len(own) - width + 1, k))
                flat += own
        self.flat = np.array(flat, dtype=np.uint64)
        self.tables = {}
        for width, parts in starts.items():
            at, owner = np.concatenate(parts).astype(np.int64), np.concatenate(owners[width])
            hashes = self._roll([self.flat[at + k] for k in range(width)])
            order = np.argsort(hashes, kind="stable")
            at, owner, hashes = at[order], owner[order], hashes[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            for k in range(width):
                new[1:] |= self.flat[at[1:] + k] != self.flat[at[:-1] + k]
            first = np.flatnonzero(new)
            bloom = np.zeros(1 << _BLOOM_BITS, dtype=bool)
            bloom[self._slot(hashes)] = True
            self.tables[width] = (bloom, hashes[first], at[first], np.append(first, len(at)), owner)

    @staticmethod
    def _roll(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            total = (total + column) * _FACTOR
        return total

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The words inside occurring windows as merged spans (first word, end word), and the items that have the windows."""
        get = self.ids.get
        own = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        if not own.any():
            return [], set()
        spans, items = [], set()
        unknown = np.concatenate(([0], np.cumsum(own == 0)))
        for width, (bloom, hashes, places, cuts, owner) in self.tables.items():
            n = len(words) - width + 1
            if n < 1:
                continue
            at = np.flatnonzero(unknown[width:] == unknown[:n])
            if not len(at):
                continue
            rolled = self._roll([own[at + k] for k in range(width)])
            likely = bloom[self._slot(rolled)]
            at, rolled = at[likely], rolled[likely]
            low, high = np.searchsorted(hashes, rolled, "left"), np.searchsorted(hashes, rolled, "right")
            while len(at := at[low < high]):  # one turn, unless different windows share a hash
                low, high = low[low < high], high[low < high]
                same = np.ones(len(at), dtype=bool)
                for k in range(width):
                    same &= own[at + k] == self.flat[places[low] + k]
                spans.append(np.stack((at[same], at[same] + width)))
                for window in np.unique(low[same]).tolist():
                    items.update(self.items[k] for k in np.unique(owner[cuts[window] : cuts[window + 1]]).tolist())
                low, at = low[~same] + 1, at[~same]
                high = high[~same]
        return merged(np.concatenate(spans, axis=1).T if spans else []), items


def merged(spans) -> list[tuple[int, int]]:
    """Spans (a, b) without overlaps, touching ones joined, in order."""
    spans = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > end[:-1])))
    return list(zip(spans[first, 0].tolist(), end[np.append(first[1:], len(spans)) - 1].tolist()))


_held: list = [None, None]


def _windows(block) -> WindowSet:
    """The window set of a broadcast block, built once in each Python worker."""
    if _held[0] is not block:
        _held[:] = block, WindowSet(block.value)
    return _held[1]


def count_blocks(benchmark: DataFrame) -> int:
    return int(-(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)) or 1


def blocks(benchmark: DataFrame, n: int):
    """Broadcasts of the items dealt into ``n`` blocks of about BLOCK_BYTES of text at most."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("t")).where("t is not null")
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("item_id", "t"), F.lit(n)))
    for k in range(n):
        part = (dealt.where(F.col("b") == k) if n > 1 else dealt).select("item_id", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in part])


#: What a scan finds in a document: words, merged word spans [a, b) of occurring windows, items with such windows.
FOUND = "struct<n_words:bigint,hits:array<struct<a:int,b:int>>,items:array<string>>"
_ONE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, found: str = "found") -> DataFrame:
    """``docs`` with one more column ``found`` of type FOUND (a column of that name is replaced, all others are kept).

    A benchmark of one block takes one pass.  Of a larger one each block passes over ids and texts alone and leaves the
    rows that it hits, without their texts, in the shared folder; one join brings all blocks' spans to the documents, so
    neither the number of blocks nor a block's windows multiply what is written.  Null texts have no words; an empty
    benchmark hits nothing; a null item_id counts as the item ``null``; repeated rows each get the same result.
    """
    n = count_blocks(benchmark)
    if n == 1:
        base = docs.withColumn(found, F.lit(None).cast(FOUND))
        return _pass(base, next(blocks(benchmark, 1)), found)
    keys = key_names(docs, "doc_id")
    narrow = with_row_key(docs.select("doc_id", "text"), F.xxhash64("text"), ["doc_id"], keys).select(*keys, "text", F.lit(None).cast(FOUND).alias("f"))
    every = None
    for block in blocks(benchmark, n):
        hit = keep(_pass(narrow, block, "f").where(F.size("f.hits") > 0).select(*keys, "f.hits", "f.items").dropDuplicates(keys))
        every = hit if every is None else every.unionByName(hit)
    per = every.groupBy(*keys).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per = per.mapInArrow(_merge_hits, per.schema)
    hits, items = free_names([*docs.columns, *keys], "__hits", "__items")
    per = per.withColumnsRenamed({"hits": hits, "items": items})
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(_ONE_WORD))).cast("long")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    value = F.struct(words.alias("n_words"), none(F.col(hits), "array<struct<a:int,b:int>>").alias("hits"), none(F.col(items), "array<string>").alias("items"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != found]
    return with_row_key(docs, F.xxhash64("text"), ["doc_id"], keys).join(per, keys, "left").select(*columns, value.alias(found))


def _merge_hits(batches):
    """Rows with the spans of all blocks merged; a document's spans are few beside its words."""
    for part in batches:
        at = part.schema.get_field_index("hits")
        whole = [[{"a": a, "b": b} for a, b in merged([(h["a"], h["b"]) for h in hits])] for hits in part.column(at).to_pylist()]
        yield part.set_column(at, part.schema.field(at), pa.array(whole, type=part.schema.field(at).type))


def _pass(docs: DataFrame, block, found: str) -> DataFrame:
    def run(batches):
        held = _windows(block)
        for part in slices(batches):
            values = []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                spans, items = held.scan(words)
                values.append({"n_words": len(words), "hits": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)})
            arrays = [pa.array(values, type=f.type) if f.name == found else part.column(f.name) for f in part.schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def n_hit(found: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda s, h: s + h["b"] - h["a"])


def verdict(hit: Column, words: Column) -> Column:
    return (hit > 0) & (hit * SHARE >= words)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (texts do not leave the scan)."""
    if count_blocks(benchmark) == 1:
        block = next(blocks(benchmark, 1))

        def run(part: pa.RecordBatch) -> dict[str, list]:
            held = _windows(block)
            out = defaultdict(list)
            for text in part.column("t").to_pylist():
                words = words_of(text)
                spans, found = held.scan(words)
                out["n_words"].append(len(words))
                out["n_hit"].append(sum(b - a for a, b in spans))
                out["n_items"].append(len(found))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
            return {"doc_id": part.column("doc_id")} | out

        kind = docs.schema["doc_id"].dataType.simpleString()
        narrow = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
        found = map_slices(narrow, run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
    else:
        f = F.col("found")
        found = scan_benchmark(docs.select("doc_id", "text"), benchmark).select(
            "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256")
        )
    return found.withColumn("contaminated", verdict(F.col("n_hit"), F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated documents, columns unchanged (one pass, no shuffle, for one block)."""
    (name,) = free_names(docs.columns, "__found")
    found = F.col(name)
    return scan_benchmark(docs, benchmark, name).where(~verdict(n_hit(found), found["n_words"])).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit span of words cut out of the text (from the first word's start to the last one's end)."""
    (name,) = free_names(docs.columns, "__found")
    scanned = scan_benchmark(docs, benchmark, name)
    names = docs.columns

    def cut(text: str, spans: list[dict]) -> str:
        import regex

        places = [m.span() for m in regex.finditer(_ONE_WORD, text)]
        kept, at = [], 0
        for h in spans:
            kept.append(text[at : places[h["a"]][0]])
            at = places[h["b"] - 1][1]
        return "".join([*kept, text[at:]])

    def run(batches):
        for part in slices(batches):
            texts = [cut(t, f["hits"]) if f["hits"] else t for t, f in zip(part.column("text").to_pylist(), part.column(name).to_pylist())]
            keep_ = [pa.array(texts, type=part.schema.field("text").type) if n == "text" else part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(keep_, names=names)

    return scanned.mapInArrow(run, docs.schema)
