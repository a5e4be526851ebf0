"""Readers for every input shape: JSON envelopes, GeoJSON, RSS, delimited text, GTFS, gzip, workbooks."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo, text as tx

#: Keys under which envelopes hold their records.
ENVELOPES = ("features", "items", "Items", "data", "records", "list", "results")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): JSON files whole; compressed files by their suffix."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def records(doc: Column) -> Column:
    """The records of a document as JSON texts: a list, an envelope's list, or the document itself."""
    many = lambda text: F.from_json(text, "array<string>")
    inner = [F.when(F.get_json_object(doc, f"$.{k}").startswith("["), many(F.get_json_object(doc, f"$.{k}"))) for k in ENVELOPES]
    return F.coalesce(F.when(F.ltrim(doc).startswith("["), many(doc)), *inner, F.array(doc))


def json_records(spark: SparkSession, path: str, budget: int | None = None) -> DataFrame:
    """(path, record): one row a record; ``budget`` keeps a file's first records (a feature of polling, off by default)."""
    every = json_documents(spark, path).select("path", F.posexplode(records(F.col("doc"))).alias("at", "record"))
    return (every.where(F.col("at") < budget) if budget is not None else every).select("path", "record")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, record) from files with a JSON record on each line: splittable, for large feeds."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))


def delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """CSV, TSV or GTFS text as strings; without a header the columns are col_0, col_1 and so on."""
    rows = spark.read.csv(path, sep=sep, header=header, multiLine=False, mode="PERMISSIVE", escape='"')
    return rows if header else rows.toDF(*(columns or [f"col_{i}" for i in range(len(rows.columns))]))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, record) of the items of RSS or Atom XML files, as the JSON that collectors write."""
    rows = spark.read.format("xml").option("rowTag", "item").load(path)
    return rows.select(F.lit(path).alias("path"), F.to_json(F.struct(*rows.columns)).alias("record"))


def gtfs(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("routes", "stops", "trips")) -> DataFrame:
    """The tables of a GTFS folder under one schema, with record_kind."""
    out = None
    for kind in kinds:
        part = delimited(spark, f"{folder}/{kind}.txt").withColumn("record_kind", F.lit(kind[:-1]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, modified, size) whose signature differs from the one seen before."""
    return files.join(seen, ["path", "modified", "size"], "left_anti")


Getter = Callable[[str], Column]


def parsed(rows: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, Getter]:
    """``rows`` ready for access to ``fields`` by name, and the access: columns of delimited rows, or members of the JSON
    ``record`` (properties first), which is read once however many there are."""
    if "record" not in rows.columns:
        return rows, named({c: F.col(f"`{c}`") for c in rows.columns})
    at = {f: k for k, f in enumerate(dict.fromkeys(fields))}
    top = rows.select("*", F.json_tuple("record", *at, "properties", *SHAPES).alias(*(f"__top{k}" for k in at.values()), "__properties", *(f"__{s}" for s in SHAPES)))
    both = top.select("*", F.json_tuple("__properties", *at).alias(*(f"__own{k}" for k in at.values())))
    return both, lambda f: F.coalesce(f"__own{at[f]}", f"__top{at[f]}")


def named(columns: dict[str, Column]) -> Getter:
    """Access to fields by name, letter case aside; null for what there is not."""
    names = {c.lower(): column for c, column in columns.items()}
    return lambda f: names[f.lower()].cast("string") if f.lower() in names else F.lit(None).cast("string")


# fixed values: spellings of the coordinates
LATITUDES = ("dispatch_latitude", "latitude", "lat", "Latitude", "y", "stop_lat")
LONGITUDES = ("dispatch_longitude", "longitude", "lon", "long", "Longitude", "x", "stop_lon")
#: Members of a JSON record that hold its place in another form.
SHAPES = ("geometry", "PointCoordinate")


def location(get: Getter, has_json: bool) -> Column:
    """A point of rows that were ``parsed``: GeoJSON geometry, a [lat, lon] pair, or the first spelling of latitude and longitude."""
    number = lambda c: c.try_cast("double")
    lat, lon = F.coalesce(*(number(get(f)) for f in LATITUDES)), F.coalesce(*(number(get(f)) for f in LONGITUDES))
    flat = geo.point(lon, lat)
    if not has_json:
        return flat
    at = lambda p: number(F.get_json_object("__geometry", f"$.coordinates{p}"))
    pair = lambda k: number(F.get_json_object("__PointCoordinate", f"$[{k}]"))
    shape = F.get_json_object("__geometry", "$.type")
    first = F.when(shape == "Point", geo.point(at("[0]"), at("[1]"))).when(shape.isin("LineString", "MultiPoint"), geo.point(at("[0][0]"), at("[0][1]"))).when(shape == "Polygon", geo.point(at("[0][0][0]"), at("[0][0][1]")))
    return F.coalesce(F.when(F.col("__geometry").isNotNull(), first), F.when(F.col("__PointCoordinate").isNotNull(), geo.point(pair(1), pair(0))), flat)


def in_region(point: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inside (min lon, min lat, max lon, max lat); rows without a place pass."""
    return point.isNull() | (point["lon"].between(bounds[0], bounds[2]) & point["lat"].between(bounds[1], bounds[3]))


def admission(point: Column, relevant: Column, bounds: tuple[float, float, float, float], comparator: Column) -> Column:
    """unlocated, region or comparator for rows that are kept, null for rows to drop."""
    return F.when(~relevant, None).when(point.isNull(), "unlocated").when(in_region(point, bounds), "region").when(comparator, "comparator")


class _Sheet(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class _WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", 0))

    def _open(self):
        """The workbook in whatever file system its path names."""
        system, path = pf.FileSystem.from_uri(self.path)
        return zipfile.ZipFile(system.open_input_file(path))

    def partitions(self) -> list[InputPartition]:
        with self._open() as book:
            return [_Sheet(self.path, n) for n in sorted(book.namelist()) if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with self._open() as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                for _, el in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                    if el.tag == f"{ns}si":
                        shared.append("".join(t.text or "" for t in el.iter(f"{ns}t")))
                        el.clear()
            at = 0
            for _, el in ElementTree.iterparse(book.open(partition.name)):
                if el.tag != f"{ns}row":
                    continue
                cells: dict[int, str | None] = {}
                for c in el.iter(f"{ns}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    column = 0
                    for ch in letters:
                        column = column * 26 + ord(ch) - 64
                    value, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                    said = value.text if value is not None else "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else None
                    cells[column or len(cells) + 1] = shared[int(said)] if c.get("t") == "s" and said else said
                yield partition.name, at, [cells.get(i) for i in range(1, max(cells, default=0) + 1)]
                at += 1
                el.clear()
                if self.limit and at >= self.limit:
                    return


class Workbook(DataSource):
    """Rows of an xlsx workbook as (sheet, row, cells): one partition a sheet, streamed from the zipped XML."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _WorkbookReader(self.options)


def workbook(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").option("limit", str(limit)).load(path)


def discover_layout(rows: DataFrame, bounds: tuple[float, float, float, float], least_pairs: int = 50) -> dict[str, int | None]:
    """Which columns of a headerless table hold the id, date, URL, latitude and longitude.

    One aggregation profiles all columns: the id is unique integers, the date eight digits, the URL starts with http,
    and the coordinates are the adjacent numeric pair that puts most rows inside the bounds; of pairs that put a like
    share inside, the first.  Only the profile, one row, comes to the driver."""
    names, n = rows.columns, F.count(F.lit(1))
    number = {c: F.col(c).try_cast("double") for c in names}
    checks: list[Column] = [n.alias("n")]
    for i, c in enumerate(names):
        checks += [
            F.count_if(F.col(c).rlike("^[0-9]+$")).alias(f"int_{i}"), F.approx_count_distinct(c, 0.01).alias(f"distinct_{i}"), F.count_if(F.col(c).rlike("^[0-9]{8}$")).alias(f"date_{i}"),
            F.count_if(F.col(c).rlike("^https?://")).alias(f"url_{i}"), F.count(c).alias(f"set_{i}"),
        ]
        if i + 1 < len(names):
            a, b = number[c], number[names[i + 1]]
            inside = lambda lon, lat: lon.between(bounds[0], bounds[2]) & lat.between(bounds[1], bounds[3])
            checks += [F.count_if(inside(b, a)).alias(f"geo_{i}"), F.count_if(a.isNotNull() & b.isNotNull()).alias(f"pair_{i}")]
    p = rows.agg(*checks).first().asDict()
    total = p["n"]
    pick = lambda ok: next((i for i in range(len(names)) if ok(i)), None)
    shares = {i: p[f"geo_{i}"] / p[f"pair_{i}"] for i in range(len(names) - 1) if p[f"pair_{i}"] and p[f"geo_{i}"] >= least_pairs}
    lat = min((i for i, s in shares.items() if s >= 0.85 * max(shares.values())), default=None)
    return {
        "id": pick(lambda i: total and p[f"int_{i}"] == total and p[f"distinct_{i}"] >= 0.97 * total and p[f"date_{i}"] < total),
        "date": pick(lambda i: total and p[f"date_{i}"] == total), "url": pick(lambda i: p[f"set_{i}"] and p[f"url_{i}"] >= 0.9 * p[f"set_{i}"] and p[f"url_{i}"] > 0),
        "latitude": lat, "longitude": None if lat is None else lat + 1,
    }


def when_of(get: Getter, fields: tuple[str, ...]) -> Column:
    """The first field that parses as a time."""
    return F.coalesce(*(tx.feed_time(get(f)) for f in fields), F.lit(None).cast("timestamp"))
