"""Zipped CSV deliveries: inventory, lines, ragged rows, one schema per table, loads by archive.

Archives are chosen by name and size first; only the chosen ones are read and opened. Lines carry a key of
their header, not its text; where a column lies in a line is worked out once for each distinct header.
A table is written with a partition per archive, so that a later delivery replaces its own and no other.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import archive_base, archive_table, file_name
from ..operators.bounded import broadcast_if_small
from ..session import settle
from ..sinks.tables import replace_partitions

SEPARATOR = ";"
#: Characters of the lines that leave Python at once.
BATCH_CHARS = 1 << 23
#: Bytes that Spark holds of one file.
MOST_BYTES = 2**31 - 1
DATE = "[0-9]" * 8

LINE_SCHEMA = (
    "path string, member string, line_no bigint, header_key binary, header string, line string, fits boolean, problem string"
)


def read_archives(
    spark: SparkSession, root: str, layout: str = "*", tables: list[str] | None = None
) -> DataFrame:
    """Archive files below `root/layout`, of some tables or all: path, length and, where it is asked for, content.

    Files of other tables are left out when the folders are listed. Archives over 2 GiB, which Spark can't hold,
    have no content here: ask `oversized` for them.
    """
    return _archives(spark, root, layout, tables).filter(F.col("length") <= MOST_BYTES)


def oversized(spark: SparkSession, root: str, layout: str = "*", tables: list[str] | None = None) -> DataFrame:
    """Archives of over 2 GiB: path, problem."""
    large = _archives(spark, root, layout, tables).select("path", "length").filter(F.col("length") > MOST_BYTES)
    return large.select("path", F.concat(F.lit("too large: "), F.col("length"), F.lit(" bytes")).alias("problem"))


def _archives(spark: SparkSession, root: str, layout: str, tables: list[str] | None) -> DataFrame:
    names = "*.[zZ][iI][pP]"
    if tables is not None:
        names = "{%s}_%s%s" % (",".join(_plain_glob(t) for t in tables), DATE, names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(f"{root.rstrip('/')}/{layout}")
    return files.select("path", "length", "content")


def _plain_glob(name: str) -> str:
    """A pattern that matches the name only."""
    return "".join(f"\\{c}" if c in "\\*?[]{},^" else c for c in name)


def inventory(archives: DataFrame) -> DataFrame:
    """(table, archives, bytes) from names and sizes; the content column is never read."""
    sized = archives.select("path", "length")
    return (
        sized.withColumn("table", archive_table(F.col("path")))
        .filter(F.col("table").isNotNull())
        .groupBy("table")
        .agg(F.count(F.lit(1)).alias("archives"), F.sum("length").alias("bytes"))
    )


def latest_delivery(archives: DataFrame) -> DataFrame:
    """Path that wins for each (table, base): the last in sort order. Also how many it replaces."""
    named = archives.select(
        "path", archive_table(F.col("path")).alias("table"), archive_base(F.col("path")).alias("base")
    )
    return named.groupBy("table", "base").agg(
        F.max("path").alias("path"), (F.count(F.lit(1)) - 1).alias("replaced")
    )


def _encoding(member) -> str:
    """UTF-8 when the whole member is valid, else Latin-1; reads in chunks."""
    check = codecs.getincrementaldecoder("utf-8")()
    try:
        while chunk := member.read(1 << 20):
            check.decode(chunk)
        check.decode(b"", True)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8-sig"


def _archive_lines(path: str, content: bytes) -> Iterator[tuple]:
    """(member, line_no, header_key, header, line, fits, problem); line 0 carries the header."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield None, None, None, None, None, None, "not a zip archive"
        return
    member = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
    if member is None:
        yield None, None, None, None, None, None, "no csv member"
        return
    try:
        with archive.open(member) as raw:
            encoding = _encoding(raw)
    except (zipfile.BadZipFile, zipfile.zlib.error, EOFError, RuntimeError, NotImplementedError) as e:
        yield member, None, None, None, None, None, f"unreadable: {type(e).__name__}"
        return
    with archive.open(member) as raw:
        key, separators = None, 0
        for number, line in enumerate(io.TextIOWrapper(raw, encoding, newline="\n")):
            text = line.rstrip("\n").rstrip("\r")
            if key is None:
                key, separators = hashlib.blake2b(text.encode(), digest_size=16).digest(), text.count(SEPARATOR)
                yield member, 0, key, text, None, None, None
            elif text:
                yield member, number, key, None, text, text.count(SEPARATOR) == separators, None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def table(path: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[path] * len(rows), *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for k in range(batch.num_rows):  # one archive's bytes at a time
            path, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
            rows, chars = [], 0
            for row in _archive_lines(path, content):
                rows.append(row)
                chars += len(row[4] or row[3] or "") + 64
                if chars >= BATCH_CHARS:
                    yield table(path, rows)
                    rows, chars = [], 0
            if rows:
                yield table(path, rows)


def zip_lines(archives: DataFrame) -> DataFrame:
    """Lines of the first CSV member of each archive, decompressed on the executors.

    Line 0 has the header, every other line its text, a key of its header and whether it has as many fields (quotes
    have no meaning here); blank lines are left out. An archive that cannot be read gives a single row with its
    `problem`. Each archive is opened once; memory holds its packed bytes and one batch of lines.
    """
    return archives.select("path", "content").mapInArrow(_lines, LINE_SCHEMA)


def split_ragged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with as many fields as their header, all others)."""
    return lines.filter("line is not null and fits"), lines.filter("line is not null and not fits")


def distinct_headers(lines: DataFrame) -> DataFrame:
    """(table, header_key, header, path): a row per distinct header of a table, with the first path that has it."""
    headers = lines.filter("line_no = 0 and header is not null")
    return headers.groupBy(archive_table(F.col("path")).alias("table"), "header_key").agg(
        F.min("header").alias("header"), F.min("path").alias("path")
    )


def header_names(header: Column) -> Column:
    return F.transform(F.split(header, SEPARATOR, -1), lambda n: F.trim(n))


def header_union(headers: DataFrame) -> dict[str, list[str]]:
    """Column names per table over its distinct headers: trimmed, first seen first, in path order.

    What reaches the driver are the tables' columns.
    """
    names = headers.select("table", "path", F.posexplode(header_names(F.col("header"))).alias("at", "name"))
    first = names.filter("name <> ''").groupBy("table", "name").agg(F.min(F.struct("path", "at")).alias("seen"))
    union: dict[str, list[str]] = {r["table"]: [] for r in headers.select("table").distinct().collect()}
    for row in sorted(first.collect(), key=lambda r: (r["seen"]["path"], r["seen"]["at"])):
        union[row["table"]].append(row["name"])
    return union


def align(lines: DataFrame, headers: DataFrame, columns: list[str]) -> DataFrame:
    """Fields by trimmed header name, NULL where the file lacks the column or the field is empty.

    The place of every column is found once for each distinct header of the table; a line is split once.
    """
    names = header_names(F.col("header"))
    wanted = F.array(*(F.lit(c) for c in columns)) if columns else F.array().cast("array<string>")
    places = F.transform(wanted, lambda c: (F.array_position(names, c) - 1).cast("int"))
    known = headers.select("header_key", places.alias("_places")).dropDuplicates(["header_key"])
    split = lines.join(broadcast_if_small(known), "header_key").withColumn("_cells", F.split("line", SEPARATOR, -1))

    def cell(i: int) -> Column:
        at = F.col("_places")[i]
        return F.when(at >= 0, F.nullif(F.get(F.col("_cells"), at), F.lit("")))

    return split.select("path", "line_no", *(cell(i).alias(c) for i, c in enumerate(columns)))


def replaced_deliveries(archives: DataFrame) -> DataFrame:
    """Paths that a later folder's archive of the same name replaces. Reads names only."""
    named = archives.select(
        "path", archive_table(F.col("path")).alias("table"), archive_base(F.col("path")).alias("base")
    )
    last = named.groupBy("table", "base").agg(F.max("path").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return (
        named.join(last.filter(F.col("_n") > 1), ["table", "base"])
        .filter(F.col("path") != F.col("_last"))
        .select("path")
    )


class Delivery:
    """Archives, opened once; tables are read from the shared copy of their lines."""

    def __init__(self, archives: DataFrame, tables: list[str] | None = None, too_large: DataFrame | None = None):
        """`archives` has path and content; with `tables`, archives of others are not opened."""
        # The few replaced paths are excluded by a broadcast: the packed bytes stay where they are.
        name = archive_table(F.col("path"))
        archives = archives.filter(name.isNotNull() if tables is None else name.isin(list(tables)))
        replaced = broadcast_if_small(settle(replaced_deliveries(archives), "replaced"))
        kept = archives.join(replaced, "path", "left_anti")
        lines = zip_lines(kept).withColumn("table", archive_table(F.col("path")))
        self.lines = settle(lines, "zip-lines", ["table"])
        self.headers = settle(distinct_headers(self.lines), "zip-headers")
        self.columns = header_union(self.headers)
        self.good, self.bad = split_ragged(self.lines)
        self.too_large = too_large

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, layout: str = "*", tables: list[str] | None = None) -> Delivery:
        """The archives below `root/layout`, of some tables or all; no file of another table is read.

        Name and size decide first: of archives that a later folder replaces, and of those over 2 GiB, the
        content is not read either. The driver holds the paths of the archives, as in any scan of them.
        """
        named = read_archives(spark, root, layout, tables).select("path")
        last = latest_delivery(named).filter(F.col("table").isNotNull())
        if tables is not None:
            last = last.filter(F.col("table").isin(list(tables)))
        paths = [_literal(r["path"]) for r in last.select("path").collect()]
        chosen = spark.read.format("binaryFile").load(paths) if paths else read_archives(spark, root, layout).limit(0)
        return cls(chosen.select("path", "length", "content"), tables, oversized(spark, root, layout, tables))

    def table(self, name: str) -> DataFrame:
        """All rows of one table in the union of its headers, every column text."""
        rows, of = self.good.filter(F.col("table") == name), self.headers.filter(F.col("table") == name)
        return align(rows, of, self.columns[name]).withColumn("source", file_name(F.col("path")))

    def quarantine(self) -> DataFrame:
        """Ragged lines, as they were, with the header they did not fit."""
        of = broadcast_if_small(self.headers.select("table", "header_key", "header"))
        rows = self.bad.drop("header").join(of, ["table", "header_key"])
        return rows.select("table", archive_base(F.col("path")).alias("base"), "line_no", "header", "line")

    def problems(self) -> DataFrame:
        """(path, problem) of archives that could not be read, or are too large to be."""
        found = self.lines.filter(F.col("problem").isNotNull()).select("path", "problem")
        return found if self.too_large is None else found.unionByName(self.too_large)

    def bases(self) -> DataFrame:
        """(table, base): the archives that were read."""
        return self.lines.filter("line_no = 0").select("table", archive_base(F.col("path")).alias("base")).distinct()

    def write(self, root: str) -> None:
        """Load the delivery into `root/<table>/base=<archive>/…`, ragged lines into `root/errors/table=…/base=…`.

        Only the partitions of the archives that were read are replaced, also by nothing. A second load of the same
        delivery changes nothing, so a load that failed is simply run again.
        """
        bases = settle(self.bases(), "bases")
        for name in self.columns:
            rows = self.table(name).withColumn("base", archive_base(F.col("path")))
            replace_partitions(rows, f"{root}/{name}", ["base"], bases.filter(F.col("table") == name).select("base"))
        replace_partitions(self.quarantine(), f"{root}/errors", ["table", "base"], bases)


def _literal(path: str) -> str:
    """A path as a pattern that matches only itself."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)
