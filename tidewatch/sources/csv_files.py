"""CSV files in and out.

Reading begins with a catalogue, a table of the files: what is wrong with each, its encoding, whether quotes span lines, its size and
its header. Files that agree in encoding, quotes and header are of one kind and are read together by Spark's CSV reader, all columns as
text (so leading zeros survive); kinds are put under each other by column name, so files may order their columns as they like. The
driver gets a row per kind, with the names of its files, which the reader is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.errors import DataValidationError
from tidewatch.functions.text import neutralise_frame, strip
from tidewatch.schema import clean_header
from tidewatch.sources.staging import measured, stage

CORRUPT = "_corrupt_record"
# Input order of CSV rows: file, split within the file, row within the split.
POSITION = ["_file", "_block", "_row"]
BOM = "\ufeff"
# Lets Spark read and write encodings beyond the few it names.
CHARSETS = "spark.sql.legacy.javaCharsets"


@dataclass
class CsvData:
    rows: DataFrame
    quarantine: DataFrame


def allow_charsets(spark: SparkSession) -> bool:
    """Whether the session may read and write GB18030. A session that does not say is set to it; one that forbids it stays as it is."""
    if spark.conf.get(CHARSETS, "true") != "true":
        return False
    spark.conf.set(CHARSETS, "true")
    return True


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line as it is in its file, with its place: file, split, and a number that rises within the split."""
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )


def catalogue(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: problem (null if usable), encoding, multiline, size, header (its first line that holds something)."""
    lines = _lines(spark, paths)
    value = F.col("value")
    # Counted in bytes: neither UTF-8 nor GB18030 uses the quote's byte inside another character.
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    filled = strip(F.replace(value, F.lit(BOM), F.lit(""))) != ""
    seen = lines.groupBy("file").agg(
        F.bool_or(F.contains(value, F.char(F.lit(0)))).alias("nul"),
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(filled).alias("filled"),
        F.bool_or(quotes % 2 == 1).alias("multiline"),
        (F.sum(quotes) % 2 == 1).alias("open"),
        F.max("size").alias("size"),
        F.min(F.when((F.col("block") == 0) & filled, F.col("place"))).alias("place"),
    )
    seen = measured(seen)  # a narrow row per file
    # the same splits as above, so the first line has the number it had there
    first = lines.select("place", "value").join(seen.select("place"), "place")
    problem = (
        F.when(~F.col("filled"), F.lit("empty file")).when(F.col("nul"), F.lit("binary content"))
        .when(F.col("open"), F.lit("a quote is not closed"))
    )
    encoding = F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("GB18030"))
    rows = seen.join(first.withColumnRenamed("value", "header"), "place", "left").select(
        "file", problem.alias("problem"), encoding.alias("encoding"), "multiline", "size",
        F.hex(F.replace("header", F.lit(BOM), F.lit(""))).alias("header"),
    )
    bare = spark.createDataFrame([(f,) for f in _without_content(spark, paths, seen)], "file string")
    return rows.unionByName(bare.withColumns({"problem": F.lit("empty file"), "size": F.lit(0).cast("long")}), allowMissingColumns=True)


def _without_content(spark: SparkSession, paths: str | list[str], seen: DataFrame) -> list[str]:
    """Files of the listing that gave no line at all."""
    listed = spark.read.text(paths).inputFiles()
    if len(listed) == seen.count():
        return []
    return _unlisted(listed, seen)


def _named(uri: str) -> str:
    """The path that a reader takes for the file of a listing: decoded, and no pattern whatever signs it has."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _unlisted(paths: list[str], seen: DataFrame) -> list[str]:
    """The paths that are no ``file`` of ``seen``, however many slashes begin them."""
    plain = lambda p: re.sub(r"^(\w+):/+", r"\1:/", p)
    known = {plain(r["file"]) for r in seen.select("file").toLocalIterator()}
    return [p for p in paths if plain(p) not in known]


def _reader(spark: SparkSession, encoding: str, multiline: bool):
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("enforceSchema", False)
    )


def _names(spark: SparkSession, files: list[str], encoding: str, multiline: bool) -> list[str]:
    return _reader(spark, encoding, multiline).csv(files[0]).columns


def _too_long(columns: list[str]) -> Column:
    """More fields than the header: such a line cannot be placed; a short one is null-filled.

    The condition touches every column: a pruned CSV scan would not see the surplus fields.
    """
    bare = F.regexp_replace(F.col(CORRUPT), r'"([^"]|"")*"', "")
    surplus = F.coalesce(F.size(F.split(bare, ",")) > len(columns), F.lit(False))
    return surplus & (F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in columns])) >= 0)


Kind = tuple[str, bool, list[str]]


def _kinds(files: DataFrame) -> list[Kind]:
    """(encoding, quotes span lines, files) of the usable files; a row per kind meets the driver."""
    usable = files.where("problem is null").groupBy("encoding", "multiline", "header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [(r["encoding"], r["multiline"], [_named(f) for f in r["files"]]) for r in usable.orderBy("encoding", "multiline", "header").collect()]


def _refuse_unusable(files: DataFrame, what: str, shown: int = 20) -> None:
    bad = files.where("problem is not null")
    some = [f"{r['file']}: {r['problem']}" for r in bad.orderBy("file").limit(shown).collect()]
    if some:
        raise DataValidationError(f"{what} cannot be read: " + "; ".join(some))


def _of_kind(spark: SparkSession, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """Rows with their position, and lines with too many fields."""
    encoding, multiline, names = kind
    columns = _names(spark, names, encoding, multiline)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    df = (
        _reader(spark, encoding, multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(schema)
        .csv(names)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    long = _too_long(columns)
    good = df.where(~long).drop(CORRUPT).toDF(*[clean_header(c) for c in columns], *POSITION)
    surplus = df.where(long).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("line"), F.lit("too many fields").alias("reason"))
    return good, surplus


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    what: str = "the table",
    encoding: str | None = None,
    multiline: bool = False,
    unusable: str = "error",
) -> CsvData:
    """Read CSV files in UTF-8 (with or without BOM) or GB18030/GBK, whatever the order of their columns.

    The rows carry their position (``POSITION``), which keep-first operators order by; a column that a file lacks is null in its rows.
    A line with more fields than its header goes to the quarantine (file, line, reason); a short one is filled with nulls. Files that are
    empty, binary or end inside a quote are an error, or, with ``unusable="quarantine"``, rows of the quarantine without a line. Naming
    the ``encoding`` skips the catalogue; the files then have to have one header.
    """
    if unusable not in ("error", "quarantine"):
        raise ValueError("unusable files are an error or go to the quarantine")
    rejected = []
    if encoding is None:
        files = stage(catalogue(spark, paths), "file-catalogue")
        if unusable == "error":
            _refuse_unusable(files, what)
        rejected.append(files.where("problem is not null").select("file", F.lit(None).cast("string").alias("line"), F.col("problem").alias("reason")))
        kinds = _kinds(files)
    else:
        kinds = [(encoding, multiline, [paths] if isinstance(paths, str) else list(paths))]
    if not kinds:
        raise DataValidationError(f"{what} has no usable files")
    if any(name != "UTF-8" for name, *_ in kinds) and not allow_charsets(spark):
        raise DataValidationError(f"{what} is not in UTF-8; set {CHARSETS} to true to read other encodings")
    read = [_of_kind(spark, kind) for kind in kinds]
    return CsvData(_union([rows for rows, _ in read]), _union([*rejected, *[surplus for _, surplus in read]]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Sources of one kind under each other, columns matched by name."""
    return _union(frames)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header and byte-order mark, safe to open in a spreadsheet; one file per partition."""
    safe = neutralise_frame(df)
    first, *rest = safe.columns
    safe.toDF(BOM + first, *rest).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def file_signature(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, signature): the first 16 hex digits of the SHA-256 of each file's bytes, for files of any size.

    A file's lines pass through one task in order (SHA-256 can't be split), which holds no more than a batch of them.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["file", "block", "place"]
    rows = lines.repartition("file").sortWithinPartitions(*order).select("file", "size", "value")
    found = rows.mapInArrow(_signatures, "file string, signature string")
    bare = _without_content(spark, paths, lines.select("file").distinct())  # empty, or a byte-order mark alone
    if not bare:
        return found
    small = spark.read.format("binaryFile").load([_named(f) for f in bare]).select(
        F.col("_metadata.file_path").alias("file"), F.substring(F.sha2("content", 256), 1, 16).alias("signature")
    )
    empty = hashlib.sha256().hexdigest()[:16]  # Spark may give no row for a file without bytes
    void = spark.createDataFrame([(f, empty) for f in _unlisted(bare, small)], "file string, signature string")
    return found.union(small).union(void)


class _Bytes:
    """The digest of a file from its lines. Reading drops a byte-order mark and does not tell whether the last line was ended;
    the file's size tells both at the end, so the digests with and without the mark are carried on."""

    def __init__(self, file: str, size: int):
        self.file, self.size, self.read, self.begun = file, size, 0, False
        self.bare, self.marked = hashlib.sha256(), hashlib.sha256(BOM.encode())

    def add(self, line: bytes) -> None:
        if self.begun:
            line = b"\n" + line
        self.begun = True
        self.read += len(line)
        self.bare.update(line)
        self.marked.update(line)

    def signature(self) -> str:
        left = self.size - self.read
        digest = self.marked if left >= len(BOM.encode()) else self.bare
        if left in (1, 1 + len(BOM.encode())):
            digest.update(b"\n")
        return digest.hexdigest()[:16]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for file, size, line in zip(*(batch.column(c) for c in ("file", "size", "value"))):
            if now is None or now.file != file.as_py():
                if now:
                    done.append(now)
                now = _Bytes(file.as_py(), size.as_py())
            now.add(line.as_py())
    done += [now] if now else []
    yield pa.RecordBatch.from_pydict({"file": [x.file for x in done], "signature": [x.signature() for x in done]},
                                     pa.schema([("file", pa.string()), ("signature", pa.string())]))
