"""Sources and sinks.

A "workbook" is a directory holding two tables (``pan_data``, ``gstin_data``);
every write goes to a new numbered version directory, and a marker written there
last makes it the current one, so nothing is ever overwritten (S8, S9).
"""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampNTZType)

from regspark.functions.ids import NA_TOKENS, null_if_tokens
from regspark.functions.text import file_extension, stamp
from regspark.operators.runlog import latest_states
from regspark.session import hadoop_fs, path_exists

# --- fixed values -----------------------------------------------------------
ALLOWED_EXTENSIONS = ("xlsx", "xls", "csv")
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
CSV_QUOTING = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
SPLIT_SHIFT = 20  # splits of a file start at least 2^20 bytes apart
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"  # written with one slash or three
MAX_SPLIT_FILES = 1 << 14  # files of a folder whose rows are numbered by split; of more files each is read by one task
COMPLETE_MARKER = "_COMPLETE"
# JSON time stamps keep microseconds (the default format stops at milliseconds).
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# ---------------------------------------------------------------------------

RESULT_ITEM = StructType([
    StructField("ord", LongType()), StructField("gstin", StringType()),
    StructField("gstin_status", StringType()), StructField("state", StringType()),
    StructField("result", StringType()),
])
CHECKPOINT_SCHEMA = StructType([
    StructField("batch", LongType()),
    StructField("processed_pans", ArrayType(StringType())),
    StructField("results", MapType(StringType(), ArrayType(RESULT_ITEM))),
    StructField("timestamp", TimestampNTZType()),
])
JOB_RECORD = StructType([
    StructField("id", StringType()), StructField("filename", StringType()),
    StructField("file_path", StringType()), StructField("status", StringType()),
    StructField("type", StringType()),
    StructField("created_at", TimestampNTZType()), StructField("start_time", TimestampNTZType()),
    StructField("end_time", TimestampNTZType()), StructField("result_file", StringType()),
    StructField("excel_file", StringType()), StructField("error", StringType()),
    StructField("gstins", ArrayType(StringType())),
    StructField("progress", StructType([
        StructField("total", LongType()), StructField("processed", LongType()),
        StructField("successful", LongType()), StructField("failed", LongType()),
        StructField("processed_count", LongType()), StructField("timestamp", TimestampNTZType())])),
    StructField("results", ArrayType(StructType([
        StructField("gstin", StringType()), StructField("success", BooleanType()),
        StructField("error", StringType())]))),
    StructField("parameters", StructType([
        StructField("headless", BooleanType()), StructField("test_mode", BooleanType()),
        StructField("limit", IntegerType()), StructField("resume", BooleanType())])),
    StructField("changed_at", TimestampNTZType()),
])
RUN_LOG_LINE = MapType(StringType(), JOB_RECORD)
# Schemas of the landed responses (S12): what came back per PAN and per GSTIN.
LANDED_SCHEMAS = {
    "lookup_results": StructType([
        StructField("pan", StringType()), StructField("ord", LongType()), StructField("gstin", StringType()),
        StructField("gstin_status", StringType()), StructField("state", StringType()),
        StructField("result", StringType()), StructField("seen_at", TimestampNTZType())]),
    "details": StructType([
        StructField("gstin", StringType()), StructField("trade_name", StringType()),
        StructField("registration_date", StringType())]),
    "details_hsn": StructType([
        StructField("gstin", StringType()), StructField("pos", LongType()), StructField("hsn_code", StringType())]),
    "lookup_pages": StructType([
        StructField("pan", StringType()), StructField("page_no", LongType()), StructField("html", StringType())]),
    "detail_pages": StructType([StructField("gstin", StringType()), StructField("html", StringType())]),
}


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


# --- S1, S8, S9: two-table workbook -------------------------------------------

class VersionConflict(RuntimeError):
    """Another writer has made a newer version than the one this write started from."""


def write_two_tables(pan_data: DataFrame, gstin_data: DataFrame, root: str, based_on: str | None = None) -> str:
    """Both tables into a fresh version directory, then its marker (S9 keeps the old).

    Versions are numbered; the current one is the last that holds the marker, so a
    write that fails at any point leaves the earlier version current. Each writer reserves
    a number of its own. A writer that passes the version it read as ``based_on`` gets
    ``VersionConflict``, before or after its tables are written, if another one is current by then.
    """
    spark = pan_data.sparkSession
    _check_base(spark, root, based_on)
    number = max((int(v.split("-")[1]) for v in _versions(spark, root)), default=0) + 1
    while not _reserved(spark, root, number):
        number += 1
    target = os.path.join(root, f"v-{number:010d}-{uuid.uuid4().hex}")
    pan_data.write.mode("errorifexists").parquet(os.path.join(target, "pan_data"))
    gstin_data.write.mode("errorifexists").parquet(os.path.join(target, "gstin_data"))
    _check_base(spark, root, based_on)
    spark.range(1).coalesce(1).write.mode("errorifexists").parquet(os.path.join(target, COMPLETE_MARKER))
    return target


def _check_base(spark: SparkSession, root: str, based_on: str | None) -> None:
    if based_on is not None and current_version(spark, root) != based_on:
        raise VersionConflict(f"{based_on} is no longer the current version under {root}")


def _reserved(spark: SparkSession, root: str, number: int) -> bool:
    """Whether this writer got the number: its file can be made only once."""
    hit = hadoop_fs(spark, os.path.join(root, "_numbers", f"{number:010d}"))
    if hit is None:  # no JVM gateway: the random part of the folder's name keeps writers apart
        return True
    if hit[0].getUri().getScheme() == "file":  # Hadoop looks first and creates then; two writers may pass between
        path = hit[1].toUri().getPath()
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        return bool(hit[0].createNewFile(hit[1]))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def current_version(spark: SparkSession, root: str) -> str | None:
    """The last complete version directory; None if there is none (any other failure is an error)."""
    for version in reversed(_versions(spark, root)):
        target = os.path.join(root, version)
        if path_exists(spark, os.path.join(target, COMPLETE_MARKER, "_SUCCESS")):
            return target
    return None


def _versions(spark: SparkSession, root: str) -> list[str]:
    return sorted(n for n in table_names(spark, root) if re.fullmatch(r"v-[0-9]{10,}-[0-9a-f]{32}", n))


def table_names(spark: SparkSession, version_dir: str | None) -> list[str]:
    """Names of the folders in a directory: the tables of a version (for C4), or the versions."""
    if version_dir is None:
        return []
    hit = hadoop_fs(spark, version_dir)
    if hit is None:
        local = _local(version_dir)
        if not os.path.isdir(local):
            return []
        return sorted(n for n in os.listdir(local) if n[0] != "_" and os.path.isdir(os.path.join(local, n)))
    fs, jvm_path = hit
    if not fs.exists(jvm_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path) if s.isDirectory()]
    return [n for n in names if n[0] != "_"]


def read_two_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The current version's two tables."""
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no table version under {root}")
    return (spark.read.parquet(os.path.join(v, "pan_data")),
            spark.read.parquet(os.path.join(v, "gstin_data")))


# --- S12: landed responses ---------------------------------------------------------

def write_landed(df: DataFrame, path: str, kind: str) -> None:
    """Land a response table (Parquet) in the shape ``read_landed`` expects."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LANDED_SCHEMAS[kind].fields]
    df.select(*cols).write.mode("append").parquet(path)


def read_landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed responses with their declared schema (no inference, pruned scans)."""
    return spark.read.schema(LANDED_SCHEMAS[kind]).parquet(path)


# --- S2, S3, S4, S10: CSV ----------------------------------------------------------

def read_sheet(spark: SparkSession, path: str, na_tokens=NA_TOKENS, row_id: str | None = "row_id",
               multi_line: bool | None = None) -> DataFrame:
    """S2/S3 + S4: a CSV sheet with a header row, every column as text (ids stay text),
    missing-value spellings turned into NULL, and a ``row_id`` in file order.

    Quotes are doubled inside quoted cells. A file is split over tasks unless a quoted cell holds a line break
    (``multi_line``; ``None`` looks for one), in which case one task reads it. ``row_id`` increases by file
    path, then place in the file (of up to 256 GB); it is not dense.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).options(**CSV_QUOTING)
    if multi_line is None:
        multi_line = holds_line_breaks(spark, path)
    df = reader.option("multiLine", multi_line).csv(path)
    cols = [null_if_tokens(F.col(f"`{c}`").cast("string"), na_tokens).alias(c) for c in df.columns]
    if row_id is None or row_id in df.columns:
        return df.select(*cols)
    files = sorted(re.sub(SCHEME, r"\1:/", f) for f in df.inputFiles())
    if len(files) > MAX_SPLIT_FILES and not multi_line:
        df, multi_line = reader.option("multiLine", True).csv(path), True
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = F.regexp_replace(F.col("_metadata.file_path"), SCHEME, "$1:/")
    rows = df.select(*cols, own.alias("_file"), F.col("_metadata.file_block_start").alias("_at"), place.alias("_place"))
    numbered = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _n long")
    if len(files) <= MAX_SPLIT_FILES:
        numbered = F.broadcast(numbered)  # the listed paths, not the rows, are sent
    listed = F.coalesce(F.col("_n"), F.raise_error(F.concat(F.lit("file was not listed: "), "_file")).cast("long"))
    if multi_line:
        number = listed * (1 << 33) + F.col("_place")
    else:  # file, split within it, place within the task
        number = listed * (1 << 49) + F.shiftright("_at", SPLIT_SHIFT) * (1 << 31) + F.col("_place")
    return rows.join(numbered, "_file", "left").withColumn(row_id, number).drop("_file", "_n", "_at", "_place")


def holds_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes over a line end: some line then has an odd number of quotes. Reads the files as
    lines, split over tasks, until such a line is found."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).limit(1).isEmpty()


def read_csv_text(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV written by ``write_csv`` back exactly: every column as text, a quoted
    empty field as '', an empty unquoted field as NULL (no missing-value tokens)."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("nullValue", "\u0001").option("emptyValue", "").options(**CSV_QUOTING)
            .option("multiLine", holds_line_breaks(spark, path) if multi_line is None else multi_line).csv(path))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Flat CSV with a header. ``single_file`` (one task) is for small exports only."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


# --- S5: input discovery ------------------------------------------------------------

def discover_inputs(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``root`` with an accepted extension and, if ``max_bytes`` is
    given (the web form's bound is ``MAX_UPLOAD_BYTES``), size; only path and length are read (``content`` is pruned away)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length"))
    ext = file_extension(F.col("path"))
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), ext.alias("extension"),
        F.col("length").cast("long").alias("length"),
        (ext.isin(*ALLOWED_EXTENSIONS) & (F.lit(max_bytes is None) | (F.col("length") <= F.lit(max_bytes or 0)))).alias("accepted"))


# --- S6, S7: checkpoint ----------------------------------------------------------------

def write_checkpoint(done: DataFrame, results: DataFrame, path: str, batch: int, as_of,
                     block: int = 1000) -> None:
    """Append one batch (done keys, nested results, time) as JSON records.

    Done keys and results are separate records; results are nested per PAN and
    block of ``block`` order keys, so no record grows with a PAN's result count.
    """
    ts = stamp(as_of).alias("timestamp")
    keys = done.select(F.lit(batch).cast("long").alias("batch"), F.array("pan").alias("processed_pans"),
                       F.lit(None).cast(CHECKPOINT_SCHEMA["results"].dataType).alias("results"), ts)
    items = (results.groupBy("pan", F.floor(F.col("ord") / block).alias("_blk"))
             .agg(F.array_sort(F.collect_list(F.struct(*RESULT_ITEM.names))).alias("items")))
    nested = items.select(F.lit(batch).cast("long").alias("batch"),
                          F.lit(None).cast("array<string>").alias("processed_pans"),
                          F.create_map("pan", "items").alias("results"), ts)
    keys.unionByName(nested).write.mode("append").options(**JSON_OPTIONS).json(path)


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(done keys, flat results); an absent checkpoint gives two empty tables; a
    malformed record or an unreadable path is an error, so no result is lost unseen."""
    if path_exists(spark, path):
        raw = spark.read.schema(CHECKPOINT_SCHEMA).options(**JSON_OPTIONS).option("mode", "FAILFAST").json(path)
    else:
        raw = spark.createDataFrame([], CHECKPOINT_SCHEMA)
    done = raw.select(F.explode("processed_pans").alias("pan"), "timestamp")
    flat = raw.select(F.explode("results").alias("pan", "items")).select(
        "pan", F.explode("items").alias("i")).select("pan", "i.*")
    return done, flat


# --- S11: run log --------------------------------------------------------------------------

def _run_lines(jobs: DataFrame) -> DataFrame:
    """JSON lines, each an object keyed by job id.

    A field is the column of its name; a column that ``jobs`` lacks is left out of the
    record. ``job_id`` and the run options may stand as plain columns.
    """
    given = {"id": F.col("job_id")} if "id" not in jobs.columns else {}
    if "parameters" not in jobs.columns:
        given["parameters"] = F.struct("headless", "test_mode", F.col("max_pans").alias("limit"), "resume")
    rec = F.struct(*[given.get(f.name, F.col(f.name) if f.name in jobs.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                     for f in JOB_RECORD.fields])
    return jobs.select(F.to_json(F.create_map("job_id", rec), JSON_OPTIONS).alias("value"))


def write_run_log(jobs: DataFrame, path: str) -> None:
    """The run log as JSON lines, one job per line, in a new folder."""
    _run_lines(jobs).write.mode("errorifexists").text(path)


def append_run_changes(jobs: DataFrame, path: str) -> None:
    """The present records of changed jobs (with ``changed_at``) added to the log; nothing is rewritten, so writers
    do not meet. A job is removed (U3) by a record of status ``removed``."""
    if "changed_at" not in jobs.columns:
        raise ValueError("a change needs its time, changed_at")
    _run_lines(jobs).write.mode("append").text(path)


def read_run_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per job, as its last change left it."""
    lines = spark.read.text(path)
    return latest_states(lines.select(F.explode(F.from_json("value", RUN_LOG_LINE, JSON_OPTIONS)).alias("job_id", "job")))


def compact_run_log(spark: SparkSession, path: str, to: str) -> None:
    """The log's present state as a new log with one line per job."""
    _run_lines(read_run_states(spark, path)).write.mode("errorifexists").text(to)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log back as one row per job."""
    lines = spark.read.text(path)
    return lines.select(F.explode(F.from_json("value", RUN_LOG_LINE, JSON_OPTIONS)).alias("job_id", "job")).select(
        "job_id", "job.*")
