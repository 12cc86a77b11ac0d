"""Text rasters to scan lines, and their columnar cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.numeric import range_normalise
from cohortloom.functions.text import file_stem
from cohortloom.session import path_exists

PREAMBLE_LINES = 4


def _scanned(documents: DataFrame) -> DataFrame:
    """(sample_id, scan, error): the whole raster of a document as array of lines, checked inside its row.

    Four header lines, then `row,v1,...,vW,`. Lines without a row number or values are skipped, empty
    fields dropped. A document is one row, so no check needs a shuffle.
    """
    lines = F.split("content", "\r?\n")
    body = F.slice(lines, PREAMBLE_LINES + 1, F.greatest(F.size(lines) - PREAMBLE_LINES, F.lit(0)))
    fields = F.filter(
        F.transform(body, lambda line: F.split(line, ",")), lambda parts: (F.size(parts) > 1) & (parts[0] != "")
    )
    values = F.transform(
        fields, lambda parts: F.filter(F.slice(parts, 2, F.size(parts) - 1), lambda v: v != "")
    )
    kept = F.filter(values, lambda v: F.size(v) > 0)
    numbers = F.transform(kept, lambda row: F.transform(row, lambda v: v.try_cast("double")))
    parsed = documents.select("sample_id", numbers.alias("scan"))
    widths = F.transform("scan", lambda row: F.size(row))
    error = (
        F.when(F.size("scan") == 0, "no rows")
        .when(F.exists("scan", lambda row: F.exists(row, lambda v: v.isNull())), "not a number")
        .when(F.array_min(widths) != F.array_max(widths), "inconsistent row widths")
    )
    return parsed.withColumn("error", error)


def parse_rasters(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan lines (sample_id, y, temps) of the sound rasters, and (sample_id, error) for the others."""
    scanned = _scanned(documents)
    sound = scanned.where(F.col("error").isNull()).select("sample_id", F.posexplode("scan").alias("y", "temps"))
    return sound, scanned.where(F.col("error").isNotNull()).select("sample_id", "error")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, content) for every CSV under a folder; one file is one row."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(path, wholetext=True)
        .select(file_stem(F.col("_metadata.file_name")).alias("sample_id"), F.col("value").alias("content"))
    )


def convert_rasters(documents: DataFrame, excluded: DataFrame, target: str) -> DataFrame:
    """Append the scan lines of rasters not excluded and not cached yet; counts by outcome.

    The texts are parsed once, for the write; the counts come from ids alone.
    """
    spark = documents.sparkSession

    def cached() -> DataFrame:
        return spark.read.parquet(target).select("sample_id").distinct()

    out, before, skipped = excluded.select("sample_id"), 0, 0
    wanted = documents.select("sample_id").join(out, "sample_id", "left_anti")
    if path_exists(spark, target):
        done = cached()
        before, skipped = done.count(), wanted.join(done, "sample_id", "left_semi").count()
        out = out.unionByName(done)
    # The texts meet the ids to leave out once, whichever reason they have.
    parse_rasters(documents.join(out, "sample_id", "left_anti"))[0].write.mode("append").parquet(target)
    success = cached().count() - before
    failed = wanted.count() - skipped - success
    outcome = [("success", success), ("skipped", skipped), ("failed", failed)]
    return spark.createDataFrame(outcome, "outcome string, n long")


def stream_rasters(documents: DataFrame, target: str, checkpoint: str, excluded: DataFrame | None = None) -> DataFrame:
    """Convert the raster files that arrived since the last call; the table of all rasters converted so far.

    `documents` is a streaming (sample_id, content). The checkpoint remembers which files were read, and the
    target's log lists the files of committed batches: a call reads new files only, and a call that died is
    taken up at its batch without a raster lost or doubled. The table has one row per raster: sample_id, scan
    (array of scan lines) and error, so a ragged file is a row with its reason. Excluded samples are left
    out for good; nothing of the cached rasters is joined or read.
    """
    if excluded is not None:
        documents = documents.join(excluded.select("sample_id").distinct(), "sample_id", "left_anti")
    scanned = _scanned(documents)
    run = (
        scanned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    if not path_exists(documents.sparkSession, target):  # no file has arrived yet
        return documents.sparkSession.createDataFrame([], scanned.schema)
    return documents.sparkSession.read.schema(scanned.schema).parquet(target)


def raster_stream(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """Streaming (sample_id, content) of the CSV files under a folder; one file is one row."""
    return (
        spark.readStream.format("text")
        .option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(file_stem(F.col("_metadata.file_name")).alias("sample_id"), F.col("value").alias("content"))
    )


def size_histogram(lines: DataFrame) -> DataFrame:
    """Number of rasters per (width, height)."""
    shape = lines.groupBy("sample_id").agg(F.max(F.size("temps")).alias("width"), F.count("*").cast("int").alias("height"))
    return shape.groupBy("width", "height").agg(F.count("*").alias("n"))


def range_normalised(lines: DataFrame) -> DataFrame:
    """Scan lines clipped to the fixed sensor range and scaled to 0..1."""
    return lines.withColumn("temps", F.transform("temps", lambda t: range_normalise(t)))
