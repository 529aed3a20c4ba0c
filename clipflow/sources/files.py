"""Readers and writers: caption, score and summary CSV, subtitles, catalogs, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema
from ..functions import paths
from ..functions.arith import int_div
from ..operators.frames import BLOCK, BLOCK_FRAMES
from .documents import write_named

#: Output folders: one level per coordinate of a run, however many videos it has.
COORDINATES = ("experiment", "video_folder")
#: What tells the rows of one video from another's, inside the files.
VIDEO = ("video_id", "stem")
#: Rows per CSV file at most. Rebalanced partitions bound files by bytes beforehand.
ROWS_PER_FILE = 1_000_000

_CSV = {"header": "true", "escape": '"'}
_CSV_WRITE = _CSV | {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_CSV_READ = _CSV | {"multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def with_coordinates(rows: DataFrame, experiment: str, folder: str, name) -> DataFrame:
    return rows.withColumns(
        {"experiment": F.lit(experiment), "video_folder": F.lit(folder), "stem": paths.stem(name)}
    )


def write_captions(captions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``VideoId, Stem, Start, End, Caption``; needs the run coordinates as columns."""
    _write_csv(
        captions.select(
            *COORDINATES, *_named_video(),
            F.col("start_frame").alias("Start"), F.col("end_frame").alias("End"), F.col("caption").alias("Caption"),
        ),
        path, COORDINATES, mode,
    )


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    rows = _read_csv(spark, path, schema.CAPTION_CSV, COORDINATES)
    return rows.select(
        *COORDINATES, *_read_video(),
        F.col("Start").alias("start_frame"), F.col("End").alias("end_frame"), F.col("Caption").alias("caption"),
    )


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``VideoId, Stem, Prompt, Probs``."""
    _write_csv(
        scores.select(*COORDINATES, *_named_video(), F.col("prompt").alias("Prompt"), F.col("prob").alias("Probs")),
        path, COORDINATES, mode,
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    rows = _read_csv(spark, path, schema.SCORE_CSV, COORDINATES)
    return rows.select(*COORDINATES, *_read_video(), F.col("Prompt").alias("prompt"), F.col("Probs").alias("prob"))


def write_summaries(summaries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``VideoId, Stem, Summary``, by experiment."""
    _write_csv(
        summaries.select("experiment", *_named_video(), F.col("summary").alias("Summary")), path, ("experiment",), mode
    )


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    rows = _read_csv(spark, path, schema.SUMMARY_CSV, ("experiment",))
    return rows.select("experiment", *_read_video(), F.col("Summary").alias("summary"))


def write_subtitles(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``VideoId, Stem, No, Cue``: one row per cue in its written form, a video's cues in order.

    Ranges over video and number divide a video that holds most cues.
    """
    rows = blocks.select(*COORDINATES, *_named_video(), F.col("cue_no").alias("No"), F.col("block").alias("Cue"))
    in_order = rows.repartitionByRange("VideoId", "No").sortWithinPartitions(*COORDINATES, "VideoId", "No")
    _csv(in_order, path, COORDINATES, mode)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``video_id, stem, cue_no, block``; the blocks of a video in order are its subtitles."""
    rows = _read_csv(spark, path, schema.SUBTITLE_CSV, COORDINATES)
    return rows.select(*COORDINATES, *_read_video(), F.col("No").alias("cue_no"), F.col("Cue").alias("block"))


def write_subtitle_files(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """One subtitle file per video under its name in the output layout, put together from ``cue_no, block``.

    Needs the run coordinates as columns. ``path`` is a folder that driver and executors share.
    """
    name = paths.subtitle_path("", F.col("experiment"), F.col("video_folder"), "stem")
    write_named(blocks, path, F.ltrim(name, F.lit("/")), F.col("block"), ["cue_no"], mode)


def write_caption_files(captions: DataFrame, path: str, mode: str = "append") -> None:
    """One ``Start,End,Caption`` file per video under its name in the output layout, a video's captions in clip order."""
    name = paths.caption_path("", F.col("experiment"), F.col("video_folder"), "stem")
    file = F.ltrim(name, F.lit("/"))
    cells = F.to_csv(
        F.struct(F.col("start_frame"), F.col("end_frame"), F.coalesce("caption", F.lit(""))),
        {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    )
    lines = captions.select(file.alias("_file"), F.col("clip_no"), F.concat(cells, F.lit("\n")).alias("_line"))
    header = lines.select("_file").distinct().select(
        "_file", F.lit(-1).cast("bigint").alias("clip_no"), F.lit("Start,End,Caption\n").alias("_line")
    )
    write_named(lines.unionByName(header), path, F.col("_file"), F.col("_line"), ["clip_no"], mode)


def write_summary_files(summaries: DataFrame, path: str, mode: str = "append") -> None:
    """One ``Summary`` file per video under its name in the output layout."""
    file = F.ltrim(paths.summary_path("", F.col("experiment"), "stem"), F.lit("/"))
    cell = F.to_csv(
        F.struct(F.coalesce("summary", F.lit(""))),
        {"escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    )
    write_named(summaries, path, file, F.concat(F.lit("Summary\n"), cell, F.lit("\n")), ["video_id"], mode)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.VIDEOS).parquet(path)


def prompt_table(spark: SparkSession, prompts: list[str]) -> DataFrame:
    """A prompt set given as plain texts."""
    return spark.createDataFrame(list(enumerate(prompts)), "prompt_id bigint, prompt string")


def write_frames(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Frames ordered by video and number, so that readers skip by both.

    Ranges over both columns also divide a video that holds most frames.
    """
    key = ("video_id", "frame_idx")
    frames.repartitionByRange(*key).sortWithinPartitions(*key).write.mode(mode).parquet(path)


def read_frames(spark: SparkSession, path: str, payload: T.DataType | None = None) -> DataFrame:
    layout = T.StructType(
        [
            T.StructField("video_id", T.LongType()),
            T.StructField("frame_idx", T.LongType()),
            T.StructField("payload", payload or T.DoubleType()),
        ]
    )
    return spark.read.schema(layout).parquet(path)


def write_frame_blocks(frames: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Frames as a table bucketed by video and block of ``BLOCK_FRAMES`` numbers, sorted inside the buckets.

    The one shuffle of the payload; ``assemble_blocks`` has none. A long video spreads over buckets by its blocks.
    ``buckets`` is the number of tasks that read them: so many that one bucket suits a task. ``mode`` "append" adds files to the
    buckets. Without ``path`` the table lies in the warehouse.
    """
    key = ("video_id", BLOCK)
    dealt = frames.withColumn(BLOCK, int_div("frame_idx", BLOCK_FRAMES)).repartition(buckets, *key)
    writer = dealt.write.mode(mode).bucketBy(buckets, *key).sortBy(*key, "frame_idx")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def list_media(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """Paths, sizes and times of media files; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "length", "modificationTime", paths.stem(paths.base_name("path")).alias("stem"))


def stream_parquet(
    spark: SparkSession, path: str, layout: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 64
) -> DataFrame:
    """A file stream whose micro-batches stay bounded."""
    return (
        spark.readStream.schema(layout)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def _named_video() -> list[Column]:
    return [F.col("video_id").alias("VideoId"), F.col("stem").alias("Stem")]


def _read_video() -> list[Column]:
    return [F.col("VideoId").alias("video_id"), F.col("Stem").alias("stem")]


def _write_csv(rows: DataFrame, path: str, keys, mode: str) -> None:
    # Rebalancing gathers a video's rows for few files, yet splits a huge video.
    _csv(rows.hint("rebalance", "VideoId"), path, keys, mode)


def _csv(rows: DataFrame, path: str, keys, mode: str) -> None:
    rows.write.mode(mode).partitionBy(*keys).options(**_CSV_WRITE).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)


def _read_csv(spark: SparkSession, path: str, layout: T.StructType, keys) -> DataFrame:
    full = T.StructType([*layout.fields, *[T.StructField(k, T.StringType()) for k in keys]])
    return spark.read.schema(full).options(**_CSV_READ).csv(path)
