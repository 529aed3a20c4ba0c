"""Clip planning over whole catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import clips as fc
from ..functions.arith import int_div
from .skew import HotKeys, number_rows

#: Clips generated per planning row; longer videos are planned in several rows.
CLIPS_PER_BLOCK = 65_536


def plan_clips(videos: DataFrame, length: int = 10, stride: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per clip: ``video_id, clip_no, frame_idx`` plus the ``keep`` columns.

    A very long video is first cut into blocks of clips, and blocks are spread
    over the tasks, so no single row has to produce all clips of a video.
    """
    fc.check_plan(length, stride)
    last_block = int_div(F.col("_clips") - 1, CLIPS_PER_BLOCK)
    blocks = (
        videos.filter(F.col("n_frames") > 0)
        .select("video_id", "n_frames", *keep, fc.clip_count("n_frames", length, stride).alias("_clips"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
        .repartition("video_id", "_block")
    )
    first = F.col("_block") * CLIPS_PER_BLOCK
    final = F.least(F.col("_clips"), first + CLIPS_PER_BLOCK) - 1
    return blocks.withColumn("clip_no", F.explode(F.sequence(first, final))).select(
        "video_id", "clip_no", *keep, fc.clip_frames("clip_no", "n_frames", length, stride).alias("frame_idx")
    )


def with_span(clips: DataFrame) -> DataFrame:
    return clips.withColumns({"start_frame": fc.span_start("frame_idx"), "end_frame": fc.span_end("frame_idx")})


def stride_sample(frames: DataFrame, stride: int) -> DataFrame:
    fc.check_plan(1, stride)
    return frames.filter(fc.on_stride("frame_idx", stride))


def number_frames(
    events: DataFrame, video: str, order: list[str], hot: HotKeys | None = None
) -> DataFrame:
    """Add ``frame_idx``, the 0-based position of an event within its video."""
    return number_rows(events, video, order, "frame_idx", hot)
