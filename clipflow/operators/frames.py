"""Frames joined to clips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clips as fc, media
from ..functions.arith import int_div
from .clips import plan_clips
from .skew import HotKeys, hot_keys, lookup

CLIP_KEY = ("video_id", "clip_no")

#: Column of stored frames that says which block of its video a frame is in, and frames per block. A clip lies
#: within one block if its length times its stride divides a block, as the usual ones do.
BLOCK, BLOCK_FRAMES = "frame_block", 14_400
#: Ranges of video ids at most that a scan of stored frames is told to keep to.
ID_RANGES = 64


def gather_frames(clips: DataFrame, frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Fetch the payload of every listed frame, order and repeats kept.

    Works for any clip table. Both sides hash on ``(video_id, frame_idx)``, so a
    single long video spreads over all tasks.
    """
    wanted = clips.select(*CLIP_KEY, F.posexplode("frame_idx").alias("pos", "frame_idx"))
    fetched = wanted.join(frames.select("video_id", "frame_idx", payload), ["video_id", "frame_idx"])
    return _collect(fetched, payload)


def assemble_clips(
    videos: DataFrame, frames: DataFrame, length: int = 10, stride: int = 3, payload: str = "payload"
) -> DataFrame:
    """Gather planned clips straight from the frame table, without a join.

    The clip of a frame follows from its number. The catalog says which clips are planned
    by one small marker row for each, so the payload is shuffled once, by clip. Frames beyond the
    catalog's count and of videos it does not hold belong to no clip. Returns the same rows as
    ``plan_clips`` followed by ``gather_frames``.
    """
    samples = frames.filter(fc.on_stride("frame_idx", stride)).withColumn("_s", int_div("frame_idx", stride))
    rows = samples.select(
        "video_id",
        int_div("_s", length).alias("clip_no"),
        F.struct(F.col("_s").alias("s"), F.col(payload).alias("v")).alias("_frame"),
        F.lit(None).cast("bigint").alias("_h"),
    )
    markers = plan_clips(videos, length, stride, keep=("n_frames",)).select(
        "video_id", "clip_no",
        F.lit(None).cast(rows.schema["_frame"].dataType).alias("_frame"),
        fc.sample_count("n_frames", stride).alias("_h"),
    )
    grouped = (
        rows.unionByName(markers)
        .groupBy(*CLIP_KEY)
        .agg(F.array_sort(F.collect_list("_frame")).alias("_all"), F.max("_h").alias("_h"))
        .filter(F.col("_h").isNotNull())  # planned
        .withColumn("_found", F.filter("_all", lambda f: f["s"] < F.col("_h")))
        .filter(F.size("_found") > 0)
    )
    return _padded(grouped, length, payload)


def assemble_blocks(
    videos: DataFrame, frames: DataFrame, length: int = 10, stride: int = 3, payload: str = "payload"
) -> DataFrame:
    """The rows of ``assemble_clips`` from frames stored in blocks (``files.write_frame_blocks``).

    The catalog is sent to where the blocks of its videos lie, so frames are not shuffled, and the scan skips
    what lies outside the id ranges of the catalog's videos. Clips that do not divide a block have their frames shuffled.
    """
    fc.check_plan(length, stride)
    if BLOCK_FRAMES % (length * stride):
        return assemble_clips(videos, frames, length, stride, payload)
    catalog = videos.filter(F.col("n_frames") > 0).groupBy("video_id").agg(F.max("n_frames").alias("n_frames"))
    planned = catalog.select(
        "video_id",
        fc.sample_count("n_frames", stride).alias("_h"),
        fc.clip_count("n_frames", length, stride).alias("_clips"),
    )
    last_block = int_div(F.col("_clips") * (length * stride) - 1, BLOCK_FRAMES)
    wanted = planned.withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    samples = within_ids(frames, videos).filter(fc.on_stride("frame_idx", stride)).select(
        "video_id", BLOCK, int_div("frame_idx", stride).alias("_s"), F.col(payload).alias("_v")
    )
    clip_no = int_div("_s", length)
    kept = samples.join(wanted, ["video_id", BLOCK]).filter((F.col("_s") < F.col("_h")) & (clip_no < F.col("_clips")))
    frame = F.struct(F.col("_s").alias("s"), F.col("_v").alias("v")).alias("_frame")
    grouped = (
        kept.select("video_id", BLOCK, clip_no.alias("clip_no"), frame, "_h")
        .groupBy("video_id", BLOCK, "clip_no")
        .agg(F.array_sort(F.collect_list("_frame")).alias("_found"), F.max("_h").alias("_h"))
    )
    return _padded(grouped, length, payload)


def within_ids(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames whose ``video_id`` lies in one of a few ranges that hold all ids of ``videos``.

    A plain filter that reaches the scan: frames sorted by video are skipped by their file statistics. At most ``ID_RANGES``
    pairs of numbers reach the driver, whatever the number of videos.
    """
    ids = videos.select("video_id").filter(F.col("video_id").isNotNull())
    low, high = ids.agg(F.min("video_id"), F.max("video_id")).first()
    if low is None:
        return frames.filter(F.lit(False))
    width = (high - low) // ID_RANGES + 1
    ranges = ids.groupBy(int_div(F.col("video_id") - low, width).alias("_range")).agg(
        F.min("video_id").alias("low"), F.max("video_id").alias("high")
    )
    held = F.lit(False)
    for found in ranges.orderBy("_range").collect():
        held = held | F.col("video_id").between(found["low"], found["high"])
    return frames.filter(held)


def clip_members(
    videos: DataFrame, frames: DataFrame, length: int = 10, stride: int = 3, hot: HotKeys | None = None
) -> DataFrame:
    """Frames a decoding scan keeps: each once, between the clip's first and last element.

    In a padded clip the last element can lie before the largest, and frames after
    it are not kept.
    """
    fc.check_plan(length, stride)
    hot = hot_keys(frames, "video_id") if hot is None else hot
    sampled = frames.filter(fc.on_stride("frame_idx", stride))
    known = lookup(sampled, videos.select("video_id", "n_frames"), "video_id", hot, how="inner")
    h = fc.sample_count("n_frames", stride)
    s = int_div("frame_idx", stride)
    padded = h < length
    kept = F.when(padded, s <= F.lit(length - 1) % h).otherwise(int_div(s, length) < int_div(h, length))
    clip_no = F.when(padded, F.lit(0).cast("bigint")).otherwise(int_div(s, length))
    return known.filter(kept & (F.col("frame_idx") < F.col("n_frames"))).withColumn("clip_no", clip_no).drop("n_frames")


def semi_members(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """The same for any clip table, as an equi-join on the listed frames."""
    wanted = clips.select(
        *CLIP_KEY,
        F.explode(F.array_distinct("frame_idx")).alias("frame_idx"),
        fc.span_start("frame_idx").alias("_first"),
        fc.span_end("frame_idx").alias("_last"),
    ).filter(F.col("frame_idx").between(F.col("_first"), F.col("_last")))
    return wanted.drop("_first", "_last").join(frames, ["video_id", "frame_idx"])


def full_clips(gathered: DataFrame, length: int) -> DataFrame:
    """Only clips whose every frame was fetched go to a model."""
    return gathered.filter(F.col("n_fetched") == length)


def head_of_video(
    videos: DataFrame, frames: DataFrame, seconds: int = media.KEEP_SECONDS, hot: HotKeys | None = None
) -> DataFrame:
    """Frames of the first seconds. The highest rate of the catalog bounds their numbers, which the scan is told."""
    lowest, highest = videos.agg(F.min("fps"), F.max("fps")).first()
    if highest is not None and lowest >= 0 and math.isfinite(highest * seconds):
        frames = frames.filter(F.col("frame_idx") <= math.ceil(highest * seconds))
    hot = hot_keys(frames, "video_id") if hot is None else hot
    timed = lookup(frames, videos.select("video_id", "fps"), "video_id", hot, how="inner")
    return timed.filter(media.in_head("frame_idx", F.col("fps"), seconds))


def cut_catalog(videos: DataFrame, seconds: int = media.KEEP_SECONDS) -> DataFrame:
    kept = media.kept_frames("n_frames", "fps", seconds)
    return videos.withColumn("n_frames", kept).withColumn(
        "duration_s", F.try_divide(F.col("n_frames").cast("double"), F.col("fps"))
    )


def _collect(fetched: DataFrame, payload: str) -> DataFrame:
    found = F.array_sort(F.collect_list(F.struct("pos", F.col(payload).alias("v"))))
    return _with_payload(fetched.groupBy(*CLIP_KEY).agg(found.alias("_found")), F.col("_found"), payload)


def _padded(grouped: DataFrame, length: int, payload: str) -> DataFrame:
    """Clips of ``_found`` entries ``s, v``; those of a video with ``_h`` samples, fewer than a clip has, repeat cyclically."""
    last = F.lit(length - 1).cast("bigint")
    repeated = F.array_sort(
        F.flatten(
            F.transform(
                "_found",
                lambda f: F.transform(
                    F.sequence(f["s"], last, F.col("_h")), lambda p: F.struct(p.alias("s"), f["v"].alias("v"))
                ),
            )
        )
    )
    padded = F.col("_h") < length
    return _with_payload(grouped, F.when(padded, repeated).otherwise(F.col("_found")), payload)


def _with_payload(grouped: DataFrame, entries: Column, payload: str) -> DataFrame:
    """Payload array and its size.

    The generator computes the array once and keeps its lambdas out of what follows:
    Spark cannot hand an argument with lambdas to a Python model.
    """
    values = F.transform(entries, lambda f: f["v"])
    return grouped.select(*CLIP_KEY, F.explode(F.array(values)).alias(payload)).withColumn(
        "n_fetched", F.size(payload).cast("bigint")
    )
