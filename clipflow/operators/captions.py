"""Captions per clip: inference, alignment with the plan, reuse of stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clips as fc
from ..functions.arith import as_col, int_div
from ..functions.models import MAX_CAPTION_WORDS, NO_CAPTION, Captioner, cap_caption, statistics_captioner
from .frames import full_clips


def caption_clips(
    gathered: DataFrame,
    prompt: str | Column,
    length: int,
    captioner: Captioner | None = None,
    payload: str = "payload",
    max_length: int = MAX_CAPTION_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``video_id, clip_no, caption`` of every fully fetched clip, of at most ``max_length`` words after the prompt."""
    hook = captioner or statistics_captioner(max_length)
    echoed = F.lit(prompt) if isinstance(prompt, str) else prompt
    said = full_clips(gathered, length).select(
        "video_id", "clip_no", *keep, hook(as_col(payload), echoed).alias("caption"), echoed.alias("_echo")
    )
    return _capped(said, captioner, max_length).drop("_echo")


def _capped(said: DataFrame, captioner: Captioner | None, max_length: int) -> DataFrame:
    """The default captioner keeps to the limit; any other model's answer is held to it."""
    if captioner is None:
        return said
    echo = F.col("caption").startswith(F.col("_echo"))
    after = F.when(echo, F.substr("caption", F.length("_echo") + 1)).otherwise(F.col("caption"))
    capped = F.concat(F.when(echo, F.col("_echo")).otherwise(F.lit("")), cap_caption(after, max_length))
    # more words than the limit have more than twice as many characters, the spaces between them included
    return said.withColumn("caption", F.when(F.length(after) <= 2 * max_length, F.col("caption")).otherwise(capped))


def align_captions(spans: DataFrame, captions: DataFrame, fill: str | None = None) -> DataFrame:
    """Every planned clip with its caption; a clip without one keeps NULL or ``fill``."""
    aligned = spans.select("video_id", "clip_no", "start_frame", "end_frame").join(
        captions.select("video_id", "clip_no", "caption"), ["video_id", "clip_no"], "left"
    )
    return aligned if fill is None else aligned.fillna({"caption": fill})


def sentinel_captions(spans: DataFrame, captions: DataFrame) -> DataFrame:
    return align_captions(spans, captions, fill=NO_CAPTION)


def caption_images(
    images: DataFrame,
    prompt: str,
    captioner: Captioner | None = None,
    keep: tuple[str, ...] = (),
    max_length: int = MAX_CAPTION_WORDS,
) -> DataFrame:
    """One caption per image: a clip of a single frame, without a length guard."""
    hook = captioner or statistics_captioner(max_length)
    said = images.select(
        "image_id", *keep, hook(F.array("payload"), F.lit(prompt)).alias("caption"), F.lit(prompt).alias("_echo")
    )
    return _capped(said, captioner, max_length).drop("_echo")


def missing_captions(videos: DataFrame, captions: DataFrame) -> DataFrame:
    """Videos that still need inference.

    Captions shrink to one row per video before the join, whatever a video holds.
    """
    return videos.join(captions.select("video_id").distinct(), "video_id", "left_anti")


def complete_videos(videos: DataFrame, captions: DataFrame, length: int, stride: int) -> DataFrame:
    """Videos of the catalog all of whose planned clips are stored."""
    h = fc.sample_count("n_frames", stride)
    planned = F.when(F.col("n_frames") > 0, F.greatest(F.lit(1).cast("bigint"), int_div(h, length))).otherwise(0)
    held = captions.groupBy("video_id").agg(F.count_distinct("clip_no").alias("_held"))
    known = videos.select("video_id", planned.alias("_planned")).join(held, "video_id")
    return known.filter(F.col("_held") >= F.col("_planned")).select("video_id")


def extend_captions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.unionByName(fresh)
