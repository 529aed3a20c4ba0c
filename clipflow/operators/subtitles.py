"""Subtitle cues and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as ft, timecode as tc
from .documents import joined
from .skew import HotKeys, hot_keys, lookup, running_totals


def subtitle_cues(
    captions: DataFrame,
    videos: DataFrame,
    prompt: str | Column = "",
    strip_newlines: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Numbered cues ``video_id, cue_no, start_tc, end_tc, text`` in clip order."""
    return _cues(captions, videos, prompt, strip_newlines, hot)


def subtitle_documents(
    captions: DataFrame,
    videos: DataFrame,
    prompt: str | Column = "",
    strip_newlines: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Subtitle text per video in one value: ``video_id, body``. ``subtitle_blocks`` is the form for any size."""
    blocks = subtitle_blocks(captions, videos, prompt, strip_newlines, hot)
    return blocks.groupBy("video_id").agg(joined("block", "cue_no", "").alias("body"))


def subtitle_blocks(
    captions: DataFrame,
    videos: DataFrame,
    prompt: str | Column = "",
    strip_newlines: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The written form of every cue: ``video_id, cue_no, block``; a video's blocks in order are its subtitles."""
    cues = _cues(captions, videos, prompt, strip_newlines, hot)
    return cues.select("video_id", "cue_no", tc.cue_block("cue_no", "start_tc", "end_tc", "text").alias("block"))


def _cues(captions, videos, prompt, strip_newlines, hot) -> DataFrame:
    hot = hot_keys(captions, "video_id") if hot is None else hot
    text = ft.strip_prompt("caption", prompt)
    if strip_newlines:
        text = F.replace(text, F.lit("\n"), F.lit(""))
    timed = lookup(
        captions.select("video_id", "clip_no", "start_frame", "end_frame", text.alias("text")),
        videos.select("video_id", "fps"),
        "video_id",
        hot,
    )
    numbered = running_totals(
        timed,
        "video_id",
        ["clip_no"],
        {"cue_no": F.lit(1).cast("bigint")},
        hot=hot,
    )
    return numbered.select(
        "video_id",
        (F.col("cue_no") + 1).alias("cue_no"),
        tc.timecode("start_frame", "fps").alias("start_tc"),
        tc.timecode("end_frame", "fps").alias("end_tc"),
        "text",
    )
