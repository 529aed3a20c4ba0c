"""Captioning of whole catalogs, with CSV and subtitle output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths, text as ft
from ..functions.models import MAX_CAPTION_WORDS, Captioner
from ..operators.captions import (
    align_captions, caption_clips, complete_videos, extend_captions, missing_captions
)
from ..operators.clips import plan_clips, with_span
from ..operators.frames import BLOCK, assemble_blocks, assemble_clips
from ..operators.skew import hot_keys, lookup
from ..operators.subtitles import subtitle_blocks
from ..sources import files


def caption_videos(
    videos: DataFrame,
    frames: DataFrame,
    prompt: str,
    length: int = 10,
    stride: int = 3,
    captioner: Captioner | None = None,
    strip: bool = False,
    stored: DataFrame | None = None,
    max_length: int = MAX_CAPTION_WORDS,
) -> DataFrame:
    """``video_id, clip_no, start_frame, end_frame, caption`` of every planned clip.

    Captions echo the prompt unless ``strip`` is set and have at most ``max_length`` words after it. Videos whose
    planned clips are all among the ``stored`` captions keep those; only the others go through the model. Frames of
    kept videos meet no planned clip, so the frame table is not joined to the catalog. Frames stored in blocks
    (``files.write_frame_blocks``) are not shuffled, and those outside the id ranges of the others are not read.
    """
    todo, kept = videos, None
    if stored is not None:
        done = complete_videos(videos, stored, length, stride)
        todo = missing_captions(videos, done)
        kept = missing_captions(stored, todo)
    spans = with_span(plan_clips(todo, length, stride))
    assemble = assemble_blocks if BLOCK in frames.columns else assemble_clips
    inferred = caption_clips(
        assemble(todo, frames, length, stride), prompt, length, captioner, max_length=max_length
    )
    captions = align_captions(spans, inferred)
    if strip:
        captions = captions.withColumn("caption", _strip_known(prompt))
    return captions if kept is None else extend_captions(kept.select(captions.columns), captions)


def export_captions(
    captions: DataFrame, videos: DataFrame, prompt: str, root: str, experiment: str, folder: str
) -> DataFrame:
    """Write caption CSVs, then subtitles built from what was written; returns the latter.

    The captions are stored before anything else reads them, so the model behind
    them runs once. Rows keep their ``video_id``, so videos of one stem stay apart; a caption whose video the
    catalog does not hold has no stem and no times.
    """
    spark = captions.sparkSession
    hot = hot_keys(captions, "video_id")
    names = videos.select("video_id", paths.base_name("path").alias("_name"))
    coordinates = (experiment, folder, F.col("_name"))
    caption_path, subtitle_path = f"{root}/{paths.CAPTION_LAYOUT}", f"{root}/{paths.SUBTITLE_LAYOUT}"

    named = lookup(captions, names, "video_id", hot)
    files.write_captions(files.with_coordinates(named, *coordinates), caption_path)

    written = files.read_captions(spark, caption_path)
    in_order = written.withColumn("clip_no", F.col("start_frame"))  # starts rise with the clip number
    blocks = lookup(subtitle_blocks(in_order, videos, prompt, hot=hot), names, "video_id", hot)
    files.write_subtitles(files.with_coordinates(blocks, *coordinates), subtitle_path)
    return files.read_subtitles(spark, subtitle_path)


def _strip_known(prompt: str):
    return F.when(F.col("caption").isNotNull(), ft.strip_prompt("caption", prompt))
