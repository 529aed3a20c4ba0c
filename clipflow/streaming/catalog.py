"""Captions of a catalog that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.models import MAX_CAPTION_WORDS, Captioner
from ..operators.captions import missing_captions
from ..plans.captioning import caption_videos
from .run import run_batches


def caption_catalog(
    catalog: DataFrame,
    frames: DataFrame,
    prompt: str,
    length: int = 10,
    stride: int = 3,
    captioner: Captioner | None = None,
    strip: bool = False,
    max_length: int = MAX_CAPTION_WORDS,
    path: str | None = None,
) -> DataFrame | None:
    """Captions of all videos of a streamed catalog, each video captioned by the first micro-batch that names it.

    The rows of ``caption_videos``. Another call with the same ``path`` takes the catalog rows that came since. A video
    with captions from earlier micro-batches is passed over when it is named again; of rows that name one video in one micro-batch, the
    one with the most frames counts. A micro-batch that failed is repeated whole. ``frames`` is a table that
    holds a video's frames before the catalog names it; stored in blocks, those of other videos are skipped.
    """
    others = [name for name in catalog.columns if name not in ("video_id", "n_frames")]

    def work(named: DataFrame, earlier: DataFrame | None) -> DataFrame:
        entry = F.max(F.struct("n_frames", *others)).alias("_entry")
        videos = named.filter(F.col("video_id").isNotNull()).groupBy("video_id").agg(entry).select("video_id", "_entry.*")
        todo = videos if earlier is None else missing_captions(videos, earlier)
        return caption_videos(todo, frames, prompt, length, stride, captioner, strip, max_length=max_length)

    return run_batches(catalog, work, path, look_back=True)
