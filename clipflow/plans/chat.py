"""Answering chat turns from stored captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import clips as fc, text as ft
from ..functions.arith import int_div
from ..functions.models import MAX_CAPTION_WORDS, Captioner, Translator
from ..operators.captions import caption_clips
from ..operators.chat import (
    active_context, gate_uploads, reply_catalog, reply_language, reply_rows, with_translation
)
from ..operators.frames import BLOCK, assemble_blocks, assemble_clips
from ..operators.skew import MAX_HOT_KEYS, HotKeys, hot_keys, lookup
from ..operators.summary import summarize_joined, summarize_pieces
from ..session import HOT_ROWS, setting

#: Words that the captions of one turn may have together to be joined into one text.
JOINED_WORDS = 1 << 18
#: Clips of a video that a turn meets together.
MET_CLIPS = 64


def answer_turns(
    messages: DataFrame,
    uploads: DataFrame,
    summaries: DataFrame,
    translator: Translator,
    hot: HotKeys | None = None,
) -> DataFrame:
    """All replies of all turns: gate, carry forward, summarise, translate, fan out.

    ``uploads`` maps a path to the video whose captions answer for it. The summary is
    looked up where a video is uploaded and carried along with it, so a session that
    talks about one video for millions of turns adds no join.
    """
    hot = hot_keys(messages, "conv_id") if hot is None else hot
    judged = with_summaries(gate_uploads(messages), uploads, summaries)
    turns = active_context(judged, ["summary"], hot)
    return reply_rows(translated(turns, translator), reply_catalog(messages.sparkSession))


def answer_questions(
    messages: DataFrame,
    uploads: DataFrame,
    videos: DataFrame,
    frames: DataFrame,
    translator: Translator,
    captioner: Captioner | None = None,
    length: int = 10,
    stride: int = 3,
    max_length: int = MAX_CAPTION_WORDS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """All replies of all turns, each answered from captions made for its own question.

    The turn's text becomes the prompt; every clip of the session's active video is captioned under it, the prompt
    is stripped, and the captions are summarised in one go. ``uploads`` maps a path to its video, which must be unique.
    A video that is not known, or has no full clip, has no answer text.
    """
    hot = hot_keys(messages, "conv_id") if hot is None else hot
    known = uploads.select(F.col("path").alias("upload"), F.col("video_id").alias("_video"))
    judged = _by_upload(gate_uploads(messages)).join(known, "upload", "left")
    turns = active_context(judged, ["_video"], hot)
    return answer_carried(turns, videos, frames, translator, captioner, length, stride, max_length)


def answer_carried(
    turns: DataFrame,
    videos: DataFrame,
    frames: DataFrame,
    translator: Translator,
    captioner: Captioner | None = None,
    length: int = 10,
    stride: int = 3,
    max_length: int = MAX_CAPTION_WORDS,
) -> DataFrame:
    """The replies of turns whose ``active_video`` and ``_video``, its id, are known."""
    answered = summarize_asked(turns, videos, frames, captioner, length, stride, max_length)
    return reply_rows(translated(answered, translator), reply_catalog(turns.sparkSession))


def summarize_asked(
    turns: DataFrame,
    videos: DataFrame,
    frames: DataFrame,
    captioner: Captioner | None = None,
    length: int = 10,
    stride: int = 3,
    max_length: int = MAX_CAPTION_WORDS,
) -> DataFrame:
    """Turns with the ``summary`` of their video's captions under their own question, instead of ``_video``.

    Turns meet the clips of their video ``MET_CLIPS`` at a time, and a video that very many ask about in several tasks, so neither
    a long video nor a much-asked one is the work of one task; what is shuffled or broadcast for it is turns and clips, not their
    pairs. How many clips a turn has is known before any clip is captioned:
    captions of up to ``JOINED_WORDS`` words are summarised as one text, those of longer turns stay rows.
    """
    turns = turns.withColumn("_turn", F.concat_ws(":", "conv_id", "turn"))
    asked = turns.filter((F.col("active_video") != "") & F.col("_video").isNotNull()).select(
        "_turn", F.col("_video").alias("video_id"), ft.echoed_prompt(ft.chat_prompt("text")).alias("_prompt")
    )
    wanted = videos.join(asked.select("video_id").distinct(), "video_id", "left_semi")
    met = hot_keys(asked, "video_id", weight=MET_CLIPS)
    hot = {video: n // MET_CLIPS for video, n in met.items() if n // MET_CLIPS > setting(turns.sparkSession, HOT_ROWS)}
    counts = wanted.groupBy("video_id").agg(F.max(fc.clip_count("n_frames", length, stride)).alias("_clips"))
    counted = lookup(asked, counts.filter(F.col("_clips") > 0), "video_id", hot, "inner")
    parts = F.sequence(F.lit(0).cast("bigint"), int_div(F.col("_clips") - 1, MET_CLIPS))
    each = counted.withColumn("_part", F.explode(parts))
    assemble = assemble_blocks if BLOCK in frames.columns else assemble_clips
    clips = assemble(wanted, frames, length, stride).withColumn("_part", int_div("clip_no", MET_CLIPS))
    seen = lookup(each, clips, "video_id", met, "inner", on=("_part",)).filter(
        (F.col("clip_no") >= 0) & (F.col("clip_no") < F.col("_clips"))
    )
    # a clip under a question is a clip of its own to the captioner
    posed = seen.select(F.col("_turn").alias("video_id"), "clip_no", "payload", "n_fetched", "_prompt")
    said = caption_clips(posed, F.col("_prompt"), length, captioner, max_length=max_length, keep=("_prompt",))
    stripped = said.select("video_id", "clip_no", ft.strip_prompt("caption", F.col("_prompt")).alias("caption"))
    long, hot_turns = _long_turns(counted, max_length)
    if long is None:
        found = summarize_joined(stripped, "video_id", "clip_no", "caption")
    else:
        kept = stripped.join(long, "video_id", "left")
        found = summarize_joined(kept.filter(F.col("_long").isNull()), "video_id", "clip_no", "caption").unionByName(
            summarize_pieces(kept.filter("_long"), "video_id", "clip_no", "caption", hot_turns)
        )
    found = found.select(F.col("video_id").alias("_turn"), "summary")
    return turns.join(found, "_turn", "left").drop("_turn", "_video")


def _long_turns(counted: DataFrame, max_length: int) -> tuple[DataFrame | None, HotKeys]:
    """Turns whose captions are too much for one text, and those whose captions are too much for a task, from the clip counts alone.

    Clips are counted over all questions of a turn. The first are rows ``video_id, _long``, or None if there are none; at most
    ``MAX_HOT_KEYS`` of the second reach the driver.
    """
    rows = setting(counted.sparkSession, HOT_ROWS)
    joined = min(rows, JOINED_WORDS // max(max_length, 1))
    long = counted.groupBy("_turn").agg(F.sum("_clips").alias("_clips")).filter(F.col("_clips") > joined)
    heaviest = long.orderBy(F.desc("_clips"), "_turn").limit(MAX_HOT_KEYS).collect()
    if not heaviest:
        return None, {}
    hot = {row["_turn"]: row["_clips"] for row in heaviest if row["_clips"] > rows}
    return long.select(F.col("_turn").alias("video_id"), F.lit(True).alias("_long")), hot


def translated(turns: DataFrame, translator: Translator) -> DataFrame:
    """``translation`` and ``error`` of the answers that are given in Italian; no other text reaches the translator."""
    wanted = (reply_language("lang") == "it") & (F.col("active_video") != "") & F.col("summary").isNotNull()
    nothing = F.lit(None).cast("string")
    return with_translation(turns.filter(wanted), "summary", translator).unionByName(
        turns.filter(~F.coalesce(wanted, F.lit(False))).withColumns({"translation": nothing, "error": nothing})
    )


def upload_summaries(uploads: DataFrame, summaries: DataFrame) -> DataFrame:
    """``upload, summary`` of every known upload, however many share one video."""
    known = uploads.select(F.col("path").alias("upload"), "video_id")
    return lookup(known, summaries, "video_id", hot_keys(uploads, "video_id")).select("upload", "summary")


def with_summaries(judged: DataFrame, uploads: DataFrame, summaries: DataFrame) -> DataFrame:
    """Add the summary of the video each upload stands for.

    Turns without an upload get a key of their own, so that they do not meet in one
    task.
    """
    return _by_upload(judged).join(upload_summaries(uploads, summaries), "upload", "left")


def _by_upload(judged: DataFrame) -> DataFrame:
    return judged.withColumn("upload", F.coalesce("upload", F.concat_ws(" ", F.lit("none"), "conv_id", "turn")))
