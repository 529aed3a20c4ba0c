"""Record layouts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LONG, TEXT, REAL, FLAG = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()

VIDEOS = _schema(("video_id", LONG), ("path", TEXT), ("n_frames", LONG), ("fps", REAL), ("duration_s", REAL))
CLIPS = _schema(("video_id", LONG), ("clip_no", LONG), ("frame_idx", T.ArrayType(LONG)))
CAPTIONS = _schema(
    ("video_id", LONG), ("clip_no", LONG), ("start_frame", LONG), ("end_frame", LONG), ("caption", TEXT)
)
SCORES = _schema(("video_id", LONG), ("clip_no", LONG), ("prompt_id", LONG), ("prompt", TEXT), ("prob", REAL))
CUES = _schema(("video_id", LONG), ("cue_no", LONG), ("start_tc", TEXT), ("end_tc", TEXT), ("text", TEXT))
SUMMARIES = _schema(("video_id", LONG), ("summary", TEXT))
MESSAGES = _schema(("conv_id", LONG), ("turn", LONG), ("text", TEXT), ("files", T.ArrayType(TEXT)))

# Header names of the exchanged CSV files.
CAPTION_CSV = _schema(("VideoId", LONG), ("Stem", TEXT), ("Start", LONG), ("End", LONG), ("Caption", TEXT))
SCORE_CSV = _schema(("VideoId", LONG), ("Stem", TEXT), ("Prompt", TEXT), ("Probs", REAL))
SUMMARY_CSV = _schema(("VideoId", LONG), ("Stem", TEXT), ("Summary", TEXT))
SUBTITLE_CSV = _schema(("VideoId", LONG), ("Stem", TEXT), ("No", LONG), ("Cue", TEXT))
