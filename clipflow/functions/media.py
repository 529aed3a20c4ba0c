"""Duration gate, head-of-video cut and pixel narrowing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arith import as_col

# Accepted whole seconds of an upload, and what a cut keeps.
MIN_SECONDS = 2
TOO_LONG_SECONDS = 11
KEEP_SECONDS = 10

OK, TOO_LONG, TOO_SHORT, CONVERT_ERROR = "ok", "too_long", "too_short", "convert_error"


def upload_status(path, duration_s) -> Column:
    """Verdict on one upload; seconds are truncated before they are compared."""
    seconds = as_col(duration_s).cast("int")
    return (
        F.when(as_col(path) == "", CONVERT_ERROR)
        .when(seconds >= TOO_LONG_SECONDS, TOO_LONG)
        .when(seconds < MIN_SECONDS, TOO_SHORT)
        .otherwise(OK)
    )


def kept_frames(n_frames, fps, seconds: int = KEEP_SECONDS) -> Column:
    """Frames left of a video after only its first seconds are kept."""
    return F.least(as_col(n_frames), F.ceil(as_col(fps) * seconds).cast("bigint"))


def in_head(frame_idx, fps, seconds: int = KEEP_SECONDS) -> Column:
    return F.try_divide(as_col(frame_idx).cast("double"), as_col(fps)) < float(seconds)


def to_bytes(pixels) -> Column:
    """Narrow pixel values to 0..255 the way an unsigned byte wraps."""
    return F.transform(as_col(pixels), lambda v: v.cast("int").bitwiseAND(F.lit(255)))
