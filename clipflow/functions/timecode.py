"""Frame numbers as subtitle timecodes, and the cue text block."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arith import as_col

# The subtitle formats every player expects.
TIMECODE_FORMAT = "%02d:%02d:%02d,%03d"
CUE_FORMAT = "%d\n%s --> %s\n%s\n\n"


def timecode(frame, fps) -> Column:
    """``HH:MM:SS,mmm`` with truncated milliseconds; NULL where fps is 0 or unknown."""
    t = F.try_divide(as_col(frame).cast("double"), as_col(fps).cast("double"))
    in_minute = t % F.lit(60.0)
    text = F.format_string(
        TIMECODE_FORMAT,
        F.floor(t / 3600.0),
        F.floor((t % F.lit(3600.0)) / 60.0),
        in_minute.cast("bigint"),
        ((in_minute % F.lit(1.0)) * 1000.0).cast("bigint"),
    )
    return F.when(t.isNotNull(), text)


def cue_block(cue_no, start_tc, end_tc, text) -> Column:
    return F.format_string(CUE_FORMAT, as_col(cue_no), as_col(start_tc), as_col(end_tc), as_col(text))
