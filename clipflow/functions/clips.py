"""Closed-form clip planning: which frames belong to which clip.

A video of ``n`` frames sampled every ``stride`` frames has ``h`` samples; they
form clips of ``length`` samples. Left-over samples after the last full clip are
dropped. With fewer samples than one clip needs, the samples repeat cyclically.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arith import as_col, int_div


def check_plan(length: int, stride: int) -> None:
    if length < 1 or stride < 1:
        raise ValueError(f"clip length and stride must be at least 1, got {length} and {stride}")


def sample_count(n_frames, stride: int) -> Column:
    return int_div(as_col(n_frames) + F.lit(stride - 1), stride)


def clip_count(n_frames, length: int, stride: int) -> Column:
    """Clips of a video; a video without frames has none."""
    full = int_div(sample_count(n_frames, stride), length)
    return F.when(as_col(n_frames) > 0, F.greatest(F.lit(1).cast("bigint"), full)).otherwise(
        F.lit(0).cast("bigint")
    )


def clip_frames(clip_no, n_frames, length: int, stride: int) -> Column:
    """Frame numbers of one clip, in order, repeats included."""
    h = sample_count(n_frames, stride)
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))
    first = as_col(clip_no).cast("bigint") * length
    return F.when(
        h < length, F.transform(slots, lambda i: (i % h) * stride)
    ).otherwise(F.transform(slots, lambda i: (first + i) * stride))


def span_start(frame_idx) -> Column:
    return F.element_at(as_col(frame_idx), 1)


def span_end(frame_idx) -> Column:
    """The last element, which in a cyclically padded clip is not the largest."""
    return F.element_at(as_col(frame_idx), -1)


def on_stride(frame_idx, stride: int) -> Column:
    return as_col(frame_idx) % stride == 0
