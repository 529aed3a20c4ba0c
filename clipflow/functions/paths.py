"""File names: stems, container targets and the output layout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arith import as_col

# The container the gate accepts, and names of the output layout.
CONTAINER = ".mp4"
CUT_SUFFIX = "_cut.mp4"
CAPTION_LAYOUT = "csv_captions"
SUBTITLE_LAYOUT = "srt_captions"
SUMMARY_LAYOUT = "summary"

# The last dot and what follows it, if something else than dots stands before it in the base name.
_EXTENSION = r"(?s)^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$"


def stem(name, suffix: str = CONTAINER) -> Column:
    """Drop every occurrence of the suffix, wherever it stands."""
    return F.replace(as_col(name), F.lit(suffix), F.lit(""))


def base_name(path) -> Column:
    return F.element_at(F.split(as_col(path), "/", -1), -1)


def root(path) -> Column:
    """The path without its extension; leading-dot names have none."""
    return F.substr(as_col(path), F.lit(1), F.length(as_col(path)) - F.length(extension(path)))


def extension(path) -> Column:
    return F.regexp_extract(as_col(path), _EXTENSION, 1)


def needs_convert(path) -> Column:
    return extension(path) != CONTAINER


def mp4_target(path) -> Column:
    return F.when(needs_convert(path), F.concat(root(path), F.lit(CONTAINER))).otherwise(as_col(path))


def cut_target(path) -> Column:
    return F.concat(root(path), F.lit(CUT_SUFFIX))


def caption_path(output_root: str, experiment, folder, name) -> Column:
    return _output_path(output_root, CAPTION_LAYOUT, experiment, folder, name, "csv")


def subtitle_path(output_root: str, experiment, folder, name) -> Column:
    return _output_path(output_root, SUBTITLE_LAYOUT, experiment, folder, name, "srt")


def summary_path(output_root: str, experiment, name) -> Column:
    file_name = F.concat(F.lit("summary_"), stem(name), F.lit(".csv"))
    return F.concat_ws("/", F.lit(output_root), F.lit(SUMMARY_LAYOUT), experiment, file_name)


def _output_path(output_root, layout, experiment, folder, name, kind) -> Column:
    file_name = F.concat(F.lit("output_"), stem(name), F.lit("." + kind))
    return F.concat_ws("/", F.lit(output_root), F.lit(layout), experiment, folder, file_name)
