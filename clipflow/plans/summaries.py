"""Summaries of the captions of a video."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as ft
from ..functions.models import Summarizer
from ..operators.documents import join_text, word_chunks
from ..operators.skew import HotKeys, hot_keys, running_totals, split_hot
from ..operators.summary import MAX_WORDS, MIN_WORDS, summarize_pieces, summarize_rows
from ..session import scratch_path

# Words per chunk, the count below which a text is passed on, characters of a head.
#: Words per chunk, and the count below which a text is passed on unsummarised.
CHUNK_WORDS = 512
ROUTE_WORDS = 130
HEAD_CHARS = 4000


@dataclass(frozen=True)
class Bounds:
    """Words that a summary may and should have, that a chunk has, and below which a text passes as it is."""

    max_words: int = MAX_WORDS
    min_words: int = MIN_WORDS
    chunk_words: int = CHUNK_WORDS
    route_words: int = ROUTE_WORDS


def stripped(captions: DataFrame, prompt: str) -> DataFrame:
    return captions.select("video_id", "clip_no", ft.strip_prompt("caption", prompt).alias("caption"))


def hierarchical_summary(
    captions: DataFrame, prompt: str, hot: HotKeys | None = None, model: Summarizer | None = None, bounds: Bounds = Bounds()
) -> DataFrame:
    """Summarise chunks of the joined captions, then their joined summaries.

    With a ``model`` every chunk and every joined text of ``bounds.route_words`` words or more goes through it; shorter
    ones pass as they are and never reach it. What it says of the chunks is written to the scratch folder.
    """
    hot = hot_keys(captions, "video_id") if hot is None else hot
    texts = stripped(captions, prompt)
    if model is not None:
        return _two_levels_by_model(texts, hot, model, bounds)
    if not hot:
        return _two_levels(texts, {}, bounds)
    cold_rows, hot_rows = split_hot(texts, "video_id", hot)
    return _two_levels(cold_rows, {}, bounds).unionByName(_two_levels(hot_rows, hot, bounds))


def _two_levels(texts: DataFrame, hot: HotKeys, bounds: Bounds) -> DataFrame:
    chunks = word_chunks(texts, "video_id", "clip_no", "caption", bounds.chunk_words, bounds.route_words, hot)
    parts = summarize_rows(
        chunks, ["video_id", "chunk_no"], "chunk", bounds.max_words, bounds.min_words, bounds.route_words, counted="n_words"
    )
    # A video whose captions hold no word has no chunk; its summary is empty.
    return summarize_pieces(
        parts, "video_id", "chunk_no", "summary", hot, bounds.max_words, bounds.min_words, bounds.route_words,
        every=texts.select("video_id").distinct(),
    )


def _two_levels_by_model(texts: DataFrame, hot: HotKeys, model: Summarizer, bounds: Bounds) -> DataFrame:
    chunks = word_chunks(texts, "video_id", "clip_no", "caption", bounds.chunk_words, bounds.route_words, hot)
    path = scratch_path(texts.sparkSession, "parts")
    # written once: two branches read them below, and the model is not asked for a chunk again
    _through(chunks, ["video_id", "chunk_no"], "chunk", F.col("n_words"), model, bounds).write.parquet(path)
    parts = texts.sparkSession.read.parquet(path)
    whole = join_text(parts, "video_id", "chunk_no", "summary").select("video_id", F.col("text").alias("_whole"))
    done = _through(whole, ["video_id"], "_whole", ft.word_count("_whole"), model, bounds)
    # a video whose captions hold no word has no chunk; its summary is empty
    return texts.select("video_id").distinct().join(done, "video_id", "left").fillna({"summary": ""})


def _through(texts: DataFrame, keys: list[str], text: str, n_words: Column, model: Summarizer, bounds: Bounds) -> DataFrame:
    """Texts that are long enough through the model, the others past it."""
    counted = texts.select(*keys, F.col(text).alias("_text"), n_words.alias("_n"))
    long = counted.filter(F.col("_n") >= bounds.route_words).select(*keys, model(F.col("_text")).alias("summary"))
    short = counted.filter(F.col("_n") < bounds.route_words).select(*keys, F.col("_text").alias("summary"))
    return long.unionByName(short)


def oneshot_summary(
    captions: DataFrame, prompt: str = "", hot: HotKeys | None = None, model: Summarizer | None = None,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """Summarise all captions of a video in one go; a ``model`` gets the joined text in one value."""
    if model is not None:
        whole = join_text(stripped(captions, prompt), "video_id", "clip_no", "caption")
        return whole.select("video_id", model(F.col("text")).alias("summary"))
    hot = hot_keys(captions, "video_id") if hot is None else hot
    return summarize_pieces(stripped(captions, prompt), "video_id", "clip_no", "caption", hot, bounds.max_words, bounds.min_words)


def head_summary(
    captions: DataFrame,
    prompt: str,
    limit: int = HEAD_CHARS,
    hot: HotKeys | None = None,
    model: Summarizer | None = None,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """Summarise the first ``limit`` characters of the joined captions.

    Only captions that start within those characters are joined.
    """
    texts = stripped(captions, prompt).withColumn("caption", ft.head_chars("caption", limit))
    size = F.length("caption").cast("bigint") + 1
    placed = running_totals(texts, "video_id", ["clip_no"], {"_at": size}, hot=hot)
    joined = placed.filter(F.col("_at") < limit).groupBy("video_id").agg(
        F.expr("listagg(caption, ' ') within group (order by clip_no)").alias("_joined")
    )
    heads = joined.select("video_id", ft.head_chars("_joined", limit).alias("head"))
    if model is not None:
        return heads.select("video_id", model(F.col("head")).alias("summary"))
    return summarize_rows(heads, ["video_id"], "head", bounds.max_words, bounds.min_words)
