"""The engine's tables, derived from the given test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipflow.functions.arith import int_div
from clipflow.operators.clips import number_frames

PROMPT = "USER: \nWhat is happening in this recording? ASSISTANT: "
LOGIT_SCALE = 10.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rate(video_id: str):
    rest = F.col(video_id) % 3
    return F.when(rest == 0, 24.0).when(rest == 1, 25.0).otherwise(29.97)


def videos(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.col("video_id") % 3
    ext = F.when(rest == 0, ".mp4").when(rest == 1, ".avi").otherwise(".MP4")
    counted = table(spark, sf, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.count("*").alias("n_frames"))
    return counted.select(
        "video_id",
        F.concat(F.lit("/in/v_"), F.col("video_id").cast("string"), ext).alias("path"),
        "n_frames",
        rate("video_id").alias("fps"),
        (F.col("n_frames") / rate("video_id")).alias("duration_s"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("video_id"), "value")
    return number_frames(events, "video_id", ["ts", "event_id"]).select(
        "video_id",
        "frame_idx",
        F.col("value").alias("payload"),
        F.array(F.col("value").cast("int"), (F.col("event_id") % 300).cast("int")).alias("px"),
    )


def captions(spark: SparkSession, sf: str) -> DataFrame:
    clip_no = F.col("doc_id") % 2
    return table(spark, sf, "documents").select(
        int_div("doc_id", 2).alias("video_id"),
        clip_no.alias("clip_no"),
        (clip_no * 30).alias("start_frame"),
        (clip_no * 30 + 27).alias("end_frame"),
        F.concat(F.lit(PROMPT), F.col("text")).alias("caption"),
    )


def caption_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog of the captioned videos."""
    ids = table(spark, sf, "documents").select(int_div("doc_id", 2).alias("video_id")).distinct()
    return ids.select(
        "video_id",
        F.concat(F.lit("/in/d_"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("path"),
        rate("video_id").alias("fps"),
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt per label: its vector of the smallest id, found over the whole table."""
    first = table(spark, sf, "embeddings").groupBy("label").agg(
        F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding")
    )
    return as_prompts(first)


def as_prompts(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("prompt_id"),
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("prompt"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def clip_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        int_div("vec_id", 5).alias("video_id"),
        (F.col("vec_id") % 5).alias("clip_no"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def message_columns(conversations: DataFrame) -> DataFrame:
    """Works on the batch table and on the stream alike."""
    name = F.concat(F.lit("/up/c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".mp4"))
    second = F.replace(name, F.lit(".mp4"), F.lit("b.mp4"))
    turn_class = (F.col("conv_id") + F.col("turn")) % 4
    none = F.array().cast("array<string>")
    return conversations.filter("role = 'user'").select(
        "conv_id",
        "turn",
        "text",
        F.when(turn_class == 3, F.array(name, second)).when(turn_class == 1, none).otherwise(F.array(name)).alias("files"),
        ((F.col("conv_id") * 7 + F.col("turn") * 3) % 15 + F.lit(0.99)).cast("double").alias("dur"),
        ((F.col("conv_id") % 11 != 0) | ((F.col("conv_id") + F.col("turn")) % 3 == 0)).alias("convert_ok"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("it").alias("lang"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return message_columns(table(spark, sf, "conversations"))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Which stored captions answer for an uploaded file."""
    n_videos = table(spark, sf, "documents").select(
        F.countDistinct(int_div("doc_id", 2)).alias("n")
    ).scalar()
    named = messages(spark, sf).select("conv_id", "turn", F.explode("files").alias("path")).distinct()
    return named.select("path", ((F.col("conv_id") * 31 + F.col("turn")) % n_videos).alias("video_id"))


def translation_of(conv_id: str):
    """Stand-in translator: fails for every third conversation."""
    return lambda text: F.when(F.col(conv_id) % 3 != 0, F.concat(F.lit("IT:"), text))
