"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clipflow.functions import clips as fc, media, paths, text as ft, timecode as tc
from clipflow.functions.models import udf_captioner, udf_encoder, udf_summarizer, udf_translator
from clipflow.operators import (
    captions as oc, chat, clips, documents, frames as of, scoring, skew, subtitles, summary
)
from clipflow.plans import captioning, chat as chat_plan, scoring as score_plan, summaries
from clipflow.schema import LONG, REAL, TEXT
from clipflow.session import scratch_path
from clipflow.sources import files
from clipflow.sources.documents import list_named
from clipflow.streaming.catalog import caption_catalog
from clipflow.streaming.clips import assemble_clip_stream
from clipflow.streaming.run import latest, run_to_table
from clipflow.streaming.sessions import active_video_stream, answer_stream

from . import fixtures as fx

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def listed(column) -> F.Column:
    """Arrays leave a query as text, which every engine compares alike."""
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


# ---------------------------------------------------------------- catalogs, clips


@query
def video_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return fx.videos(spark, sf).withColumn("duration_s", F.round("duration_s", 6))


@query
def frame_numbering(spark, sf):
    return fx.frames(spark, sf).select("video_id", "frame_idx", "payload")


@query
def clip_index_plan(spark, sf):
    plan = clips.plan_clips(fx.videos(spark, sf), length=5, stride=3)
    return plan.withColumn("frame_idx", listed("frame_idx"))


@query
def clip_index_plan_padded(spark, sf):
    plan = clips.plan_clips(fx.videos(spark, sf), length=8, stride=8)
    return plan.withColumn("frame_idx", listed("frame_idx"))


@query
def stride_sample(spark, sf):
    return clips.stride_sample(fx.frames(spark, sf), 3).select("video_id", "frame_idx", "payload")


@query
def clip_spans(spark, sf):
    return clips.with_span(clips.plan_clips(fx.videos(spark, sf), 8, 8)).drop("frame_idx")


@query
def clip_timecodes(spark, sf):
    spans = clips.with_span(clips.plan_clips(fx.videos(spark, sf), 5, 3, keep=("fps",)))
    return spans.select(
        "video_id", "clip_no",
        tc.timecode("start_frame", "fps").alias("start_tc"), tc.timecode("end_frame", "fps").alias("end_tc"),
    )


# ---------------------------------------------------------------- frames


@query
def clip_frame_gather(spark, sf):
    gathered = of.assemble_clips(fx.videos(spark, sf), fx.frames(spark, sf), 8, 8)
    return gathered.select("video_id", "clip_no", "n_fetched", _payload())


@query
def clip_frame_gather_join(spark, sf):
    plan = clips.plan_clips(fx.videos(spark, sf), 5, 3)
    gathered = of.gather_frames(plan, fx.frames(spark, sf))
    return gathered.select("video_id", "clip_no", "n_fetched", _payload())


@query
def clip_frame_members(spark, sf):
    kept = of.clip_members(fx.videos(spark, sf), fx.frames(spark, sf), 8, 8)
    return kept.select("video_id", "clip_no", "frame_idx", "payload")


@query
def clip_frame_members_join(spark, sf):
    plan = clips.plan_clips(fx.videos(spark, sf), 8, 8)
    return of.semi_members(plan, fx.frames(spark, sf)).select("video_id", "clip_no", "frame_idx", "payload")


@query
def full_clip_filter(spark, sf):
    gathered = of.assemble_clips(fx.videos(spark, sf), _decoded(spark, sf), 5, 3)
    return of.full_clips(gathered, 5).select("video_id", "clip_no", _payload())


@query
def head_by_time(spark, sf):
    slow = fx.videos(spark, sf).withColumn("fps", F.lit(5.0))
    return of.head_of_video(slow, fx.frames(spark, sf)).select("video_id", "frame_idx", "payload")


@query
def cut_catalog(spark, sf):
    slow = fx.videos(spark, sf).withColumn("fps", F.lit(5.0))
    return of.cut_catalog(slow).select("video_id", "n_frames", F.round("duration_s", 6).alias("duration_s"))


@query
def pixel_cast(spark, sf):
    return fx.frames(spark, sf).select("video_id", "frame_idx", listed(media.to_bytes("px")).alias("px"))


# ---------------------------------------------------------------- captions


@query
def clip_captions(spark, sf):
    gathered = of.assemble_clips(fx.videos(spark, sf), fx.frames(spark, sf), 5, 3)
    return oc.caption_clips(gathered, fx.PROMPT, 5)


@query
def clip_captions_udf(spark, sf):
    """A stand-in model in Python; it must answer as the built-in captioner does."""

    def load():
        # defined in here, so that it reaches the executors with the query
        def say(values):
            scaled = [round(float(v) * 1000) for v in values]
            low, high, mean = min(scaled), max(scaled), sum(scaled) // len(scaled)
            return f"n={len(scaled)} min={low / 1000:.3f} max={high / 1000:.3f} mean={mean / 1000:.3f}"

        return lambda payload, prompt: prompt + payload.map(say)

    gathered = of.assemble_clips(fx.videos(spark, sf), fx.frames(spark, sf), 5, 3)
    return oc.caption_clips(gathered, fx.PROMPT, 5, udf_captioner(load))


@query
def caption_align(spark, sf):
    videos = fx.videos(spark, sf)
    spans = clips.with_span(clips.plan_clips(videos, 5, 3))
    known = oc.caption_clips(of.assemble_clips(videos, _decoded(spark, sf), 5, 3), fx.PROMPT, 5)
    return oc.align_captions(spans, known)


@query
def caption_sentinel(spark, sf):
    videos = fx.videos(spark, sf)
    spans = clips.with_span(clips.plan_clips(videos, 5, 3))
    known = oc.caption_clips(of.assemble_clips(videos, _decoded(spark, sf), 5, 3), fx.PROMPT, 5)
    return oc.sentinel_captions(spans, known)


@query
def image_captions(spark, sf):
    images = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("image_id"),
        F.concat(F.lit("img_"), F.col("event_id").cast("string"), F.lit(".png")).alias("name"),
        F.col("value").alias("payload"),
    )
    done = oc.caption_images(images, fx.PROMPT, keep=("name",))
    return done.select("image_id", paths.stem("name", ".png").alias("stem"), "caption")


@query
def incremental_todo(spark, sf):
    stored = fx.frames(spark, sf).select("video_id")
    return oc.missing_captions(fx.caption_catalog(spark, sf), stored).select("video_id", "path")


@query
def caption_batch(spark, sf):
    return captioning.caption_videos(fx.videos(spark, sf), fx.frames(spark, sf), fx.PROMPT, 5, 3)


@query
def caption_batch_stripped(spark, sf):
    return captioning.caption_videos(fx.videos(spark, sf), fx.frames(spark, sf), fx.PROMPT, 8, 8, strip=True)


@query
def caption_batch_reuse(spark, sf):
    """Every other video has all its captions stored, every third of the rest only its first."""
    videos, frames = fx.videos(spark, sf), fx.frames(spark, sf)
    known = captioning.caption_videos(videos, frames, fx.PROMPT, 5, 3)
    kept = (F.col("video_id") % 2 == 0) | ((F.col("video_id") % 3 == 0) & (F.col("clip_no") == 0))
    path = scratch_path(spark, "stored")
    known.filter(kept).write.parquet(path)
    return captioning.caption_videos(videos, frames, fx.PROMPT, 5, 3, stored=spark.read.parquet(path))


@query
def caption_batch_blocks(spark, sf):
    """Captions from frames stored in blocks; those of the catalog's first half by time are stored already."""
    videos, frames = fx.videos(spark, sf), _frame_blocks(spark, sf)
    older = videos.filter(F.col("video_id") < videos.agg(F.percentile_approx("video_id", 0.5)).scalar())
    path = scratch_path(spark, "stored")
    captioning.caption_videos(older, frames, fx.PROMPT, 5, 3).write.parquet(path)
    return captioning.caption_videos(videos, frames, fx.PROMPT, 5, 3, stored=spark.read.parquet(path))


@query
def caption_stream(spark, sf):
    """A catalog that comes in three parts, the first of them twice."""
    layout = T.StructType([T.StructField("video_id", LONG), T.StructField("n_frames", LONG), T.StructField("fps", REAL)])
    source, target = scratch_path(spark, "catalog"), scratch_path(spark, "stream")
    frames, catalog = _frame_blocks(spark, sf), fx.videos(spark, sf).select(*layout.names)
    for part in (0, 1, 0, 2):
        catalog.filter(F.pmod(F.xxhash64("video_id"), F.lit(3)) == part).write.mode("append").parquet(source)
        done = caption_catalog(files.stream_parquet(spark, source, layout), frames, fx.PROMPT, 5, 3, path=target)
    return done


@query
def caption_cut_batch(spark, sf):
    """Captions of a catalog cut to its first seconds, from the whole frame table."""
    cut = of.cut_catalog(fx.videos(spark, sf).withColumn("fps", F.lit(2.0)))
    return captioning.caption_videos(cut, fx.frames(spark, sf), fx.PROMPT, 5, 3)


@query
def caption_batch_export(spark, sf):
    videos = fx.videos(spark, sf)
    captions = captioning.caption_videos(videos, fx.frames(spark, sf), fx.PROMPT, 5, 3)
    return captioning.export_captions(captions, videos, fx.PROMPT, scratch_path(spark, "export"), "exp", "folder")


# ---------------------------------------------------------------- text


@query
def prompt_strip(spark, sf):
    return fx.captions(spark, sf).select("video_id", "clip_no", ft.strip_prompt("caption", fx.PROMPT).alias("text"))


@query
def prompt_render(spark, sf):
    asked = fx.messages(spark, sf)
    return asked.select("conv_id", "turn", ft.echoed_prompt(ft.chat_prompt("text")).alias("prompt"))


@query
def prompt_struct(spark, sf):
    asked = fx.messages(spark, sf)
    return asked.select("conv_id", "turn", F.to_json(ft.chat_prompt("text")).alias("prompt"))


@query
def caption_join(spark, sf):
    return documents.join_text(summaries.stripped(fx.captions(spark, sf), fx.PROMPT), "video_id", "clip_no", "caption")


@query
def word_chunks(spark, sf):
    return _chunks(spark, sf).select("video_id", "chunk_no", "n_words", "chunk")


@query
def document_chunks(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode_outer(ft.chunks("text", 512, 130)).alias("chunk_no", "chunk")).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk"
    ).dropna(subset=["chunk_no"])


@query
def chunk_route(spark, sf):
    return _chunks(spark, sf).select(
        "video_id", "chunk_no", "n_words", (F.col("n_words") >= summaries.ROUTE_WORDS).alias("summarise")
    )


@query
def extractive_summary(spark, sf):
    # the operator shuffles nothing; a table that is one row group would be one task
    texts = fx.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    return summary.summarize_rows(texts, ["doc_id"], "text")


@query
def hierarchical_summary(spark, sf):
    return summaries.hierarchical_summary(fx.captions(spark, sf), fx.PROMPT)


@query
def hierarchical_summary_udf(spark, sf):
    """A stand-in model in Python; it must answer as the built-in summary does."""

    def load():
        import re
        from collections import Counter
        from fractions import Fraction

        def say(text):
            sentences, terms = {}, {}
            for pos, match in enumerate(re.findall(r"[^.!?]+[.!?]*", text or ""), 1):
                sentence = " ".join(match.split())
                if sentence:
                    sentences[pos] = sentence
                    kept = "".join(c for c in sentence.lower() if c == " " or c.isalpha() or c.isnumeric())
                    terms[pos] = [t for t in kept.split(" ") if t]
            counts = Counter(t for own in terms.values() for t in own)
            score = {p: Fraction(sum(counts[t] for t in own), len(own)) if own else 0 for p, own in terms.items()}
            total, chosen = 0, []
            for pos in sorted(sentences, key=lambda p: (-score[p], p)):
                before, total = total, total + len(sentences[pos].split(" "))
                if total <= 130 or before == 0 or before < 30:
                    chosen.append(pos)
            return " ".join(" ".join(sentences[p] for p in sorted(chosen)).split(" ")[:130])

        return lambda texts: texts.map(say)

    return summaries.hierarchical_summary(fx.captions(spark, sf), fx.PROMPT, model=udf_summarizer(load))


@query
def oneshot_summary(spark, sf):
    return summaries.oneshot_summary(fx.captions(spark, sf), fx.PROMPT)


@query
def head_summary(spark, sf):
    return summaries.head_summary(fx.captions(spark, sf), fx.PROMPT)


# ---------------------------------------------------------------- subtitles, files


@query
def srt_cues(spark, sf):
    return subtitles.subtitle_cues(fx.captions(spark, sf), fx.caption_catalog(spark, sf), fx.PROMPT)


@query
def srt_document(spark, sf):
    return subtitles.subtitle_documents(fx.captions(spark, sf), fx.caption_catalog(spark, sf), fx.PROMPT)


@query
def srt_document_lines(spark, sf):
    """Cues whose texts have no line breaks of their own."""
    return subtitles.subtitle_documents(fx.captions(spark, sf), fx.caption_catalog(spark, sf), fx.PROMPT, strip_newlines=True)


@query
def output_files(spark, sf):
    """Caption, subtitle and summary files by name, as read back."""
    root = scratch_path(spark, "files")
    captions, catalog = fx.captions(spark, sf), fx.caption_catalog(spark, sf)
    names = catalog.select("video_id", paths.base_name("path").alias("name"))
    placed = lambda rows: files.with_coordinates(rows.join(names, "video_id"), "exp", "folder", "name")
    files.write_caption_files(placed(captions), root)
    files.write_subtitle_files(placed(subtitles.subtitle_blocks(captions, catalog, fx.PROMPT)), root)
    files.write_summary_files(placed(summaries.head_summary(captions, fx.PROMPT)), root)
    return list_named(spark, root).select("file", "length", F.sha2("content", 256).alias("digest"))


@query
def output_paths(spark, sf):
    name = paths.base_name("path")
    return fx.videos(spark, sf).select(
        "video_id",
        paths.stem(name).alias("stem"),
        paths.caption_path("/out", F.lit("exp"), F.lit("folder"), name).alias("csv_path"),
        paths.subtitle_path("/out", F.lit("exp"), F.lit("folder"), name).alias("srt_path"),
        paths.summary_path("/out", F.lit("exp"), name).alias("summary_path"),
    )


@query
def mp4_target(spark, sf):
    return fx.videos(spark, sf).select(
        "video_id", "path", paths.needs_convert("path").alias("needs_convert"), paths.mp4_target("path").alias("target")
    )


@query
def caption_csv_roundtrip(spark, sf):
    captions = fx.captions(spark, sf)
    name = F.concat(F.lit("d_"), F.col("video_id").cast("string"), F.lit(".mp4"))
    path = scratch_path(spark, "captions")
    files.write_captions(files.with_coordinates(captions, "exp", "folder", name), path)
    return files.read_captions(spark, path).withColumn("caption", F.coalesce("caption", F.lit("")))


@query
def score_csv_roundtrip(spark, sf):
    scores = score_plan.score_videos(fx.clip_vectors(spark, sf), fx.prompts(spark, sf), fx.LOGIT_SCALE, last_only=True)
    name = F.concat(F.lit("v_"), F.col("video_id").cast("string"), F.lit(".mp4"))
    path = scratch_path(spark, "scores")
    files.write_scores(files.with_coordinates(scores, "exp", "folder", name), path)
    return files.read_scores(spark, path).withColumn("prob", F.round("prob", 6))


@query
def summary_csv_roundtrip(spark, sf):
    done = summaries.hierarchical_summary(fx.captions(spark, sf), fx.PROMPT)
    name = F.concat(F.lit("d_"), F.col("video_id").cast("string"), F.lit(".mp4"))
    path = scratch_path(spark, "summaries")
    files.write_summaries(files.with_coordinates(done, "exp", "folder", name), path)
    return files.read_summaries(spark, path).withColumn("summary", F.coalesce("summary", F.lit("")))


# ---------------------------------------------------------------- scores


@query
def zero_shot_scores(spark, sf):
    scored = score_plan.score_videos(fx.clip_vectors(spark, sf), fx.prompts(spark, sf), fx.LOGIT_SCALE)
    return scored.withColumn("prob", F.round("prob", 6))


@query
def zero_shot_scores_blocks(spark, sf):
    scored = scoring.score_clips_in_blocks(fx.clip_vectors(spark, sf), fx.prompts(spark, sf), fx.LOGIT_SCALE, 2)
    return scored.withColumn("prob", F.round("prob", 6))


@query
def zero_shot_last_clip(spark, sf):
    scored = score_plan.score_videos(
        fx.clip_vectors(spark, sf), fx.prompts(spark, sf), fx.LOGIT_SCALE, last_only=True
    )
    return scored.withColumn("prob", F.round("prob", 6))


@query
def zero_shot_last_clip_many(spark, sf):
    """The last clips against every vector as a prompt."""
    asked = fx.table(spark, sf, "embeddings")
    scored = score_plan.score_videos(fx.clip_vectors(spark, sf), fx.as_prompts(asked), fx.LOGIT_SCALE, last_only=True)
    return scored.withColumn("prob", F.round("prob", 6))


@query
def zero_shot_top(spark, sf):
    """The three likeliest of all vectors' prompts for every vector as a clip: both sides grow with the table."""
    asked = fx.as_prompts(fx.table(spark, sf, "embeddings"))
    best = scoring.best_prompts(fx.clip_vectors(spark, sf), asked, 3, fx.LOGIT_SCALE)
    return best.withColumn("prob", F.round("prob", 6))


@query
def zero_shot_texts(spark, sf):
    """The two likeliest of all benchmark texts for every clip; each distinct text is encoded once."""
    asked = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))

    def load():
        import numpy as np
        import pandas as pd

        def shares(text):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4") % 64
            return (np.bincount(points, minlength=64) / max(1, len(points))).tolist()

        return lambda texts: pd.Series([shares(t) for t in texts])

    best = score_plan.score_texts(fx.clip_vectors(spark, sf), asked, udf_encoder(load), fx.LOGIT_SCALE, best=2)
    return best.withColumn("prob", F.round("prob", 6))


# ---------------------------------------------------------------- chat


@query
def upload_gate(spark, sf):
    gated = chat.gate_uploads(fx.messages(spark, sf))
    return gated.filter(F.col("status").isNotNull()).select(
        "conv_id", "turn", "status", paths.cut_target("upload").alias("cut_path"), "active_set"
    )


@query
def active_video(spark, sf):
    gated = chat.gate_uploads(fx.messages(spark, sf))
    return chat.active_video(gated).select("conv_id", "turn", "active_video")


@query
def translate_fallback(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    known = docs.filter("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("IT:"), "text").alias("translation"))
    rows = chat.translate_with_fallback(docs, "doc_id", "text", known, prefix="Translate: ")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def translate_errors(spark, sf):
    """A translator that fails for some texts always and for others at first; what it said of a failure is kept."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")

    def load():
        failed = set()  # texts that are asked for again; none is kept once it is answered

        def ask(text):
            if len(text) % 3 == 0 or len(text) % 3 == 1 and text not in failed:
                if len(text) % 3:
                    failed.add(text)
                raise ValueError(f"no answer for {len(text)} characters")
            failed.discard(text)
            return "IT:" + text

        return ask

    rows = chat.translate_with_fallback(docs, "doc_id", "text", translator=udf_translator(load), prefix="Translate: ")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def chat_replies(spark, sf):
    return _replies(spark, sf)


@query
def chat_questions(spark, sf):
    """Every turn answered from captions made under its own question."""
    return chat_plan.answer_questions(
        fx.messages(spark, sf), *_asked_videos(spark, sf), fx.translation_of("conv_id"), _describe, 5, 3
    )


@query
def chat_history(spark, sf):
    return _history(_replies(spark, sf))


# ---------------------------------------------------------------- streams


@query
def stream_active_video(spark, sf):
    gated = chat.gate_uploads(_message_stream(spark, sf)).select("conv_id", "turn", "active_set")
    return latest(run_to_table(active_video_stream(gated)), "conv_id", "turn")


@query
def stream_clips(spark, sf):
    """Frames and end-of-video rows arrive in many small batches."""
    arriving = fx.frames(spark, sf).select("video_id", "frame_idx", F.lit(False).alias("eos"))
    ends = fx.videos(spark, sf).select("video_id", F.col("n_frames").alias("frame_idx"), F.lit(True).alias("eos"))
    path = scratch_path(spark, "frames")
    arriving.unionByName(ends).repartition(8).write.parquet(path)
    layout = T.StructType([T.StructField("video_id", LONG), T.StructField("frame_idx", LONG), T.StructField("eos", T.BooleanType())])
    stream = files.stream_parquet(spark, path, layout, files_per_trigger=4)
    return run_to_table(assemble_clip_stream(stream, 8, 8)).withColumn("frame_idx", listed("frame_idx"))


@query
def stream_clips_lossy(spark, sf):
    """Frames that failed to decode never come, others come twice; clips that lack frames are closed by the end of the video."""
    layout = T.StructType([T.StructField("video_id", LONG), T.StructField("frame_idx", LONG), T.StructField("eos", T.BooleanType())])
    arriving = _decoded(spark, sf).select("video_id", "frame_idx", F.lit(False).alias("eos"))
    ends = fx.videos(spark, sf).select("video_id", F.col("n_frames").alias("frame_idx"), F.lit(True).alias("eos"))
    path, target = scratch_path(spark, "frames"), scratch_path(spark, "stream")
    again = arriving.filter("frame_idx % 5 = 0")
    arriving.unionByName(again).unionByName(ends).repartition(6).write.parquet(path)
    for late in (ends, ends):  # ends that are delivered again bring micro-batches in which clips are closed
        stream = files.stream_parquet(spark, path, layout, files_per_trigger=3)
        found = run_to_table(assemble_clip_stream(stream, 8, 8, grace_ms=1), target)
        late.repartition(1).write.mode("append").parquet(path)
    stream = files.stream_parquet(spark, path, layout, files_per_trigger=3)
    found = run_to_table(assemble_clip_stream(stream, 8, 8, grace_ms=1), target)
    return found.withColumn("frame_idx", listed("frame_idx"))


@query
def stream_turns(spark, sf):
    """Streamed turns, each answered inside its micro-batch from captions made under its own question."""
    return answer_stream(_message_stream(spark, sf), *_stored_videos(spark, sf), fx.translation_of("conv_id"), _describe, 5, 3)


@query
def stream_history(spark, sf):
    """Sessions' entries as they grow by micro-batches."""
    replies = answer_stream(_message_stream(spark, sf), *_stored_videos(spark, sf), fx.translation_of("conv_id"), _describe, 5, 3)
    return _history(replies)


# ---------------------------------------------------------------- shared parts


def _payload():
    return F.array_join(F.transform("payload", lambda v: F.format_string("%.2f", v)), ",").alias("payload")


def _frame_blocks(spark, sf):
    path = scratch_path(spark, "frames")
    table = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.write_frame_blocks(fx.frames(spark, sf).select("video_id", "frame_idx", "payload"), table, buckets, path)
    return spark.table(table)


def _decoded(spark, sf):
    """Frames without those that failed to decode."""
    events = fx.table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("video_id"), "value", "event_type")
    numbered = clips.number_frames(events, "video_id", ["ts", "event_id"])
    return numbered.filter("event_type <> 'error'").select("video_id", "frame_idx", F.col("value").alias("payload"))


def _chunks(spark, sf):
    texts = summaries.stripped(fx.captions(spark, sf), fx.PROMPT)
    return documents.word_chunks(texts, "video_id", "clip_no", "caption", summaries.CHUNK_WORDS, summaries.ROUTE_WORDS)


def _summaries(spark, sf):
    """Summaries of the videos some upload stands for."""
    captions = fx.captions(spark, sf)
    asked = captions.join(fx.uploads(spark, sf).select("video_id").distinct(), "video_id", "left_semi")
    return summaries.oneshot_summary(asked, fx.PROMPT, hot=skew.hot_keys(captions, "video_id"))


def _replies(spark, sf):
    return chat_plan.answer_turns(
        fx.messages(spark, sf), fx.uploads(spark, sf), _summaries(spark, sf), fx.translation_of("conv_id")
    )


def _message_stream(spark, sf):
    layout = T.StructType(
        [T.StructField("conv_id", LONG), T.StructField("turn", LONG), T.StructField("role", TEXT), T.StructField("text", TEXT)]
    )
    # eight files of rows in no order, three to a micro-batch: turns arrive late and out of turn
    path = scratch_path(spark, "conversations")
    said = fx.table(spark, sf, "conversations").select(*layout.names)
    said.repartition(8, F.xxhash64("conv_id", "turn", "role")).write.parquet(path)
    return fx.message_columns(files.stream_parquet(spark, path, layout, files_per_trigger=3))


def _asked_videos(spark, sf):
    """Which video an upload stands for, the catalog, and the frames."""
    videos = fx.videos(spark, sf)
    n_videos = videos.count()
    named = fx.messages(spark, sf).select("conv_id", "turn", F.explode("files").alias("path")).distinct()
    uploads = named.select("path", ((F.col("conv_id") * 31 + F.col("turn")) % n_videos).alias("video_id"))
    return uploads, videos, fx.frames(spark, sf)


def _stored_videos(spark, sf):
    """The same as tables, with frames in blocks, which every micro-batch reads."""
    uploads, videos, _ = _asked_videos(spark, sf)
    return _stored(uploads, "uploads"), _stored(videos, "catalog"), _frame_blocks(spark, sf)


def _stored(rows, name):
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _describe(payload, prompt):
    size, asked = F.size(payload).cast("string"), F.length(prompt).cast("string")
    return F.concat(prompt, F.lit("Clip of "), size, F.lit(" frames, asked in "), asked, F.lit(" characters."))


def _history(replies):
    said = chat.chat_history(replies)
    entry = lambda e: F.concat(F.coalesce(e["user"], F.lit("-")), F.lit("|"), F.coalesce(e["bot"], F.lit("-")))
    return said.select("conv_id", F.array_join(F.transform("history", entry), "\n").alias("history"))
