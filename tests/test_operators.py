"""Operators on small tables, and that skew changes no result."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipflow.operators import chat, documents, frames as of, scoring, skew, summary
from clipflow.operators.captions import caption_clips
from clipflow.operators.clips import plan_clips
from clipflow.operators.scoring import best_prompts, encode_texts, score_clips, score_prompts
from clipflow.session import HOT_ROWS
from clipflow.functions.models import udf_encoder, udf_summarizer, udf_translator
from clipflow.plans import chat as chat_plan
from clipflow.plans.summaries import Bounds, head_summary, hierarchical_summary, oneshot_summary
from clipflow.streaming.clips import assemble_clip_stream
from clipflow.streaming.run import latest, run_batches, run_to_table
from clipflow.streaming.sessions import active_video_stream


@pytest.fixture
def skewed(spark):
    """One key with most rows, ties in the order column broken by a second one."""
    rng = random.Random(7)
    rows = [(1, i // 5, i, rng.randint(0, 9), rng.choice([None, None, "", "a", "b"])) for i in range(400)]
    rows += [(k, i, i, i, "x" if i == 1 else None) for k in (2, 3, 4) for i in range(3)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, a bigint, b bigint, v bigint, s string").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=repr) == sorted(
        map(tuple, b.select(sorted(b.columns)).collect()), key=repr
    )


def test_ordered_scans_do_not_depend_on_slicing(spark, skewed, setting):
    def scans():
        numbered = skew.number_rows(skewed, "k", ["a", "b"], "n")
        totals = skew.running_totals(skewed, "k", ["a", "b"], {"before": F.col("v")}, {"all": F.col("v")})
        carried = skew.carry_forward(skewed, "k", ["a", "b"], "s", "c")
        return [d.select("k", "a", "b", c) for d, c in ((numbered, "n"), (totals, "before"), (totals, "all"), (carried, "c"))]

    plain = scans()
    assert skew.hot_keys(skewed, "k") == {}
    setting(HOT_ROWS, 50)
    assert skew.hot_keys(skewed, "k") == {1: 400}
    for a, b in zip(plain, scans()):
        same(a, b)


def test_lookup_spreads_hot_keys(spark, skewed):
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k bigint, name string")
    for how in ("left", "inner"):
        same(skew.lookup(skewed, dim, "k", {}, how), skew.lookup(skewed, dim, "k", {1: 400}, how))


def test_lookup_by_further_columns(spark, skewed):
    dim = spark.createDataFrame([(k, v, f"{k}-{v}") for k in (1, 2) for v in range(5)], "k bigint, v bigint, name string")
    for how in ("left", "inner"):
        plain = skewed.join(dim, ["k", "v"], how)
        same(skew.lookup(skewed, dim, "k", {1: 400}, how, on=("v",)), plain)
        same(skew.lookup(skewed, dim, "k", {}, how, on=("v",)), plain)


def test_sentences_of_texts_that_share_a_batch(spark):
    texts = {
        0: "", 1: None, 2: "   ", 3: "...", 4: "One two. " * 3, 5: "a b c d. a a. c!", 6: "word " * 200 + ".",
        7: "?! Same same. Same other words here. " + "Filler goes on and on. " * 40, 8: "x" * 5000, 9: "12 3. É é. \u2003b\u00a0c.",
    }
    rows = spark.createDataFrame(list(texts.items()), "k bigint, t string").coalesce(1)
    apart = rows.repartition(7, "k")
    for limits in ((130, 30, 0), (5, 2, 0), (10, 0, 4), (3, 9, 2)):
        together = summary.summarize_rows(rows, ["k"], "t", *limits)
        same(together, summary.summarize_rows(apart, ["k"], "t", *limits))
        pieces = rows.withColumn("i", F.lit(0))
        same(together, summary.summarize_pieces(pieces, "k", "i", "t", {}, *limits))
    assert summary.summarize_rows(rows.limit(0), ["k"], "t").count() == 0
    assert "Exchange" not in summary.summarize_rows(rows, ["k"], "t")._jdf.queryExecution().executedPlan().toString()


def test_hot_rows_are_cut_into_even_slices(spark, skewed, setting):
    setting(HOT_ROWS, 50)
    rows = skew._slice(skewed.filter("k = 1"), "k", ["a", "b"], {1: 400})
    sizes = [r["count"] for r in rows.groupBy(skew.SLICE).count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 50


def test_gather_keeps_order_and_repeats(spark):
    clips = spark.createDataFrame([(1, 0, [0, 3, 6, 9, 0, 3, 6, 9, 0, 3])], "video_id bigint, clip_no bigint, frame_idx array<bigint>")
    frames = spark.createDataFrame([(1, i, float(i)) for i in range(12)], "video_id bigint, frame_idx bigint, payload double")
    got = of.gather_frames(clips, frames).first()
    assert got.payload == [0.0, 3.0, 6.0, 9.0, 0.0, 3.0, 6.0, 9.0, 0.0, 3.0] and got.n_fetched == 10
    assert sorted(r.frame_idx for r in of.semi_members(clips, frames).collect()) == [0, 3]


@pytest.mark.parametrize("length,stride", [(5, 3), (10, 3), (4, 1), (8, 8)])
def test_frames_first_equals_join(spark, length, stride):
    rng = random.Random(3)
    sizes = {v: rng.randint(0, 70) for v in range(30)}
    videos = spark.createDataFrame(list(sizes.items()), "video_id bigint, n_frames bigint")
    kept = [(v, i, float(v * 1000 + i)) for v, n in sizes.items() for i in range(n) if rng.random() > 0.1]
    frames = spark.createDataFrame(kept, "video_id bigint, frame_idx bigint, payload double")
    plan = plan_clips(videos, length, stride)
    same(of.assemble_clips(videos, frames, length, stride), of.gather_frames(plan, frames))
    same(of.clip_members(videos, frames, length, stride), of.semi_members(plan, frames).select("video_id", "frame_idx", "payload", "clip_no"))


def test_joined_text(spark):
    rows = spark.createDataFrame([(1, i, f"text {i}.") for i in range(30)] + [(2, 0, None)], "k bigint, i bigint, t string")
    got = {r.k: r.text for r in documents.join_text(rows, "k", "i", "t", sep="'").collect()}
    assert got == {1: "'".join(f"text {i}." for i in range(30)), 2: ""}


@pytest.mark.parametrize("length,stride", [(5, 1), (4, 3), (8, 8)])
def test_clips_follow_the_plan_when_frames_and_catalog_differ(spark, length, stride):
    videos = spark.createDataFrame([(1, 20), (2, 4), (4, 70), (5, 0)], "video_id bigint, n_frames bigint")
    frames = spark.createDataFrame([(v, i, float(v * 1000 + i)) for v in (1, 2, 3, 5) for i in range(60)], "video_id bigint, frame_idx bigint, payload double")
    same(of.assemble_clips(videos, frames, length, stride), of.gather_frames(plan_clips(videos, length, stride), frames))


def test_extensions_follow_the_last_dot_behind_a_name(spark):
    from clipflow.functions import paths

    names = ["/x/a..mp4", "a.b..avi", ".mp4", "/d.d/..mp4", "a.mp4", "/x.y/a", "a.", "", "...a.b"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.root("p"), paths.extension("p")).collect()
    import os.path

    assert [(r[1], r[2]) for r in got] == [os.path.splitext(n) for n in names]


def test_every_language_gets_its_replies(spark):
    turns = [(1, 0, "de"), (1, 1, None), (1, 2, "it"), (1, 3, "en")]
    rows = spark.createDataFrame([(*t, "hi", "v.mp4", "sum", None, "ok") for t in turns], "conv_id bigint, turn bigint, lang string, text string, active_video string, summary string, translation string, status string")
    got = chat.reply_rows(rows, chat.reply_catalog(spark)).groupBy("turn").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 5, 1: 5, 2: 7, 3: 5}


def test_model_answers_keep_to_the_length(spark):
    from clipflow.functions.models import udf_captioner

    def load():
        return lambda payload, prompt: prompt + payload.map(lambda v: "one two three four")

    gathered = spark.createDataFrame([(1, 0, [1.0, 2.0], 2)], "video_id bigint, clip_no bigint, payload array<double>, n_fetched bigint")
    assert caption_clips(gathered, "P: q ", 2, udf_captioner(load), max_length=3).first().caption == "P: q one two three"


def test_lookup_copies_follow_each_keys_own_count(spark, setting):
    from clipflow.operators import skew

    setting(HOT_ROWS, 100)
    rows = [(1, i) for i in range(1600)] + [(k, 0) for k in range(2, 50)] + [(60, i) for i in range(150)]
    facts = spark.createDataFrame(rows, "k bigint, i bigint")
    dim = spark.createDataFrame([(k, f"d{k}") for k in [1, 60, 70, *range(2, 49)]], "k bigint, d string")
    hot = skew.hot_keys(facts, "k")
    same(skew.lookup(facts, dim, "k", hot), facts.join(dim, "k", "left"))
    assert dim.select(skew._salts(facts, "k", hot).alias("n")).agg({"n": "sum"}).first()[0] == 16 + 2 + 48


def test_cue_text_keeps_line_breaks_unless_told(spark):
    from clipflow.operators.subtitles import subtitle_cues, subtitle_documents

    captions = spark.createDataFrame([(1, 0, 0, 27, "P: one\ntwo"), (1, 1, 30, 57, None)], "video_id bigint, clip_no bigint, start_frame bigint, end_frame bigint, caption string")
    videos = spark.createDataFrame([(1, 30.0)], "video_id bigint, fps double")
    first = lambda **kw: subtitle_cues(captions, videos, "P: ", **kw).orderBy("cue_no").first().text
    assert first() == "one\ntwo" and first(strip_newlines=True) == "onetwo"
    assert subtitle_documents(captions, videos, "P: ").first().body == (
        "1\n00:00:00,000 --> 00:00:00,900\none\ntwo\n\n2\n00:00:01,000 --> 00:00:01,899\n\n\n"
    )


PIECES = [
    ["Hello there", "you two. And then", "a third piece! Well", "", "...done now. Hello again"],
    ["...", "Starts late. Starts", "again"],
    ["?!Odd start. Next one"],
    ["_", "_", "_"],
    ["", "  ", "\n"],
    [f"Word{i % 7} and word{i % 3} follow here{'.' if i % 2 else ''}" for i in range(90)],
    ["no stop at all here"] * 80,
]


def test_pieces_summarise_like_the_joined_text(spark, setting):
    rows = [(k, i, t) for k, texts in enumerate(PIECES) for i, t in enumerate(texts)]
    pieces = spark.createDataFrame(rows, "k bigint, i bigint, t string")
    joined = spark.createDataFrame([(k, " ".join(texts)) for k, texts in enumerate(PIECES)], "k bigint, t string")
    for least in (0, 20):
        want = summary.summarize_rows(joined, ["k"], "t", 40, 10, min_input=least)
        same(summary.summarize_pieces(pieces, "k", "i", "t", {}, 40, 10, least), want)
        setting(HOT_ROWS, 2)
        hot = skew.hot_keys(pieces, "k")
        assert hot
        same(summary.summarize_pieces(pieces, "k", "i", "t", hot, 40, 10, least), want)
        setting(HOT_ROWS, 1_000_000)


def test_joined_pieces_are_summarised_as_pieces(spark):
    rows = [(k, i, t) for k, texts in enumerate(PIECES) for i, t in enumerate(texts)]
    rows += [(100, 0, None), (101, 1, "two"), (101, 0, None), (None, 0, "Lost."), (102, 0, "Once."), (102, 0, "Once.")]
    pieces = spark.createDataFrame(rows, "k bigint, i bigint, t string")
    want = summary.summarize_pieces(pieces, "k", "i", "t", {}, 40, 10)
    same(summary.summarize_joined(pieces.repartition(3), "k", "i", "t", 40, 10), want)


@pytest.mark.parametrize("joined_words", [1 << 18, 250, 0])
def test_turns_are_answered_alike_however_long_their_captions(spark, monkeypatch, joined_words):
    videos = spark.createDataFrame([(1, 4), (2, 40), (3, 0)], "video_id bigint, n_frames bigint")
    frames = spark.createDataFrame(
        [(v, i, float(i)) for v, n in ((1, 4), (2, 40)) for i in range(n)], "video_id bigint, frame_idx bigint, payload double"
    )
    asked = [(7, 0, 1), (7, 1, 2), (8, 0, 2), (8, 1, 3), (9, 0, 1), (9, 0, 2), (None, 5, 2)]  # one turn comes twice
    turns = spark.createDataFrame(
        [(c, t, f"What, {c} {t}?", "/in.mp4", v) for c, t, v in asked],
        "conv_id bigint, turn bigint, text string, active_video string, _video bigint",
    )

    def say(payload, prompt):
        return F.concat(prompt, F.lit("Seen "), F.array_max(payload).cast("int").cast("string"), F.lit("; next. More"))

    monkeypatch.setattr(chat_plan, "JOINED_WORDS", joined_words)
    answers = chat_plan.summarize_asked(turns, videos, frames, say, length=2, stride=2, max_length=50)
    got = {}
    for row in answers.collect():
        got.setdefault((row.conv_id, row.turn), []).append(row.summary)
    long = " ".join(f"Seen {4 * i + 2}; next. More" for i in range(10))
    assert got[7, 1] == got[8, 0] == got[None, 5] == [long]
    assert got[7, 0] == ["Seen 2; next. More"] and got[8, 1] == [None]
    assert len(got[9, 0]) == 2 and got[9, 0][0] == got[9, 0][1] and got[9, 0][0].count("Seen 2;") == 2
    # words become rows, which are shuffled and sorted, only for turns with more captions than one text may have
    by_words = "_term" in answers._jdf.queryExecution().optimizedPlan().toString()
    assert by_words == (joined_words < 500)


def brute_summary(text, most, least):
    import re

    parts = [(i, " ".join(s.split())) for i, s in enumerate(re.findall(r"[^.!?]+[.!?]*", text))]
    parts = [(i, s) for i, s in parts if s]
    terms = {i: [t for t in (re.sub(r"[^\w]|_", "", w.lower()) for w in s.split()) if t] for i, s in parts}
    every = [t for ts in terms.values() for t in ts]
    score = {i: sum(every.count(t) for t in ts) / len(ts) if ts else 0.0 for i, ts in terms.items()}
    kept, used = [], 0
    for i, s in sorted(parts, key=lambda p: (-score[p[0]], p[0])):
        n = len(s.split())
        if used + n <= most or used == 0 or used < least:
            kept.append((i, s))
        used += n
    return " ".join(" ".join(s for _, s in sorted(kept)).split()[:most])


def test_summary_against_brute_force(spark):
    rng = random.Random(11)
    words = "red green blue sky sea. sun! moon? star, rain\nwind".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    for k, got in summary.summarize_rows(rows, ["k"], "t", 30, 10).collect():
        assert got == brute_summary(texts[k], 30, 10)


def test_prompt_sets_of_any_size_score_alike(spark):
    rng = random.Random(5)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    clips = spark.createDataFrame([(v, c, vector()) for v in range(4) for c in range(3)], "video_id bigint, clip_no bigint, vector array<double>")
    prompts = spark.createDataFrame([(p, f"p{p}", vector()) for p in range(9)], "prompt_id bigint, prompt string, vector array<double>")
    inline = score_prompts(clips, prompts, 3.0).withColumn("prob", F.round("prob", 10))
    blocks = score_prompts(clips, prompts, 3.0, max_inline=2).withColumn("prob", F.round("prob", 10))
    same(inline, blocks.select(inline.columns))
    with pytest.raises(ValueError):
        score_clips(clips, prompts, max_inline=2)


def test_active_video_keeps_and_clears(spark):
    turns = [(1, 0, None), (1, 1, "v1"), (1, 2, None), (1, 3, ""), (1, 4, None)]
    gated = spark.createDataFrame(turns, "conv_id bigint, turn bigint, active_set string")
    got = [r.active_video for r in chat.active_video(gated).orderBy("turn").collect()]
    assert got == ["", "v1", "v1", "", ""]


def test_history_in_order(spark):
    rows = [(1, t, 0, f"message number {t}", None) for t in range(12)]
    replies = spark.createDataFrame(rows, "conv_id bigint, turn bigint, pos bigint, user string, bot string")
    assert [e.user for e in chat.chat_history(replies).first().history] == [f"message number {t}" for t in range(12)]


def test_python_model_sees_each_full_clip_once(spark):
    from clipflow.functions.models import udf_captioner

    def load():
        return lambda payload, prompt: prompt + payload.map(lambda v: str(len(v)))

    gathered = spark.createDataFrame([(1, 0, [1.0, 2.0], 2), (1, 1, [1.0], 1)], "video_id bigint, clip_no bigint, payload array<double>, n_fetched bigint")
    got = caption_clips(gathered, "P ", 2, udf_captioner(load)).collect()
    assert [tuple(r) for r in got] == [(1, 0, "P 2")]


@pytest.mark.parametrize("files", [1, 7])
def test_clip_stream_takes_frames_in_any_order(spark, tmp_path, files):
    rng = random.Random(files)
    sizes = {v: rng.randint(1, 40) for v in range(12)}
    rows = [(v, i, False) for v, n in sizes.items() for i in range(n)] + [(v, n, True) for v, n in sizes.items()]
    rng.shuffle(rows)
    layout = "video_id bigint, frame_idx bigint, eos boolean"
    spark.createDataFrame(rows, layout).repartition(files).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    videos = spark.createDataFrame(list(sizes.items()), "video_id bigint, n_frames bigint")
    same(run_to_table(assemble_clip_stream(stream, 4, 3)), plan_clips(videos, 4, 3))


def test_clip_stream_closes_what_lacks_frames_once(spark, tmp_path):
    rng = random.Random(9)
    length, stride = 4, 3
    sizes = {v: rng.randint(1, 60) for v in range(10)}
    frames = [(v, i) for v, n in sizes.items() for i in range(n) if rng.random() < 0.8]
    rows = [(v, i, False) for v, i in frames + rng.sample(frames, 40)] + [(v, n, True) for v, n in sizes.items()]
    rng.shuffle(rows)
    layout = "video_id bigint, frame_idx bigint, eos boolean"
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    ends = [r for r in rows if r[2]]
    # late frames of closed clips and ends that come again change nothing
    for part in (rows, ends, [r for r in rows if not r[2]][:30] + ends, ends):
        spark.createDataFrame(part, layout).repartition(3).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 2).parquet(folder)
        found = run_to_table(assemble_clip_stream(stream, length, stride, grace_ms=1), target)
    got = sorted((r["video_id"], r["clip_no"], r["frame_idx"]) for r in found.collect())
    present = set(frames)
    expected = []
    for v, n in sizes.items():
        h = -(-n // stride)
        for c in range(max(1, h // length)):
            plan = [(i % h if h < length else c * length + i) * stride for i in range(length)]
            kept = [i for i in plan if (v, i) in present]
            if kept:
                expected.append((v, c, kept))
    assert got == sorted(expected)


@pytest.mark.parametrize("page_turns", [3, 4096])
def test_session_stream_takes_turns_in_any_order(spark, tmp_path, page_turns):
    layout = "conv_id bigint, turn bigint, active_set string, note string"
    rng = random.Random(page_turns)
    rows = [(c, t, rng.choice([None, None, None, "", f"v{c}{t}"]), rng.choice([None, f"n{t}"])) for c in range(6) for t in range(25)]
    arriving = rows + rng.sample(rows, 30)  # some are delivered again
    rng.shuffle(arriving)
    folder = str(tmp_path / "in")
    for part in range(5):
        spark.createDataFrame(arriving[part::5], layout).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(folder)
    table = run_to_table(active_video_stream(stream, context="note", page_turns=page_turns))
    batch = chat.active_context(spark.createDataFrame(rows, layout), ["note"])
    columns = ["conv_id", "turn", "active_video", "note"]
    same(latest(table, "conv_id", "turn").select(columns), batch.select(columns))


def test_session_stream_goes_on_where_it_ended(spark, tmp_path):
    layout = "conv_id bigint, turn bigint, active_set string"
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows, expected in (
        ([(1, 0, "a"), (1, 5, None)], {0: "a", 5: "a"}),
        ([(1, 3, "b")], {0: "a", 3: "b", 5: "b"}),
        ([(1, 4, "")], {0: "a", 3: "b", 4: "", 5: ""}),
        ([(1, 0, None)], {0: "", 3: "b", 4: "", 5: ""}),
    ):
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(folder)
        table = run_to_table(active_video_stream(spark.readStream.schema(layout).parquet(folder), page_turns=2), target)
        assert {r["turn"]: r["active_video"] for r in latest(table, "conv_id", "turn").collect()} == expected


def test_a_long_session_in_one_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    turns = spark.range(200_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 1000 == 7, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("active_set"),
    )
    turns.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(turns.schema).parquet(folder)
    got = run_to_table(active_video_stream(stream))
    held = F.when(F.col("turn") < 7, "").otherwise(F.concat(F.lit("v"), ((F.col("turn") - 7) - (F.col("turn") - 7) % 1000 + 7).cast("string")))
    assert got.count() == 200_000 and got.filter(F.col("active_video") != held).count() == 0


def test_repeated_micro_batches_replace_their_results(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(folder)
    stream = spark.readStream.schema("id bigint").parquet(folder)
    calls = []

    def work(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rows.withColumn("twice", F.col("id") * 2)

    assert run_batches(stream, work, target).count() == 3
    spark.range(3, 5).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="lost"):
        run_batches(stream, work, target)
    assert sorted(r["twice"] for r in run_batches(stream, work, target).collect()) == [0, 2, 4, 6, 8]
    (tmp_path / "none").mkdir()
    assert run_batches(spark.readStream.schema("id bigint").parquet(str(tmp_path / "none")), work, str(tmp_path / "never")) is None


def test_replies_carry_what_a_failed_translation_said(spark):
    turns = spark.createDataFrame(
        [(1, 0, "hi", "it", None, "/v.mp4", "good"), (1, 1, "hi", "it", None, "/v.mp4", "bad"), (1, 2, "hi", "it", None, "/v.mp4", "bad"),
         (1, 3, "hi", "en", None, "/v.mp4", "bad"), (1, 4, "hi", "it", None, "/v.mp4", None)],
        "conv_id bigint, turn bigint, text string, lang string, status string, active_video string, summary string",
    )

    def load():
        calls = []

        def ask(text):
            calls.append(text)
            if text == "bad":
                raise RuntimeError(f"call {len(calls)}")
            return text.upper()

        return ask

    replies = chat.reply_rows(chat_plan.translated(turns.coalesce(1), udf_translator(load, attempts=2)), chat.reply_catalog(spark))
    got = [[r["bot"] for r in sorted(replies.collect(), key=lambda r: (r["turn"], r["pos"])) if r["turn"] == t and r["bot"]] for t in range(5)]
    assert got[0][0] == "GOOD"
    # the text was asked for twice in all, in one batch for both turns
    assert got[1][0] == got[2][0] == "La traduzione non è riuscita: call 3" and got[1][2] == "bad"
    assert got[3][0] == "bad" and got[4][0] == "La traduzione non è riuscita."
    with pytest.raises(ValueError):
        udf_translator(load, attempts=0)


def test_best_prompts_are_those_of_all_scores(spark):
    rng = random.Random(4)
    clips = spark.createDataFrame(
        [(v, c, [rng.randint(-2, 2) * 0.5 for _ in range(3)]) for v in range(4) for c in range(3)] + [(9, 0, None), (9, 1, [1.0, None, 2.0])],
        "video_id bigint, clip_no bigint, vector array<double>",
    )
    prompts = spark.createDataFrame([(i, f"p{i}", [rng.randint(-2, 2) * 0.5 for _ in range(3)]) for i in range(23)], "prompt_id bigint, prompt string, vector array<double>")
    best = {}
    for r in score_prompts(clips.filter("video_id < 9"), prompts, 2.0).collect():
        best.setdefault((r["video_id"], r["clip_no"]), []).append((-round(r["prob"], 9), r["prompt_id"]))
    expected = {(*clip, rank): (i, -p) for clip, found in best.items() for rank, (p, i) in enumerate(sorted(found)[:4], 1)}
    for size in (3, 100):
        got = best_prompts(clips, prompts, 4, 2.0, size).collect()
        assert {(r["video_id"], r["clip_no"], r["rank"]): (r["prompt_id"], round(r["prob"], 9)) for r in got} == expected
    assert len(best_prompts(clips.filter("video_id = 0"), prompts, 50, 2.0, 3).collect()) == 3 * 23
    with pytest.raises(ValueError):
        best_prompts(clips, prompts, 0)


def test_equal_texts_are_encoded_once(spark):
    rows = spark.createDataFrame([(i, f"text {i % 3}" if i else None) for i in range(20)], "prompt_id bigint, prompt string")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return texts.map(lambda t: [float(len(t)), float(t[-1])])

        return model

    got = {r["prompt_id"]: r["vector"] for r in encode_texts(rows, udf_encoder(load)).collect()}
    assert got == {i: [6.0, float(i % 3)] if i else None for i in range(20)} and calls.value == 3


def test_bounds_of_summaries(spark):
    words = " ".join(f"Word {k} is here and word {k % 7} is there too." for k in range(200))
    captions = spark.createDataFrame([(1, 0, words), (2, 0, "A few words only.")], "video_id bigint, clip_no bigint, caption string")
    few = Bounds(max_words=25, min_words=5, chunk_words=60, route_words=10)
    for plan in (hierarchical_summary, oneshot_summary, head_summary):
        found = {r["video_id"]: r["summary"] for r in plan(captions, "P", bounds=few).collect()}
        assert found[2] == "A few words only." and 5 <= len(found[1].split()) <= 25
        usual = {r["video_id"]: r["summary"] for r in plan(captions, "P").collect()}
        assert 30 <= len(usual[1].split()) <= 130


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def _vector_rows(n, seed, copies=()):
    rng = random.Random(seed)
    rows = [(i, f"p{i}", [rng.gauss(0, 1) for _ in range(7)]) for i in range(n)]
    for a, b in copies:
        rows[b] = (b, f"p{b}", rows[a][2])
    return rows


def test_best_of_many_prompts_are_products_of_matrices(spark):
    """Every pair as an expression over its components took minutes for 2,000 vectors."""
    known = _vector_rows(700, 3, [(i, i + 350) for i in range(0, 350, 2)])
    prompts = spark.createDataFrame(known, "prompt_id bigint, prompt string, vector array<double>").repartition(5)
    clips = prompts.select((F.col("prompt_id") % 50).alias("video_id"), F.col("prompt_id").alias("clip_no"), "vector")
    best = best_prompts(clips, prompts, 5, 2.0)
    assert "zip_with" not in _plan(best)
    got = {}
    for r in best.collect():
        got.setdefault(r["clip_no"], {})[r["rank"]] = r["prompt_id"], r["prob"]
    for clip, _, x in known:
        logits = []
        for i, _, y in known:
            z = 0.0
            for a, b in zip(x, y):
                z += a * b
            logits.append((-2.0 * z, i))
        total = sum(math.exp(-z) for z, _ in logits)
        want = [(i, math.exp(-z) / total) for z, i in sorted(logits)[:5]]
        assert [got[clip][n + 1][0] for n in range(5)] == [i for i, _ in want]
        assert [got[clip][n + 1][1] for n in range(5)] == pytest.approx([p for _, p in want])


def test_best_prompts_leave_out_what_has_no_logit(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "b", None), (2, "c", [0.0, 1.0]), (3, "d", [1.0]), (4, "e", [1.0, None]), (None, "f", [1.0, 1.0])]
    prompts = spark.createDataFrame(rows, "prompt_id bigint, prompt string, vector array<double>")
    clips = prompts.select(F.col("prompt_id").alias("video_id"), F.lit(0).alias("clip_no"), "vector")
    for size in (1, 2):
        found = best_prompts(clips, prompts.filter("vector[0] is not null and size(vector) = 2"), 9, 1.0, size)
        assert {r["video_id"] for r in found.collect()} <= {0, 2, None}
    assert best_prompts(clips.filter("vector is null"), prompts, 2).count() == 0
    assert best_prompts(clips, prompts.limit(0), 2).count() == 0


def test_scores_of_many_prompts_move_no_logits(spark):
    """Logits of every pair were shuffled to meet their sums."""
    known = _vector_rows(300, 5)
    prompts = spark.createDataFrame(known, "prompt_id bigint, prompt string, vector array<double>")
    clips = spark.createDataFrame(
        [(i, 0, v) for i, _, v in _vector_rows(20, 6)] + [(20, 0, None), (21, 0, [1.0]), (None, 0, [1.0] * 7)],
        "video_id bigint, clip_no bigint, vector array<double>",
    )
    blocks = score_prompts(clips, prompts, 3.0, max_inline=100)
    assert "zip_with" not in _plan(blocks)
    inline = score_prompts(clips.filter("video_id is not null"), prompts, 3.0, max_inline=300)
    got = {(r["video_id"], r["prompt_id"]): r["prob"] for r in blocks.collect()}
    assert got == {
        (r["video_id"], r["prompt_id"]): r["prob"] if r["prob"] is None else pytest.approx(r["prob"]) for r in inline.collect()
    }
    assert len(got) == 22 * 300 and got[20, 0] is None and got[21, 299] is None


def test_many_prompts_and_clips_are_shuffled_once(spark, monkeypatch):
    """Clips were copied for every block of prompts and prompts for every group of clips, on disk."""
    monkeypatch.setattr(scoring, "TILE_CLIPS", 8)
    monkeypatch.setattr(scoring, "LEAST_TASKS", 20, raising=False)
    prompts = spark.createDataFrame(_vector_rows(90, 12), "prompt_id bigint, prompt string, vector array<double>")
    clips = spark.createDataFrame([(i, 0, v) for i, _, v in _vector_rows(70, 13)], "video_id bigint, clip_no bigint, vector array<double>")
    asked = scoring.score_clips_in_blocks(clips, prompts, 2.0, 6)
    assert "explode" not in asked._jdf.queryExecution().analyzed().toString()
    got = {(r["video_id"], r["prompt_id"]): r["prob"] for r in asked.collect()}
    inline = score_prompts(clips, prompts, 2.0, max_inline=90).collect()
    assert got == {(r["video_id"], r["prompt_id"]): pytest.approx(r["prob"]) for r in inline} and len(got) == 70 * 90
    best = best_prompts(clips, prompts, 4, 2.0, 6)
    assert "explode(sequence" not in best._jdf.queryExecution().analyzed().toString()
    same(best.withColumn("prob", F.round("prob", 9)), best_prompts(clips, prompts, 4, 2.0, 200).withColumn("prob", F.round("prob", 9)))


def test_few_prompts_go_to_the_clips(spark):
    prompts = spark.createDataFrame(_vector_rows(200, 8), "prompt_id bigint, prompt string, vector array<double>")
    clips = spark.createDataFrame([(i, 0, v) for i, _, v in _vector_rows(90, 9)], "video_id bigint, clip_no bigint, vector array<double>")
    few, many = best_prompts(clips, prompts, 2, 4.0), best_prompts(clips, prompts, 2, 4.0, 50)
    assert "zip_with" not in _plan(few) and "Join" not in _plan(few) and "CoGroup" not in _plan(few)
    same(few.withColumn("prob", F.round("prob", 9)), many.withColumn("prob", F.round("prob", 9)))


def test_translations_are_not_held_by_the_batch(spark):
    """All texts and answers of an Arrow batch were held until the last one was answered."""
    texts = spark.range(3000).coalesce(1).select("id", F.concat(F.lit("x" * 3000), (F.col("id") % 2999).cast("string")).alias("text"))

    def load():
        import gc

        class Answer(str):
            pass

        calls = []

        def ask(text):
            calls.append(text)
            if text.endswith("x2500"):
                raise ValueError(f"{sum(isinstance(o, Answer) for o in gc.get_objects())} held, {calls.count(text)} asked")
            return Answer("IT:" + text)

        return ask

    said = texts.select("id", "text", udf_translator(load)("text").alias("said")).orderBy("id").collect()
    for r in said:
        if r["id"] != 2500:
            assert r["said"]["text"] == "IT:" + r["text"] and r["said"]["error"] is None
    held, _, asked = said[2500]["said"]["error"].partition(" held, ")
    assert int(held) <= 600 and asked == "3 asked"


def test_the_failing_translator_forgets_what_it_answered(spark, monkeypatch):
    from workload import queries

    kept = []
    monkeypatch.setattr(queries, "udf_translator", lambda load: kept.append(load) or (lambda _: F.lit(None).cast("string")))
    queries.translate_errors(spark, "/root/testdata/sf0.001")
    ask = kept[0]()
    for text in ("a", "abcd", "ab", "abc"):
        for _ in range(3):
            try:
                ask(text)
                break
            except ValueError:
                pass
    assert not [c.cell_contents for c in ask.__closure__ if c.cell_contents and "a" in c.cell_contents]


def test_sentences_are_ranked_in_bounded_slices(spark, monkeypatch):
    """An Arrow batch of texts was ranked in one go, with arrays of all its words."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [[" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    terms = pa.array([*texts, None, []], pa.list_(pa.string()))
    sizes = pa.array([[len(s.split()) for s in t] for t in texts] + [None, []], pa.list_(pa.int64()))
    whole = summary.chosen_sentences(30, 10).func(sizes, terms).to_pylist()
    longest, cut = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: longest.append(len(keys[0])) or cut(keys))
    monkeypatch.setattr(summary, "RANKED_BYTES", 2000)
    assert summary.chosen_sentences(30, 10).func(sizes, terms).to_pylist() == whole
    assert len(longest) > 5 and max(longest) < 200
    assert summary.chosen_sentences(30, 10).func(sizes.slice(0, 0), terms.slice(0, 0)).to_pylist() == []


def test_a_model_is_asked_for_a_chunk_once(spark):
    """Both branches of the second level asked it again for every chunk."""
    calls = spark.sparkContext.accumulator(0)

    def load():
        return lambda texts: calls.add(len(texts)) or texts.str.slice(0, 4)

    rows = [(v, c, "some words of a caption. " * 20) for v in range(6) for c in range(2)]
    captions = spark.createDataFrame(rows, "video_id bigint, clip_no bigint, caption string")
    done = hierarchical_summary(captions, "", model=udf_summarizer(load), bounds=Bounds(chunk_words=60, route_words=50))
    assert {r["summary"] for r in done.collect()} == {"some some some"}
    assert calls.value == 6 * 3


def test_clips_share_values_of_the_state(spark, tmp_path, monkeypatch):
    """Every clip was a group of its own, with several calls of the state store each."""
    from clipflow.streaming import clips as clip_stream, run

    monkeypatch.setattr(clip_stream, "BUCKETS", 4, raising=False)
    rows = [(v, i * 3, False) for v in [*range(200), None] for i in range(3)] + [(v, 12, True) for v in range(100)]
    layout = "video_id bigint, frame_idx bigint, eos boolean"
    spark.createDataFrame(rows, layout).repartition(2).write.parquet(f"{tmp_path}/in")
    found = assemble_clip_stream(spark.readStream.schema(layout).parquet(f"{tmp_path}/in"), 4, 3)
    with run._store(spark):
        query = (
            found.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert 0 < max(int(s["numRowsTotal"]) for p in query.recentProgress for s in p["stateOperators"]) <= 40


def test_sessions_of_a_bucket_are_worked_through_together(spark, tmp_path, monkeypatch):
    """Every session was a group of its own; with few turns at hand, what is not is written and read again."""
    from clipflow.streaming import sessions

    rng = random.Random(12)
    rows = [(c, t, rng.choice([None, "", f"/v{c}_{t}.mp4"])) for c in [*range(40), 2**60 + 1, None] for t in rng.sample(range(60), 20)]
    rng.shuffle(rows)
    layout = "conv_id bigint, turn bigint, active_set string"
    spark.createDataFrame(rows, layout).repartition(3).write.parquet(f"{tmp_path}/in")
    want = {}
    for c, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[c, t] = v if v is not None else next((want[c, b] for b in range(t - 1, -1, -1) if (c, b) in want), "")
    seen = []
    monkeypatch.setattr(sessions, "BUCKETS", 5, raising=False)
    monkeypatch.setattr(sessions, "NEAR_TURNS", 30, raising=False)
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    carried = active_video_stream(stream, page_turns=16)
    seen.append(carried._jdf.queryExecution().analyzed().toString())
    got = latest(run_to_table(carried), "conv_id", "turn").collect()
    assert {(r["conv_id"], r["turn"]): r["active_video"] for r in got} == want and len(got) == len(want)
    assert "AS bucket" in seen[0]


@pytest.mark.parametrize("together, rows, hot_rows", [(4, 3, 500_000), (64, 1, 500_000), (4, 3, 3)])
def test_turns_meet_clips_in_parts(spark, monkeypatch, setting, together, rows, hot_rows):
    """What is shuffled for a turn is a row per part of its video, not one per clip; each clip is seen once."""
    setting(HOT_ROWS, hot_rows)
    met, lookup = [], chat_plan.lookup

    def watched(facts, dim, key, hot, how="left", on=()):
        if on:
            met.append((facts.count(), hot))
        return lookup(facts, dim, key, hot, how, on)

    monkeypatch.setattr(chat_plan, "lookup", watched)
    monkeypatch.setattr(chat_plan, "MET_CLIPS", together)
    videos = spark.createDataFrame([(1, 40), (2, 3)], "video_id bigint, n_frames bigint")
    frames = spark.createDataFrame(
        [(v, i, float(i)) for v, n in ((1, 45), (2, 3)) for i in range(n)], "video_id bigint, frame_idx bigint, payload double"
    )
    asked = [(7, t, f"What {t}?", "/in.mp4", 1 + (t == 4)) for t in range(5)]
    turns = spark.createDataFrame(asked, "conv_id bigint, turn bigint, text string, active_video string, _video bigint")

    def say(payload, prompt):
        return F.concat(prompt, F.array_max(payload).cast("int").cast("string"))

    found = {r.turn: r.summary for r in chat_plan.summarize_asked(turns, videos, frames, say, length=2, stride=2).collect()}
    whole = " ".join(str(4 * i + 2) for i in range(10))
    assert found == {0: whole, 1: whole, 2: whole, 3: whole, 4: "2"}
    (n_met, hot), = met
    assert n_met == 4 * rows + 1
    assert hot == ({} if hot_rows > 100 else {1: 4 * together, 2: together})


def test_short_captions_are_not_counted_and_long_ones_are_cut(spark):
    texts = ["", "a b", "a b c", "ab  cd", " a\tb ", "é è ê", None]
    gathered = spark.createDataFrame(
        [(1, i, [float(i)], 1, t) for i, t in enumerate(texts)],
        "video_id bigint, clip_no bigint, payload array<double>, n_fetched bigint, said string",
    )
    for echo in (True, False):
        hook = lambda payload, prompt: F.concat(prompt, F.col("said")) if echo else F.col("said")
        said = caption_clips(gathered, "P: ", 1, hook, max_length=2).orderBy("clip_no").collect()
        want = ["", "a b", "a b", "ab  cd", " a\tb ", "é è", None]
        assert [r.caption for r in said] == [w if w is None else "P: " * echo + w for w in want]


@pytest.mark.parametrize("spread", [0, 1 << 30])
def test_words_are_counted_alike_in_places_and_sorted(spark, monkeypatch, spread):
    rng = random.Random(11)
    pick = lambda: rng.choice(["cat", "Dog", "ox", "ΑΣ", "-", "x1", "İl"]) + rng.choice([" ", "  ", "\t", " ", "\n", ". ", "! "])
    rows = [(k, "".join(pick() for _ in range(rng.randint(0, 60)))) for k in range(30)]
    texts = spark.createDataFrame(rows, "k bigint, t string").repartition(2)
    pieces = texts.select("k", F.lit(0).alias("i"), "t")
    want = summary.summarize_pieces(pieces, "k", "i", "t", {}, 12, 4)
    monkeypatch.setattr(summary, "COUNTED_SPREAD", spread)
    same(summary.summarize_rows(texts, ["k"], "t", 12, 4), want)
