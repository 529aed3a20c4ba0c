"""Hand-worked values and brute-force comparisons of column functions."""

from itertools import islice, cycle

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clipflow.functions import clips as fc, media, paths, text as ft, timecode as tc
from clipflow.functions.models import lookup_translator, statistics_captioner
from clipflow.functions.vectors import softmax
from clipflow.operators.clips import plan_clips


def brute_clips(length, stride, n):
    samples = list(range(0, n, stride))
    full = [samples[i:i + length] for i in range(0, len(samples) - length + 1, length)]
    if full or not samples:
        return full
    return [list(islice(cycle(samples), length))]


def test_clips_match_brute_force(spark):
    sizes = [*range(0, 60), 99, 100, 300]
    videos = spark.createDataFrame([(n, n) for n in sizes], "video_id bigint, n_frames bigint")
    for length, stride in [(1, 1), (4, 1), (4, 5), (10, 3), (8, 8), (7, 2)]:
        rows = plan_clips(videos, length, stride).orderBy("video_id", "clip_no").collect()
        mine = {}
        for r in rows:
            mine.setdefault(r.video_id, []).append(r.frame_idx)
        assert mine == {n: brute_clips(length, stride, n) for n in sizes if n}


def test_long_video_is_planned_in_blocks(spark):
    videos = spark.createDataFrame([(1, 200_003)], "video_id bigint, n_frames bigint")
    plan = plan_clips(videos, 1, 1)
    assert plan.count() == 200_003
    assert plan.agg(F.countDistinct("clip_no"), F.max("clip_no")).first()[:] == (200_003, 200_002)


def test_padded_clip_ends_at_its_last_element(spark):
    videos = spark.createDataFrame([(1, 12)], "video_id bigint, n_frames bigint")
    clip = plan_clips(videos, 10, 3).select(fc.span_start("frame_idx"), fc.span_end("frame_idx"), "frame_idx").first()
    assert clip[:] == (0, 3, [0, 3, 6, 9, 0, 3, 6, 9, 0, 3])


@pytest.mark.parametrize("length,stride", [(0, 1), (1, 0)])
def test_impossible_plans_are_refused(spark, length, stride):
    with pytest.raises(ValueError):
        plan_clips(spark.createDataFrame([(1, 1)], "video_id bigint, n_frames bigint"), length, stride)


def test_timecodes(spark):
    cases = [
        (0, 30.0, "00:00:00,000"), (27, 30.0, "00:00:00,900"), (33, 30.0, "00:00:01,100"),
        (69, 30.0, "00:00:02,299"), (29, 29.97, "00:00:00,967"), (107892, 29.97, "01:00:00,000"),
        (32400000, 30.0, "300:00:00,000"), (1, 0.0, None),
    ]
    rows = spark.createDataFrame(cases, "frame bigint, fps double, want string")
    for got, want in rows.select(tc.timecode("frame", "fps"), "want").collect():
        assert got == want


@pytest.mark.parametrize(
    "n,sizes",
    [(0, []), (1, [1]), (512, [512]), (513, [513]), (641, [641]), (642, [512, 130]), (1024, [512, 512]),
     (1153, [512, 641]), (1154, [512, 512, 130])],
)
def test_chunk_sizes(spark, n, sizes):
    text = " ".join(f"w{i}" for i in range(n))
    got = spark.range(1).select(ft.chunks(F.lit(text), 512, 130)).first()[0]
    assert [len(c.split()) for c in got] == sizes
    assert " ".join(got).split() == text.split()


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!\n\t\x0b\x1c\x85\xa0 　​")), max_size=40))
def test_words_split_like_python(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(ft.words("t")).first()[0] == text.split()


def test_plain_spaces_touch_only_whitespace(spark):
    text = "a\tb　c d\x1ee f"
    assert spark.createDataFrame([(text,)], "t string").select(ft.plain_spaces("t")).first()[0] == "a b c d e f"


def test_prompt_strip(spark):
    rows = spark.createDataFrame([("abcabc", ), (None,)], "c string")
    assert [r[0] for r in rows.select(ft.strip_prompt("c", "bc")).collect()] == ["aa", ""]
    assert [r[0] for r in rows.select(ft.strip_prompt("c", "")).collect()] == ["abcabc", ""]


def test_prompt_rendering(spark):
    prompt = ft.chat_prompt(F.lit("What is it?"))
    rendered, echoed = spark.range(1).select(ft.render_prompt(prompt), ft.echoed_prompt(prompt)).first()
    assert rendered == "USER: <video>\nWhat is it? ASSISTANT: "
    assert echoed == "USER: \nWhat is it? ASSISTANT: "


def test_paths(spark):
    names = ["a.mp4.mp4b.mp4", "/x/.mp4", "/x/y.tar.avi", "/x.y/z", "v.MP4", "..mp4"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = rows.select(paths.stem("p"), paths.extension("p"), paths.mp4_target("p"), paths.cut_target("p")).collect()
    assert got[0][0] == "ab"
    import os.path

    for name, row in zip(names, got):
        root, ext = os.path.splitext(name)
        assert row[1] == ext
        assert row[2] == (name if ext == ".mp4" else root + ".mp4")
        assert row[3] == root + "_cut.mp4"


def test_upload_verdicts(spark):
    cases = [("v", 1.99, "too_short"), ("v", 2.0, "ok"), ("v", 10.99, "ok"), ("v", 11.0, "too_long"), ("", 5.0, "convert_error")]
    rows = spark.createDataFrame(cases, "p string, d double, want string")
    assert all(r[0] == r[1] for r in rows.select(media.upload_status("p", "d"), "want").collect())


def test_bytes_wrap(spark):
    assert spark.range(1).select(media.to_bytes(F.array(*map(F.lit, [0, 255, 256, 300, -1])))).first()[0] == [0, 255, 0, 44, 255]


def test_softmax(spark):
    for logits, want in [([2.0, 1.0], 0.7310585786300049), ([1000.0, 999.0], 0.7310585786300049), ([5.0], 1.0)]:
        got = spark.range(1).select(softmax(F.array(*map(F.lit, logits)))).first()[0]
        assert got[0] == pytest.approx(want, abs=1e-12) and sum(got) == pytest.approx(1.0)


def test_default_captioner(spark):
    rows = spark.createDataFrame([([1.0, 2.5, 4.0],)], "payload array<double>")
    got = rows.select(statistics_captioner()(F.col("payload"), F.lit("P: "))).first()[0]
    assert got == "P: n=3 min=1.000 max=4.000 mean=2.500"


def test_lookup_translator(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r[0] for r in rows.select(lookup_translator({"a": "x"})(F.col("t"))).collect()] == ["x", None]
