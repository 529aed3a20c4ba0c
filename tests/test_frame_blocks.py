"""Frames stored in blocks, and catalogs that come as a stream."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from clipflow.operators import frames as of
from clipflow.operators.clips import plan_clips
from clipflow.plans.captioning import caption_videos
from clipflow.sources import files
from clipflow.streaming.catalog import caption_catalog

CATALOG = "video_id bigint, n_frames bigint"


@pytest.fixture
def stored(spark, tmp_path):
    """Write frames in blocks and read them as a table."""

    def write(frames, buckets=4):
        table = f"frames_{uuid.uuid4().hex}"
        files.write_frame_blocks(frames, table, buckets, str(tmp_path / table))
        return spark.table(table)

    return write


def numbered(spark, sizes):
    """``video_id, frame_idx, payload`` of videos by their number of frames."""
    catalog = spark.createDataFrame(list(sizes.items()), CATALOG)
    return catalog.filter("n_frames > 0").select(
        "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame_idx")
    ).withColumn("payload", F.col("video_id") * 100_000.0 + F.col("frame_idx"))


def same(a, b):
    assert sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))


def above_scan(plan, column):
    """Operators above the file scan that reads ``column``, in a printed plan."""
    lines = [line for line in plan.splitlines() if re.search("[A-Za-z]", line)]
    depth = [re.search("[A-Za-z(*]", line).start() for line in lines]
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and column in line)
    found, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < level:
            found.append(lines[i])
            level = depth[i]
    return found


@pytest.mark.parametrize("length,stride", [(10, 3), (8, 8), (5, 3), (7, 3)])
def test_blocks_give_the_planned_clips(spark, stored, length, stride):
    frames = numbered(spark, {1: 30_000, 2: 14_400, 3: 14_401, 4: 20, 5: 4, 6: 60, 7: 60})
    frames = frames.filter("video_id <> 7 or frame_idx % 5 <> 0")
    videos = spark.createDataFrame([(1, 30_000), (2, 14_400), (3, 14_401), (4, 20), (5, 4), (7, 60), (8, 50), (9, 0), (10, None)], CATALOG)
    expected = of.gather_frames(plan_clips(videos, length, stride), frames)
    same(of.assemble_blocks(videos, stored(frames), length, stride), expected)
    same(of.assemble_blocks(videos.union(videos), stored(frames), length, stride), expected)


def test_no_clips_without_videos_or_frames(spark, stored):
    frames = stored(numbered(spark, {1: 40}))
    for rows in ([], [(None, 4)], [(2, 40)], [(1, 0)]):
        assert of.assemble_blocks(spark.createDataFrame(rows, CATALOG), frames).count() == 0
    assert of.assemble_blocks(spark.createDataFrame([(1, 40)], CATALOG), frames.limit(0)).count() == 0


def test_stored_frames_are_neither_shuffled_nor_all_read(spark, stored, setting):
    setting(("spark.sql.adaptive.enabled", 0), "false")
    setting(("spark.sql.autoBroadcastJoinThreshold", 0), "-1")
    written = spark._jsc.hadoopConfiguration()
    written.set("parquet.page.row.count.limit", "200")
    try:
        sizes = {v: 300 for v in range(80)}
        frames = stored(numbered(spark, sizes))
    finally:
        written.unset("parquet.page.row.count.limit")
    videos = spark.createDataFrame(list(sizes.items()), CATALOG)
    known = caption_videos(videos, frames, "P ", 10, 3).filter("video_id < 60")
    known = spark.createDataFrame(known.collect(), known.schema)
    again = caption_videos(videos, frames, "P ", 10, 3, stored=known)
    same(again, caption_videos(videos, frames.drop(of.BLOCK), "P ", 10, 3))

    todo = videos.filter("video_id >= 60")
    clips = of.assemble_blocks(todo, frames, 10, 3)
    plan = clips._jdf.queryExecution().executedPlan()
    above = above_scan(plan.toString(), "frame_idx")
    assert any("collect_list" in line for line in above) and not [line for line in above if "Exchange" in line]
    assert "Bucketed: true" in plan.toString()
    assert len(clips.collect()) == 20 * 10
    scans = plan.collectLeaves()
    read = max(
        scans.apply(i).metrics().apply("numOutputRows").value()
        for i in range(scans.size()) if scans.apply(i).nodeName().startswith("Scan parquet")
    )
    assert 20 * 300 <= read < 40 * 300


def test_head_of_video_tells_the_scan(spark, stored):
    frames = stored(numbered(spark, {1: 400, 2: 400, 3: 400}))
    videos = spark.createDataFrame([(1, 24.0), (2, 29.97), (3, None)], "video_id bigint, fps double")
    head = of.head_of_video(videos, frames)
    assert {r[0]: r[1] for r in head.groupBy("video_id").count().collect()} == {1: 240, 2: 300}
    assert "LessThanOrEqual(frame_idx,300)" in head._jdf.queryExecution().executedPlan().toString()
    odd = videos.union(spark.createDataFrame([(3, float("nan"))], videos.schema))
    assert of.head_of_video(odd, frames).filter("video_id < 3").count() == 540


def test_catalog_stream_equals_batch_after_a_crash(spark, stored, tmp_path):
    sizes = {v: 20 + v for v in range(12)}
    frames = numbered(spark, sizes)
    videos = spark.createDataFrame(list(sizes.items()), CATALOG).withColumn("path", F.lit("a.mp4"))
    folder, target = str(tmp_path / "catalog"), str(tmp_path / "out")
    blocks, calls = stored(frames), []

    def captioner(payload, prompt):
        calls.append(1)
        said = F.concat(prompt, F.size(payload).cast("string"), F.lit(" "), F.array_max(payload).cast("string"))
        return F.raise_error(F.lit("lost")).cast("string") if len(calls) == 2 else said

    def run(part):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(folder)
        stream = files.stream_parquet(spark, folder, videos.schema)
        return caption_catalog(stream, blocks, "P ", 5, 3, captioner, path=target)

    first = run(videos.filter("video_id < 4"))
    assert first.select("video_id").distinct().count() == 4
    with pytest.raises(Exception):
        run(videos.filter("video_id between 3 and 7"))  # 3 is named again
    repeated = run(None)
    assert repeated.select("video_id").distinct().count() == 8
    shrunk = videos.filter("video_id >= 8").withColumn("n_frames", F.lit(5).cast("bigint"))
    done = run(videos.filter("video_id >= 8").union(shrunk))
    same(done, caption_videos(videos, frames, "P ", 5, 3, captioner))
    same(run(None), done)
