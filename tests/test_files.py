"""What is written reads back."""

import pickle
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipflow import session
from clipflow.plans.captioning import caption_videos
from clipflow.sources import documents, files
from clipflow.sources.documents import list_named, write_named

CAPTIONS = ['two\nlines and "quotes"', "", "NA", None, 'back\\slash "q\\" end', "  spaces around  ", "a,b;c"]


def test_caption_csv(spark, tmp_path):
    rows = [(7, i * 30, i * 30 + 27, c) for i, c in enumerate(CAPTIONS)]
    captions = spark.createDataFrame(rows, "video_id bigint, start_frame bigint, end_frame bigint, caption string")
    files.write_captions(files.with_coordinates(captions, "exp", "folder", F.lit("v.mp4.mp4")), str(tmp_path / "csv"))
    got = files.read_captions(spark, str(tmp_path / "csv")).orderBy("start_frame").collect()
    assert [r.caption or "" for r in got] == [c or "" for c in CAPTIONS]
    assert {(r.experiment, r.video_folder, r.video_id, r.stem) for r in got} == {("exp", "folder", 7, "v")}
    text = next((tmp_path / "csv" / "experiment=exp" / "video_folder=folder").glob("part-*")).read_text()
    assert text.startswith("VideoId,Stem,Start,End,Caption\n")


def test_score_and_summary_csv(spark, tmp_path):
    scores = spark.createDataFrame([(1, "p, one", 0.25), (1, "two", 0.75)], "video_id bigint, prompt string, prob double")
    files.write_scores(files.with_coordinates(scores, "e", "f", F.lit("v.mp4")), str(tmp_path / "scores"))
    assert {(r.prompt, r.prob) for r in files.read_scores(spark, str(tmp_path / "scores")).collect()} == {("p, one", 0.25), ("two", 0.75)}
    done = spark.createDataFrame([(1, 'so "it\ngoes"')], "video_id bigint, summary string")
    files.write_summaries(files.with_coordinates(done, "e", "f", F.lit("v.mp4")), str(tmp_path / "sum"))
    assert files.read_summaries(spark, str(tmp_path / "sum")).first().summary == 'so "it\ngoes"'


def test_subtitle_files(spark, tmp_path):
    cues = [(v, n, f"{n}\n00:00:00,000 --> 00:00:01,000\ntext {v}\n\n") for v in range(40) for n in range(1, 4)]
    rows = spark.createDataFrame(cues, "video_id bigint, cue_no bigint, block string")
    files.write_subtitles(files.with_coordinates(rows, "e", "f", F.lit("v.mp4")), str(tmp_path / "srt"))
    assert len([p for p in (tmp_path / "srt").rglob("*") if p.is_dir()]) == 2  # whatever the number of videos
    got = files.read_subtitles(spark, str(tmp_path / "srt")).orderBy("video_id", "cue_no").collect()
    assert [(r.video_id, r.cue_no, r.block) for r in got] == cues and {r.stem for r in got} == {"v"}


def test_videos_of_one_stem_stay_apart(spark, tmp_path):
    from clipflow.plans.captioning import export_captions

    captions = spark.createDataFrame([(1, 0, 0, 27, "one"), (2, 0, 0, 27, "two"), (9, 0, 0, 27, "lost")], "video_id bigint, clip_no bigint, start_frame bigint, end_frame bigint, caption string")
    videos = spark.createDataFrame([(1, "/x/a.mp4", 30.0), (2, "/y/a.mp4", 30.0)], "video_id bigint, path string, fps double")
    got = export_captions(captions, videos, "", str(tmp_path / "out"), "e", "f").collect()
    assert sorted((r.video_id, r.stem, r.cue_no) for r in got if r.stem) == [(1, "a", 1), (2, "a", 1)]
    assert [r.video_id for r in got if r.stem is None] == [9]


def test_media_listing(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    got = files.list_media(spark, str(tmp_path)).collect()
    assert [(r.length, r.stem) for r in got] == [(3, "a")]


def test_frame_table(spark, tmp_path):
    frames = spark.createDataFrame([(v, i, float(i)) for v in (2, 1) for i in range(50)], "video_id bigint, frame_idx bigint, payload double")
    files.write_frames(frames, str(tmp_path / "frames"))
    got = files.read_frames(spark, str(tmp_path / "frames"))
    assert got.count() == 100
    plan = got.filter("video_id = 1 and frame_idx < 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(video_id), IsNotNull(frame_idx), EqualTo(video_id,1), LessThan(frame_idx,5)]" in plan


def test_prompt_table(spark):
    assert [tuple(r) for r in files.prompt_table(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]


def test_stored_captions_are_reused(spark):
    videos = spark.createDataFrame([(1, 4), (2, 4)], "video_id bigint, n_frames bigint")
    frames = spark.createDataFrame([(v, i, float(i)) for v in (1, 2) for i in range(4)], "video_id bigint, frame_idx bigint, payload double")
    stored = spark.createDataFrame([(1, 0, 0, 3, "kept")], "video_id bigint, clip_no bigint, start_frame bigint, end_frame bigint, caption string")
    got = {r.video_id: r.caption for r in caption_videos(videos, frames, "P ", 4, 1, stored=stored).collect()}
    assert got[1] == "kept" and got[2].startswith("P n=4")


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_named_files_are_whole_and_in_order(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"a/{k % 3}.txt", k, f"line {k} ü\n") for k in range(300)] + [("b/empty.txt", 0, ""), ("b/none.txt", 0, None)],
        "name string, at int, text string",
    ).repartition(7)
    root = str(tmp_path / "out")
    write = lambda mode="append": write_named(rows, root, F.col("name"), F.col("text"), ["at"], mode)
    write()
    there = lambda: {str(p.relative_to(root)): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix == ".txt"}
    found = there()
    listed = {r["file"]: bytes(r["content"]).decode() for r in list_named(spark, root).collect()}
    assert listed == {name: text for name, text in found.items() if text}
    assert found == {f"a/{m}.txt": "".join(f"line {k} ü\n" for k in range(m, 300, 3)) for m in range(3)} | {"b/empty.txt": "", "b/none.txt": ""}
    with pytest.raises(Exception, match="already"):
        write()
    (tmp_path / "out" / "a" / "0.txt").write_text("old")
    write("overwrite")
    assert there() == found
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"a", "b"}


def test_failed_tasks_leave_no_files(spark, tmp_path):
    root = tmp_path / "out"
    broken = F.when(F.col("id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="lost"):
        write_named(spark.range(50), str(root), F.concat(F.lit("f"), (F.col("id") % 5).cast("string")), broken, ["id"])
    assert not root.exists() or [p.name for p in root.rglob("*")] == []


def test_messages_and_commit_do_not_hold_the_names(tmp_path, monkeypatch):
    """The driver had the names of all files, and those of their staged ones."""
    monkeypatch.setattr(documents, "COMPARED_NAMES", 7, raising=False)
    part = lambda names: pa.record_batch([pa.array(names, pa.string()), pa.array([n.encode() for n in names], pa.binary())], ["file", "part"])
    sizes = []
    for n in (10, 1000):
        writer = documents._Writer(str(tmp_path / f"out{n}"), False)
        tasks = [writer.write(iter([part([f"a/{k}/{i} \n.txt" for i in range(n // 2)])])) for k in range(2)] + [writer.write(iter([]))]
        sizes.append(len(pickle.dumps(tasks)))
        writer.commit([*tasks, None])
        found = {str(p.relative_to(writer.root)): p.read_text() for p in (tmp_path / f"out{n}").rglob("*") if p.is_file()}
        assert found == {name: name for name in (f"a/{k}/{i} \n.txt" for k in range(2) for i in range(n // 2))}
    assert sizes[1] < 2 * sizes[0]
    writer = documents._Writer(str(tmp_path / "twice"), False)
    tasks = [writer.write(iter([part([f"{k + i}.txt" for i in range(20)])])) for k in range(2)]
    with pytest.raises(ValueError, match="19 files were written by two tasks"):
        writer.commit(tasks)
    assert list((tmp_path / "twice").iterdir()) == []


def test_listing_takes_few_tasks_and_no_driver(spark, tmp_path, monkeypatch):
    """Spark's file reader kept every file in the driver and dealt four of them to a task."""
    monkeypatch.setattr(documents, "READ_BYTES", 40, raising=False)
    monkeypatch.setattr(documents, "LISTED_NAMES", 16, raising=False)
    want = {}
    for k in range(300):
        name = f"{k % 2}/x={k % 5}/file {k} ü%20.{'txt' if k % 3 else 'csv'}"
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(want.setdefault(name, b"\x00\xff" * (k % 31)))
    for name in ("0/.hidden.txt", "0/_hidden.txt", "0/x._COPYING_", ".staged/file.txt", "_tmp/file.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("hidden")
    want = {name: content for name, content in want.items() if content}
    listed = list_named(spark, f"file:{tmp_path}/")
    assert listed.rdd.getNumPartitions() <= 8
    assert {r["file"]: (r["length"], bytes(r["content"])) for r in listed.collect()} == {n: (len(c), c) for n, c in want.items()}
    assert "content" not in listed.select("file", "length")._jdf.queryExecution().optimizedPlan().toString()
    some = list_named(spark, str(tmp_path), "file 1?*{0.csv,txt}").collect()
    assert sorted(r["file"] for r in some) == sorted(n for n in want if re.fullmatch(r"file 1..*(0\.csv|txt)", n.rpartition("/")[2]))
    (tmp_path / "none").mkdir()
    assert list_named(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        list_named(spark, str(tmp_path / "lost")).count()
