"""Clips assembled while frames arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import clips as fc
from ..functions.arith import int_div

CLIPS = "video_id bigint, clip_no bigint, frame_idx array<bigint>"
#: Buckets clips are dealt to; a bucket's state is read and written as one value.
BUCKETS = 1024

_HELD = pa.schema(
    [("video_id", pa.string()), ("clip_no", pa.int64()), ("samples", pa.list_(pa.int64())), ("h", pa.int64()),
     ("done", pa.bool_()), ("due", pa.int64()), ("news", pa.int64())]
)


def assemble_clip_stream(
    frames: DataFrame, length: int = 10, stride: int = 3, grace_ms: int = 600_000, keep_ms: int = 86_400_000
) -> DataFrame:
    """Emit a clip as soon as its last sample is in; order of arrival is free.

    ``frames`` has ``video_id, frame_idx, eos``. An end-of-video row sets ``eos`` and holds the number of frames in
    ``frame_idx``; it reaches every clip of the video. A clip that still lacks frames ``grace_ms`` after that is emitted
    with those it has, once; a trailing clip that no plan holds is dropped. Frames and ends may be lost, repeated and
    delivered again. State is kept per clip, not per video, so a busy video spreads over all tasks; the clips of a
    bucket, by hash, go to the state store together, as a call of it costs more than a clip. Of a clip nothing counts
    ``keep_ms`` after its last news, and its bucket drops it with the next ones. Clips none of whose frames arrive
    are never emitted.
    """
    fc.check_plan(length, stride)
    sample = int_div("frame_idx", stride)
    none = F.lit(None).cast("bigint")
    samples = frames.filter(~F.col("eos") & fc.on_stride("frame_idx", stride)).select(
        "video_id", int_div(sample, length).alias("clip_no"), "frame_idx", none.alias("h")
    )
    h = fc.sample_count("frame_idx", stride)
    ends = frames.filter(F.col("eos") & (h > 0)).select(
        "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), int_div(h - 1, length))).alias("clip_no"),
        none.alias("frame_idx"), h.alias("h"),
    )

    class Clips(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "clips binary", keep_ms)

        def _load(self, now: int) -> dict[tuple, list]:
            """Of every clip of the bucket: samples, h, whether it is done, when it is closed, and its last news."""
            known = self.held.get()
            if not known:
                return {}
            columns = pa.ipc.open_stream(known[0]).read_all().to_pydict().values()
            return {(v, c): rest for v, c, *rest in zip(*columns) if rest[-1] + keep_ms > now}

        def _store(self, clips: dict[tuple, list]) -> None:
            columns = list(zip(*((*key, *clip) for key, clip in clips.items()))) or [()] * len(_HELD)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _HELD) as writer:
                writer.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, _HELD)], schema=_HELD))
            self.held.update((sink.getvalue().to_pybytes(),))

        def _clip(self, clip_no: int, seen: list, h: int | None) -> list:
            """What is there of the clip's plan; a clip without an end among its news is a full one."""
            if h is not None and h < length:
                plan = [i % h * stride for i in range(length)]
            else:
                plan = [(clip_no * length + i) * stride for i in range(length)]
            present = set(seen)
            return [i for i in plan if i in present]

        def _rows(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
            some = [(v, c, i) for v, c, i in found if i]
            if some:
                rows = pd.DataFrame(some, columns=["video_id", "clip_no", "frame_idx"])
                rows["video_id"] = pd.array([None if v is None else int(v) for v in rows["video_id"]], "Int64")
                yield rows

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentProcessingTimeInMs()
            news: dict[tuple, tuple] = {}
            for batch in rows:
                for video, clip_no, frame, end in zip(*(batch[c] for c in ("video_id", "clip_no", "frame_idx", "h"))):
                    video = video if isinstance(video, str) else None
                    frames_in, ends_in = news.setdefault((video, int(clip_no)), (set(), []))
                    if pd.notna(frame):
                        frames_in.add(int(frame))
                    if pd.notna(end):
                        ends_in.append(int(end))
            held, found, waiting = self._load(now), [], False
            for (video, clip_no), (frames_in, ends_in) in news.items():
                kept, h, done, due, _ = held.get((video, clip_no), ([], None, False, None, now))
                if done:
                    continue
                ended = h is not None
                seen = frames_in.union(kept)
                h = max(ends_in) if ends_in else h
                extra = h is not None and clip_no >= max(1, h // length)
                wanted = length if h is None or h >= length else h
                if extra or len(seen) >= wanted:
                    held[video, clip_no] = [[], h, True, None, now]
                    if not extra:
                        found.append((video, clip_no, self._clip(clip_no, sorted(seen), h)))
                    continue
                if h is not None and not ended:
                    due, waiting = now + grace_ms, True
                held[video, clip_no] = [sorted(seen), h, False, due, now]
            self._store(held)
            if waiting:
                self.handle.registerTimer(now + grace_ms)
            yield from self._rows(found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, until = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
            held, found = self._load(now), []
            for (video, clip_no), (kept, h, done, due, _) in held.items():
                if not done and due is not None and due <= until:
                    held[video, clip_no] = [[], h, True, None, now]
                    found.append((video, clip_no, self._clip(clip_no, kept, h)))
            if found:
                self._store(held)
            yield from self._rows(found)

        def close(self) -> None:
            pass

    arrived = samples.unionByName(ends).select(
        F.pmod(F.xxhash64("video_id", "clip_no"), F.lit(BUCKETS)).alias("bucket"),
        F.col("video_id").cast("bigint").cast("string").alias("video_id"), "clip_no", "frame_idx", "h",
    )
    return arrived.groupBy("bucket").transformWithStateInPandas(Clips(), CLIPS, "append", "ProcessingTime")
