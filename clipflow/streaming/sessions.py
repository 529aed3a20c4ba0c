"""The active video of chat sessions while messages arrive, and answers to them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.models import MAX_CAPTION_WORDS, Captioner, Translator
from ..operators.chat import gate_uploads, reply_catalog, reply_rows
from ..plans.chat import summarize_asked, translated
from ..session import scratch_path
from .run import latest, run_batches

#: Turns whose numbers fall into one page of a session's state, which is read and written as a whole.
PAGE_TURNS = 4096
#: Buckets that sessions are dealt to; turns that a bucket's sessions have at hand before they are written.
BUCKETS, NEAR_TURNS = 1024, 100_000
#: The session of messages without an id; those of others begin with another letter.
NO_SESSION = "none"


def active_video_stream(
    gated: DataFrame, context: str | None = None, expire_ms: int | None = None, page_turns: int = PAGE_TURNS
) -> DataFrame:
    """Carry the active video of each session from message to message, in the order of turns whatever arrives first.

    ``conv_id`` and ``turn`` name a message. With ``context``, that text column of the turn that set the video goes along.
    A message's row has a ``revision``; where a late one changes what holds for those behind it, these come
    again with a higher one, so ``latest`` of a table of all rows is what the batch has. A message that
    is delivered again replaces itself.

    A session's turns are kept in pages by turn number; a micro-batch reads and writes the pages it brings turns for
    and those whose first video changes, a bounded number at a time. Sessions are dealt to buckets by hash, and those of
    a bucket are worked through together. A session without news for ``expire_ms`` is forgotten.
    """
    rows = gated if context else gated.withColumn("_context", F.lit(None).cast("string"))
    known = context or "_context"
    kept = T.StructType([f for f in rows.schema.fields if f.name != "active_set"])
    text = T.StringType()
    out = T.StructType([*kept.fields, T.StructField("active_video", text), T.StructField("revision", T.LongType())])
    own = [T.StructField("active_set", text), T.StructField("_told_video", text), T.StructField("_told_text", text)]
    told_layout, arriving, given = to_arrow_schema(out), to_arrow_schema(rows.schema), rows.columns
    names = [f.name for f in [*kept.fields, *own]]
    conv_at, turn_at, text_at = names.index("conv_id"), names.index("turn"), names.index(known)
    set_at, video_at, told_at = len(names) - 3, len(names) - 2, len(names) - 1

    class Sessions(StatefulProcessor):
        """The sessions of a bucket; a page is rows by turn, as lists in the order of ``names``, and pickled in the state.

        Most pages are a few rows, for which an Arrow stream costs fifty times as much.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.pages = handle.getMapState("pages", "session string, page bigint", "rows binary", expire_ms)
            self.known = handle.getMapState("known", "session string", "pages array<bigint>, revision bigint", expire_ms)
            self.near: dict[tuple, dict[int, list]] = {}
            self.news: set[tuple] = set()
            self.n_near = 0

        def _load(self, session: str, page: int) -> dict[int, list]:
            if (session, page) not in self.near:
                held = self.pages.getValue((session, page))
                self._keep(session, page, {row[turn_at]: row for row in pickle.loads(held[0])} if held else {})
            return self.near[session, page]

        def _keep(self, session: str, page: int, turns: dict[int, list]) -> None:
            if self.n_near >= NEAR_TURNS:
                self._flush()
            self.near[session, page] = turns
            self.n_near += len(turns) + 1

        def _flush(self) -> None:
            for at in self.news:
                self.pages.updateValue(at, (pickle.dumps([turn for _, turn in sorted(self.near[at].items())]),))
            self.near, self.news, self.n_near = {}, set(), 0

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            known_of: dict[str, tuple] = {}
            touched: dict[str, set] = {}
            for batch in rows:
                # by place: names that begin with an underscore come changed; nothing has been told of these rows yet
                arrived = pa.Table.from_pandas(
                    batch.iloc[:, :len(given)].set_axis(given, axis=1), schema=arriving, preserve_index=False
                )
                columns = [arrived.column(c).to_pylist() for c in names[:-2]]
                by_page: dict[tuple, list] = {}
                for session, *row in zip(batch.iloc[:, len(given)], *columns):
                    if session == NO_SESSION:
                        row[conv_at] = None
                    by_page.setdefault((session, row[turn_at] // page_turns), []).append([*row, None, None])
                for (session, page), some in by_page.items():
                    if session not in known_of:
                        held = self.known.getValue((session,))
                        known_of[session] = (list(held[0]), held[1] + 1) if held else ([], 0)
                        touched[session] = set()
                    if page not in touched[session] and page not in known_of[session][0]:
                        self._keep(session, page, {})
                    touched[session].add(page)
                    self._load(session, page).update((turn[turn_at], turn) for turn in some)
                    self.n_near += len(some)
                    self.news.add((session, page))

            told: list[list] = []
            for session, of_session in touched.items():
                pages = sorted(of_session.union(known_of[session][0]))
                revision = known_of[session][1]
                self.known.updateValue((session,), (pages, revision))
                end, behind = None, False  # what holds after the page before, if known; whether that may have changed
                for at, page in enumerate(pages):
                    if page not in of_session and not behind:
                        end = None
                        continue
                    if end is None:
                        end = ("", None)
                        if at and (before := self._load(session, pages[at - 1])):
                            last = before[max(before)]
                            end = (last[video_at], last[told_at])
                    behind, changed = page in of_session, False
                    for _, turn in sorted(self._load(session, page).items()):
                        if turn[set_at] is not None:
                            end = (turn[set_at], turn[text_at])
                        changed = (turn[video_at], turn[told_at]) != end
                        if changed:
                            turn[video_at], turn[told_at] = end
                            self.news.add((session, page))
                            row = turn[:set_at] + [end[0], revision]
                            row[text_at] = end[1]
                            told.append(row)
                    behind = behind or changed
                    if len(told) >= NEAR_TURNS:
                        yield self._told(told)
                        told = []
            self._flush()
            if told:
                yield self._told(told)

        def _told(self, rows: list[list]) -> pd.DataFrame:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), told_layout)]
            return pa.Table.from_arrays(columns, schema=told_layout).to_pandas(integer_object_nulls=True)

        def close(self) -> None:
            pass

    mode = "none" if expire_ms is None else "ProcessingTime"
    # a session without an id gets one on the way, as integers among NULLs would become floating
    bucket, conv_id = F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)), F.col("conv_id")
    session = F.coalesce(F.concat(F.lit("s"), conv_id.cast("string")), F.lit(NO_SESSION))
    dealt = rows.filter(F.col("turn").isNotNull()).select(
        *[F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)).alias(c) if c == "conv_id" else c for c in given],
        session.alias("session"), bucket.alias("bucket"),
    )
    carried = dealt.groupBy("bucket").transformWithStateInPandas(Sessions(), out, "append", mode)
    return carried if context else carried.drop("_context")


def answer_stream(
    messages: DataFrame,
    uploads: DataFrame,
    videos: DataFrame,
    frames: DataFrame,
    translator: Translator,
    captioner: Captioner | None = None,
    length: int = 10,
    stride: int = 3,
    max_length: int = MAX_CAPTION_WORDS,
    expire_ms: int | None = None,
    path: str | None = None,
) -> DataFrame | None:
    """Replies to all messages that have arrived, each from captions made for its own question.

    The stream form of ``answer_questions``: session state says which video a turn is about, and the turns of
    a micro-batch are captioned, summarised and translated inside it. ``uploads``, ``videos`` and
    ``frames`` are tables; what is added to them serves later micro-batches. Another call with the same ``path`` goes on
    with messages that have arrived since. None if nothing has ever arrived.
    """
    known = uploads.select(F.col("path").alias("upload"), F.col("video_id").cast("string").alias("_video"))
    judged = gate_uploads(messages).withColumn(
        "upload", F.coalesce("upload", F.concat_ws(" ", F.lit("none"), "conv_id", "turn"))
    )
    asked = judged.join(known, "upload", "left").select("conv_id", "turn", "text", "lang", "status", "active_set", "_video")
    turns = active_video_stream(asked, context="_video", expire_ms=expire_ms)

    def reply(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        carried = rows.withColumn("_video", F.col("_video").cast("bigint"))
        answered = summarize_asked(carried, videos, frames, captioner, length, stride, max_length)
        # written, as what is translated and what is not are read from it apart
        path = scratch_path(spark, "answered")
        answered.write.parquet(path)
        stored = spark.read.schema(answered.schema).parquet(path)
        said = reply_rows(translated(stored, translator), reply_catalog(spark))
        revised = rows.select("conv_id", "turn", "revision").distinct()
        return said.join(revised, ["conv_id", "turn"])

    replies = run_batches(turns, reply, path)
    return None if replies is None else latest(replies, "conv_id", "turn")
