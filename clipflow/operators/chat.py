"""Chat sessions: upload gate, active video, translations, replies, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import media, paths
from ..functions.models import Translator
from .skew import HotKeys, carry_forward

#: Own wording of every reply: status, language, position, side, kind, text.
#: ``kind`` names what fills the entry; ``text`` entries use the wording as it is.
REPLY_CATALOG = [
    ("said", "en", 0, "user", "message", ""),
    ("said", "it", 0, "user", "message", ""),
    ("ok", "en", 0, "user", "video", ""),
    ("ok", "it", 0, "user", "video", ""),
    ("too_long", "en", 0, "user", "video", ""),
    ("too_long", "en", 1, "bot", "text", "This recording is long: only its first 10 seconds are used."),
    ("too_long", "it", 0, "user", "video", ""),
    ("too_long", "it", 1, "bot", "text", "Registrazione lunga: si usano solo i primi 10 secondi."),
    ("too_short", "en", 0, "bot", "text", "This recording is under 2 seconds, please send a longer one."),
    ("too_short", "it", 0, "bot", "text", "La registrazione dura meno di 2 secondi, inviarne una più lunga."),
    ("convert_error", "en", 0, "bot", "text", "The file could not be converted."),
    ("convert_error", "it", 0, "bot", "text", "Impossibile convertire il file."),
    ("no_video", "en", 0, "bot", "text", "Send a recording first."),
    ("no_video", "it", 0, "bot", "text", "Inviare prima una registrazione."),
    ("answered", "en", 0, "bot", "summary", ""),
    ("answered", "en", 1, "bot", "text", "All clip captions are in the file below."),
    ("answered", "en", 2, "bot", "file", ""),
    ("translated", "it", 0, "bot", "translation", ""),
    ("translated", "it", 1, "bot", "text", "Le didascalie sono nel file qui sotto."),
    ("translated", "it", 2, "bot", "file", ""),
    ("untranslated", "it", 0, "bot", "failure", "La traduzione non è riuscita."),
    ("untranslated", "it", 1, "bot", "text", "Segue il testo originale:"),
    ("untranslated", "it", 2, "bot", "summary", ""),
    ("untranslated", "it", 3, "bot", "text", "Le didascalie sono nel file qui sotto."),
    ("untranslated", "it", 4, "bot", "file", ""),
]
_CATALOG_SCHEMA = "status string, lang string, position int, side string, kind string, wording string"


def reply_catalog(spark) -> DataFrame:
    return spark.createDataFrame(REPLY_CATALOG, _CATALOG_SCHEMA)


def gate_uploads(messages: DataFrame) -> DataFrame:
    """Judge the attachment of every turn.

    Needs ``files``, ``dur`` and ``convert_ok``. Adds ``upload`` (the attached
    path), ``status`` and ``active_set``: NULL keeps the session's video, ``''``
    clears it, a path replaces it. Only a single attachment counts.
    """
    single = F.size("files") == 1
    attached = F.when(single, F.element_at("files", 1))
    converted = F.when(single, F.when(F.col("convert_ok"), paths.mp4_target(attached)).otherwise(F.lit("")))
    judged = messages.withColumns({"upload": attached, "_converted": converted})
    status = F.when(F.col("_converted").isNotNull(), media.upload_status("_converted", "dur"))
    active = (
        F.when(status == media.OK, F.col("_converted"))
        .when(status == media.TOO_LONG, paths.cut_target("_converted"))
        .when(status.isNotNull(), F.lit(""))
    )
    return judged.withColumns({"status": status, "active_set": active}).drop("_converted")


def active_video(gated: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """The video each turn talks about; ``''`` where there is none."""
    carried = carry_forward(gated, "conv_id", ["turn"], "active_set", "active_video", hot)
    return carried.withColumn("active_video", F.coalesce("active_video", F.lit("")))


def active_context(gated: DataFrame, context: list[str], hot: HotKeys | None = None) -> DataFrame:
    """As ``active_video``, carrying what is known of the video along with it."""
    known = F.struct(F.col("active_set").alias("path"), *context)
    held = gated.withColumn("_set", F.when(F.col("active_set").isNotNull(), known)).drop(*context)
    carried = carry_forward(held, "conv_id", ["turn"], "_set", "_now", hot)
    return carried.withColumns(
        {"active_video": F.coalesce("_now.path", F.lit(""))} | {c: F.col("_now")[c] for c in context}
    ).drop("_set", "_now")


def translate_with_fallback(
    texts: DataFrame, key: str, text: str, translations: DataFrame | None = None, translator: Translator | None = None,
    prefix: str = "",
) -> DataFrame:
    """Ordered output rows per text: the translation, or two notices and the text itself.

    Translations come from a table keyed like the texts or from a hook; the first notice has the text of a hook's
    error. ``request`` holds what a remote translator would be sent.
    """
    if translations is not None:
        known = texts.join(translations.select(key, "translation"), key, "left").withColumn("error", _nothing())
    else:
        known = with_translation(texts, text, translator or (lambda _: _nothing()))
    notice = {row[2]: row[5] for row in REPLY_CATALOG if row[0] == "untranslated" and row[4] in ("text", "failure")}
    failed = F.array(failure_notice(F.lit(notice[0]), F.col("error")), F.lit(notice[1]), F.col(text))
    rows = F.when(F.col("translation").isNull(), failed).otherwise(F.array("translation"))
    return known.select(
        key, F.concat(F.lit(prefix), F.col(text)).alias("request"), F.posexplode(rows).alias("pos", "output")
    )


def _nothing() -> Column:
    return F.lit(None).cast("string")


def with_translation(texts: DataFrame, text: str, translator: Translator) -> DataFrame:
    """Add what a hook says of a text as ``translation`` and ``error``."""
    asked = texts.withColumn("_said", translator(F.col(text)))
    if not isinstance(asked.schema["_said"].dataType, T.StructType):
        return asked.withColumnsRenamed({"_said": "translation"}).withColumn("error", _nothing())
    return asked.withColumns({"translation": F.col("_said.text"), "error": F.col("_said.error")}).drop("_said")


def failure_notice(wording: Column, error: Column) -> Column:
    """The notice of a failed translation, followed by what the failure said."""
    return F.when(error.isNull(), wording).otherwise(F.concat(F.rtrim(wording, F.lit(".")), F.lit(": "), error))


def reply_language(lang: str) -> Column:
    """Italian where that is asked for; everything else, NULL too, is answered in English."""
    return F.when(F.col(lang) == "it", "it").otherwise("en")


def reply_rows(turns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ordered replies ``conv_id, turn, pos, user, bot`` of every turn.

    A turn passes through up to three situations (what was said, the verdict on its
    upload, the answer); the catalog fans each out. The catalog is a fixed list of
    a few dozen rows and is broadcast.
    """
    turns = turns.withColumn("lang", reply_language("lang"))
    if "error" not in turns.columns:
        turns = turns.withColumn("error", _nothing())
    translated = F.when(F.col("translation").isNotNull(), "translated").otherwise("untranslated")
    answer = (
        F.when(F.col("active_video") == "", F.lit("no_video"))
        .when(F.col("lang") == "it", translated)
        .otherwise(F.lit("answered"))
    )
    verdict_rows = F.when(F.col("status").isNull(), 0).when(F.col("status") == media.TOO_LONG, 2).otherwise(1)
    situations = F.array(
        F.struct(F.lit("said").alias("situation"), F.lit(0).alias("base")),
        F.struct(F.col("status").alias("situation"), F.lit(1).alias("base")),
        F.struct(answer.alias("situation"), (verdict_rows + 1).alias("base")),
    )
    fanned = turns.select(
        "conv_id", "turn", "lang", "text", "active_video", "summary", "translation", "error", F.inline(situations)
    ).withColumnRenamed("situation", "status")
    filled = (
        F.when(F.col("kind") == "message", F.col("text"))
        .when(F.col("kind") == "video", F.col("active_video"))
        .when(F.col("kind") == "summary", F.col("summary"))
        .when(F.col("kind") == "translation", F.col("translation"))
        .when(F.col("kind") == "failure", failure_notice(F.col("wording"), F.col("error")))
        .when(F.col("kind") == "file", F.concat(paths.root("active_video"), F.lit(".csv")))
        .otherwise(F.col("wording"))
    )
    return fanned.join(F.broadcast(catalog), ["status", "lang"]).select(
        "conv_id", "turn", (F.col("base") + F.col("position")).cast("bigint").alias("pos"),
        F.when(F.col("side") == "user", filled).alias("user"),
        F.when(F.col("side") == "bot", filled).alias("bot"),
    )


def chat_history(replies: DataFrame) -> DataFrame:
    """Entries of a session in order in one value: ``conv_id, history``.

    ``reply_rows`` ordered by ``turn, pos`` is the form for sessions of any size.
    """
    entry = F.struct("turn", "pos", "user", "bot")
    entries = replies.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    return entries.select(
        "conv_id", F.transform("_entries", lambda e: F.struct(e["user"].alias("user"), e["bot"].alias("bot"))).alias("history")
    )
