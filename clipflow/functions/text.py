"""Caption text: prompt removal, word splitting, chunking, prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arith import as_col, int_div, let

# The whitespace str.split() recognises, the media tag of the chat
# template and the cue that opens the model's answer.
WHITESPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
ODD_SPACE = r"[\t-\r\x{1c}-\x{1f}\x{85}\x{a0}[\p{Z}&&[^ ]]]"
VIDEO_TAG = "<video>"
ANSWER_CUE = " ASSISTANT: "


def strip_prompt(caption, prompt) -> Column:
    """Remove every literal occurrence of the echoed prompt; NULL counts as ''."""
    return F.replace(F.coalesce(as_col(caption), F.lit("")), F.lit(prompt) if isinstance(prompt, str) else prompt, F.lit(""))


def words(text) -> Column:
    return F.array_remove(F.split(as_col(text), WHITESPACE, -1), "")


def word_count(text) -> Column:
    return F.size(words(text)).cast("bigint")


def plain_spaces(text) -> Column:
    """Every whitespace character becomes one plain space."""
    return F.regexp_replace(as_col(text), ODD_SPACE, " ")


def chunk_count(n_words, size: int, min_tail: int) -> Column:
    """Chunks of ``size`` words; a tail under ``min_tail`` words joins the one before."""
    n = int_div(as_col(n_words) + F.lit(size - 1), size)
    tail = as_col(n_words) - (n - 1) * size
    return F.when((n > 1) & (tail < min_tail), n - 1).otherwise(n)


def chunks(text, size: int = 1024, min_tail: int = 130) -> Column:
    """Array of chunk texts of one cell; empty for a text without words."""

    def cut(w: Column) -> Column:
        n = chunk_count(F.size(w).cast("bigint"), size, min_tail)

        def piece(k: Column) -> Column:
            length = F.when(k == n - 1, F.size(w) - k * size).otherwise(F.lit(size))
            return F.array_join(F.slice(w, (k * size + 1).cast("int"), length.cast("int")), " ")

        none = F.array().cast("array<string>")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), piece)).otherwise(none)

    return let(words(text), cut)


def head_chars(text, limit: int = 4000) -> Column:
    return F.substring(as_col(text), 1, limit)


def chat_prompt(question) -> Column:
    """One user message holding the question and a video slot."""
    no_text = F.lit(None).cast("string")
    content = F.array(
        F.struct(F.lit("text").alias("type"), as_col(question).alias("text")),
        F.struct(F.lit("video").alias("type"), no_text.alias("text")),
    )
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def render_prompt(prompt) -> Column:
    """Flat prompt text: role, media first, then the text parts, then the answer cue."""

    def message(m: Column) -> Column:
        parts = m["content"]
        media = F.array_join(
            F.transform(F.filter(parts, lambda p: p["type"] == "video"), lambda _: F.lit(VIDEO_TAG + "\n")), ""
        )
        said = F.array_join(
            F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), " "
        )
        return F.concat(F.upper(m["role"]), F.lit(": "), media, said)

    return F.concat(F.array_join(F.transform(as_col(prompt), message), " "), F.lit(ANSWER_CUE))


def echoed_prompt(prompt) -> Column:
    """The rendered prompt as the model echoes it, the media tag gone."""
    return F.replace(render_prompt(prompt), F.lit(VIDEO_TAG), F.lit(""))
