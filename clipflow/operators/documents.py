"""Per-key texts built from ordered rows, and word chunks across rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as ft
from ..functions.arith import int_div, let
from .skew import HotKeys, hot_keys, running_totals


def join_text(rows: DataFrame, key: str, order: str, text: str, sep: str = " ", out: str = "text") -> DataFrame:
    """Join the texts of a key in order into one value: ``key, out``.

    The rows in order are the form for any size; this one is for texts that one cell can hold,
    and fails where one cannot.
    """
    texts = rows.select(key, F.col(order).alias("_no"), F.coalesce(text, F.lit("")).alias("_text"))
    return texts.groupBy(key).agg(joined("_text", "_no", sep).alias(out))


def joined(text: str, order: str, sep: str) -> Column:
    """The texts of a group in order, as an aggregate."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("no"), F.col(text).alias("text"))))
    return F.array_join(F.transform(entries, lambda e: e["text"]), sep)


def word_chunks(
    rows: DataFrame,
    key: str,
    order: str,
    text: str,
    size: int = 512,
    min_tail: int = 130,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Chunks of the joined words of a key: ``key, chunk_no, n_words, chunk``.

    Every row cuts its own words at the chunk borders, which follow from the number
    of words before it; the joined text of a key is never built.
    """
    texts = rows.select(key, order, F.col(text).alias("_text"))
    hot = hot_keys(texts, key) if hot is None else hot
    if not hot:
        texts = texts.repartition(key)  # so that words are counted where they are cut
    counted = texts.withColumn("_n", ft.word_count("_text"))
    placed = running_totals(counted, key, [order], {"_at": F.col("_n")}, {"_total": F.col("_n")}, hot=hot)
    last = ft.chunk_count("_total", size, min_tail) - 1
    filled = placed.filter(F.col("_n") > 0).withColumn("_last", last)
    end = F.col("_at") + F.col("_n")

    def cut(w: Column) -> Column:
        def piece(k: Column) -> Column:
            first = F.greatest(k * size, F.col("_at"))
            stop = F.least(F.when(k == F.col("_last"), F.col("_total")).otherwise((k + 1) * size), end)
            taken = F.slice(w, (first - F.col("_at") + 1).cast("int"), (stop - first).cast("int"))
            return F.struct(
                k.alias("chunk_no"),
                F.col("_at").alias("_at"),
                (stop - first).alias("_taken"),
                F.array_join(taken, " ").alias("_piece"),
            )

        first_chunk = F.least(int_div("_at", size), F.col("_last"))
        final_chunk = F.least(int_div(end - 1, size), F.col("_last"))
        return F.transform(F.sequence(first_chunk, final_chunk), piece)

    # The outer form spares the size check Spark would run on the array beforehand.
    pieces = filled.select(key, F.inline_outer(let(ft.words("_text"), cut)))
    return pieces.groupBy(key, "chunk_no").agg(
        F.sum("_taken").alias("n_words"),
        F.expr("listagg(_piece, ' ') within group (order by _at)").alias("chunk"),
    )
