"""Deterministic extractive summaries as windows and aggregates.

Sentences are ranked by the mean frequency of their words within the text, taken
in rank order while the word budget lasts, and put back in text order. A text may
be one row, or the ordered rows of a key whose join is never built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as ft
from ..functions.arith import let
from .skew import HotKeys, running_totals, split_hot

MAX_WORDS = 130
MIN_WORDS = 30
#: Bytes of terms that are ranked at a time, whole texts always.
RANKED_BYTES = 1 << 20
#: Places per word at most that words are counted in; more distinct ones are sorted.
COUNTED_SPREAD = 8

# What ends a sentence, and what a word loses before it is counted.
SENTENCE = r"[^.!?]+[.!?]*"
SENTENCE_ENDS = r"[.!?]+"
STARTS_WITH_END = r"^[.!?]"
NOT_TERM = r"[^\p{L}\p{N} ]+"


def first_words(text, limit: int) -> Column:
    """The first words of a text, one space between them."""
    return F.array_join(F.slice(ft.words(text), 1, limit), " ")


def summarize_rows(
    texts: DataFrame,
    keys: list[str],
    text: str,
    max_words: int = MAX_WORDS,
    min_words: int = MIN_WORDS,
    min_input: int = 0,
    counted: str | None = None,
) -> DataFrame:
    """Summarise texts held in one row each: ``keys, summary``.

    The keys identify a text and are never NULL. Nothing is shuffled: the words of a batch of texts are counted
    together (``chosen_sentences``), and only the numbers of the chosen sentences come back. Texts under ``min_input`` words
    pass as they are; ``counted`` names a column that already holds the word count.
    """
    # neither sentences nor words depend on which white space lies between them
    plain = ft.plain_spaces(F.coalesce(text, F.lit("")))
    columns = [plain.alias("_text"), *([F.col(counted).alias("_n")] if counted else [])]
    rows = _with_keys(texts.select(*keys, *columns), keys)
    matches = _matches(F.col("_text"))
    if min_input:
        n_words = F.col("_n") if counted else ft.word_count("_text")
        matches = F.when(n_words < min_input, F.array("_text")).otherwise(matches)

    def measured(match: Column) -> Column:
        return F.struct(
            match.alias("s"),
            F.size(_split(match)).cast("bigint").alias("n"),
            F.regexp_replace(F.lower(match), NOT_TERM, "").alias("t"),
        )

    # The generator keeps the lambdas out of the arguments: Spark cannot hand those with lambdas to Python.
    sentences = rows.select(*keys, F.explode(F.array(F.transform(matches, measured))).alias("_all"))
    kept = chosen_sentences(max_words, min_words)(F.col("_all.n"), F.col("_all.t"))
    joined = F.array_join(F.transform("_kept", lambda p: F.get(F.col("_all.s"), p)), " ")
    return sentences.withColumn("_kept", kept).select(*keys, first_words(joined, max_words).alias("summary"))


def chosen_sentences(max_words: int, min_words: int):
    """Numbers of the sentences a summary keeps, in text order, from every sentence's word count and its terms.

    Terms are separated by single spaces. Texts of an Arrow batch are ranked by the same few array operations, so many at a
    time that what these hold follows the longest text and not the batch.
    """

    def ranked(sizes: pa.Array, terms: pa.Array) -> pa.Array:
        per_text = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(per_text)])
        n = int(starts[-1])
        text_of = np.repeat(np.arange(len(per_text)), per_text)
        n_words = sizes.flatten().to_numpy(zero_copy_only=False)
        words = pc.split_pattern(terms.flatten(), " ")
        per_sentence = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sentence_of = np.repeat(np.arange(n), per_sentence)
        if len(codes):
            sentence_of, codes = sentence_of[real[codes]], codes[real[codes]]
        which = text_of[sentence_of] * (len(real) + 1) + codes
        if len(per_text) * (len(real) + 1) <= COUNTED_SPREAD * len(codes):
            times = np.bincount(which)
        else:
            _, which, times = np.unique(which, return_inverse=True, return_counts=True)
        total = np.bincount(sentence_of, weights=times[which], minlength=n)
        score = total / np.maximum(np.bincount(sentence_of, minlength=n), 1)

        asked = np.nonzero(n_words > 0)[0]  # a sentence of spaces is none
        order = asked[np.lexsort((asked, -score[asked], text_of[asked]))]
        upto = np.cumsum(n_words[order])
        first = np.concatenate([[True], text_of[order][1:] != text_of[order][:-1]])[:len(order)]
        before = upto - n_words[order]
        before -= np.repeat(before[first], np.diff(np.append(np.nonzero(first)[0], len(order))))
        fits = (before + n_words[order] <= max_words) | (before == 0) | (before < min_words)
        kept = np.sort(order[fits])
        ends = np.concatenate([[0], np.cumsum(np.bincount(text_of[kept], minlength=len(per_text)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept - starts[text_of[kept]], pa.int32()))

    @F.arrow_udf("array<int>")
    def chosen(sizes: pa.Array, terms: pa.Array) -> pa.Array:
        n_bytes = pc.fill_null(pc.binary_length(terms.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        per_text = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n_bytes)])[np.cumsum(per_text)]
        cuts = [0, *(np.nonzero(np.diff(upto // RANKED_BYTES))[0] + 1).tolist(), len(terms)]
        parts = [ranked(sizes.slice(x, y - x), terms.slice(x, y - x)) for x, y in zip(cuts, cuts[1:])]
        return pa.concat_arrays(parts)

    return chosen


def summarize_pieces(
    rows: DataFrame,
    key: str,
    order: str,
    text: str,
    hot: HotKeys,
    max_words: int = MAX_WORDS,
    min_words: int = MIN_WORDS,
    min_input: int = 0,
    every: DataFrame | None = None,
) -> DataFrame:
    """Summarise the joined text of each key: ``key, summary``.

    A sentence may run over several rows. Keys known to be hot take a plan whose
    groups all stay bounded; the others stay in the tasks their rows were sent to.
    ``every`` lists the keys to report, if that is cheaper than reading ``rows``.
    """
    limits = (max_words, min_words, min_input)
    known = _with_keys(rows, [key])
    if hot:
        cold_rows, hot_rows = split_hot(known, key, hot)
        cold = _summarize_stitched(cold_rows, key, order, text, limits, {})
        found = cold.unionByName(_summarize_stitched(hot_rows, key, order, text, limits, hot))
    else:
        found = _summarize_stitched(known, key, order, text, limits, {})
    keys = known.select(key).distinct() if every is None else every
    return keys.join(found, key, "left").select(key, F.coalesce("summary", F.lit("")).alias("summary"))


def summarize_joined(
    rows: DataFrame,
    key: str,
    order: str,
    text: str,
    max_words: int = MAX_WORDS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """As ``summarize_pieces`` for keys whose joined text is known to be small: ``key, summary`` of every key of ``rows``.

    The text is built once per key, and its words are ranked where it lies (``summarize_rows``) instead of being rows
    that are shuffled and sorted.
    """
    piece = F.struct(F.col(order).alias("_ord"), F.coalesce(text, F.lit("")).alias("_raw"))
    pieces = _with_keys(rows, [key]).groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    joined = pieces.select(key, F.array_join(F.col("_pieces._raw"), " ").alias("_joined"))
    return summarize_rows(joined, [key], "_joined", max_words, min_words)


def _summarize_stitched(rows: DataFrame, key: str, order: str, text: str, limits, hot: HotKeys) -> DataFrame:
    max_words, min_words, min_input = limits
    placed = _stitched(rows, key, order, text, min_input, hot)
    sentences = placed.select(key, "_base", F.posexplode_outer(_row_matches()).alias("_j", "_match")).select(
        key, (F.col("_base") + F.coalesce("_j", F.lit(0))).alias("_pos"), "_match"
    )
    chosen = _chosen(sentences, [key], max_words, min_words, spread=bool(hot))
    if hot:
        chosen = F.broadcast(chosen)  # at most MAX_HOT_KEYS rows of max_words numbers

    def picked(matches: Column) -> Column:
        mine = F.filter("_kept", lambda p: (p >= F.col("_base")) & (p < F.col("_base") + F.size(matches)))
        return F.transform(
            mine,
            lambda p: F.struct(
                p.alias("_pos"),
                first_words(F.get(matches, (p - F.col("_base")).cast("int")), max_words).alias("_head"),
            ),
        )

    fragments = (
        placed.join(chosen, key)
        .select(key, "_ord", F.inline_outer(let(_row_matches(), picked)))
        .filter(F.col("_head") != "")
    )
    # Only the opening words of a sentence can show, so its first rows suffice.
    opening = Window.partitionBy(key, "_pos").orderBy("_ord")
    shown = fragments.withColumn("_nth", F.row_number().over(opening)).filter(F.col("_nth") <= max_words)
    entry = F.struct("_pos", "_ord", "_head")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_head"]), " ")
    return shown.groupBy(key).agg(joined.alias("_joined")).select(
        key, first_words("_joined", max_words).alias("summary")
    )


def _with_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A plain filter, as joins on the keys imply it; a shuffle under both sides is then one."""
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows


def _matches(text) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def _split(text) -> Column:
    return F.array_remove(F.split(text, " ", -1), "")


def _stitched(rows: DataFrame, key: str, order: str, text: str, min_input: int, hot: HotKeys) -> DataFrame:
    """Rows with ``_base``, the number of their first sentence within the key's text.

    The join puts a space before every row but the first, so punctuation at the
    start counts only there. A row's first fragment continues the sentence before
    it unless that one was ended.
    """
    pieces = rows.select(key, F.col(order).alias("_ord"), F.coalesce(text, F.lit("")).alias("_raw"))
    if not hot:
        pieces = pieces.repartition(key)
    placed = running_totals(
        pieces,
        key,
        ["_ord"],
        {"_done": F.regexp_count("_raw", F.lit(SENTENCE_ENDS)).cast("bigint"), "_rows": F.lit(1).cast("bigint")},
        {"_words": ft.word_count("_raw")} if min_input else {},
        hot=hot,
    )
    whole = F.col("_words") < min_input if min_input else F.lit(False)
    first = F.col("_rows") == 0
    # Punctuation a text starts with is counted above but is no sentence.
    skipped = F.when(first & F.col("_raw").rlike(STARTS_WITH_END), F.lit(1)).otherwise(F.lit(0))
    base = F.when(whole, F.lit(0)).otherwise(F.col("_done") + skipped)
    return placed.select(key, "_ord", "_raw", whole.alias("_whole"), first.alias("_first"), base.alias("_base"))


def _row_matches() -> Column:
    spaced = F.concat(F.when(F.col("_first"), F.lit("")).otherwise(F.lit(" ")), F.col("_raw"))
    return F.when(F.col("_whole"), F.array("_raw")).otherwise(_matches(spaced))


def _chosen(sentences: DataFrame, keys: list[str], max_words: int, min_words: int, spread: bool) -> DataFrame:
    """Numbers of the sentences a summary keeps, in text order: ``keys, _kept``.

    ``sentences`` has ``keys, _pos, _match``; rows of one number form one sentence.
    """
    # With plain spaces only, the splits below need no pattern.
    spaced = sentences.select(*keys, "_pos", ft.plain_spaces("_match").alias("_match"))
    measured = spaced.select(
        *keys,
        "_pos",
        F.size(_split("_match")).cast("bigint").alias("_nw"),
        _split(F.regexp_replace(F.lower("_match"), NOT_TERM, "")).alias("_terms"),
    )
    words = measured.select(*keys, "_pos", "_nw", F.posexplode_outer("_terms").alias("_i", "_term")).select(
        *keys, "_pos", "_term", F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_nw")).alias("_nw")
    )
    scored = (_scored_spread if spread else _scored_local)(words, keys)
    mean = F.col("_sum").cast("double") / F.col("_cnt")
    score = F.when(F.col("_cnt") > 0, mean).otherwise(F.lit(0.0))
    kept = _within_budget(scored.filter(F.col("_nw") > 0).withColumn("_score", score), keys, max_words, min_words)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("_pos")).alias("_kept"))


def _scored_local(words: DataFrame, keys: list[str]) -> DataFrame:
    counted = words.withColumn("_tf", F.count("_term").over(Window.partitionBy(*keys, "_term")))
    return counted.groupBy(*keys, "_pos").agg(
        F.sum(F.when(F.col("_term").isNotNull(), F.col("_tf"))).alias("_sum"),
        F.count("_term").alias("_cnt"),
        F.sum("_nw").alias("_nw"),
    )


def _scored_spread(words: DataFrame, keys: list[str]) -> DataFrame:
    """The same with words counted and looked up by (key, word), map-side first.

    Spark splits the rows of a frequent word, as the joined rows are shuffled again.
    """
    nothing = F.concat(F.lit(" "), F.col("_pos").cast("string"))  # no word holds a space
    named = words.withColumns({"_real": F.col("_term").isNotNull(), "_term": F.coalesce("_term", nothing)})
    counts = named.groupBy(*keys, "_term").agg(F.count("*").alias("_tf"))
    return (
        named.groupBy(*keys, "_pos", "_term", "_real")
        .agg(F.count("*").alias("_times"), F.sum("_nw").alias("_nw"))
        .join(counts, [*keys, "_term"])
        .groupBy(*keys, "_pos")
        .agg(
            F.sum(F.when(F.col("_real"), F.col("_tf") * F.col("_times"))).alias("_sum"),
            F.coalesce(F.sum(F.when(F.col("_real"), F.col("_times"))), F.lit(0)).alias("_cnt"),
            F.sum("_nw").alias("_nw"),
        )
    )


def _within_budget(scored: DataFrame, keys: list[str], max_words: int, min_words: int) -> DataFrame:
    """Keep sentences in rank order while the budget lasts.

    Each sentence has a word, so only the first ``max`` ranks can be kept; the rank
    filter lets Spark cut every map task's share to that many rows per key.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc("_score"), "_pos")
    running = F.sum("_nw").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = scored.withColumns({"_rank": F.row_number().over(best), "_cum": running})
    before = F.col("_cum") - F.col("_nw")
    fits = (F.col("_cum") <= max_words) | (before == 0) | (before < min_words)
    return ranked.filter(F.col("_rank") <= max(max_words, min_words)).filter(fits)
