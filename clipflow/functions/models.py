"""Model hooks: plain column functions, with deterministic defaults.

A captioner maps ``(payload array, prompt)`` to the model's answer, which echoes
the prompt. A translator maps a text to its translation, or NULL on failure, or to a struct ``text, error``
that keeps what a failure said.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from .arith import as_col, int_div, let
from .text import words

Captioner = Callable[[Column, Column], Column]
Translator = Callable[[Column], Column]
Summarizer = Callable[[Column], Column]
Encoder = Callable[[Column], Column]

#: Words a caption may have after the echoed prompt.
MAX_CAPTION_WORDS = 100
#: Texts whose translations go back together.
ANSWERED_ROWS = 256
#: What stands for a clip that was too short for the model.
NO_CAPTION = "_"


def cap_caption(answer, limit: int = MAX_CAPTION_WORDS) -> Column:
    def cut(text: Column) -> Column:
        w = words(text)
        return F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")).otherwise(text)

    return let(as_col(answer), cut)


def statistics_captioner(max_words: int = MAX_CAPTION_WORDS) -> Captioner:
    """Describes a clip of numeric frames by count, extremes and mean, in thousandths."""

    def caption(payload: Column, prompt: Column) -> Column:
        def describe(q: Column) -> Column:
            total = F.aggregate(q, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
            n = F.size(q).cast("bigint")
            mean = int_div(total, n) / 1000.0
            return F.format_string(
                "n=%d min=%.3f max=%.3f mean=%.3f", n, F.array_min(q) / 1000.0, F.array_max(q) / 1000.0, mean
            )

        answer = let(F.transform(payload, lambda v: F.round(v * 1000).cast("bigint")), describe)
        return F.concat(prompt, cap_caption(answer, max_words))

    return caption


def udf_captioner(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]) -> Captioner:
    """Wrap a Python model: ``load`` runs once per worker stream, the model per Arrow batch."""

    @F.pandas_udf("string")
    def caption(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for payload, prompt in batches:
            yield model(payload, prompt)

    return caption.asNondeterministic()


def udf_summarizer(load: Callable[[], Callable[[pd.Series], pd.Series]]) -> Summarizer:
    """Wrap a Python model of texts: ``load`` runs once per worker stream, the model per Arrow batch."""

    @F.pandas_udf("string")
    def summary(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    return summary.asNondeterministic()


def udf_encoder(load: Callable[[], Callable[[pd.Series], pd.Series]]) -> Encoder:
    """Wrap a Python model of texts or clips that gives vectors: ``load`` runs once per worker stream, the model per Arrow batch."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            yield model(values)

    return encode.asNondeterministic()


def udf_translator(load: Callable[[], Callable[[str], str]], attempts: int = 3) -> Translator:
    """Wrap a translating function that may raise: ``load`` runs once per worker stream.

    A text that an Arrow batch holds many times is asked for once; the answers to others are given back in small parts and
    not held. One that fails ``attempts`` times has no translation
    but the text of its last error; NULL stays NULL and is not asked for.
    """
    if attempts < 1:
        raise ValueError(f"at least one attempt is needed, got {attempts}")

    @F.pandas_udf("text string, error string")
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = load()

        def answer(text: str) -> tuple:
            for _ in range(attempts):
                try:
                    return ask(text), None
                except Exception as failure:  # whatever a remote service raises is its answer
                    said = None, str(failure) or type(failure).__name__
            return said

        for texts in batches:
            again = set(texts[texts.duplicated()].dropna())
            known: dict[str, tuple] = {}
            for at in range(0, len(texts), ANSWERED_ROWS):
                answers = []
                for text in texts.iloc[at:at + ANSWERED_ROWS]:
                    if not isinstance(text, str):
                        answers.append((None, None))
                    elif text not in again:
                        answers.append(answer(text))
                    else:
                        if text not in known:
                            known[text] = answer(text)
                        answers.append(known[text])
                yield pd.DataFrame(answers, columns=["text", "error"])

    return translate.asNondeterministic()


def lookup_translator(translations: dict[str, str]) -> Translator:
    """A fixed phrase table as translator; unknown texts count as failures."""
    pairs = [F.lit(x) for pair in translations.items() for x in pair]
    table = F.create_map(*pairs) if pairs else None
    return lambda text: table[text] if table is not None else F.lit(None).cast("string")
