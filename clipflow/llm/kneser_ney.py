"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

Events are characters, padded at the start and closed by an end mark, so every text has at
least one. Documents travel in blocks of bounded size. A block asks once for each of its
distinct n-grams; counts are summed and probabilities are joined by (language, n-gram) over
all tasks, and the answers go back to the block, which adds up its documents. What is
shuffled per block is its vocabulary, not its text's length.

Documents are dealt into folds by a hash of their id. Each fold is scored by a model of the trusted
text of all other folds, so that no text is judged by a model that has read it, all trusted text is
learnt from, and thresholds rest on every trusted document.

A word said over and over is made of likely characters. So each text is also written as one mark per word, which
says how long ago the word was last used, and the same model is built over the marks of trusted text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import block_count, bundled, drop_rows, frugal, if_small, stored, text_digest, unbundled, volume

ORDER = 4
FOLDS = 2
#: Order of the model over marks, and the classes of distance: 1, 2-3, 4-7, 8-15, 16 and more words ago.
MARK_ORDER = 2
MARKS = 5
#: Bytes of text per block. Its n-grams are asked for once, so large blocks send few; a task holds one at a time.
BLOCK = 16_000_000
#: Share of the trusted documents of a language that its threshold lets through.
QUANTILE = 0.99
#: Accuracy of the quantiles: an error of 1 / ACCURACY of the documents.
ACCURACY = 10_000

START, END = "\x02", "\x03"
#: Characters that are worked on at a time, and largest lookup table.
CHUNK_CHARS = 600_000
TABLE = 1 << 24

SEEN = "block int, model string, gram string, trusted bigint"
SCORES = "doc_id bigint, lang string, n_events bigint, trusted boolean, bits double, digest binary, marks string"
#: What a row of ``SCORES`` takes along while its marks are scored.
TAKEN = ["n_events", "bits", "digest"]
REPEATS = "doc_id bigint, lang string, n_marks bigint, trusted boolean, mark_bits double, n_events bigint, bits double, digest binary"


def _ranks(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Codes below ``size`` renumbered without gaps, in order."""
    if size <= TABLE:
        seen = np.zeros(size, bool)
        seen[codes] = True
        rank = np.cumsum(seen) - 1
        return rank[codes], int(rank[-1]) + 1
    values, ranks = np.unique(codes, return_inverse=True)
    return ranks, len(values)


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Gram number of every event, first event of every text, and the grams by number."""
    whole = "".join([f"{START * (order - 1)}{t}{END}" for t in texts])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    spans = np.array([len(t) + order for t in texts])
    ends = np.cumsum(spans)
    symbols, n_symbols = _ranks(points, int(points.max()) + 1)
    codes, n = symbols, n_symbols
    for k in range(1, order):
        codes, n = _ranks(codes[:-1] * n_symbols + symbols[k:], n * n_symbols)
    inside = np.ones(len(codes), bool)
    for k in range(1, order):
        inside[ends[:-1] - k] = False
    at = np.nonzero(inside)[0]
    codes, n = _ranks(codes[at], n)
    first = np.empty(n, np.int64)
    first[codes[::-1]] = at[::-1]
    names = points[first[:, None] + np.arange(order)].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    starts = np.concatenate([[0], np.cumsum(spans - order + 1)[:-1]])
    return codes, starts, [names[i:i + order] for i in range(0, n * order, order)]


def marks(text: str) -> str:
    """Per word how many words ago it was last used, as a digit: the bit length of the distance, at most ``MARKS``; 0 if never."""
    last: dict[str, int] = {}
    out = []
    for k, word in enumerate(text.lower().split()):
        out.append(min((k - last.get(word, k)).bit_length(), MARKS))
        last[word] = k
    return "".join(map(str, out))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if texts:
        yield start, len(texts)


def _by_model(docs: pa.Table) -> Iterator[tuple[str, list[int], list[str]]]:
    """Model, rows of ``docs`` and their texts."""
    groups: dict[str, tuple[list, list]] = {}
    for row, (model, text) in enumerate(zip(docs["model"].to_pylist(), docs["text"].to_pylist())):
        rows, texts = groups.setdefault(model, ([], []))
        rows.append(row), texts.append(text.decode("utf-8", "replace"))
    for model, (rows, texts) in groups.items():
        for a, b in _chunks(texts):
            yield model, rows[a:b], texts[a:b]


def _seen(order: int):
    def run(bundles, labels):
        docs = unbundled(bundles, ("doc_id", "model", "text"))
        trusted = set(labels["doc_id"].to_pylist())
        ids = docs["doc_id"].to_pylist()
        found: dict[tuple[str, str], int] = {}
        for model, rows, texts in _by_model(docs):
            codes, starts, names = grams(texts, order)
            weight = np.repeat([ids[i] in trusted for i in rows], np.diff(np.append(starts, len(codes))))
            for name, n in zip(names, np.bincount(codes, weight, len(names)).tolist()):
                found[model, name] = found.get((model, name), 0) + int(n)
        block = bundles["block"][0].as_py() if bundles.num_rows else 0
        keys = list(found)
        return pa.table({
            "block": pa.array([block] * len(keys), pa.int32()),
            "model": pa.array([k[0] for k in keys], pa.string()),
            "gram": pa.array([k[1] for k in keys], pa.string()),
            "trusted": pa.array(found.values(), pa.int64()),
        })

    return run


def _scored(order: int, taken: list[str]):
    def run(bundles, answers):
        docs = unbundled(bundles, ("doc_id", "model", "text", *taken))
        bits = dict(zip(zip(answers["model"].to_pylist(), answers["gram"].to_pylist()), answers["bits"].to_pylist()))
        trusted = {g for model, g in bits if model is None}
        ids, raw, along = docs["doc_id"].to_pylist(), docs["text"], [docs[c].to_pylist() for c in taken]
        out: list[list] = [[] for _ in range(5 + (len(taken) or 2))]
        for model, rows, texts in _by_model(docs):
            codes, starts, names = grams(texts, order)
            each = np.array([bits[model, name] for name in names])
            total = np.add.reduceat(each[codes], starts)
            n = np.diff(np.append(starts, len(codes)))
            if taken:
                rest = [[c[i] for i in rows] for c in along]
            else:
                rest = [[hashlib.sha256(raw[i].as_py()).digest() for i in rows], list(map(marks, texts))]
            for column, values in zip(out, (
                [ids[i] for i in rows], [model.partition(":")[2]] * len(rows), n.tolist(),
                [str(ids[i]) in trusted for i in rows], (total / n).tolist(), *rest,
            )):
                column.extend(values)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.float64()]
        kinds += [pa.int64(), pa.float64(), pa.binary()] if taken else [pa.binary(), pa.string()]
        names = [c.split()[0] for c in (REPEATS if taken else SCORES).split(", ")]
        return pa.table({name: pa.array(c, k) for name, c, k in zip(names, out, kinds)})

    return run


def _discounts(level: DataFrame) -> DataFrame:
    """Per model the three discounts of modified Kneser-Ney from the counts of counts.

    Where a count of counts is zero the estimates are undefined; 0.5, 1 and 1.5 stand in. None is below 0.1.
    """
    n = [F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4)]
    counts = level.groupBy("model").agg(*[v.alias(f"n{k}") for k, v in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = F.least("n1", "n2", "n3", "n4") > 0
    return counts.select("model", *[
        F.when(known, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(float(k))))
        .otherwise(0.5 * k).alias(f"d{k}")
        for k in (1, 2, 3)
    ])


def probabilities(seen: DataFrame, order: int = ORDER) -> DataFrame:
    """``model, gram, p`` of every gram in ``seen``, from the trusted counts in it.

    ``seen`` has ``model, gram, trusted``, several rows per gram adding up. Below the highest order a
    gram counts as often as there are different symbols before it.
    """
    targets = stored(seen.groupBy("model", "gram").agg(F.sum("trusted").alias("c")), "grams")
    levels = {order: targets.filter("c > 0")}
    wanted = {order: targets.select("model", "gram")}
    for n in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, n).alias("gram")
        levels[n] = stored(levels[n + 1].groupBy("model", shorter).agg(F.count("*").alias("c")), "level")
        wanted[n] = stored(wanted[n + 1].select("model", shorter).distinct(), "wanted")

    # below single symbols all symbols of the model are alike, one more standing for the unseen
    below = levels[1].groupBy("model").agg((1 / (F.count("*") + 1)).alias("p0"))
    known = None
    for n in range(1, order + 1):
        discounts = if_small(stored(_discounts(levels[n]), "discounts"), 100_000)
        context = F.substring("gram", 1, n - 1).alias("context")
        counted = levels[n].join(discounts, "model")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        counted = counted.select("model", "gram", "c", d.alias("d"))
        contexts = counted.groupBy("model", context).agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        rows = wanted[n].select("model", "gram", context, F.substring("gram", 2, n - 1).alias("shorter"))
        rows = rows.join(counted, ["model", "gram"], "left").join(contexts, ["model", "context"], "left")
        if known is None:
            rows = rows.join(if_small(stored(below, "below"), 100_000), "model", "left")
            rows = rows.withColumn("lower", F.coalesce("p0", F.lit(1.0)))
        else:
            rows = rows.join(known.select("model", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["model", "shorter"])
        own = F.coalesce(F.col("c") - F.col("d"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(
            (own + F.col("freed") * F.col("lower")) / F.col("total")
        )
        known = stored(rows.select("model", "gram", p.alias("p")), "probabilities")
    return known


def perplexity(
    docs: DataFrame, trusted: DataFrame, order: int = ORDER, folds: int = FOLDS, taken: list[str] | None = None
) -> DataFrame:
    """``doc_id, lang, n_events, trusted, bits, digest, marks`` of every row: mean bits per character under the model
    of its language and fold, the SHA-256 of its text and its marks.

    ``trusted`` lists the ids (``doc_id``) of the texts to learn from. With ``taken``, the columns ``TAKEN``, which go
    along, texts are marks and the result is ``REPEATS``.
    """
    taken = taken or []
    rows, size = volume(docs)
    n = block_count(size + rows, BLOCK)
    text = F.coalesce(F.col("text"), F.lit(""))
    # labels meet their documents by id; rows without an id have none and are dealt by text
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id").cast("bigint")))
    block = F.pmod(key, F.lit(n)).cast("int").alias("block")
    fold = F.pmod(F.shiftrightunsigned(key, 40), F.lit(folds))
    blocks = bundled(docs.select(
        block, F.col("doc_id").cast("bigint").alias("doc_id"),
        F.concat(fold.cast("string"), F.lit(":"), F.coalesce(F.col("lang"), F.lit(""))).alias("model"),
        text.cast("binary").alias("text"), *taken,
    ))
    ids = trusted.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    marks = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id")
    seen = stored(
        blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(frugal(_seen(order)), SEEN), "seen"
    )
    own = F.substring_index("model", ":", 1)
    others = F.array(*[F.lit(str(k)) for k in range(folds)])
    learnt = seen.filter("trusted > 0").select(
        F.explode(F.filter(others, lambda k: k != own)).alias("fold"), "model", "gram", "trusted"
    ).select(
        F.concat("fold", F.expr("substring(model, instr(model, ':'))")).alias("model"), "gram", "trusted"
    )
    asked = seen.select("model", "gram", F.lit(0).cast("bigint").alias("trusted"))
    known = probabilities(learnt.unionByName(asked), order)
    answers = stored(seen.select("block", "model", "gram").join(known, ["model", "gram"]).select(
        "block", "model", "gram", (-F.log2("p")).alias("bits")
    ), "answers")
    # trusted ids ride along as answers without a model
    answers = answers.unionByName(marks.select(
        "block", F.lit(None).cast("string").alias("model"), F.col("doc_id").cast("string").alias("gram"),
        F.lit(0.0).alias("bits"),
    ))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        frugal(_scored(order, taken)), REPEATS if taken else SCORES
    )


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """Every row with its perplexity, the threshold of its language and whether it is kept.

    Columns: ``doc_id, lang, n_events, perplexity, threshold, kept, repeat_perplexity, repeat_threshold``. Trusted are the documents that all their
    labels call of quality 1 and none calls toxic; no sample is drawn from them. The threshold is the ``quantile`` of
    the perplexities of a language's trusted documents, over characters and over marks; a row is kept that is above
    neither. A language without trusted documents has none and
    keeps all. NULL texts count as empty and have one event, the end; a NULL language is the language ''. Rows that
    repeat an id are scored one by one; rows without an id are scored and never trusted.
    """
    return _judged(docs, labels, order, quantile).drop("digest")


def _judged(docs: DataFrame, labels: DataFrame, order: int, quantile: float) -> DataFrame:
    """What ``classify`` says, and the ``digest`` of each row's text."""
    trusted = labels.groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    ).filter("good = 1 and toxic = 0").select("doc_id")
    scores = stored(perplexity(docs, trusted, order), "scores")
    by_marks = scores.select("doc_id", "lang", F.col("marks").alias("text"), *TAKEN)
    scores = stored(perplexity(by_marks, trusted, MARK_ORDER, taken=TAKEN), "repeats")
    limits = scores.filter("trusted").groupBy("lang").agg(*[
        F.percentile_approx(bits, F.lit(quantile), F.lit(ACCURACY)).alias(limit)
        for bits, limit in (("bits", "limit"), ("mark_bits", "mark_limit"))
    ])
    limits = if_small(stored(limits, "limits"), 100_000)
    return scores.join(limits, "lang", "left").select(
        "doc_id", "lang", "n_events", F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "limit").alias("threshold"),
        F.coalesce((F.col("bits") <= F.col("limit")) & (F.col("mark_bits") <= F.col("mark_limit")), F.lit(True)).alias("kept"),
        F.pow(F.lit(2.0), "mark_bits").alias("repeat_perplexity"), F.pow(F.lit(2.0), "mark_limit").alias("repeat_threshold"),
        "digest",
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """The rows that ``classify`` keeps, all columns as they were. Each row, also one without an id, follows its own verdict."""
    verdicts = _judged(docs, labels, order, quantile)
    return drop_rows(docs, stored(verdicts.filter(~F.col("kept")).select("doc_id", "digest", "lang"), "rejected"), {
        "doc_id": F.col("doc_id").cast("bigint"), "digest": text_digest(), "lang": F.coalesce(F.col("lang"), F.lit("")),
    })
