"""Corpus operators on Spark against brute force, and on rows of every awkward kind."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from clipflow.llm import common, components, exact, html, kneser_ney, packing, pieces, queries, simhash, suffixes, transducers, urls, vptree, warc
from conftest import TABLES
from workload.compare import connect, difference

public = pytest.importorskip("public_tokenizers")
BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")

LONG = " ".join(f"w{i * i % 9973}" for i in range(60_000))
SHARED = "a passage of more than a hundred bytes that stands in several documents, word for word, as passages at times do. "
ODD = [
    (1, "The same text twice.", "en"), (2, "The same text twice.", "en"), (3, None, None), (4, "", "en"), (5, " \n ", "de"),
    (6, SHARED * 3, "en"), (7, f"x{SHARED}y", "en"), (8, f"{SHARED}{SHARED}", "fr"), (9, LONG, "en"), (10, LONG + " end", "en"),
    (11, "日本語 ▁ 𝒳é", None), (12, "A the SAME text  twice.", "en"), (12, "A the SAME text  twice.", "en"),
    (None, "no id", "en"), (None, "no id", "en"), (None, SHARED, "en"), (13, "a" * 400, "en"), (14, "a" * 400, "en"), (2, SHARED + "z", "en"),
]
#: Columns that operators use names like.
CLASHES = ["block", "digest", "fp", "kept", "page", "sha", "_sha", "rest", "mark", "bucket", "rank", "model", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, f"s{k}", len(t or ""), *([k] * len(CLASHES))) for k, (i, t, lang) in enumerate(ODD)]
    names = ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, None), (6, 1, 0), (9, 0, 0), (10, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{TABLES}/documents.parquet").to_pylist()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ---------------------------------------------------------------- exact


def test_exact_groups(spark, odd):
    got = rows(exact.exact_groups(odd, shard_keys=4))
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [
        (i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD
    ]
    assert sorted(map(repr, (tuple(r.values()) for r in got))) == sorted(map(repr, expected))


def test_one_row_per_text_stays(spark, odd):
    left = exact.drop_copies(odd)
    assert left.columns == odd.columns
    kept = rows(left)
    assert sorted(r["text"] or "" for r in kept) == sorted({t or "" for _, t, _ in ODD})
    assert {r["doc_id"] for r in kept if r["text"] == "The same text twice."} == {2}
    assert all(r["_sha"] is not None for r in kept)


def test_index_takes_insertions_and_deletions(spark):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(100)], "doc_id bigint, text string")
    offers = exact.with_shard(exact.digests(docs).selectExpr("*", "1L as copies"), 3)
    index = common.stored(exact.update_index(None, offers), "index")
    assert index.count() == 40
    gone = exact.with_shard(exact.digests(docs.filter("doc_id < 10")), 3)
    left = exact.update_index(exact.with_shard(index, 3), offers.filter("doc_id = 99"), gone)
    found = {r["keep_id"]: r["group_size"] for r in rows(left)}
    assert len(found) == 30 and found[99] == 4


# ---------------------------------------------------------------- near copies


@pytest.mark.parametrize("pairwise", [4096, 4])
def test_links_connect_what_all_pairs_connect(spark, pairwise):
    rng = random.Random(8)
    values = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(base)
    values = sorted(values)
    near = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = rows(simhash.links(fps, pairwise=pairwise))
    at = {v: k for k, v in enumerate(signed)}
    edges = [(at[r["u"]], at[r["v"]]) for r in got]
    assert roots(len(values), edges) == roots(len(values), near)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, rng.randint(101, 400)) for _ in range(150)] + [(7, 7)]
    links += [(500 + rng.randint(0, 80), 500 + rng.randint(0, 80)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in rows(components.components(spark.createDataFrame(links, "u bigint, v bigint")))}
    up = roots(700, links)
    assert got == {n: up[n] for link in links if link[0] != link[1] for n in link}
    assert not rows(components.components(spark.createDataFrame([], "u bigint, v bigint")))


def test_near_groups(spark, odd):
    got = rows(simhash.near_groups(odd))
    prints = [simhash.fingerprint((t or "").encode()) for _, t, _ in ODD]
    near = [(a, b) for a in range(len(ODD)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    up = roots(len(ODD), near)
    first = {r: min((ODD[k][0] for k in range(len(ODD)) if up[k] == r and ODD[k][0] is not None), default=None) for r in set(up)}
    expected = [(ODD[k][0], f"{prints[k]:016x}", first[up[k]]) for k in range(len(ODD))]
    assert sorted(map(repr, (tuple(r.values()) for r in got))) == sorted(map(repr, expected))
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns


def test_each_row_follows_its_own_component(spark, odd):
    prints = [simhash.fingerprint((t or "").encode()) for _, t, _ in ODD]
    up = roots(len(ODD), [(a, b) for a in range(len(ODD)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    first = {r: min((ODD[k][0] for k in range(len(ODD)) if up[k] == r and ODD[k][0] is not None), default=None) for r in set(up)}
    expected = [k for k in range(len(ODD)) if ODD[k][0] == first[up[k]]]
    left = rows(simhash.drop_near_copies(odd))
    assert sorted(r["n"] for r in left) == expected
    assert (2, SHARED + "z") in [(r["doc_id"], r["text"]) for r in left]


# ---------------------------------------------------------------- language model


def brute_kneser_ney(texts, order):
    """Probability of a gram from counts in dictionaries, by the textbook."""
    counts = {order: Counter()}
    for t in texts:
        s = kneser_ney.START * (order - 1) + t + kneser_ney.END
        for i in range(len(s) - order + 1):
            counts[order][s[i:i + order]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4))
        if min(n1, n2, n3, n4) == 0:
            discounts[n] = [0, 0.5, 1.0, 1.5]
        else:
            y = n1 / (n1 + 2 * n2)
            discounts[n] = [0] + [min(max(k - (k + 1) * y * b / a, 0.1), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1) if counts[1] else 1.0
        lower = p(gram[1:])
        seen = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(seen.values())
        if not total:
            return lower
        d = discounts[n]
        freed = sum(d[min(c, 3)] for c in seen.values())
        c = seen.get(gram, 0)
        return ((c - d[min(c, 3)] if c else 0) + freed * lower) / total

    return p


def test_perplexities_against_the_textbook(spark):
    docs = [(i, " ".join(random.Random(i).choices(["ab", "ba", "abba", "c.", "bac"], k=12)), "en") for i in range(24)] + [(30, "", "en"), (31, "qx", "fr")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(16)], "doc_id bigint")
    got = {r["doc_id"]: r for r in rows(kneser_ney.perplexity(frame, trusted, order=3, folds=2))}
    fold = {r[0]: r[1] for r in frame.selectExpr("doc_id", "cast(pmod(shiftrightunsigned(xxhash64(doc_id), 40), 2) as int)").collect()}
    for doc_id, text, lang in docs:
        p = brute_kneser_ney([t for i, t, other in docs if i < 16 and fold[i] != fold[doc_id] and other == lang], 3)
        s = kneser_ney.START * 2 + text + kneser_ney.END
        events = [s[i:i + 3] for i in range(len(s) - 2)]
        assert got[doc_id]["n_events"] == len(events) == len(text) + 1
        assert got[doc_id]["bits"] == pytest.approx(-sum(math.log2(p(e)) for e in events) / len(events), rel=1e-9)
        assert got[doc_id]["trusted"] == (doc_id < 16)


def test_classifier_on_odd_rows(spark, odd, labels):
    got = rows(kneser_ney.classify(odd, labels))
    assert len(got) == len(ODD) and all(r["perplexity"] > 0 for r in got)
    assert all(r["kept"] for r in got if r["lang"] in ("", "de", "fr"))
    assert {r["threshold"] is None for r in got if r["lang"] == "en"} == {False}
    assert kneser_ney.drop_rejected(odd, labels).columns == odd.columns


def test_each_row_follows_its_own_verdict(spark):
    prose = [" ".join(random.Random(i).choices(["ab", "ba", "abba", "c.", "bac"], k=30)) for i in range(40)]
    data = [(i, t, "en") for i, t in enumerate(prose)] + [(3, "xq#" * 30, "en"), (3, "xq#" * 30, None), (None, "zz%" * 30, "en"), (None, prose[5], "en")]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    known = spark.createDataFrame([(i, 1, 0) for i in range(40) if i != 3], "doc_id bigint, quality int, toxic int")
    left = sorted(map(repr, (tuple(r.values()) for r in rows(kneser_ney.drop_rejected(frame, known, quantile=1.0)))))
    assert left == sorted(repr(r) for r in data if r not in ((3, "xq#" * 30, "en"), (None, "zz%" * 30, "en")))


def test_words_said_over_and_over_are_rejected(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices(["an", "the", "er", "on", "ti"], k=rng.randint(1, 4))) for _ in range(400)]
    prose = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    spam = [" ".join(w for w in rng.choices(words, k=5) for _ in range(12)) for _ in range(20)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + spam)], "doc_id bigint, text string, lang string")
    known = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(kneser_ney.classify(frame, known))}
    assert not any(got[i]["kept"] for i in range(200, 220))
    assert sum(r["perplexity"] <= r["threshold"] for i, r in got.items() if i >= 200) > 0  # characters alone let some pass
    assert sum(got[i]["kept"] for i in range(200)) >= 190


def test_classifier_tells_noise_from_held_out_text(spark):
    docs, known = spark.read.parquet(f"{TABLES}/../sf0.01/documents.parquet"), spark.read.parquet(f"{TABLES}/../sf0.01/labels.parquet")
    verdicts = kneser_ney.classify(docs, known).join(known, "doc_id").groupBy("quality").agg({"*": "count", "kept": "count_if"}).toPandas()
    share = {r["quality"]: r["count_if(kept)"] / r["count(1)"] for _, r in verdicts.iterrows()}
    assert share[1] > 0.95 and share[0] < 0.2


# ---------------------------------------------------------------- byte strings


def brute_cut(docs, length):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    seen, out = set(), {}
    for k in order:
        data = (docs[k][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (docs[k][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return list(out.values())


@pytest.mark.parametrize("frequent, bucket_bytes, block_bytes", [(20_000, 5_000_000, 12_000_000), (1, 2_000, 20_000)])
def test_cuts_against_all_strings(spark, monkeypatch, frequent, bucket_bytes, block_bytes):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(suffixes, "block_count", lambda n: common.block_count(n, block_bytes))
    monkeypatch.setattr(suffixes, "SHARD_HASHES", 500)
    docs = [(d["doc_id"], d["text"]) for d in documents()[:120]] + [(d["doc_id"] + 1000, f"{d['text'][50:700]} new") for d in documents()[:40]]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows(suffixes.cut_repeats(frame))]
    assert sorted(got) == sorted(brute_cut(docs, 100))


def test_cuts_of_odd_rows(spark, odd):
    got = rows(suffixes.cut_repeats(odd))
    assert len(got) == len(ODD)
    by_text = defaultdict(list)
    for r in got:
        by_text[r["doc_id"]].append(r["n_removed"])
    a = 13
    assert by_text[a] == [400 - 100 - 1 + 100] and by_text[14] == [400]  # from the second string on; a whole copy
    assert by_text[12] == [0, 0]
    left = suffixes.drop_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert all(r["n_chars"] == len(r["text"]) for r in rows(left))


# ---------------------------------------------------------------- packing


def test_pieces_are_placed_without_gaps_and_rebuild_the_tokens(spark, odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    model.encode_special_tokens = True
    placed = common.stored(packing.pack_documents(odd, BPE, capacity=64), "placed")
    filled = defaultdict(list)
    for r in rows(placed):
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    tokens = Counter(tuple(model.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in ODD)
    parts = defaultdict(list)
    got = Counter()
    for r in rows(placed):
        if r["doc_id"] is not None and [i for i, _, _ in ODD].count(r["doc_id"]) == 1:
            parts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for v in parts.values():
        got[tuple(x for _, ids in sorted(v) for x in ids)] += 1
    assert got and not got - tokens
    volume = sum(len(t) * n for t, n in tokens.items())
    assert sum(r["length"] for r in rows(placed)) == volume
    assert len(filled) <= -(-volume // 64) + 1
    whole = rows(packing.sequences(placed))
    assert len(whole) == len(filled) and sum(len(r["ids"]) for r in whole) == volume


# ---------------------------------------------------------------- pages


@pytest.fixture(scope="module")
def odd_pages(spark):
    page = "<html><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>Some words of a text.</p></article></body></html>"
    data = [(1, "http://A.Example.NET/en/x?q#f", page), (2, None, None), (3, "no scheme", ""), (4, "x://h", page), (4, "x://h", page),
            (None, "http://org/fr/1", page), (5, "http://sub.org/fr/1", "é" * 100_000), (6, "https://example.com/de/", "b\r\n\r\nc"), (7, "http://net?x", page)]
    return spark.createDataFrame([(*r, k, k) for k, r in enumerate(data)], "page_id bigint, url string, html string, page int, sha int")


def test_main_text(spark, odd_pages):
    got = rows(html.main_text(odd_pages))
    assert len(got) == 9
    assert {r["text"] for r in got if r["page_id"] in (1, 4, 7)} == {"Head\n\nSome words of a text."}
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (2, 3))


def test_url_rules(spark, odd_pages):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urls.judge(odd_pages))}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4][:3] == ("h", "", None)
    assert got[None] == ("org", "/fr/1", "org/fr/", "allow") and got[5][2] == "org/fr/"
    assert got[6] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[7][:3] == ("net", "", None)  # the rule's path is not the start of an empty one


def test_archives(spark, odd_pages):
    got = rows(warc.archive_report(odd_pages, segment_bytes=1000))
    assert len(got) == 9
    first = {r["page_id"]: r for r in got}
    assert first[1]["record_type"] == "response" and first[7]["record_type"] == "revisit" and first[7]["refers_to"] == 1
    assert [r["refers_to"] for r in got if r["page_id"] == 4] == [1, 1] and first[None]["refers_to"] == 1
    assert first[3]["refers_to"] == 2 and first[5]["payload_bytes"] == 200_000
    assert first[6]["payload_digest"] == warc.sha1_base32(b"b\r\n\r\nc")
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 4, 7)} == {first[1]["payload_bytes"]}


def test_broken_archives_are_told(spark, odd_pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(odd_pages.filter("page_id in (1, 5)"), path, segment_bytes=5000)
    texts = []
    import gzip
    from pathlib import Path

    for file in Path(path).glob("part-*"):
        texts.append(gzip.decompress(file.read_bytes()))
    records = [r for t in texts for r in t.split(b"WARC/1.1\r\n") if r]
    kept = [r for r in records if b"WARC-Segment-Number: 3\r\n" not in r]
    assert len(kept) == len(records) - 1
    broken = tmp_path / "b"
    broken.mkdir()
    (broken / "part-0").write_bytes(b"".join(b"WARC/1.1\r\n" + r for r in kept))
    got = {r["page_id"]: r for r in rows(warc.read_archives(spark, str(broken)))}
    assert got[1]["complete"] and not got[5]["complete"] and got[5]["payload"] is None


# ---------------------------------------------------------------- pieces and vectors


def test_piece_round_trip(spark, odd):
    got = rows(pieces.round_trip(odd, PIECES))
    assert len(got) == len(ODD) and all(r["same"] for r in got)
    back = rows(pieces.decode(pieces.encode(odd, PIECES), PIECES))
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, _ in ODD)


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    data = [(i, rng.normal(0, 1 + i % 3, 5).tolist()) for i in range(200)]
    data += [(300 + i, [1.0] * 5) for i in range(60)] + [(20, None), (40, [0.0] * 5), (None, [1.0] * 5), (60, [1.0, None, 1.0, 1.0, 1.0])]
    data += [(61, [float("nan")] * 5), (62, [float("inf")] * 5), (80, [1.0, 2.0]), (7, [1.0] * 5)]
    frame = spark.createDataFrame([(*r, 0) for r in data], "vec_id bigint, embedding array<double>, rank int")
    usable = [(i, v) for i, v in data if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    asked = {}
    for i, v in usable:
        if i % 20 == 0 and len(v) == 5:
            asked.setdefault(i, v)
    got = defaultdict(list)
    for r in sorted(rows(vptree.nearest(frame, frame.filter("vec_id % 20 = 0"), k=20, shard_rows=70)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i, q in asked.items():
        best = sorted((-vptree.scores(np.array([q]), np.array([v]))[0, 0], k) for k, v in usable if k != i and len(v) == 5)[:20]
        assert got[i] == [(k, -s) for s, k in best]


# ---------------------------------------------------------------- all


def test_token_counts_are_those_of_the_library(spark, odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    count = lambda t: len(model.encode(t or "", add_special_tokens=False).ids)
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(transducers.token_counts(odd, BPE))]
    expected = [(i, len((t or "").encode()), count(t), count(t) > 1024) for i, t, _ in ODD]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    query = rows(queries.QUERIES["op13_token_counts"](spark, TABLES))
    assert {r["doc_id"]: r["n_tokens"] for r in query} == {d["doc_id"]: count(d["text"]) for d in documents()}


def test_empty_tables(spark, odd, odd_pages, labels):
    none, no_pages = odd.limit(0), odd_pages.limit(0)
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    results = [
        exact.exact_groups(none), exact.drop_copies(none), simhash.near_groups(none), simhash.drop_near_copies(none),
        kneser_ney.classify(none, labels), kneser_ney.classify(none, labels.limit(0)), suffixes.cut_repeats(none),
        suffixes.drop_repeats(none), packing.pack_documents(none, BPE), transducers.token_counts(none, BPE), pieces.round_trip(none, PIECES), html.main_text(no_pages),
        urls.judge(no_pages), warc.archive_report(no_pages), vptree.nearest(vectors, vectors),
    ]
    assert all(not r.collect() for r in results)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op7_exact_dedup", "op8_warc_segments", "op10_vantage_point_search"])
def test_queries_with_sql(spark, name):
    from clipflow.llm.queries import ORACLES, QUERIES

    assert difference(QUERIES[name](spark, TABLES).toPandas(), connect(TABLES).sql(ORACLES[name]).df()) is None


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in rows(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, TABLES), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows(docs)}
        assert set(after) <= set(before)
        if name == "exact_dedup":
            keep = {t: i for i, t in sorted(before.items())}
            assert after == {i: t for t, i in keep.items()}
        elif name == "near_dedup":
            prints = {i: simhash.fingerprint(t.encode()) for i, t in before.items()}
            ids = sorted(before)
            near = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3]
            assert set(after) == {ids[r] for r in roots(len(ids), near)}
        elif name == "suffix_dedup":
            cut = {c[0]: c[4] for c in brute_cut(list(before.items()), 100)}
            whole = {i: t for i, t in after.items() if hashlib.sha256(t.encode()).hexdigest() == cut[i]}
            assert len(whole) > 0.9 * len(after)  # others lost the rest of a cut character
        else:
            assert all(before[i] == t for i, t in after.items())
        before = after
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert placed.select("doc_id").distinct().count() == docs.count()
