"""Vector codes and whitening against brute force, and on rows of every awkward kind."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clipflow.llm import codes, queries, whitening
from conftest import TABLES
from workload.compare import connect, difference

NAN, INF = float("nan"), float("inf")
#: id, vector, label; vectors of eight components but for one.
VECTORS = [
    (1, [0.5, -0.25, 3.0, 1.0, -1.0, 2.0, 0.0, 0.125], "a"), (2, None, "a"), (3, [], "a"), (4, [1.0, None] * 4, "a"),
    (5, [NAN] * 8, None), (6, [INF, 1.0] * 4, None), (7, [-0.0, 0.0] * 4, None), (7, [-0.0, 0.0] * 4, "b"), (8, [1e-9, -1e-9] * 4, ""),
    (None, [2.0, 1.0] * 4, "b"), (None, [2.0, 1.0] * 4, None), (9, [1.0, 2.0, 3.0, 4.0], "b"), (10, [5.0, 4.0, 3.0, 2.0, 1.0, 0.0, -1.0, -2.0], "b"),
    (11, [0.5, -0.25, 3.0, 1.0, -1.0, 2.0, 0.0, 0.125], None),
]
SCHEMA = "vec_id bigint, embedding array<double>, label string, code string, n bigint, size bigint, ints binary, place int"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, b"y", 3) for i, v, label in vectors], SCHEMA).repartition(3)


def usable(vectors, scale):
    """(id, integers, label) of the rows that take part, in the order of first codebooks."""
    fine = [(i, [int(np.floor(scale * c)) for c in v], label) for i, v, label in vectors
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    return [r for r in fine if len(r[1]) == len(fine[0][1])]


def brute_codes(vectors, parts, entries, rounds, scale):
    known = usable(vectors, scale)
    x = np.array([v for _, v, _ in known])
    cuts = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cuts]

    def nearest():
        gaps = [((c[:, None] - b[None]) ** 2).sum(-1) for c, b in zip(cuts, books)]
        return [g.argmin(1) for g in gaps], sum(g.min(1) for g in gaps)

    for _ in range(rounds):
        for book, c, entry in zip(books, cuts, nearest()[0]):
            for e in set(entry.tolist()):
                book[e] = c[entry == e].sum(0) // (entry == e).sum()
    entry, error = nearest()
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(known, error.tolist()):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{p[k]:02x}" for p in entry), int(error[k]), by_label[label], digest) for k, (i, _, label) in enumerate(known)]


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("entries, listed", [(256, 32), (3, 1), (1, 4), (4, 3)])
def test_codes_of_odd_vectors(spark, entries, listed):
    got = [tuple(r.values()) for r in rows(codes.encode(frame(spark, VECTORS), entries=entries, rounds=3, listed=listed))]
    assert order(got) == order(brute_codes(VECTORS, 4, entries, 3, 1024))


def clustered(seed, n, dim, kinds):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim))
    return [(k, (centres[rng.integers(kinds)] + rng.normal(scale=0.05, size=dim)).round(2).tolist(), str(k % 3)) for k in range(n)]


@pytest.mark.parametrize("scale", [1024, 3])  # at the smaller one many parts are equally near
def test_codes_of_clusters_by_bounds(spark, monkeypatch, scale):
    seen = []
    train = codes.train
    monkeypatch.setattr(codes, "train", lambda *a, **k: seen.append(train(*a, **k)) or seen[-1])
    vectors = clustered(5, 900, 8, 12)
    got = [tuple(r.values()) for r in rows(codes.encode(frame(spark, vectors), entries=64, rounds=4, scale=scale))]
    assert order(got) == order(brute_codes(vectors, 4, 64, 4, scale))
    state, _, lengths = seen[0]
    assert lengths[0] == 32 and lengths[-1] < 32  # lists have shrunk
    needs = np.stack([np.frombuffer(r["need"], np.uint8) for r in state.select("need").collect()])
    # most parts were left alone by their bounds, or compared with few; with many ties only the latter
    assert (needs == 0).mean() > (0.5 if scale == 1024 else 0.1) and (needs <= lengths[-2]).mean() > 0.9


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 20), st.integers(1, 12), st.integers(0, 6), st.integers(1, 4))
def test_bounds_hold_while_entries_move(seed, n, k, listed, span):
    rng = np.random.default_rng(seed)
    ints = rng.integers(-span, span + 1, size=(n, 3)).astype(np.int32)
    entries = rng.integers(-span, span + 1, size=(k, 3))
    known = codes.Bounds(ints, entries, listed)
    known.assign()
    for _ in range(4):
        exact = codes.squared(ints, entries)
        assert known.entry.tolist() == exact.argmin(1).tolist()
        root = np.sqrt(exact)
        assert (known.upper >= root[np.arange(n), known.entry]).all()
        away = np.ones((n, k), bool)
        away[np.arange(n), known.entry] = False
        for j in range(known.listed):
            assert (known.lower[:, j] <= root[np.arange(n), known.order[:, j]]).all()
            away[np.arange(n), known.order[:, j]] = False
        assert (np.where(away, root, np.inf).min(1) >= known.outer).all()
        after = entries + rng.integers(-1, 2, size=entries.shape) * (rng.random(entries.shape) < 0.3)
        held = np.concatenate([known.upper[:, None], known.lower, known.outer[:, None]], axis=1).astype("<f4")
        entry, listing = known.entry.astype(np.uint8), known.order.astype(np.uint8)
        known = codes.Bounds(ints, after, max(0, known.listed - int(rng.integers(0, 2))))
        known.resume(entry, listing, held, np.sqrt(((after - entries) ** 2).sum(1)) * (1 + 1e-12))
        known.assign()
        entries = after


def test_exact_distances_of_large_integers():
    top = codes.LARGEST - 1
    left, right = np.array([[top, -top, top]]), np.array([[-top, top, 1 - top], [top, -top, top]])
    assert codes.squared(left, right).tolist() == [[8 * top * top + (2 * top - 1) ** 2, 0]]
    with pytest.raises(ValueError):
        codes.encode(None, entries=300)


def test_query_codes_against_sql(spark):
    sql = connect(TABLES).sql(queries.ORACLES["op11_vector_codes"]).df()
    assert difference(queries.QUERIES["op11_vector_codes"](spark, TABLES).toPandas(), sql) is None


# ---------------------------------------------------------------- whitening


def brute_whitening(vectors, scale, count):
    known = usable(vectors, scale)
    fit = np.array(sorted({tuple(v) for _, v, _ in known}), object)
    n, total = len(fit), fit.sum(0)
    wide = np.array((n * fit - total).tolist(), float) / n
    _, scales, right = np.linalg.svd(wide, full_matrices=False)
    kept = min(count, int((scales > 1e-9 * scales[0]).sum()) if scales[0] > 0 else 0)
    variance = scales ** 2 / n
    out = {}
    for k, (i, v, _) in enumerate(known):
        gap = n * np.array(v, object) - total
        out[k] = (i, int((gap * gap).sum()), [float(np.dot(gap.astype(float) / n, right[c])) / variance[c] ** 0.5 for c in range(kept)])
    return n, list(out.values()), [variance[c] / variance.sum() for c in range(kept)]


def check_whitening(found, vectors, scale=256, count=4, rel=1e-8):
    n, expected, shares = brute_whitening(vectors, scale, count)
    assert len(found) == len(expected) * len(shares)
    assert all(r["n"] == n and r["identity_error"] < 1e-6 for r in found)
    signs = {}
    for c, share in enumerate(shares, 1):
        own = [r for r in found if r["component"] == c]
        assert all(r["explained"] == pytest.approx(share, rel=1e-6) for r in own)
        key = lambda i, d, w: (i is None, i, d, round(w, 6))
        best = None
        for sign in (1, -1):
            a = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in own), key=lambda r: key(*r))
            b = sorted(((i, d, sign * w[c - 1]) for i, d, w in expected), key=lambda r: key(*r))
            if [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], rtol=rel, atol=1e-7):
                best = sign
        assert best is not None
        signs[c] = best


def test_whitening_of_odd_vectors(spark):
    check_whitening(rows(whitening.whiten(frame(spark, VECTORS))), VECTORS)


def test_whitening_of_clusters_and_little_rank(spark):
    rng = np.random.default_rng(2)
    wide = [(k, (rng.normal(size=12) * 2.0 ** -np.arange(12)).tolist(), None) for k in range(400)]
    check_whitening(rows(whitening.whiten(frame(spark, wide + wide[:50]))), wide + wide[:50])
    base = rng.integers(-5, 6, size=(40, 2)) / 16
    flat = [(k, [a, b, a + b, a - b, 2 * a, 0.0, 1.0, b], None) for k, (a, b) in enumerate(base.tolist())]
    check_whitening(rows(whitening.whiten(frame(spark, flat))), flat)


def test_whitening_without_variance(spark):
    one = [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)]
    assert whitening.whiten(frame(spark, one)).collect() == []
    none = frame(spark, [(1, None, None)])
    assert whitening.whiten(none).collect() == [] and codes.encode(none).collect() == []
    assert whitening.whiten(none.limit(0)).collect() == [] and codes.encode(none.limit(0)).collect() == []


def test_deviations_are_exact():
    ints = np.array([[3, -4], [1 << 25, 0]], np.int32)
    assert whitening.deviations(ints[:1], 10, [5, -7]) == [25 ** 2 + 33 ** 2]
    n = 10 ** 9
    assert whitening.deviations(ints, n, [3 * n, -4 * n]) == [0, None]


def test_cholesky_shifts_only_where_it_must():
    gram = np.diag([4.0, 9.0])
    assert np.allclose(whitening.cholesky(gram), np.diag([2.0, 3.0]), atol=0, rtol=1e-15)
    lacking = np.ones((3, 3))
    factor = whitening.cholesky(lacking)
    assert np.allclose(factor.T @ factor, lacking, atol=1e-9) and (np.diag(factor) > 0).all()


def test_query_whitening(spark):
    import pyarrow.parquet as pq

    vectors = [(r["vec_id"], r["embedding"], None) for r in pq.read_table(f"{TABLES}/embeddings.parquet").to_pylist()]
    check_whitening(rows(queries.QUERIES["op12_whitening"](spark, TABLES)), vectors)
