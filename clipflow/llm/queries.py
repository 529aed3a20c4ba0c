"""The operators of this package as queries ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codes, exact, html, kneser_ney, packing, pieces, simhash, suffixes, transducers, urls, vptree, warc, whitening

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op7_exact_dedup", """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
""")
def op7(spark, sf):
    return exact.exact_groups(table(spark, sf, "documents"))


@query("op6_simhash")
def op6(spark, sf):
    return simhash.near_groups(table(spark, sf, "documents"))


@query("op1_quality_classifier")
def op1(spark, sf):
    return kneser_ney.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def byte_bpe() -> str:
    """The public byte-level vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_best_fit_packing")
def op3(spark, sf):
    packed = packing.pack_documents(table(spark, sf, "documents"), byte_bpe(), with_ids=False)
    return packed.drop("ids")


@query("op2_suffix_dedup", """
with texts as (
    select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n from documents
), strings as (
    select doc_id, p, md5(b[p + 1:p + 100]) as s from texts, unnest(range(0, n - 99)) as starts(p)
), later as (
    select doc_id, p from strings qualify row_number() over (partition by s order by doc_id, p) > 1
), apart as (
    select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 100, true)::int as opens from later
), numbered as (
    select doc_id, p, sum(opens) over (partition by doc_id order by p) as k from apart
), runs as (
    select doc_id, min(p) as a, max(p) + 100 as z from numbered group by doc_id, k
), pieces as (
    select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as low, a as high, z - a as gone from runs
    union all
    select t.doc_id, coalesce(max(r.z), 0), any_value(t.n), null
    from texts t left join runs r on r.doc_id = t.doc_id group by t.doc_id
)
select t.doc_id, any_value(t.n) as n_bytes, coalesce(sum(gone), 0)::bigint as n_removed, count(gone) as n_spans,
       sha256(unhex(string_agg(hex(t.b[low + 1:high]), '' order by low))) as kept_sha256
from texts t join pieces p on p.doc_id = t.doc_id group by t.doc_id
""")
def op2(spark, sf):
    return suffixes.cut_repeats(table(spark, sf, "documents")).drop("kept")


@query("op5_url_filter")
def op5(spark, sf):
    return urls.judge(table(spark, sf, "pages"))


@query("op10_vantage_point_search", """
with v as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
      and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id,
           list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score
    from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 20 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 20
""")
def op10(spark, sf):
    embeddings = table(spark, sf, "embeddings")
    return vptree.nearest(embeddings, embeddings.filter("vec_id % 20 = 0"), k=20)


@query("op8_warc_segments", """
with payloads as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages
), firsts as (
    select *, min(page_id) over (partition by html) as first from payloads
)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)) & 31) + 1)::int, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from firsts
""")
def op8(spark, sf):
    return warc.archive_report(table(spark, sf, "pages"))


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_sentencepiece")
def op9(spark, sf):
    return pieces.round_trip(table(spark, sf, "documents"), piece_bpe())


@query("op4_html_main_text")
def op4(spark, sf):
    return html.main_text(table(spark, sf, "pages"))


@query("op13_token_counts")
def op13(spark, sf):
    return transducers.token_counts(table(spark, sf, "documents"), byte_bpe())


def _code_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds of assignment and means, one after the other, as common table expressions."""
    gap = "list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))::bigint"
    steps = [f"""v as materialized (
    select vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) as e from embeddings
    where embedding is not null and len(embedding) > 0
      and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))
), x as materialized (
    select row_number() over () as r, * from (
        select vec_id, label, p, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] as c, rank as row
        from (select *, row_number() over (order by vec_id) as rank from v), range({parts}) as t(p))
), b0 as materialized (select p, row - 1 as k, c from x where row <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (
    select x.r, min_by(b.k, (d, b.k)) as k, min(d) as d
    from (select x.r, b.k, {gap} as d, x.p from x join b{n} b on b.p = x.p) b join x on x.r = b.r group by x.r
)""")
        if n < rounds:
            steps.append(f"""m{n} as (
    select p, k, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as c from (
        select x.p, a.k, u.i, sum(x.c[u.i]) as s, count(*) as n
        from x join a{n} a on a.r = x.r, unnest(range(1, len(x.c) + 1)) as u(i) group by x.p, a.k, u.i)
    group by p, k
), b{n + 1} as materialized (select b.p, b.k, coalesce(m.c, b.c) as c from b{n} b left join m{n} m on m.p = b.p and m.k = b.k)""")
    return f"""with {", ".join(steps)}, coded as (
    select row, any_value(vec_id) as vec_id, any_value(label) as label,
           string_agg(printf('%02x', k), '' order by p) as code, sum(d)::bigint as error
    from x join a{rounds} a on a.r = x.r group by row
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) from b{rounds}) as codebooks_sha256
from coded"""


@query("op11_vector_codes", _code_sql())
def op11(spark, sf):
    return codes.encode(table(spark, sf, "embeddings"))


@query("op12_whitening")
def op12(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))
