"""Every query against its SQL on the same tables, with and without hot keys."""

import pytest

from conftest import TABLES
from workload.compare import connect, difference
from workload.oracles import ORACLES
from workload.queries import QUERIES

HOT = [
    "frame_numbering", "clip_frame_members", "head_by_time", "word_chunks", "caption_join",
    "hierarchical_summary", "oneshot_summary", "head_summary", "srt_document", "active_video", "chat_history", "chat_questions",
]


@pytest.fixture(scope="module")
def sql():
    return connect(TABLES)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    assert difference(QUERIES[name](spark, TABLES).toPandas(), sql.sql(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", HOT)
def test_query_with_hot_keys(spark, sql, setting, name):
    from clipflow.session import HOT_ROWS

    setting(HOT_ROWS, 30 if name in ("frame_numbering", "clip_frame_members", "head_by_time") else 1)
    assert difference(QUERIES[name](spark, TABLES).toPandas(), sql.sql(ORACLES[name]).df()) is None
