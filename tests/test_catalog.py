"""The catalogue is complete and a sample of it agrees with its SQL."""

import os
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from newsweft.catalog import ORACLE, QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "P1_todays_articles", "X5_extract_body", "S12_post_links", "W6_upsert_failures", "A8_update_edges",
    "D1_parse_briefing", "U3_summarize",
]


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF).startswith("ok")


@pytest.mark.parametrize("name", ["M1_stream_filter_new", "M2_stream_failures"])
def test_streams_hold_late_and_undated_events(spark, name, tmp_path):
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f)
    events = pq.read_table(f"{SF}/events.parquet")
    n, ts = np.array(events["event_id"]), events["ts"]
    ts = pc.if_else(pa.array(n % 11 == 0), pc.add(ts, pa.scalar(timedelta(days=60), pa.duration(ts.type.unit))), ts)
    ts = pc.if_else(pa.array(n % 7 == 0), pa.scalar(None, ts.type), ts)
    os.remove(tmp_path / "events.parquet")
    pq.write_table(events.set_column(events.schema.get_field_index("ts"), "ts", ts.cast(events["ts"].type)), tmp_path / "events.parquet")
    assert compare(spark, connect(tmp_path), name, QUERIES[name], ORACLE[name], str(tmp_path)).startswith("ok")


def _with_documents(rows, tmp_path):
    for f in os.listdir(SF):
        if f != "documents.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    schema = pq.read_schema(f"{SF}/documents.parquet")
    pq.write_table(pa.Table.from_pylist([dict.fromkeys(schema.names) | r for r in rows], schema), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["S16_W14_briefing_files", "J10_unprocessed_briefings"])
def test_days_that_repeat_or_are_far_off_or_unknown(spark, name, tmp_path):
    days = [1, 1, 1, 1, 2, 2_925_593, 2_925_594, 9_000_000, -1, -726_500, -730_000, -760_000]
    days += [None, None] if name.startswith("S16") else []
    rows = [{"doc_id": d, "text": f"é{i % 3}\n", "n_chars": 4} for i, d in enumerate(days)]
    if name.startswith("S16"):
        rows += [{"doc_id": 3}, {"doc_id": 3}, {}, {"doc_id": 4, "text": ""}]
    sf_dir = _with_documents(rows, tmp_path)
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir).startswith("ok")
