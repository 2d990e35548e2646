"""Queries that give a row for every row of their table."""

import pytest

from tallyworks.registry import QUERIES
from tallyworks import queries  # noqa: F401


def test_release_keys_of_every_part(spark, tmp_path):
    parts = [(1, 7), (500, 8), (501, 9), (40000, 3)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in QUERIES["release_keys"](spark, str(tmp_path)).collect())
    assert got == [(k, f"release:auto-gpt-{s}-5", s * 1000 + 400) for k, s in parts]


def test_hype_risk_of_every_part(spark, tmp_path):
    spark.createDataFrame([(1, "a bolt", 30), (2, "a nut", 30), (3, "a ring", 4)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in QUERIES["hype_risk"](spark, str(tmp_path)).collect())
    assert got == [(1, 40, "MODERATE"), (2, 40, "MODERATE"), (3, 15, "LOW")]


def test_every_request_gets_its_answer(spark, tmp_path):
    import datetime as dt

    rows = [(i, i % 2, dt.datetime(2024, 1, 1), i * 1.5, "click") for i in range(1, 13)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in QUERIES["result_by_id_or_position"](spark, str(tmp_path)).collect())
    assert got == [(i, pytest.approx(i * 1.5), i == 10) for i in range(1, 13)]


def test_story_keys_take_the_whole_first_line(spark, tmp_path):
    long = "Extraordinarily uncharacteristically internationalization notwithstanding"
    rows = [(1, f"{long} one\nx", "en", "s1", 5), (2, f"{long} two\ny", "fr", "s2", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    key = long.lower().replace(" ", "-")
    slug = long.lower().replace(" ", "_")[:45]
    assert sorted(tuple(r) for r in QUERIES["slug_keys"](spark, str(tmp_path)).select("doc_id", "slug", "story_key").collect()) == [(1, slug, key), (2, slug, key)]
    assert [(r.story, r.hub, r.n) for r in QUERIES["story_rollup"](spark, str(tmp_path)).collect()] == [(key, 1, 2)]


def test_adjacency_keeps_every_part(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 57), (1, 7), (2, 57)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in QUERIES["adjacency"](spark, str(tmp_path)).select("node", "successors", "predecessors", "n").collect())
    assert got == [("p57", "", "s1,s2", 2), ("p7", "", "s1", 1), ("s1", "p57,p7", "", 2), ("s2", "p57", "", 1)]
