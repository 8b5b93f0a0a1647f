"""Registered queries over a small table of events, beside their SQL in DuckDB."""

from __future__ import annotations

import random

import duckdb
import pytest

from tidemark import archive_queries, queries  # noqa: F401 - registers its queries
from tidemark.operators import lifetime
from tidemark.sources import events as E


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(17)
    rows = [(i, rng.choice((3, 13, *range(40))), rng.choice(E.SLOTS), rng.choice((None, round(rng.uniform(-9, 9), 2)))) for i in range(900)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, tables, name):
    """A query's rows and its SQL's, sorted, with columns in the same order."""
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tables}/events.parquet/*.parquet')")
    found = queries.QUERIES[name](spark, tables)
    other = db.sql(queries.SQL[name])
    assert sorted(found.columns) == sorted(other.columns)
    rows = [tuple(r) for r in found.select(*other.columns).collect()]
    return sorted(rows, key=repr), sorted(other.fetchall(), key=repr)


def test_whole_key_history(spark, tables):
    rows, want = both(spark, tables, "ext_key_history_whole")
    assert rows == want
    assert {r[0] for r in rows} == set(range(40))
    pinned, _ = queries._snapshot(spark, tables)
    some = pinned.history(queries.F.col("address").isin(13, 20))
    assert sorted(map(tuple, some.collect()), key=repr) == [r for r in rows if r[0] in (13, 20)]


@pytest.mark.parametrize("name", ["account_as_of_events", "storage_as_of_events", "code_as_of_events"])
def test_a_probe_an_event(spark, tables, name):
    rows, want = both(spark, tables, name)
    assert rows == want and len(rows) == 900
    assert {r[1] for r in rows} > set(range(40))


@pytest.mark.parametrize("name", ["publish_roundtrip", "streaming_ingest", "archive_storage", "archive_rpc", "keccak_vectors", "selector_forms"])
def test_published_history(spark, tables, name):
    rows, want = both(spark, tables, name)
    assert rows == want and rows


@pytest.mark.parametrize("width", [1, 7, 4096])
@pytest.mark.parametrize("name", ["ext_key_history_whole", "lifetime_incarnations", "lifetime_from_replay_flags"])
def test_lives_do_not_depend_on_ranges(spark, tables, monkeypatch, name, width):
    monkeypatch.setattr(lifetime, "RANGE", width)
    rows, want = both(spark, tables, name)
    assert rows == want and rows


def test_lives_of_flags_that_contradict_each_other(spark, monkeypatch):
    monkeypatch.setattr(lifetime, "RANGE", 3)
    rng = random.Random(5)
    rows = [(k, b, rng.random() < 0.6, rng.random() < 0.6, rng.random() < 0.4) for k in (None, 1, 2) for b in sorted(rng.sample(range(60), 30))]
    want, last = [], {}
    for k, b, previous, exists, wiped in rows:
        before, life = last.get(k, (None, 0))
        life += (before is False and exists) + (exists and previous and wiped)
        want.append((k, b, life, before is None or before == previous))
        last[k] = (exists, life)
    frame = spark.createDataFrame(rows, "address long, block long, previous_exists boolean, exists boolean, wiped boolean")
    found = lifetime.incarnations_of_flags(frame).select("address", "block", "incarnation", "consistent")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert lifetime.incarnations_of_flags(frame.limit(0)).count() == 0


def test_bloom_shards_follow_the_number_of_keys(spark, tables, monkeypatch):
    asked, build, probe = [], queries.bloom.build_summary, queries.bloom.may_contain
    monkeypatch.setattr(queries.scalars, "SHARD_KEYS", 16)
    monkeypatch.setattr(queries.bloom, "build_summary", lambda keys, shards, **kw: asked.append(shards) or build(keys, shards, **kw))
    monkeypatch.setattr(queries.bloom, "may_contain", lambda keys, summary, shards: asked.append(shards) or probe(keys, summary, shards))
    n = queries._keys(spark, tables).distinct().count()
    assert queries.QUERIES["bloom_no_false_negatives"](spark, tables).count() == 0
    assert asked[0] == asked[1] > 4 and asked[0] // 2 < n / 16 <= asked[0]


@pytest.mark.parametrize("name", ["storage_as_of", "account_as_of", "rpc_batch"])
def test_only_versions_that_probes_ask_for_are_derived(spark, tables, monkeypatch, name):
    derived, versions = [], E.account_versions
    monkeypatch.setattr(queries, "PROBES", 3)
    monkeypatch.setattr(E, "account_versions", lambda events: derived.append(versions(events)) or derived[-1])
    rows = queries.QUERIES[name](spark, tables).collect()
    assert len(rows) == 3 and derived[-1].select("address").distinct().count() <= 3
    monkeypatch.setattr(queries, "_asked", queries._snapshot)
    assert sorted(map(tuple, queries.QUERIES[name](spark, tables).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ["bloom_no_false_negatives", "bloom_false_positives"])
def test_the_history_is_read_once_for_a_summary(spark, tables, monkeypatch, name):
    """Keys and bits are made once and read from files after that."""
    labels, stage = [], queries.bloom.stage
    for module in (queries, archive_queries, queries.bloom):
        monkeypatch.setattr(module, "stage", lambda df, label: labels.append(label) or stage(df, label))
    found = queries.QUERIES[name](spark, tables)
    assert labels.count("bloom-keys") == 1 and labels.count("bloom-summary") == 1
    files = found._jdf.queryExecution().executedPlan().toString()
    assert "bloom-summary" in files and "events.parquet" not in files


def test_jobs_of_a_publication_do_not_grow_with_its_packages(spark, tables, monkeypatch):
    counts = []
    for n in (6, 18):
        monkeypatch.setattr(archive_queries, "PACKAGES", n)
        spark.sparkContext.setJobGroup(f"publish {n}", "")
        archive = archive_queries.published(spark, tables)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"publish {n}")))
        assert archive.describe()["published_block"] == 89
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < counts[1] < 1.5 * counts[0]
