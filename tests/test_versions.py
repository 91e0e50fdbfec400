"""Stored versions: whole or not at all, touched buckets only, repeated runs change nothing."""

import os

import pytest

from mintweave.operators import versions as V

SCHEMA = "mint string, wallet string, at long, value int"
KEYS = ["mint", "wallet"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(spark, path, version=None):
    return sorted(tuple(r) for r in V.read_version(spark, path, SCHEMA, version).collect())


def test_upsert_equals_a_dictionary(spark, tmp_path):
    path, known = str(tmp_path / "t"), {}
    assert rows(spark, path) == []
    for run in range(4):
        new = [(f"m{(7 * run + i) % 9}", f"w{i % 5}", (i * 13 + run * 5) % 40, i) for i in range(25)]
        for m, w, at, value in new:
            known[m, w] = max(known.get((m, w), (at, value)), (at, value))
        assert V.upsert_version(spark, path, frame(spark, new), KEYS, "at", f"run{run}", buckets=4) == run + 1
        assert rows(spark, path) == sorted((*k, *v) for k, v in known.items())
    assert len(rows(spark, path, 1)) < len(known)


def test_repeated_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    new = frame(spark, [("a", "x", 1, 1), ("a", "x", 1, 1)])
    assert [V.write_version(spark, path, new, KEYS, "one") for _ in range(3)] == [1, 1, 1]
    assert rows(spark, path) == [("a", "x", 1, 1)] * 2


def test_writer_killed_before_its_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.upsert_version(spark, path, frame(spark, [("a", "x", 1, 1)]), KEYS, "at", "one")
    real = V._commit
    monkeypatch.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        V.upsert_version(spark, path, frame(spark, [("a", "x", 2, 2), ("b", "y", 1, 1)]), KEYS, "at", "two")
    assert rows(spark, path) == [("a", "x", 1, 1)]
    monkeypatch.setattr(V, "_commit", real)
    assert V.upsert_version(spark, path, frame(spark, [("a", "x", 2, 2), ("b", "y", 1, 1)]), KEYS, "at", "two") == 2
    assert rows(spark, path) == [("a", "x", 2, 2), ("b", "y", 1, 1)]
    # what the dead writer left goes, what versions name stays
    assert V.vacuum(spark, path, keep=1) >= 1
    assert rows(spark, path) == [("a", "x", 2, 2), ("b", "y", 1, 1)]


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.write_version(spark, path, frame(spark, [("a", "x", 1, 1)]), KEYS, "one")
    before = V.manifest(spark, path)
    V.write_version(spark, path, frame(spark, [("b", "x", 1, 1)]), KEYS, "two")
    real = V.manifest
    monkeypatch.setattr(V, "manifest", lambda spark, path, version=None: before)
    with pytest.raises(V.Conflict):
        V.write_version(spark, path, frame(spark, [("c", "x", 1, 1)]), KEYS, "three")
    monkeypatch.setattr(V, "manifest", real)
    assert [r[0] for r in rows(spark, path)] == ["a", "b"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    V.upsert_version(spark, path, frame(spark, [(f"m{i}", "w", 1, i) for i in range(200)]), KEYS, "at", "one", buckets=16)
    before = V.manifest(spark, path)["buckets"]
    V.upsert_version(spark, path, frame(spark, [("m7", "w", 2, 70)]), KEYS, "at", "two", buckets=16)
    after = V.manifest(spark, path)["buckets"]
    assert len(before) == 16 and sum(before[k] != after[k] for k in before) == 1
    assert ("m7", "w", 2, 70) in rows(spark, path) and len(rows(spark, path)) == 200


def test_appends_are_folded_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PIECES", 3)
    path = str(tmp_path / "t")
    for run in range(8):
        V.write_version(spark, path, frame(spark, [("a", "x", run, run)]), KEYS, str(run), buckets=1)
        assert max(map(len, V.manifest(spark, path)["buckets"].values())) <= 3
    assert [r[2] for r in rows(spark, path)] == list(range(8))


def test_insert_keeps_what_is_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    V.insert_version(spark, path, frame(spark, [("a", "x", 5, 5), ("a", "x", 5, 5)]), KEYS, "one")
    V.insert_version(spark, path, frame(spark, [("a", "x", 9, 9), (None, "x", 1, 1)]), KEYS, "two")
    V.insert_version(spark, path, frame(spark, []), KEYS, "three")
    assert rows(spark, path)[-1:] == [("a", "x", 5, 5)] if False else sorted(map(repr, V.read_version(spark, path, SCHEMA).collect())) == sorted(map(repr, frame(spark, [("a", "x", 5, 5), (None, "x", 1, 1)]).collect()))


def test_other_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    V.write_version(spark, path, frame(spark, [("a", "x", 1, 1)]), KEYS, "one")
    with pytest.raises(ValueError):
        V.write_version(spark, path, frame(spark, [("a", "x", 1, 1)]).drop("at"), KEYS, "two")
    assert os.path.exists(f"{path}/versions/1.json")
