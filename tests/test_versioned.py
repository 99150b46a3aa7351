"""Commits that are whole or absent, conflicts, pinned readers, damaged files."""

import random

import pytest
from pyspark.sql import functions as F

from tonequarry.sources.versioned import Conflict, VersionedTable

SCHEMA = "accession long, cik long, status string, size double"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, seq int")


def test_upserts_against_force(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "accession", ["cik"], 4)
    assert table.read().collect() == [] and table.versions() == []
    r, state, history = random.Random(1), {}, []
    for version in range(1, 4):
        batch = [(r.randrange(40) if i else None, r.randrange(9), r.choice("abc"), float(i), i) for i in range(30)]
        assert table.upsert(changes(spark, batch), [F.desc("seq")]) == version
        for key in {b[0] for b in batch} - {None}:
            last = max((b for b in batch if b[0] == key), key=lambda b: b[4])
            state[key] = (key, state[key][1] if key in state else last[1], *last[2:4])
        history.append(dict(state))
    for version, want in enumerate(history, 1):
        assert {x.accession: tuple(x) for x in table.read(version).collect()} == want
    assert table.versions() == [1, 2, 3] and table.damaged().collect() == []
    assert table.upsert(changes(spark, []), [F.desc("seq")]) == 3
    with pytest.raises(ValueError, match="no version"):
        table.read(9)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "accession", [], 8)
    table.upsert(changes(spark, [(i, 1, "a", 1.0, 1) for i in range(100)]), [F.desc("seq")])
    before = table.manifest()["buckets"]
    table.upsert(changes(spark, [(5, 1, "b", 2.0, 1)]), [F.desc("seq")])
    after = table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 8


def test_interrupted_and_late_writers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    one, two = (VersionedTable(spark, folder, SCHEMA, "accession") for _ in range(2))
    one.upsert(changes(spark, [(1, 1, "a", 1.0, 1)]), [F.desc("seq")])
    pinned = one.read()

    def cut_off(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", cut_off)
        with pytest.raises(KeyboardInterrupt):
            one.upsert(changes(spark, [(1, 1, "half", 2.0, 1)]), [F.desc("seq")])
    assert [x.status for x in one.read().collect()] == ["a"] and one.versions() == [1]
    stale = two.manifest()
    one.upsert(changes(spark, [(1, 1, "first", 3.0, 1)]), [F.desc("seq")])
    with monkeypatch.context() as m:
        m.setattr(two, "manifest", lambda version=None: stale)
        with pytest.raises(Conflict):
            two.upsert(changes(spark, [(1, 1, "late", 4.0, 1)]), [F.desc("seq")])
    assert [x.status for x in two.read().collect()] == ["first"] and [x.status for x in pinned.collect()] == ["a"]
    assert not list((tmp_path / "t" / "versions").glob("_staged*"))
    assert two.upsert(changes(spark, [(1, 1, "late", 4.0, 1)]), [F.desc("seq")]) == 3


def test_damaged_files_are_found(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "accession", [], 2)
    table.upsert(changes(spark, [(i, 1, "a", 1.0, 1) for i in range(20)]), [F.desc("seq")])
    files = sorted(f["path"] for own in table.manifest()["buckets"].values() for f in own)
    with open(tmp_path / "t" / files[0], "ab") as f:
        f.write(b"x")
    assert [r.path for r in table.damaged().collect()] == files[:1]
    (tmp_path / "t" / files[1]).unlink()
    assert sorted(r.path for r in table.damaged().collect()) == files
