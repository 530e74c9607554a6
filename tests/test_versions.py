"""Versioned tables: which version is read, what a merge rewrites, and two drivers at once."""
import os

import pytest

from facetwise.sources.versions import VersionedTable, files_of, first_available, replaced_by_key


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file:{tmp_path}/table")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def data_files(table, version):
    for folder, files in table.manifest(version)["parts"].values():
        for name in files:
            yield f"{table.root}/{folder}/{name}".removeprefix("file:")


def test_newest_complete_version_is_read(spark, table):
    assert table.load() is None and table.latest() is None
    table.replace(frame(spark, [("a", 1)]))
    old = table.load()
    table.replace(frame(spark, [("a", 2), ("b", 3)]))
    table.replace(frame(spark, [("c", 4)]))
    assert table.versions() == [3, 2, 1] and got(table.load()) == [("c", 4)]
    assert got(old) == [("a", 1)]  # a query that began on an older version can end on it
    # damaged: a file of the newest has another length; unfinished: no manifest; half a manifest
    with open(next(data_files(table, 3)), "ab") as f:
        f.write(b"x")
    frame(spark, [("z", 9)]).write.parquet(f"{table.root}/data/unfinished")
    with open(f"{table.root}/_manifests/0000000004.json".removeprefix("file:"), "w") as f:
        f.write('{"parts": {"all": ["data/unf')
    assert got(table.load()) == [("a", 2), ("b", 3)] and table.latest()[0] == 2
    assert table.replace(frame(spark, [("d", 5)])) == 5 and got(table.load()) == [("d", 5)]


def test_unreadable_footer_counts_as_damaged(spark, table):
    table.replace(frame(spark, [("a", 1)]))
    table.replace(frame(spark, [("b", 2)]))
    path = next(data_files(table, 2))
    size = os.path.getsize(path)
    os.chmod(path, 0o644)
    with open(path, "wb") as f:
        f.write(b"\0" * size)
    os.path.exists(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc") and open(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc", "wb").close()
    assert got(table.load(check_footers=True)) == [("a", 1)]


def test_current_else_history(spark, table, tmp_path):
    current = VersionedTable(spark, f"file:{tmp_path}/current")
    assert first_available(current, table) is None
    table.replace(frame(spark, [("history", 1)]))
    assert got(first_available(current, table)) == [("history", 1)]
    current.replace(frame(spark, [("current", 1)]))
    assert got(first_available(current, table)) == [("current", 1)]


def test_merge_rewrites_touched_buckets_only(spark, table):
    rows = [(f"k{i}", i) for i in range(200)] + [(None, -1)]
    table.merge(frame(spark, rows), ["k"], replaced_by_key(["k"]), buckets=8)
    first = table.manifest(1)["parts"]
    table.merge(frame(spark, [("k7", 700), (None, -2), ("new", 1)]), ["k"], replaced_by_key(["k"]), buckets=99)
    second = table.manifest(2)["parts"]
    assert 1 <= sum(second[b] != first.get(b) for b in second) <= 3 and len(second) == 8
    want = {**dict(rows), "k7": 700, None: -2, "new": 1}
    assert got(table.load()) == sorted(want.items(), key=str)
    table.merge(frame(spark, []), ["k"], replaced_by_key(["k"]))
    assert got(table.load()) == sorted(want.items(), key=str)


def test_two_drivers_at_once(spark, table, monkeypatch):
    other = VersionedTable(spark, table.root)
    table.merge(frame(spark, [("a", 1), ("b", 1)]), ["k"], replaced_by_key(["k"]), buckets=1)
    commit, raced = VersionedTable._commit, []

    def late(self, *args):
        if self is table and not raced:
            raced.append(other.merge(frame(spark, [("b", 2), ("c", 2)]), ["k"], replaced_by_key(["k"])))
        return commit(self, *args)
    monkeypatch.setattr(VersionedTable, "_commit", late)
    assert table.merge(frame(spark, [("a", 3)]), ["k"], replaced_by_key(["k"])) == 3 and raced == [2]
    assert got(table.load()) == [("a", 3), ("b", 2), ("c", 2)]
    raced.clear()
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, *args: (raced.append(commit(other, args[0], {"all": ["data/none", {"x": 1}]}, {})) if not raced else None) or commit(self, *args))
    assert table.replace(frame(spark, [("r", 1)])) == 5 and got(table.load()) == [("r", 1)]


def test_listing_of_a_missing_folder(spark, tmp_path):
    assert files_of(spark, f"file:{tmp_path}/none") is None and files_of(spark, f"file:{tmp_path}") == {}
