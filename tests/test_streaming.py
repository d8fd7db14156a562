"""Events: the step of the filter, the streams with a timer, and events out of a tree."""

import time

import pytest
from pyspark.sql import functions as F

from codestrata.engine import Engine
from codestrata.sources import files as source
from codestrata.streaming import events as E
from codestrata.streaming import tree as T


def test_admitted():
    see = None
    said = []
    for event, now in [("add", (1.0, 5, 10)), ("change", (1.0, 5, 99)), ("change", (2.0, 5, 12)), ("change", (3.0, 5, 20)), ("unlink", (3.0, 5, 20)), ("add", (3.0, 5, 20)), ("change", (None, None, None)), ("change", (None, 5, 20))]:
        ok, see = E.admitted(see, event, now, 5)
        said.append(ok)
    assert said == [True, False, False, True, True, True, True, True] and see == (None, 5, 20)


def run(spark, tmp_path, rounds, flow, wait=0.0):
    """Rows that a stream gives for files of events added one after the other."""
    folder = tmp_path / "in"
    folder.mkdir()
    got = []
    query = flow(spark.readStream.schema(E.EVENT).option("maxFilesPerTrigger", 1).json(str(folder))).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i, rows in enumerate(rounds):
            spark.createDataFrame(rows, E.EVENT.replace("ts timestamp", "ts string")).coalesce(1).write.mode("append").json(str(folder))
            if not wait:
                query.processAllAvailable()
            time.sleep(wait)
        end = time.time() + 40
        while wait and time.time() < end and len(got) < len({r[0] for rows in rounds for r in rows}):
            time.sleep(0.5)
    finally:
        query.stop()
    return [(r.path, r.event, r.lines) for r in got]


def test_unlink_with_the_mtime_last_seen_and_missing_values_pass(spark, tmp_path):
    t = "2024-01-01T00:00:0{}Z"
    rounds = [
        [("a", "add", t.format(1), 1.0, 9, 10), ("b", "add", t.format(1), 1.0, 9, 10), ("c", "change", t.format(1), None, None, None)],
        [("a", "unlink", t.format(2), 1.0, 9, 10), ("b", "change", t.format(2), 2.0, 9, 11), ("c", "change", None, None, None, None)],
        [("a", "add", t.format(3), 1.0, 9, 10), ("b", "change", t.format(3), 3.0, 9, 30), ("d", "unlink", t.format(3), None, None, None)],
    ]
    got = run(spark, tmp_path, rounds, lambda s: E.change_stream(s, 5))
    assert sorted(got, key=str) == sorted([("a", "add", 10), ("b", "add", 10), ("c", "change", None), ("a", "unlink", 10), ("c", "change", None), ("a", "add", 10), ("b", "change", 30), ("d", "unlink", None)], key=str)


def test_the_last_event_of_a_burst_goes_on_after_the_delay(spark, tmp_path):
    t = "2024-01-01T00:00:0{}Z"
    rounds = [
        [("a", "add", t.format(1), 1.0, 9, 10), ("a", "change", t.format(2), 2.0, 9, 50), ("b", "add", t.format(1), 1.0, 9, 1), ("c", "add", t.format(1), 1.0, 9, 1)],
        [("b", "unlink", t.format(2), 1.0, 9, 1)],
    ]
    got = run(spark, tmp_path, rounds, lambda s: E.change_stream(s, 5, 8000), wait=4.0)
    assert sorted(got) == [("a", "change", 50), ("b", "unlink", 1), ("c", "add", 1)]


def test_debounce_stream(spark, tmp_path):
    t = "2024-01-01T00:00:0{}Z"
    rounds = [[("a", "add", t.format(1), 1.0, 9, 10), ("a", "change", t.format(3), 2.0, 9, 50), ("a", "change", t.format(2), 7.0, 9, 40), ("b", "add", None, None, None, None)]]
    got = run(spark, tmp_path, rounds, lambda s: E.debounce_stream(s, 500), wait=1.0)
    assert sorted(got, key=str) == [("a", "change", 50), ("b", "add", None)]


@pytest.fixture
def src(tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "a.ts").write_text("export function a() {}\n")
    (root / "sub" / "b.ts").write_text("export function b() {}\n")
    (root / "c [x].ts").write_text("export function c() {}\n")
    return root


def test_tree_events_and_the_watcher(spark, src, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), str(src), languages=["ts"])
    e.index()
    tree = e.tree_events()
    assert tree.poll() == 0 and tree.poll() == 0
    (src / "a.ts").write_text("export function a() {}\nexport function more() {}\n" + "\n" * 9)
    (src / "sub" / "b.ts").unlink()
    (src / "d.ts").write_text("export function d() {}\n")
    assert tree.poll() == 1  # the deletion; the others may still be written
    assert e.tree_events().poll() == 2  # another process goes on
    tree = e.tree_events()
    assert tree.poll() == 0
    rows = {r.path: (r.event, r.lines) for r in spark.read.schema(E.EVENT).json(tree.events).collect()}
    assert rows == {"sub/b.ts": ("unlink", None), "a.ts": ("change", 12), "d.ts": ("add", 2)}
    e.watch(tree.stream(), once=True).query.awaitTermination()
    e.stop_watching()
    assert {r.name for r in e.tables["symbols"].collect()} == {"a", "more", "c", "d"}


def test_compare_waits_until_two_listings_agree(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, mtime double, size bigint")
    base = df([("same", 1.0, 1), ("gone", 1.0, 1), ("other", 1.0, 1)])
    now = df([("same", 1.0, 1), ("other", 2.0, 5), ("new", 1.0, 1), ("growing", 2.0, 9)])
    before = df([("same", 1.0, 1), ("other", 2.0, 5), ("new", 1.0, 1), ("growing", 2.0, 4)])
    assert {(r.path, r.event) for r in T.compare(base, before, now).collect()} == {("gone", "unlink"), ("other", "change"), ("new", "add")}


def test_an_update_reads_its_paths_alone(spark, src, tmp_path):
    found = source.read(spark, str(src), ["c [x].ts", "a.ts", "missing.ts", "sub"])
    assert {r.path for r in found.collect()} == {"a.ts", "c [x].ts"}
    assert {f.rsplit("/", 1)[1] for f in found.inputFiles()} == {"a.ts", "c%20%5Bx%5D.ts"}
    whole = source.scan(spark, str(src)).where("path = 'a.ts'").first()
    assert found.where("path = 'a.ts'").first() == whole
    assert source.read(spark, str(src), []).count() == 0
    seen = []
    e = Engine(spark, str(tmp_path / "s"), str(src), languages=["ts"], progress=lambda done, total: seen.append((done, total)))
    e.index()
    (src / "a.ts").write_text("export function z() {}\n")
    (src / "sub" / "b.ts").write_text("export function unread() {}\n")
    e.update_files(["a.ts"])
    assert {r.name for r in e.tables["symbols"].collect()} == {"z", "b", "c"} and seen == [(3, 3), (1, 1)]


def test_batch_windows_of_one_key(spark):
    rows = [("k", t, p) for t, p in [(0, "a"), (5, "b"), (5, "a"), (10, "a"), (19, "c"), (30, "d"), (39, "d"), (40, "d")]]
    got = E.batch_windows(spark.createDataFrame(rows, "k string, t bigint, p string"), "k", "t", "p", 10).collect()
    assert sorted((r.window_start, r.paths) for r in got) == [(0, ["a", "b"]), (10, ["a", "c"]), (30, ["d"]), (40, ["d"])]
    assert spark.range(0).select(F.lit(1)).count() == 0
