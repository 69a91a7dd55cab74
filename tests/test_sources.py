"""The file source prunes before it reads; verdicts and baselines live in keyed state; grammar kinds on small trees; results are written once."""

import os

import pytest
from pyspark.sql import functions as F

from arborq.sources import files, kinds


def tree(root, *paths, text="x = 1\n"):
    for p in paths:
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def test_files_prune_before_they_read(spark, tmp_path):
    """A pipe in a pruned folder would block whoever opens it."""
    root = str(tmp_path / "p")
    tree(root, "a.py", "pkg/b.py", "pkg/gen/c.py", "pkg/notes.txt", "env2/pyvenv.cfg", "env2/lib/d.py", "skip_me.py", "deep/skip/e.py", "deep/f.rs")
    tree(root, files.IGNORE_FILE, text="# rules\n\nskip_*.py\n/pkg/gen\n!kept\ndeep/skip/\n")
    os.makedirs(os.path.join(root, "node_modules"))
    os.mkfifo(os.path.join(root, "node_modules", "trap.py"))
    os.mkfifo(os.path.join(root, "pkg", "gen", "trap.py"))
    found = files.read_files(spark, [root])
    assert sorted(r.path for r in found.collect()) == ["a.py", "deep/f.rs", "pkg/b.py"]
    assert {r.path: r.language for r in found.collect()}["deep/f.rs"] == "rust"
    named = files.read_files(spark, [root, os.path.join(root, "skip_me.py")])
    assert sorted(r.path for r in named.collect()) == ["a.py", "deep/f.rs", "pkg/b.py", "skip_me.py"]
    folders = files.read_files(spark, [root], folders=True, contents=False).filter("is_dir")
    assert sorted(r.path for r in folders.collect()) == ["", "deep", "pkg"]
    flat = files.read_files(spark, [root], recursive=False)
    assert [r.path for r in flat.collect()] == ["a.py"]


def test_files_in_bounded_batches_and_one_cause_an_error(spark, tmp_path):
    root = str(tmp_path / "p")
    tree(root, *[f"m{i}.py" for i in range(7)], text="y" * 100)
    with open(os.path.join(root, "bad.py"), "wb") as f:
        f.write(b"\xff\xfe")
    found = files.read_files(spark, [root], batchbytes=250)
    assert found.rdd.getNumPartitions() == 4
    assert {r.path: r.error for r in found.collect() if r.error} == {"bad.py": "not_utf8"}
    assert files.read_strict(os.path.join(root, "none.py")) == (None, "not_found") and files.read_strict(root) == (None, "not_a_file")
    assert files.read_files(spark, [str(tmp_path / "absent")]).count() == 0


@pytest.mark.parametrize("path,rule,want", [("a/b.log", "*.log", True), ("build/x.py", "build", True), ("a/build/x.py", "build", True), ("a/c.py", "/c.py", False), ("c.py", "/c.py", True), ("a/b/c.py", "a/b", True), ("x/a/b/c.py", "a/b", False), ("ab.py", "?b.py", True), ("[a].py", "[a].py", True)])
def test_ignore_rules(path, rule, want):
    assert files.is_ignored(path, [rule]) == want


EVENTS = "file_id string, at timestamp, seq long, op string, snapshot_id string, mask int, simple double, composable double, secure double, navigable double"


def test_verdicts_in_keyed_state(spark, tmp_path):
    """Three batches, each a run of its own: last verdicts and baselines are found again, old baselines are stale and then gone."""
    from arborq.streaming import verdicts

    hour = lambda h: f"2024-01-01 00:00:00 + {h} h"  # noqa: E731, F841
    at = lambda h: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(hours=h)
    batches = [
        [("a", at(0), 1, "evaluate", None, 1, 0.5, None, None, None), ("a", at(0), 2, "begin", "s1", 1, 0.5, None, None, None), ("b", at(0), 1, "assess", "s9", 3, 0.5, 0.1, None, None)],
        [("a", at(2), 1, "evaluate", None, 3, 0.6, None, None, None), ("a", at(2), 2, "assess", "s1", 0, 0.4, None, None, None), ("b", at(2), 1, "evaluate", None, 1, 0.5, None, None, None)],
        [("a", at(24.5), 1, "assess", "s1", 7, 0.9, None, None, None), ("b", at(24.5), 1, "evaluate", None, 1, 0.7, None, None, None)],
        [("b", at(60), 1, "evaluate", None, 1, 0.7, None, None, None)],
        [("a", at(61), 1, "assess", "s1", 7, 0.9, None, None, None), ("b", at(61), 1, "evaluate", None, 1, 0.6, None, None, None)],
    ]
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    verdicts.state_store(spark)
    try:
        for rows in batches:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = verdicts.track(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"))
            out.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    found = verdicts.assessed(spark.read.schema(verdicts.RESULT).parquet(f"{tmp_path}/out"))
    got = sorted((r.file_id, r.at, r.seq, r.op, r.status, r.blocked_by) for r in found.collect())
    assert [(g[0], *g[3:]) for g in got] == [
        ("a", "evaluate", None, None), ("a", "begin", None, None), ("a", "evaluate", "improvement", None), ("a", "assess", "regression", None),
        ("a", "assess", None, "snapshot_stale"), ("a", "assess", None, "snapshot_not_found"),
        ("b", "assess", None, "snapshot_not_found"), ("b", "evaluate", None, None), ("b", "evaluate", "score_up", None), ("b", "evaluate", "lateral", None), ("b", "evaluate", "score_down", None),
    ]
    sets = {r.snapshot_id: (r.files, r.blocked, r.regressions, r.status) for r in verdicts.changesets(found).collect()}
    assert sets == {"s1": (3, 2, 1, "blocked"), "s9": (1, 1, 0, "blocked")}


def test_kinds_without_a_table_and_renumbering(spark):
    rows = [
        ("f", "cobol", "0", None, 0, 2, "program", None, True, ""), ("f", "cobol", "1", "0", 1, 1, ";", None, False, ";"), ("f", "cobol", "2", "0", 2, 2, "word", None, True, "x"),
        ("g", "rust", "0", None, 0, 4, "source_file", None, True, ""), ("g", "rust", "1", "0", 1, 1, "attribute_item", None, True, "#[cfg(test)]"), ("g", "rust", "2", "0", 2, 2, "attribute_item", None, True, "#[x]"),
        ("g", "rust", "3", "0", 3, 3, "mod_item", None, True, ""), ("g", "rust", "4", "0", 4, 4, "float", None, True, "1.0"),
    ]
    df = spark.createDataFrame(rows, "file_id string, language string, node_id string, parent_id string, pre long, last long, native_kind string, field string, named boolean, text string")
    got = sorted((r.file_id, r.node_id, r.pre, r.last, r.kind) for r in kinds.map_kinds(df).collect())
    assert got == [("f", "0", 0, 1, "Unknown"), ("f", "2", 1, 1, "Unknown"), ("g", "0", 0, 2, "File"), ("g", "2", 1, 1, "Unknown"), ("g", "4", 2, 2, "Literal")]
    assert kinds.map_kinds(df.filter(F.lit(False))).count() == 0


def test_freshness_by_the_first_rung_that_can_tell(spark, tmp_path):
    from arborq.sources import discovery

    root = str(tmp_path / "p")
    tree(root, "a.py", "pkg/b.py")
    for path, when in (("a.py", 1000.0), ("pkg/b.py", 1500.0), ("pkg", 1400.0), ("", 1200.0)):
        os.utime(os.path.join(root, path), (when, when))
    rows = lambda: files.read_files(spark, [root], folders=True, contents=False)
    said = lambda marker, current=None: tuple(discovery.freshness(rows(), marker, current or {}).first())
    assert said({"source_hash": "x", "head_sha": "1"}, {"source_hash": "x", "head_sha": "2"}) == (True, "source_hash", None)
    assert said({"source_hash": "x"}, {"source_hash": "y"}) == (False, "source_hash", None)
    assert said({"head_sha": "1", "made": 9e9}, {"head_sha": "2"}) == (False, "head_sha", None)
    assert said({"head_sha": "1"}, {"head_sha": "1"}) == (True, "head_sha", None)
    assert said({"made": 1502.0}) == (True, "modified", None) and said({"made": 1501.9}) == (False, "modified", "pkg/b.py")
    os.utime(os.path.join(root, "pkg"), (1600.0, 1600.0))  # a file of it was deleted
    assert said({"made": 1550.0}) == (False, "modified", "pkg")
    assert said({}, {"graph_changed": 5.0, "head_changed": 6.0}) == (False, "graph_time", None) and said(None) == (True, "graph_time", None)
    # the marker file's time tells the file system's clock: 3 s behind, in whole seconds and in parts
    assert discovery.built_before(100.5, 110.5, 107.5) == 97.5 and discovery.built_before(100.5, 110.5, 107.0) == 97.0 and discovery.built_before(100.0, 9000.0, 1.0) == 98.0


def test_unknown_nodes_are_left_out_where_asked(spark):
    from arborq.operators import compare, coverage, tree as trees

    rows = [(1, str(i), None if i == 0 else "0", i, 3 if i == 0 else i, k) for i, k in enumerate(["FunctionDecl", "IfStmt", "Unknown", "Unknown"])] + [(2, "0", None, 0, 0, "Unknown")]
    df = spark.createDataFrame(rows, "file_id int, node_id string, parent_id string, pre long, last long, kind string")
    kinds_of = lambda flag: {r.file_id: list(r.kinds) for r in trees.kind_sequence(df, flag).collect()}
    assert kinds_of(True)[1] == ["FunctionDecl", "IfStmt", "Unknown", "Unknown"] and kinds_of(False) == {1: ["FunctionDecl", "IfStmt"], 2: []}
    prints = lambda flag: {(r.kind, r.n) for r in coverage.fingerprints(df, flag).collect()}
    assert prints(True) == {("IfStmt", 1), ("Unknown", 2)} and prints(False) == {("IfStmt", 1)}
    other = df.filter("kind <> 'IfStmt'")
    got = lambda flag: {r.file_id: (round(r.kind_distance, 6), r.raw, round(r.edit_distance, 6)) for r in compare.compare_trees(df, other, flag).collect()}
    assert got(False) == {1: (0.5, 1, 0.5), 2: (0.0, 0, 0.0)} and got(True) == {1: (0.25, 1, 0.25), 2: (0.0, 0, 0.0)}
