"""Finding and reading source files: suffixes, pruned directories, ignore files, strict text, fingerprints."""

from __future__ import annotations

import hashlib
import posixpath
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages and their file suffixes.
SUFFIXES = {
    "python": (".py",), "rust": (".rs",), "javascript": (".js", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), "go": (".go",),
}
#: Directories that hold no sources of their own.
PRUNED = (
    ".git", ".gitnexus", ".hg", ".svn", ".venv", "venv", "venv.bak", "env", "__pycache__", "__pypackages__", "node_modules", "dist", "build", "out", "target",
    ".next", ".turbo", "coverage", "htmlcov", ".pytest_cache", ".mypy_cache", ".tox", ".ruff_cache", ".eggs", ".pixi",
)
#: Files that mark their folder as a virtual environment.
ENVIRONMENT = ("pyvenv.cfg", "bin/python", "bin/python3", "Scripts/python.exe")
DEFAULT_LANGUAGE = "python"


def language_of(path: Column, default: str | None = DEFAULT_LANGUAGE) -> Column:
    """By suffix; the default for an unknown one."""
    out = F.lit(None).cast("string")
    for lang, ends in SUFFIXES.items():
        out = F.when(path.rlike("(" + "|".join(re.escape(e) for e in ends) + ")$"), lang).otherwise(out)
    return F.coalesce(out, F.lit(default)) if default else out


def pruned(path: Column) -> Column:
    """Whether a directory on the path is pruned."""
    return path.rlike("(^|/)(" + "|".join(re.escape(d) for d in PRUNED) + ")/")


def environments(paths: DataFrame) -> DataFrame:
    """(dir): folders that hold a virtual environment, of a table of all paths (path), whatever their suffix."""
    found = None
    for mark in ENVIRONMENT:
        own = paths.filter((F.col("path") == mark) | F.endswith("path", F.lit("/" + mark))).select(F.expr(f"left(path, greatest(0, length(path) - {len(mark) + 1}))").alias("dir"))
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def outside(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files (path) that lie in none of the folders (dir): each path meets the folders by its own enclosing folders, so by equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inside = files.select("path", F.explode(above).alias("dir")).join(dirs, "dir", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def glob_pattern(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def ignore_patterns(lines: list[str]) -> list[str]:
    """Patterns of an ignore file: blanks, # and ! lines are skipped and a trailing / goes; a rule with / is anchored at the root, a bare
    name fits any segment of a path."""
    out = []
    for line in lines:
        rule = line.strip()
        if not rule or rule[0] in "#!":
            continue
        rule = rule.rstrip("/")
        anchored = rule.startswith("/")
        rule = rule.lstrip("/")
        if anchored or "/" in rule:
            out.append(f"^{glob_pattern(rule)}(/.*)?$")
        else:
            out.append(f"(^|/){glob_pattern(rule)}(/.*)?$".replace(".*(", "[^/]*("))
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    patterns = ignore_patterns(lines)
    return path.rlike("|".join(f"({p})" for p in patterns)) if patterns else F.lit(False)


def scan(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] | None = None, ignore: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """files (file_id, path, language, source, n_bytes, is_parseable, modified) under the roots, each path once.

    Text is read strictly: a file that is no valid UTF-8 has a null source and is not parseable. Executors read the files.
    """
    suffixes = suffixes or tuple(e for ends in SUFFIXES.values() for e in ends)
    raw = None
    for root in roots:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        part = part.withColumn("rel", F.regexp_replace("path", "^.*?" + re.escape(re.sub("^[a-z0-9+.-]+:/+", "/", root).rstrip("/")) + "/?", ""))
        raw = part if raw is None else raw.unionByName(part)
    own = raw.filter(F.col("rel").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$") & ~pruned(F.col("rel")))
    if ignore:
        own = own.filter(~ignored(F.col("rel"), ignore))
    own = own.dropDuplicates(["path"])
    listed = raw.select(F.col("rel").alias("path"))  # no contents are read for this
    own = outside(own.withColumnRenamed("path", "full").withColumnRenamed("rel", "path"), environments(listed)).withColumnRenamed("path", "rel").withColumnRenamed("full", "path")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return own.select(F.sha1("path").alias("file_id"), F.col("rel").alias("path"), language_of(F.col("rel")).alias("language"), text.alias("source"), F.col("length").alias("n_bytes"), text.isNotNull().alias("is_parseable"), F.col("modificationTime").alias("modified"))


#: Lines that a file of imports and exports may have, by language; comments may stand anywhere.
COMMENTS = ("//", "/*", "*")
SCRIPT_LINES = ("import ", "export *", "export {", "export type ", "export interface ", "#!")
ENTRY_LINES = {
    "typescript": SCRIPT_LINES,
    "javascript": SCRIPT_LINES,
    "rust": ("use ", "pub use ", "pub mod ", "mod ", "extern crate ", "#!", "#["),
    "cpp": ("#include", "#pragma once"),
}
PYTHON_LINES, PYTHON_OPENING, PYTHON_WHOLE = ("#", "import ", "from ", "__all__", "'", '"'), ("import ", "from ", "__all__"), ("[", "]", "(", ")")


def _starts(line: Column, heads: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(line, F.lit(h)) for h in heads])


def entrypoint(path: Column, source: Column, language: Column) -> Column:
    """A file named like an entry point that only imports, exports and comments; an empty file is none.

    Python statements that open a bracket go on until it is closed; the state is folded over the lines.
    """
    name = F.element_at(F.split(path, "/"), -1)
    low = F.lower(name)
    hint = F.when(language == "python", name == "__init__.py").when(language == "rust", name.isin("mod.rs", "lib.rs")).when(language == "typescript", low.isin("index.ts", "index.tsx"))
    hint = hint.when(language == "javascript", low.isin("index.js", "index.mjs", "index.cjs")).when(language == "cpp", low.rlike("\\.(hpp|hh|hxx)$")).otherwise(False)
    lines = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), "\n"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")
    comment = lambda x: _starts(x, COMMENTS) | F.endswith(x, F.lit("*/"))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    delta = lambda x: count(x, "(") + count(x, "[") - count(x, ")") - count(x, "]")

    def step(state, x):
        within = state["depth"] > 0
        fits = within | _starts(x, PYTHON_LINES) | x.isin(*PYTHON_WHOLE)
        depth = F.when(within, state["depth"] + delta(x)).when(_starts(x, PYTHON_OPENING), delta(x)).otherwise(0)
        return F.struct(depth.cast("int").alias("depth"), (state["ok"] & fits).alias("ok"))

    python = F.aggregate(lines, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), step, lambda s: s["ok"])
    only = F.when(language == "python", python)
    for lang, heads in ENTRY_LINES.items():
        only = only.when(language == lang, F.forall(lines, _line(heads, comment)))
    return hint & (F.size(lines) > 0) & only.otherwise(False)


def _line(heads: tuple[str, ...], comment):
    return lambda x: comment(x) | _starts(x, heads)


#: Buckets of paths whose digests make a fingerprint.
BUCKETS = 4096


def fingerprint(files: DataFrame) -> str:
    """One digest of all files' relative paths, sizes and contents; equal trees have equal digests whatever the order of reading.

    Each file is hashed where it is read, the digests of a bucket of paths are hashed in their order, and at most BUCKETS digests come together.
    """
    own = F.sha2(F.concat_ws("\0", "path", F.octet_length("source"), "source"), 256)
    rows = files.select(F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("bucket"), F.concat_ws("\0", "path", own).alias("d"))
    held = rows.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d")).orderBy("bucket").collect()
    h = hashlib.blake2b(digest_size=32)
    for r in held:
        h.update(f"{r['bucket']} {r['d']}\n".encode())
    return h.hexdigest()


#: Seconds by which clocks may differ, and the longest time that making a graph is believed to take.
SKEW, LONGEST_BUILD = 2.0, 3600.0


def built_before(made: float, finished: float | None = None, marker_changed: float | None = None, skew: float = SKEW) -> float:
    """The time after which a change is newer than a graph begun at ``made``.

    The marker file was written when the graph was ``finished``, so its own time of change tells how far the file system's clock is off; times in whole seconds are compared as such.
    """
    if finished is None or marker_changed is None or not 0 <= finished - made <= LONGEST_BUILD:
        return made - skew
    if marker_changed == int(marker_changed):
        return int(made) - (int(finished) - marker_changed)
    return made - (finished - marker_changed)


def freshness(files: DataFrame, marker: dict | None, current: dict) -> DataFrame:
    """(is_fresh, rung, changed): whether a graph still fits its sources, by the first rung that can tell.

    ``files`` has path and modified (seconds), folders included, as a deletion changes its folder's time. ``marker`` is what was noted when the graph was made: source_hash, head_sha,
    made, finished, changed (the marker file's own time). ``current`` has what is known now: source_hash, head_sha, graph_changed, head_changed.
    Rungs: the sources' digest, the commit, a newer file (changed is the first one's path), the graph's time against the commit's; without any the graph counts as fresh.
    """
    marker = marker or {}

    def said(fresh: bool, rung: str) -> DataFrame:
        return files.sparkSession.createDataFrame([(fresh, rung, None)], "is_fresh boolean, rung string, changed string")

    if marker.get("source_hash") is not None and current.get("source_hash") is not None:
        return said(marker["source_hash"] == current["source_hash"], "source_hash")
    anchored = bool(marker.get("head_sha")) and bool(current.get("head_sha"))
    if anchored and marker["head_sha"] != current["head_sha"]:
        return said(False, "head_sha")
    if marker.get("made") is not None:
        limit = built_before(marker["made"], marker.get("finished"), marker.get("changed"))
        first = files.agg(F.min(F.when(F.col("modified") > limit, F.col("path"))).alias("changed"))
        return first.select(F.col("changed").isNull().alias("is_fresh"), F.lit("modified").alias("rung"), "changed")
    if anchored:
        return said(True, "head_sha")
    graph, head = current.get("graph_changed"), current.get("head_changed")
    return said(not (graph and head and graph < head), "graph_time")


def resolve(path: str, root: str) -> str:
    """A path under the root, or an error: nothing outside it is read."""
    full = posixpath.normpath(posixpath.join(root, path))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} lies outside {root}")
    return full
