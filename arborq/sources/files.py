"""Source files as a data source that prunes before it reads.

``spark.read.format("source_files")`` plans by walking the roots: pruned directories, virtual environments and what a root's ignore file names
are left before they are listed, so nothing below them is opened. What is kept is sorted and dealt into partitions of bounded bytes; executors open
only those files. Roots are folders or files that driver and executors see under one path (a mounted share); stores that only Spark's own
readers reach go through ``discovery.scan``.

Rows: (file_id, root, path, language, is_dir, n_bytes, modified, source, error). Text is read strictly; a file that cannot be read has a null source
and its cause as error: not_found, not_a_file, not_utf8 or unreadable.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .discovery import DEFAULT_LANGUAGE, ENVIRONMENT, PRUNED, SUFFIXES

SCHEMA = "file_id string, root string, path string, language string, is_dir boolean, n_bytes long, modified double, source string, error string"
IGNORE_FILE = ".arborqignore"
#: Bytes of files in a partition, and in a batch of rows.
BATCH_BYTES = 16 << 20


def ignore_rules(text: str) -> list[str]:
    """The rules of an ignore file: blank lines, comments and negations are none, a slash at the end says nothing."""
    lines = (line.strip() for line in text.splitlines())
    return [x.rstrip("/") for x in lines if x and x[0] not in "#!"]


def _matches(text: str, glob: str) -> bool:
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.DOTALL) is not None


def is_ignored(path: str, rules: list[str]) -> bool:
    """Whether a rule fits a relative path. One with a slash is about the whole path, a bare name about the last segment or a folder on the way."""
    for rule in rules:
        if rule.startswith("/"):
            if _matches(path, rule.lstrip("/")):
                return True
        elif "/" in rule:
            if _matches(path, rule) or path.startswith(rule + "/"):
                return True
        elif _matches(path.rsplit("/", 1)[-1], rule) or _matches(path, rule) or f"/{rule}/" in f"/{path}/":
            return True
    return False


def is_environment(folder: str) -> bool:
    return any(os.path.exists(os.path.join(folder, *mark.split("/"))) for mark in ENVIRONMENT)


class Entry(tuple):
    """(root, relative path, full path, bytes, time of change, is a folder)."""


def walk(root: str, suffixes: tuple[str, ...], ignore_file: str = IGNORE_FILE, recursive: bool = True, folders: bool = False) -> Iterator[Entry]:
    """What is kept below a root; a root that is a file is kept whatever the rules say, if its suffix fits."""
    fits = lambda name: os.path.splitext(name)[1] in suffixes
    if os.path.isfile(root):
        if fits(root):
            st = os.stat(root)
            yield Entry((os.path.dirname(root), os.path.basename(root), root, st.st_size, st.st_mtime, False))
        return
    rules: list[str] = []
    if os.path.isfile(os.path.join(root, ignore_file)):
        with open(os.path.join(root, ignore_file), encoding="utf-8", errors="replace") as f:
            rules = ignore_rules(f.read())
    todo, seen = [(root, "")], set()
    while todo:
        folder, rel = todo.pop()
        real = os.path.realpath(folder)
        if real in seen:  # a link back into the tree
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir():
                if recursive and e.name not in PRUNED and not is_ignored(path, rules) and not is_environment(e.path):
                    todo.append((e.path, path))
            elif e.is_file() and fits(e.name) and not is_ignored(path, rules):
                st = e.stat()
                yield Entry((root, path, e.path, st.st_size, st.st_mtime, False))
        if folders:
            st = os.stat(folder)
            yield Entry((root, rel, folder, 0, st.st_mtime, True))


def read_strict(path: str) -> tuple[str | None, str | None]:
    """(text, cause of the failure): one of them is null."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "not_utf8"
    except FileNotFoundError:
        return None, "not_found"
    except IsADirectoryError:
        return None, "not_a_file"
    except OSError:
        return None, "unreadable"


class Batch(InputPartition):
    def __init__(self, entries: list[Entry]):
        self.entries = entries


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        listed = options.get("suffixes")
        self.suffixes = tuple(json.loads(listed)) if listed else tuple(e for ends in SUFFIXES.values() for e in ends)
        self.ignore_file = options.get("ignorefile", IGNORE_FILE)
        flag = lambda name, usual: str(options.get(name, usual)).lower() == "true"
        self.recursive, self.folders, self.contents = flag("recursive", True), flag("folders", False), flag("contents", True)
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def partitions(self) -> list[Batch]:
        """Kept entries, each full path once, in the order of their paths; a file larger than a batch is a partition of its own."""
        kept = {e[2]: e for root in self.roots for e in walk(root, self.suffixes, self.ignore_file, self.recursive, self.folders)}
        out, size = [[]], 0
        for full in sorted(kept):
            if out[-1] and size + kept[full][3] > self.batch_bytes:
                out.append([])
                size = 0
            out[-1].append(kept[full])
            size += kept[full][3]
        return [Batch(x) for x in out]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        languages = {e: lang for lang, ends in SUFFIXES.items() for e in ends}
        for root, path, full, n, modified, is_dir in partition.entries:
            source, error = read_strict(full) if self.contents and not is_dir else (None, None)
            lang = None if is_dir else languages.get(os.path.splitext(path)[1], DEFAULT_LANGUAGE)
            yield (hashlib.sha1(full.encode()).hexdigest(), root, path, lang, is_dir, n, modified, source, error)


class SourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_files(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] | None = None, **options) -> DataFrame:
    """The rows of all roots. Options: recursive, folders (rows for visited folders too), contents (false: nothing is opened), ignorefile, batchbytes."""
    spark.dataSource.register(SourceFiles)
    own = spark.read.format("source_files").option("roots", json.dumps(roots))
    if suffixes:
        own = own.option("suffixes", json.dumps(list(suffixes)))
    return own.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load()
