"""Source trees as tables: listed on the driver, read and decoded on the executors.

Spark's own file index hides names that begin with ``_`` or ``.``, so ``__init__.py`` would be
lost; the tree is walked instead, and only paths travel.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions.text import EXTENSIONS, is_test_file, language_of

#: Larger files are not read.
MOST_BYTES = 5 * 1024 * 1024

# What is left out by default.
EXCLUDED_DIRS = (
    "node_modules", "venv", ".venv", "env", ".git", ".hg", ".svn", "__pycache__", "build", "dist", "out", "target", "vendor", ".tox", ".mypy_cache", ".pytest_cache", "site-packages",
)
EXCLUDED_DIR_GLOBS = (".*_cache",)
EXCLUDED_FILES = ("*.min.js", "*_pb2.py", "*.generated.*")


def default_excludes() -> list[str]:
    return sorted({*EXCLUDED_DIRS, *EXCLUDED_DIR_GLOBS, *EXCLUDED_FILES})


class GitIgnore:
    """The rules of one ignore file; the last that matches decides."""

    def __init__(self, text: str) -> None:
        self.rules = [r for r in map(self._rule, text.splitlines()) if r]

    @staticmethod
    def _rule(line: str):
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            return None
        keep = line.startswith("!")
        line = line[keep:].removeprefix("\\")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        out, i, line = "", 0, line.lstrip("/")
        while i < len(line):
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                out, i = out + ".*", i + 2
            elif line[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif line[i] == "?":
                out, i = out + "[^/]", i + 1
            elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
                inside = line[i + 1 : end]
                out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
            else:
                out, i = out + re.escape(line[i]), i + 1
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"(/.*)?\Z", re.DOTALL), keep, only_dir

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        ignored = False
        for pattern, keep, only_dir in self.rules:
            if (m := pattern.match(path)) and (is_dir or not only_dir or m[1]):
                ignored = not keep
        return ignored


def walk(root: str, includes=(), excludes=(), respect_gitignore: bool = True) -> list[tuple[str, str, int]]:
    """(relative path, real path, size) of the files to read, by path. Linked folders and
    files, and second names of one file, are left out; size -1: it couldn't be read."""
    ignore = GitIgnore("")
    if respect_gitignore and os.path.isfile(path := os.path.join(root, ".gitignore")):
        with open(path, encoding="utf-8", errors="replace") as f:
            ignore = GitIgnore(f.read())
    names = [*EXCLUDED_DIRS, *EXCLUDED_DIR_GLOBS, *excludes]
    globs = [*EXCLUDED_FILES, *excludes]
    found, seen = [], set()
    for folder, dirs, files in os.walk(root):
        inner = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if inner == "." else inner + "/"
        dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(folder, d)) and not any(fnmatch.fnmatchcase(d, g) for g in names) and not ignore.ignores(prefix + d, True))
        for name in sorted(files):
            path, full = prefix + name, os.path.join(folder, name)
            if os.path.islink(full) or os.path.splitext(name)[1].lower() not in EXTENSIONS or ignore.ignores(path):
                continue
            if includes and not any(fnmatch.fnmatchcase(x, g) for g in includes for x in (name, path)):
                continue
            if any(fnmatch.fnmatchcase(x, g) for g in globs for x in (name, path)) or (real := os.path.realpath(full)) in seen:
                continue
            seen.add(real)
            try:
                size = os.path.getsize(full)
            except OSError:
                size = -1
            found.append((path, full, size))
    return sorted(found)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sources, notes = [], []
        for full in batch["full"]:
            source, note = None, None
            try:
                with open(full, "rb") as f:
                    data = f.read()
                try:
                    source = data.decode("utf-8")
                except UnicodeDecodeError:
                    source, note = data.decode("latin-1"), "encoding_fallback"
            except OSError as e:
                note = f"skipped_size:{e.strerror}"
            sources.append(source)
            notes.append(note)
        yield batch.assign(source=sources, note=notes)


def scan(spark: SparkSession, root: str, includes=(), excludes=(), respect_gitignore: bool = True, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """files(id, path, language, size_bytes, is_test, source) and diagnostics. The tree must be
    reachable from all executors under one path."""
    schema = "id string, full string, size_bytes long"
    listed = walk(root, includes, excludes, respect_gitignore)
    paths = spark.createDataFrame(listed, schema)
    if len(listed) > 1:
        paths = paths.repartition(min(len(listed), slices or spark.sparkContext.defaultParallelism * 4), "id")
    fits = F.col("size_bytes").between(0, MOST_BYTES)
    read = paths.where(fits).mapInPandas(_read, f"{schema}, source string, note string")
    good = read.where("source is not null")
    files = good.select("id", F.col("id").alias("path"), language_of(F.col("id")).alias("language"), "size_bytes", is_test_file(F.col("id")).alias("is_test"), "source")
    too_large = paths.where(~fits).select(F.col("id").alias("file"), F.lit("skipped_size").alias("kind"), F.when(F.col("size_bytes") < 0, "cannot be read").otherwise(F.concat(F.lit("larger than "), F.lit(str(MOST_BYTES)), F.lit(" bytes"))).alias("message"), F.lit(0).alias("line"))
    noted = read.where("note is not null").select(F.col("id").alias("file"), F.split_part("note", F.lit(":"), F.lit(1)).alias("kind"), F.when(F.col("note") == "encoding_fallback", "not UTF-8; read as latin-1").otherwise(F.split_part("note", F.lit(":"), F.lit(2))).alias("message"), F.lit(0).alias("line"))
    return files, too_large.union(noted)
