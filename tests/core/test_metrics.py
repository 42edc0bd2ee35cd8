"""Line counts, complexity, history and comparison."""

import re

import pytest

from basaltic.operators import churn, compare, impact, metrics
from basaltic.sources import git
from pyspark.sql import functions as F
from basaltic.functions import text

SOURCES = {
    "python": ['x = 1  # note\n\n# only\n"""doc\n\n  \nend"""\ny = "a#b"\n', "", "\n\n", "s = 'a\\\nb'\nz = 1", "'''open\nnever", '# c\n"unclosed\nstill'],
    "java": ["// a\nint x; /* b\n\n c */ int y;\n/* open\n\nend", 'String s = "// no";\n\n', "a / b; // c\n'\\''\n"],
    "javascript": ["`a\n// in\n\n`;\n// out\n", "x = 1 /* y */\n"],
}


def loc_by_hand(source, language):
    """A character at a time."""
    if not source:
        return 0, 0, 0, 0
    lines = source.split("\n")
    total = len(lines) - (lines[-1] == "")
    marks = ['"""', "'''", '"', "'"] if language == "python" else ['"', "'", "`"][: 3 if language == "javascript" else 2]
    single = "#" if language == "python" else "//"
    code, comment, line, i, inside = set(), set(), 1, 0, None
    while i < len(source):
        c = source[i]
        if c == "\n":
            line, i = line + 1, i + 1
        elif inside:
            code.add(line)
            if source.startswith(inside, i):
                i, inside = i + len(inside), None
            else:
                i += 2 if len(inside) == 1 and c == "\\" and i + 1 < len(source) else 1
        elif found := next((m for m in marks if source.startswith(m, i)), None):
            inside, i = found, i + len(found)
            code.add(line)
        elif source.startswith(single, i):
            comment.add(line)
            i = source.find("\n", i) if "\n" in source[i:] else len(source)
        elif language != "python" and source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = len(source) if end < 0 else end
            comment |= set(range(line, line + source.count("\n", i, end) + 1))
            line, i = line + source.count("\n", i, end), min(end + 2, len(source))
        else:
            if not c.isspace():
                code.add(line)
            i += 1
    code = {x for x in code if x <= total}
    only = {x for x in comment if x <= total} - code
    return total, len(code), len(only), total - len(code) - len(only)


def test_loc(spark):
    rows = [(f"{language}{i}", language, s) for language, sources in SOURCES.items() for i, s in enumerate(sources)]
    got = {r.id: (r.loc_total, r.loc_code, r.loc_comment, r.loc_blank) for r in metrics.loc(spark.createDataFrame(rows, "id string, language string, source string")).collect()}
    assert got == {i: loc_by_hand(s, language) for i, language, s in rows}


def test_confidence_scopes(spark):
    files = spark.createDataFrame([("a.py", "python", False), ("test_a.py", "python", True), ("m.c", "c", False), ("x.java", "java", False)], "id string, language string, is_test boolean")
    rows = [("a.py::f", "certain", False), ("test_a.py::t", "certain", False), ("a.py::g", "inferred", True), ("a.py::g", "inferred", True), ("a.py::h", "unresolved", False), ("m.c::m", "unresolved", False), ("m.c::n", "unresolved", False)]
    edges = spark.createDataFrame([(s, "d", "call", c, a) for s, c, a in rows] + [("a.py", "d", "import", "certain", False)], "src string, dst string, kind string, confidence string, ambiguous boolean")
    got = {r.scope: tuple(r)[1:] for r in metrics.resolution_by_scope(files, edges).collect()}
    assert got["calls"] == (7, 2, 2, 3, 2, 28.6, 28.6) and got["non_test"] == (6, 1, 2, 3, 2, 16.7, 33.3)
    assert got["language:python"][0::5] == (5, 40.0) and got["language:python"][6] == 40.0
    assert got["language:c"] == (2, 0, 0, 2, 0, 0.0, 0.0) and got["language:java"] == (0, 0, 0, 0, 0, 0.0, 0.0)


def test_hotspots(spark):
    log = "a1b2c3d\t100\n1\t1\ta.py\n2\t0\tb.py\n\nb2b2c3d\t90000\n3\t1\ta.py\n-\t-\timg.png\nc3b2c3d\t50\n1\t0\ta.py\n"
    blocks = [(f"{x}\n",) for x in ("", "no commit\n1\t1\tx.py", *re.split(r"\n(?=\w{7}\t)", log))]
    rows = churn.parse_numstat(spark.createDataFrame(blocks, "block string"))
    changes = {r.file_id: tuple(r)[1:] for r in churn.churn(rows).collect()}
    assert changes == {"a.py": (3, 5, 2, "1970-01-02"), "b.py": (1, 2, 0, "1970-01-01"), "img.png": (1, 0, 0, "1970-01-02")}
    measured = spark.createDataFrame([("a.py", 1), ("b.py", 9), ("c.py", 5)], "file_id string, cc_total long")
    scored = churn.with_hotspots(measured, churn.churn(rows))
    assert {r.file_id: r.hotspot for r in scored.collect()} == {"a.py": 0.5, "b.py": 0.5, "c.py": 0.0}
    assert [r.file_id for r in churn.top_hotspots(scored).collect()] == ["a.py", "b.py"]
    flat = churn.with_hotspots(measured.withColumn("cc_total", F.lit(0).cast("long")), churn.churn(rows))
    assert churn.top_hotspots(flat).count() == 0


def test_compare(spark):
    old = spark.createDataFrame([("a", 5, 82.1), ("b", 1, 1.0)], "file_id string, cc_total long, mi double")
    new = spark.createDataFrame([("a", 9, 70.25), ("c", 1, 1.0)], "file_id string, cc_total long, mi double")
    assert {(r.file_id, r.key, r.old_value, r.new_value) for r in compare.changed_values(old, new, ["file_id"], ["cc_total", "mi"]).collect()} == {("a", "cc_total", 5.0, 9.0), ("a", "mi", 82.1, 70.25)}
    assert {tuple(r) for r in compare.presence(old, new, ["file_id"]).collect()} == {("b", "removed"), ("c", "added")}
    one, two = (spark.createDataFrame([(c,)], "cycle array<string>") for c in (["a", "b"], ["b", "a"]))
    assert compare.cycle_changes(one, two).isEmpty()
    hot = spark.createDataFrame([("a",)], "file_id string")
    assert compare.hotspot_changes(hot, hot.limit(0)) is None
    assert {tuple(r) for r in compare.hotspot_changes(hot, hot.select(F.lit("m").alias("file_id"))).collect()} == {("m", "new"), ("a", "resolved")}


def test_ranges(spark):
    rows = [("f", 1, 2), ("f", 3, 4), ("f", 6, 9), ("f", 7, 7), ("g", 1, 1)]
    got = impact.merge_ranges(spark.createDataFrame(rows, "k string, start int, end int"), ["k"])
    assert {tuple(r) for r in got.collect()} == {("f", 1, 4), ("f", 6, 9), ("g", 1, 1)}


def test_diff():
    diff = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -2 +2 @@ def f\n-x\n+y\n@@ -9,2 +8,0 @@\n@@ -1 +10,3 @@\ndiff --git a/R.md b/R.md\n+++ b/R.md\n@@ -1 +1 @@\ndiff --git a/gone.py b/gone.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
    got = [(h["file"], h["start"], h["end"], h["status"], h["reason"]) for h in git.parse_diff(diff)]
    assert got == [("R.md", 1, 1, "skipped", "unsupported language"), ("m.py", 2, 2, "analyzed", ""), ("m.py", 8, 8, "skipped", "deletion-only hunk"), ("m.py", 10, 12, "analyzed", "")]
    touching = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1 +1,2 @@\n+++ b/other.py\n@@ -2 +3 @@\n@@ -9 +7,2 @@\ndiff --git a/x.png b/x.png\nBinary files a/x.png and b/x.png differ\n"
    assert [(h["file"], h["start"], h["end"]) for h in git.parse_diff(touching)] == [("m.py", 1, 3), ("m.py", 7, 8)] and git.parse_diff("") == []
    assert git.range_args("worktree") == ["HEAD"] and git.range_args("A..B") == ["A..B"] and git.range_args("HEAD~1") == ["HEAD~1..HEAD"]


@pytest.mark.parametrize(("path", "want"), [("tests/a.py", True), ("a/test/b.c", True), ("test_x.py", True), ("x_test.go.py", True), ("a.spec.ts", True), ("spec.ts", False), ("contest.py", False), ("tests.py", False)])
def test_is_test_file(spark, path, want):
    assert spark.range(1).select(text.is_test_file(F.lit(path))).first()[0] is want


def test_paths(spark):
    cases = {"a/../b": "b", "./a//b/.": "a/b", "../a": "../a", "a/../../b": "../b", "/a/../../b": "/b", "a/..": "."}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", text.normalized_path(F.col("p")).alias("n"), text.extension(F.col("p")).alias("e"))
    assert {r.p: r.n for r in got.collect()} == cases
    named = spark.createDataFrame([("x/a.PY",), (".hidden",), ("b.tar.ts",), ("no",)], "p string").select(text.language_of(F.col("p"))).collect()
    assert [r[0] for r in named] == ["python", None, "typescript", None]
    assert spark.range(1).select(text.glob_excluded(F.lit("x/a.min.js"), ["*.min.js"]), text.glob_excluded(F.lit("x/a.js"), ["*.min.js"])).first()[:] == (True, False)
