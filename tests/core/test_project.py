"""A small tree in all languages, from files to reports."""

import json
import subprocess

import pytest

from basaltic import cli
from basaltic.operators import compare, impact
from basaltic.plans.project import analyze_project
from basaltic.sources import sinks
from basaltic.sources.extract import facts_of
from basaltic.sources.tree import GitIgnore, walk

TREE = {
    "pkg/__init__.py": "",
    "pkg/models.py": '"""Models."""\n\n\nclass Base:\n    def save(self):\n        return helper(self)\n\n\nclass Child(Base):\n    def __init__(self, a: int):\n        self.a = a\n\n    def run(self):\n        # runs\n        self.save()\n        if self.a and self.a > 1:\n            return 1\n        return 2\n\n\ndef helper(x):\n    return x\n',
    "pkg/other.py": "class Beta:\n    def save(self):\n        pass\n",
    "pkg/services.py": "from .models import Child, helper\nfrom pkg import cyc_a\nimport os\n\n\ndef work(n):\n    c = Child(n)\n    val = c.run()\n    return helper(val)\n\n\ndef other(o):\n    o.save()\n    missing_thing()\n\n\ndef typed(b: 'Beta'):\n    b.save()\n",
    "pkg/test_services.py": "from pkg.services import work\n\n\ndef test_work():\n    work(1)\n",
    "pkg/cyc_a.py": "from pkg.cyc_b import b\n\n\ndef a():\n    b()\n",
    "pkg/cyc_b.py": "import pkg.cyc_a\n\n\ndef b():\n    pass\n",
    "broken.py": "def broken(:\n",
    "src/app/main.ts": "import { util } from '@app/util';\nimport './missing';\nimport _ from 'lodash';\nexport function tsFunc(p: number): number { return util(p); }\nfunction tsCaller() { return tsFunc(1); }\n",
    "src/app/util.ts": "export function util(x) { return x; }\n",
    "src/app/index.ts": "",
    "src/legacy.js": "const u = require('./app');\n",
    "tsconfig.json": '{ "compilerOptions": { /* c */ "baseUrl": ".", "paths": {"@app/*": ["src/app/*"],} } }',
    "c/main.c": '#include <stdio.h>\n#include "util.h"\n#ifdef X\n#include "feature.h"\n#endif\nint main(void) { return util(1) && 2; }\n',
    "c/util.h": "#ifndef U\n#define U\nint util(int);\n#endif\n",
    "c/feature.h": "",
    "java/com/ex/Main.java": "package com.ex;\nimport com.ex.Helper;\nimport java.util.List;\npublic class Main extends Helper { void run() { Helper.go(); } }\n",
    "java/com/ex/Helper.java": "package com.ex;\npublic class Helper { static void go() { /* x */ } }\n",
    "node_modules/x.js": "ignored",
    "a.min.js": "ignored",
    "logs/x.py": "ignored",
    ".gitignore": "logs/\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "pkg/latin.py").write_bytes(b"x = '\xe9'\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    (root / "pkg/models.py").write_text(TREE["pkg/models.py"] + "\n")
    run("commit", "-qam", "two")
    (root / "pkg/models.py").write_text(TREE["pkg/models.py"].replace("    return x\n", "    y = x\n    return y\n"))
    return root


@pytest.fixture(scope="module")
def tables(spark, root):
    return analyze_project(spark, str(root), churn_days=None)


def test_scan(tables):
    files = {r.id: r for r in tables["files"].collect()}
    assert "pkg/__init__.py" in files and not {"node_modules/x.js", "a.min.js", "logs/x.py"} & set(files)
    assert files["pkg/test_services.py"].is_test and not files["broken.py"].parse_ok and files["c/util.h"].language == "c"
    kinds = {(r.file, r.kind) for r in tables["diagnostics"].collect()}
    assert kinds == {("broken.py", "parse_partial"), ("pkg/latin.py", "encoding_fallback"), ("src/app/main.ts", "unresolved_import")}


def test_imports(tables):
    found = {(r.src, r.dst) for r in tables["edges"].where("kind = 'import'").collect()}
    assert found == {
        ("pkg/services.py", "pkg/models.py"), ("pkg/services.py", "pkg/cyc_a.py"), ("pkg/services.py", "pkg/__init__.py"), ("pkg/services.py", "external:os"),
        ("pkg/test_services.py", "pkg/services.py"), ("pkg/cyc_a.py", "pkg/cyc_b.py"), ("pkg/cyc_b.py", "pkg/cyc_a.py"), ("src/app/main.ts", "src/app/util.ts"),
        ("src/app/main.ts", "unresolved:./missing"), ("src/app/main.ts", "external:lodash"), ("src/legacy.js", "src/app/index.ts"), ("c/main.c", "external:stdio.h"),
        ("c/main.c", "c/util.h"), ("c/main.c", "c/feature.h"), ("java/com/ex/Main.java", "java/com/ex/Helper.java"), ("java/com/ex/Main.java", "external:java"),
    }
    assert [r.dst for r in tables["edges"].where("conditional").collect()] == ["c/feature.h"]


def test_calls(tables):
    calls = {(r.src, r.dst): (r.confidence, r.ambiguous) for r in tables["edges"].where("kind = 'call'").collect()}
    sure = ("certain", False)
    assert calls[("pkg/models.py::Child::run", "pkg/models.py::Base::save")] == sure
    assert calls[("pkg/services.py::work", "pkg/models.py::Child::run")] == sure and calls[("pkg/services.py::work", "pkg/models.py::helper")] == sure
    assert calls[("pkg/services.py::typed", "pkg/other.py::Beta::save")] == sure
    assert {d: c for (s, d), c in calls.items() if s == "pkg/services.py::other"} == {"pkg/models.py::Base::save": ("inferred", True), "pkg/other.py::Beta::save": ("inferred", True), "unresolved:missing_thing": ("unresolved", False)}
    assert calls[("src/app/main.ts::tsFunc", "src/app/util.ts::util")] == sure and calls[("java/com/ex/Main.java::Main::run", "java/com/ex/Helper.java::Helper::go")] == ("inferred", False)
    bases = {(r.src, r.dst, r.confidence) for r in tables["edges"].where("kind = 'inherit'").collect()}
    assert bases == {("pkg/models.py::Child", "pkg/models.py::Base", "certain"), ("java/com/ex/Main.java::Main", "java/com/ex/Helper.java::Helper", "certain")}


def test_measures(tables):
    by_file = {r.file_id: r for r in tables["file_metrics"].collect()}
    m = by_file["pkg/models.py"]
    assert (m.loc_total, m.loc_code, m.loc_comment, m.functions, m.classes, m.cc_total, m.cc_max, m.fan_in) == (23, 15, 1, 4, 2, 6, 3, 1)
    assert by_file["pkg/__init__.py"].mi == 100.0 and all(0 <= r.mi <= 100 for r in by_file.values())
    assert {r.symbol_id: r.cc for r in tables["symbol_metrics"].collect()}["c/main.c::main"] == 2
    assert [r.cycle for r in tables["cycles"].collect()] == [["pkg/cyc_a.py", "pkg/cyc_b.py"]]
    project = tables["project"].first()
    assert (project.files, project.test_files, project.cycles_count) == (len(by_file), 1, 1)
    assert tables["meta"].first().parse_failures == 1 and tables["churn_state"].first().available
    assert [r.file_id for r in tables["hotspots"].limit(1).collect()] == ["pkg/models.py"] and m.churn_commits == 2


def test_impact(tables):
    found = impact.analyze(tables, "pkg/models.py", 22)
    doc = sinks.impact_document(found)
    symbols = {s["symbol_id"]: s for f in doc["affected_files"] for s in f["symbols"]}
    assert doc["origin"]["symbol_id"] == "pkg/models.py::helper" and doc["sliced_vars"] == ["y"]
    assert symbols["pkg/models.py::helper"]["hops"] == 0 and symbols["pkg/models.py::Base::save"]["hops"] == 1 and symbols["pkg/models.py::Child::run"]["hops"] == 2
    assert symbols["pkg/services.py::<module>"]["via"] == "import" and symbols["pkg/services.py::other"]["confidence"] == "inferred"
    assert {"symbol_id": "pkg/services.py::other", "reason": "unresolved callee 'missing_thing'", "line": 14} in doc["unresolved_boundaries"]
    assert any("ambiguous resolution (2 candidates)" in b["reason"] for b in doc["unresolved_boundaries"]) and not doc["stats"]["max_hops_reached"]
    assert impact.analyze(tables, "pkg/models.py", 22, max_depth=1)["max_hops_reached"]
    assert "error" in impact.analyze(tables, "pkg/models.py", 2) and "error" in impact.analyze(tables, "nope.py", 1)
    assert impact.analyze(tables, "services.py", 1)["origin"]["symbol_id"] == "pkg/services.py::<module>"
    assert "boundary:" in sinks.impact_text(doc)


def test_diff_impact(tables, root):
    from basaltic.sources.git import diff_hunks

    hunks = diff_hunks(str(root), "worktree")
    found = impact.analyze_diff(tables, hunks)
    assert [o["symbol_id"] for o in found["origins"]] == ["pkg/models.py::helper"] and found["affected"].count() > 3
    assert impact.analyze_diff(tables, [{"file": "R.md", "start": 0, "end": 0, "status": "skipped", "reason": "unsupported language"}])["error"] == "no analyzable hunks: unsupported language (1)"


def test_diff_is_all_its_hunks(tables):
    """One walk for many hunks gives what the impacts of each give, merged."""
    spans = [("pkg/models.py", 22, 23), ("services.py", 1, 1), ("pkg/models.py", 21, 22), ("nope.py", 1, 1), ("pkg/models.py", 2, 2), ("pkg/models.py", 5, 18)]
    hunks = [{"file": f, "start": a, "end": b, "status": "analyzed", "reason": ""} for f, a, b in spans]
    found = impact.analyze_diff(tables, hunks, 3)
    one = [impact.analyze(tables, f, a, b, 3) for f, a, b in spans]
    assert [h["status"] == "skipped" for h in found["hunks"]] == ["error" in o for o in one] and "error" in one[3] and "error" not in one[1]
    assert [h["reason"] for h in found["hunks"]] == [o.get("error", "") for o in one]
    one = [o for o in one if "error" not in o]
    want: dict = {}
    for o in one:
        for r in o["affected"].collect():
            old = want.setdefault((r.file_id, r.symbol_id), [set(), False, r.via, r.hops])
            want[r.file_id, r.symbol_id] = [old[0] | set(r.lines), old[1] or r.confidence == "certain", old[2], min(old[3], r.hops)]
    got = {(r.file_id, r.symbol_id): [set(r.lines), r.confidence == "certain", r.via, r.hops] for r in found["affected"].collect()}
    assert got == want and len(want) > 5
    assert {tuple(r) for r in found["boundaries"].collect()} == {tuple(r) for o in one for r in o["boundaries"].collect()}
    assert set(found["sliced_vars"]) == {v for o in one for v in o["sliced_vars"]} and found["max_hops_reached"] == any(o["max_hops_reached"] for o in one)
    ids = [o["origin"]["symbol_id"] for o in one]
    assert [o["symbol_id"] for o in found["origins"]] == list(dict.fromkeys(ids))
    assert impact.normalize_files(tables["files"], ["x/pkg/models.py", "./pkg/models.py", "odels.py", "models.py"]) == dict.fromkeys(["x/pkg/models.py", "./pkg/models.py", "models.py"], "pkg/models.py")


def test_reports(spark, tables, tmp_path):
    doc = sinks.to_document(tables, with_defuse=True)
    sinks.write_json(doc, str(tmp_path / "a.json"))
    back = sinks.read_json(spark, str(tmp_path / "a.json"))
    same = sinks.compare_document(compare.compare(back, back))
    assert sinks.is_same(same) and "No differences" in sinks.compare_html(same)
    changed = json.loads(json.dumps(doc))
    changed["metrics"]["files"]["pkg/models.py"]["cc_total"] = 99
    changed["metrics"]["cycles"] = []
    sinks.write_json(changed, str(tmp_path / "b.json"))
    diff = sinks.compare_document(compare.compare(back, sinks.read_json(spark, str(tmp_path / "b.json"))))
    assert diff["files"]["changed"] == [{"file_id": "pkg/models.py", "deltas": {"cc_total": [6.0, 99.0]}}] and len(diff["cycles"]["removed"]) == 1
    assert "cc_total" in sinks.compare_html(diff) and "<table>" in sinks.report_html(tables, doc, True)
    out = sinks.export_metrics(tables, "csv")
    assert out.startswith("path,language,loc_total") and "# project summary" in out and "pkg/cyc_a.py -> pkg/cyc_b.py" in out
    assert "## Resolution" in sinks.export_metrics(tables, "md") and json.loads(sinks.export_metrics(tables, "json"))["cycles"]
    assert "pkg/models.py::Child::run" in sinks.export_symbols_csv(tables)
    rows = sinks.metric_table(tables, "loc_code", 3)
    assert len(rows) == 3 and rows[0]["loc_code"] >= rows[1]["loc_code"] and sinks.render_table(rows).count("\n") == 4
    with pytest.raises(ValueError):
        sinks.export_metrics(tables, "xml")


def test_snapshots(spark, tables, tmp_path):
    for i in ("s1", "s2"):
        sinks.save_snapshot({k: tables[k] for k in ("files", "edges")}, str(tmp_path), i)
    assert sinks.load_snapshot(spark, str(tmp_path), "s1")["files"].count() == tables["files"].count()
    assert sinks.prune_snapshots(spark, str(tmp_path), ["s1", "s2"], keep=1) == ["s2"] and not (tmp_path / "s1").exists()


def test_arguments(tmp_path, capsys):
    assert cli.main(["analyze", str(tmp_path / "none")]) == 2
    assert cli.main(["impact", str(tmp_path)]) == 2
    assert sinks.parse_target("a.py:3-5") == ("a.py", 3, 5) and sinks.parse_target("a.py:3") == ("a.py", 3, 3) and sinks.parse_target("a.py") is None


def test_ignore_rules(tmp_path):
    rules = GitIgnore("*.log\n!keep.log\nbuild/\n/top.py\nsub/**/x.py\n")
    assert rules.ignores("a/b.log") and not rules.ignores("a/keep.log") and rules.ignores("a/build/x.py") and not rules.ignores("build")
    assert rules.ignores("build", True) and rules.ignores("top.py") and not rules.ignores("a/top.py") and rules.ignores("sub/a/b/x.py")
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    assert [p for p, _, _ in walk(str(tmp_path))] == ["a.py"]
    assert walk(str(tmp_path), includes=["b*"]) == []


def test_front_ends():
    js = facts_of("probe.js", "javascript", "function calc(a, b) { if (a && b) { return a; } for (;;) {} }\nconst plain = (x) => x;\n")
    assert {s["name"]: (s["cc"], s["params"]) for s in js["symbols"] if s["kind"] == "function"} == {"calc": (4, 2), "plain": (1, 1)}
    py = facts_of("p.py", "python", "def f(a, *, b=1):\n    return [i for i in a if i] or (1 if b else 2)\n")
    assert [(s["cc"], s["params"]) for s in py["symbols"] if s["name"] == "f"] == [(4, 3)]
    java = facts_of("M.java", "java", "class Main { void run() {} int run(int a) { return a > 0 ? 1 : 2; } }")
    assert [s["id"] for s in java["symbols"][2:]] == ["M.java::Main::run", "M.java::Main::run#2"]
    cpp = facts_of("s.cpp", "cpp", "namespace geo { class Circle { double area(); };\ndouble Circle::area() { return r(); } }")
    assert [(s["id"], s["parent_id"]) for s in cpp["symbols"] if s["name"] == "area"] == [("s.cpp::geo::Circle::area", "s.cpp::geo::Circle")]
    assert facts_of("x.c", "c", "{{{")["parse_partial"]


def test_stream(spark, tmp_path):
    from basaltic.streaming import incremental

    rows = [("a.py", "python", "def f(): pass\n", 1), ("b.py", "python", "def g(): pass\n", 1)]
    folder = str(tmp_path / "in")
    for batch in (rows, [("a.py", "python", "def h(): pass\n", 2)]):
        spark.createDataFrame(batch, incremental.CHANGES).write.mode("append").parquet(folder)
        incremental.keep_facts(incremental.changes(spark, folder), str(tmp_path / "facts"), str(tmp_path / "state")).awaitTermination()
    facts = incremental.current_facts(spark, str(tmp_path / "facts"))
    assert {s.name for r in facts.collect() for s in r.symbols} == {"<module>", "h", "g"}
