"""Files in, findings out, and the incremental stream."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from scholia.__main__ import main
from scholia.operators.structure import Manuscript
from scholia.sources import sinks
from scholia.sources.manuscripts import read_manuscripts
from scholia.streaming.incremental import recheck

LEMMA = "\\begin{lemma}\\label{%s} x \\end{lemma}\n\\begin{proof}By \\ref{%s}.\\end{proof}\n"


def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "main.tex").write_text(LEMMA % ("l<1>", "gone") + "\\input{part}")
    (tmp_path / "a" / "part.tex").write_text(LEMMA % ("l2", "l<1>"))
    (tmp_path / "a" / "notes.txt").write_text("\\ref{x}")
    return str(tmp_path)


def test_files_are_projects(spark, tmp_path, capsys):
    path = folder(tmp_path)
    rows = read_manuscripts(spark, path).orderBy("ord").collect()
    assert [(r.ord, r.file) for r in rows] == [(0, "main"), (1, "part")]
    assert main([path, "--limit", "5"]) == 1 and "TH103 error gone" in capsys.readouterr().out
    assert main([path, "--fail-on", "never", "--out", str(tmp_path / "out"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_pages_escape_text(spark, tmp_path):
    m = Manuscript(read_manuscripts(spark, folder(tmp_path)))
    page = sinks.project_pages(m.findings(), m.results).first().html
    assert "l&lt;1&gt;" in page and "TH103 gone" in page and "l<1>" not in page


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, version int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], "version").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_stream_reuses_unchanged_results(spark, tmp_path):
    source, state, log = (str(tmp_path / n) for n in ("in", "state", "log"))
    schema = "project_id long, ord int, file string, raw string"
    first = [(1, 0, "main", LEMMA % ("a", "b") + "\\input{s1}"), (1, 1, "s1", LEMMA % ("b", "none"))]
    second = [(1, 0, "main", LEMMA % ("a", "b") + "\\input{s1}"), (1, 1, "s1", (LEMMA % ("b", "none")).replace("{lemma}\\label", "{lemma}[New]\\label", 1))]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        recheck(spark, source, state, log, str(tmp_path / "checkpoint")).awaitTermination(120)
        found = {r.ord: r.reason for r in spark.read.parquet(f"{log}/b{i}").collect()}
        assert found == ({0: "no_prior_review", 1: "no_prior_review"} if i == 0 else {0: "upstream_dependency_changed", 1: "local_ir_changed"})


def test_the_rest_works_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys, importlib.util as u\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith(('scholia.llm', 'corpus_pipeline')) else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
        "assert not any(m.startswith('scholia.llm') for m in sys.modules)\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0


def test_a_copy_without_llm_works(tmp_path):
    """The folders are gone, not hidden: the rest imports, registers its queries and runs one."""
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = (
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert names and set(e.oracle_sql()) <= set(names) and 'pipeline' not in names and 'op1_url_filter' not in names\n"
        "import bench, scholia.__main__, scholia.operators.exchange, scholia.operators.experiment, scholia.operators.transform, scholia.streaming.incremental\n"
        "from scholia.functions.scan import scan\n"
        "assert scan('\\\\label{x}')\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_unreadable_state_is_no_new_state(spark, tmp_path):
    from scholia.streaming.incremental import read_state

    assert read_state(spark, str(tmp_path / "state"), 3) is None
    (tmp_path / "state" / "v1").mkdir(parents=True)
    (tmp_path / "state" / "v1" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|corrupt|schema"):
        read_state(spark, str(tmp_path / "state"), 1).count()


def test_command_line_pages(spark, tmp_path, capsys):
    path = folder(tmp_path)
    assert main([path, "--graph", str(tmp_path / "g"), "--report", str(tmp_path / "r"), "--fail-on", "never"]) == 0
    assert "main:2: TH103 error gone" in capsys.readouterr().out
    for name in ("g", "r"):
        assert "<!DOCTYPE html>" in "".join(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    assert main([path, "--main", "part", "--fail-on", "never"]) == 0


def test_the_demo_holds_every_finding(spark, tmp_path):
    from scholia.operators import symbols, transform
    from scholia.sources.demo import demo_manuscripts

    m = Manuscript(demo_manuscripts(spark))
    assert sorted((r.rule, r.subject) for r in m.findings().collect()) == [("TH101", "lem:twice"), ("TH102", "lem:twice"), ("TH103", "thm:lost"), ("TH104", "fact:rule -> lem:back -> fact:rule"), ("TH113", "x: scalar, map")]
    page = sinks.report_pages(m).first().html
    assert "label lem:twice occurs at main:" in page and "P(n)" in page and "&lt;" not in page.split("<h2>")[0]
    exports = transform.lean_exports(m)
    sinks.write_lean_files(exports, str(tmp_path / "lean"))
    texts = [r.value for r in spark.read.text(str(tmp_path / "lean")).collect()]
    assert len(texts) == exports.where("lean is not null").count() > 0 and all(t.startswith("theorem scholia_") for t in texts)
    m.release()
    raw = "\\begin{lemma}Let $x > 0$ be small.\\end{lemma}\\begin{proof}One $y$. So $x < 1$. And $x = z$.\\end{proof}"
    own = Manuscript(spark.createDataFrame([(0, 0, "main", raw)], "project_id long, ord int, file string, raw string"))
    assert sorted((r.idx, r.name, r.role) for r in symbols.claim_symbols(own).collect()) == [(1, "x", "scalar"), (2, "x", "scalar")]
