"""Whole projects in one scan: includes, results of one file, captions and sections, findings by identifier."""

import pytest

from scholia.functions.scan import in_argument, scan
from scholia.operators.structure import Manuscript
from scholia.sources.manuscripts import read_manuscripts

DOC, END = "\\documentclass{article}\\begin{document}\n", "\n\\end{document}\n"
#: name: (files, status, files in order of expansion, or None where it isn't complete)
WORKSPACES = {
    "child and parent": ({"main": DOC + "\\input{child}\nrest" + END, "child": "text"}, "resolved", ["main", "child"]),
    "other folder": ({"main": DOC + "\\input{parts/one}" + END, "parts/one": "\\input{two.tex}\\include{../three}", "parts/two": "x", "three": "y"}, "resolved", ["main", "parts/one", "parts/two", "three"]),
    "cycle": ({"main": DOC + "\\input{a}" + END, "a": "\\input{b}", "b": "\\input{a}"}, "partial", None),
    "no includes": ({"main": DOC + "% \\input{ghost}\n\\begin{verbatim}\n\\input{ghost}\\ref{ghost}\n\\end{verbatim}" + END}, "resolved", ["main"]),
    "in an argument": ({"main": "\\newcommand{\\later}{\\input{ghost}}\\newcommand\\other[1]{\\input{ghost}}" + DOC + "\\emph[x]{a}{\\input{ghost}}" + END}, "resolved", ["main"]),
    "in plain braces": ({"main": DOC + "and {\\input{part}}" + END, "part": ""}, "resolved", ["main", "part"]),
    "macro with argument": ({"main": "\\def\\pick#1{#1}" + DOC + "\\input{\\pick{part}}" + END, "part": ""}, "partial", None),
    "macro": ({"main": "\\newcommand{\\file}{part}" + DOC + "\\input{\\file}" + END, "part": ""}, "partial", None),
    "malformed": ({"main": DOC + "\\input{{part}" + END, "part": ""}, "source_error", None),
    "empty target": ({"main": DOC + "\\input{ }" + END}, "source_error", None),
    "missing": ({"main": DOC + "\\input{gone}" + END}, "partial", None),
    "nested": ({"main": DOC + "\\input{a}" + END, "a": "\\input{b}", "b": "x"}, "resolved", ["main", "a", "b"]),
    "twice": ({"main": DOC + "\\input{a}\\input{a}" + END, "a": "x"}, "resolved", ["main", "a", "a"]),
    "unclosed": ({"main": DOC + "\\begin{lemma} x"}, "source_error", ["main"]),
    "open formula": ({"main": DOC + "it costs 5 $ each" + END}, "resolved", ["main"]),
    "unreached defect": ({"main": DOC + END, "loose": "\\end{lemma}"}, "resolved", ["main"]),
}


def lemma(label, text="x", proof=None, env="lemma"):
    return f"\\begin{{{env}}}\\label{{{label}}}\n{text}\n\\end{{{env}}}\n" + (f"\\begin{{proof}}\n{proof}\n\\end{{proof}}\n" if proof is not None else "")


#: name: (files, findings as (rule, unit, subject), direct dependencies by identifier)
PROJECTS = {
    "clean": ({"main": DOC + lemma("a", "A.", "Clear.") + lemma("b", "B.", "Use \\ref{a}.") + END}, [], [("b", "a")]),
    "chain": ({"main": "\\newtheorem{fact}{Fact}\\input{s}", "s": lemma("a", proof="p") + lemma("b", proof="By \\ref{a}.", env="fact") + lemma("c", proof="By \\ref{b}.") + lemma("d", proof="Clear.")}, [], [("b", "a"), ("c", "b")]),
    "circle": ({"main": DOC + lemma("a", "From \\ref{b}.") + lemma("b", "From \\ref{c}.") + lemma("c", "From \\ref{a}.") + END}, [("TH104", "a", "a -> b -> c -> a")], [("a", "b"), ("b", "c"), ("c", "a")]),
    "loop": ({"main": lemma("a", proof="By \\ref{a}.")}, [("TH104", "a", "a -> a")], [("a", "a")]),
    "twice": ({"main": lemma("d") + lemma("d") + lemma("u", "Use \\ref{d}.")}, [("TH101", "d", "d"), ("TH102", "u", "d")], []),
    "equation": ({"main": lemma("a", proof="\\begin{equation}\\label{eq}1=1\\end{equation} By \\eqref{eq}.")}, [], []),
    "caption and section": ({"main": DOC + "\\section{One \\label{sec}}\\begin{figure}\\caption{Of % \\label{no} }\n \\ref{a} \\label{fig}}\\end{figure}" + lemma("a", "See \\ref{fig}, \\ref{sec} and \\ref{no}.") + END}, [("TH103", "a", "no")], []),
    "all": ({"main": lemma("d") + lemma("d") + lemma("a", proof="By \\ref{b}.") + lemma("b", proof="By \\ref{a}.") + lemma("t", proof="By \\cref{d, gone}.")}, [("TH101", "d", "d"), ("TH102", "t", "d"), ("TH103", "t", "gone"), ("TH104", "a", "a -> b -> a")], [("a", "b"), ("b", "a")]),
    "subfolder": ({"main": DOC + "\\input{sections/one}" + lemma("t", proof="By \\ref{l}.") + END, "sections/one": lemma("l")}, [], [("t", "l")]),
    "unreached": ({"main": lemma("a", "By \\ref{z}."), "loose": lemma("z", "By \\ref{none}.")}, [("TH103", "a", "z")], []),
    "without label": ({"main": "\n" + lemma("a") + "\\begin{claim}By \\ref{a} and \\ref{q}.\\end{claim}"}, [("TH103", "main:5:claim", "q")], [("main:5:claim", "a")]),
    "result in a result": ({"main": lemma("o", "By \\ref{x}. " + lemma("i", "By \\ref{y}.") + " By \\ref{x}.") + lemma("x") + lemma("y")}, [], [("i", "y"), ("o", "x"), ("o", "y")]),
}


def manuscripts(spark, projects):
    rows = [(i, 0 if name == "main" else j, name, raw) for i, (files, *_) in enumerate(projects.values()) for j, (name, raw) in enumerate(sorted(files.items(), key=lambda f: f[0] != "main"))]
    return Manuscript(spark.createDataFrame(rows, "project_id long, ord int, file string, raw string"))


@pytest.fixture(scope="module")
def workspaces(spark):
    held = manuscripts(spark, WORKSPACES)
    yield held
    held.release()


@pytest.fixture(scope="module")
def projects(spark):
    held = manuscripts(spark, PROJECTS)
    yield held
    held.release()


def test_workspace_outcomes(workspaces):
    status = {r.project_id: r.workspace for r in workspaces.status.collect()}
    order = {}
    for r in workspaces.workspace.where("kind = 'file'").orderBy("project_id", "occurrence").collect():
        order.setdefault(r.project_id, []).append(r.file)
    for i, (name, (_, state, expanded)) in enumerate(WORKSPACES.items()):
        assert status[i] == state, name
        assert expanded is None or order[i] == expanded, name


def test_findings_name_results(projects):
    found = {}
    for r in projects.findings().collect():
        found.setdefault(r.project_id, []).append((r.rule, r.unit, r.subject))
        assert r.file and r.line > 0 and r.title and r.evidence
    for i, (name, (_, expected, _)) in enumerate(PROJECTS.items()):
        assert sorted(found.get(i, [])) == expected, name


def test_direct_reverse_and_transitive_dependencies(projects):
    names = {(r.project_id, r.node): r.identifier for r in projects.results.collect()}
    direct = {}
    for r in projects.resolved_pairs.collect():
        direct.setdefault(r.project_id, []).append((names[r.project_id, r.source], names[r.project_id, r.target]))
    for i, (name, (_, _, expected)) in enumerate(PROJECTS.items()):
        assert sorted(direct.get(i, [])) == expected, name
    chain = list(PROJECTS).index("chain")
    assert [names[chain, n] for n in range(4)] == ["a", "b", "c", "d"]
    assert {(r.source, r.dependent) for r in projects.reverse().where(f"project_id = {chain}").collect()} == {(0, 1), (1, 2)}
    assert {(r.source, r.target) for r in projects.transitive().where(f"project_id = {chain}").collect()} == {(1, 0), (2, 0), (2, 1)}
    assert {(r.source, tuple(r.path)) for r in projects.paths().where(f"project_id = {chain}").collect()} == {(1, (1, 0)), (2, (2, 1)), (2, (2, 1, 0))}
    context = {r.node: r.context for r in projects.dependency_context().where(f"project_id = {chain}").collect()}
    assert context[1] == ["[lemma a] \\label{a} x (s:1-3)"]


def test_evidence_and_lines(projects):
    rows = {(r.rule, r.project_id): r for r in projects.findings().collect()}
    twice = list(PROJECTS).index("twice")
    found = rows["TH101", twice]
    assert found.line == 4 and found.evidence == ["label d occurs at main:1-3", "label d occurs at main:4-6"]
    assert rows["TH102", twice].evidence == ["target label: d"]


def test_context_and_excerpts(projects):
    i = list(PROJECTS).index("clean")
    context = {r.node: r.context for r in projects.local_context(lines=2).where(f"project_id = {i}").collect()}
    assert context[0] == DOC.strip() and context[1] == "Clear.\n\\end{proof}"
    places = projects.results.where(f"project_id = {i} and node = 1").select("project_id", "ord", "sl", "el")
    assert [r.excerpt.split("\n")[0] for r in projects.excerpts(places).collect()] == ["\\end{proof}"]
    assert [len(r.excerpt.split("\n")) for r in projects.excerpts(places, around=30, most=4).collect()] == [4]


def test_project_order_follows_includes(spark):
    files = {"main": lemma("one") + "\\input{x}" + lemma("three"), "x": lemma("two")}
    m = manuscripts(spark, {"p": (files,)})
    assert [r.identifier for r in m.results.orderBy("node").collect()] == ["one", "two", "three"]


def test_arguments_are_told_from_plain_braces():
    for text, inner in (("\\foo{X}", True), ("{X}", False), ("\\foo[a]{b} {X}", True), ("\\foo a {X}", False), ("\\foo{a} b {X}", False), ("\\foo{a{X}}", True), ("\\foo{X", False), ("% \\foo{\nX}", False)):
        assert in_argument(text, text.index("X")) is inner, text


def test_columns_count_from_one():
    facts = scan("ab \\ref{x}\n  $y$")
    assert [(f[1], f[8], f[13]) for f in facts] == [("ref", 1, 4), ("$", 2, 3)]


def test_structural_environments_carry_no_text():
    facts = {f[1]: f[10] for f in scan("\\begin{document}\\begin{lemma}x\\end{lemma}\\end{document}") if f[0] == "env"}
    assert facts == {"document": None, "lemma": "x"}


def test_a_root_holds_its_subfolders(spark, tmp_path):
    for name, raw in {"p/main.tex": "\\input{sections/one}", "p/sections/one.tex": lemma("a"), "p/sections/deep/two.tex": "", "q/paper.tex": "x", "q/app b.tex": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(raw)
    rows = read_manuscripts(spark, str(tmp_path)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.project_id, set()).add((r.ord, r.file))
    assert sorted(map(sorted, found.values())) == [[(0, "app b"), (1, "paper")], [(0, "main"), (1, "sections/deep/two"), (2, "sections/one")]]
    m = Manuscript(read_manuscripts(spark, str(tmp_path / "p")))
    assert [r.identifier for r in m.results.collect()] == ["a"] and m.findings().count() == 0
    other = read_manuscripts(spark, str(tmp_path / "q"), main="paper").where("ord = 0").collect()
    assert [r.file for r in other] == ["paper"]


def test_prose_of_a_file(spark):
    raw = "\\usepackage{x} preamble\n\\begin{document}Some $x$ text. % note\n\\begin{verbatim}no\\end{verbatim} More.\\end{document} behind"
    m = manuscripts(spark, {"p": ({"main": raw},), "q": ({"main": "text \\begin{lemma}"},)})
    prose = [raw[r.s : r.e] for r in m.prose().where("project_id = 0").orderBy("s").collect()]
    assert [x for x in prose if x.strip()] == ["Some ", " text. ", " More."]
    assert m.prose().where("project_id = 1").count() == 0  # its regions aren't known
    spans = spark.createDataFrame([(0, 0, raw.index("Some"), raw.index("Some") + 4), (0, 0, raw.index("Some"), raw.index("text")), (0, 0, 0, 3)], "project_id long, ord int, s int, e int")
    assert [(r.s, r.e) for r in m.eligible(spans).collect()] == [(raw.index("Some"), raw.index("Some") + 4)]
