"""Scanner, sentence splitter, formulas and closures on small golden inputs."""

import pytest

from scholia.functions import formula as fx
from scholia.functions.scan import attached, group, scan
from scholia.operators import ledger
from scholia.operators.structure import Manuscript, merge_intervals
from scholia.operators.support import sentences, split_claims
from scholia.plans.fixpoint import doubled_pairs, reachable_pairs


def kinds(text):
    return [(f[0], f[1], f[2]) for f in scan(text)]


def test_groups_nest_and_escape():
    assert group("{a{b}c}d", 0) == ("a{b}c", 7)
    assert group(r"{a\}b}", 0) == (r"a\}b", 6)
    assert group("{open", 0) is None and group("x", 0) is None


def test_scanner_facts():
    text = "\\newtheorem{obs}{Observation}\n% \\label{no}\n\\begin{obs}[T]\\label{a}\nLet $x$ be \\[ y \\] 5\\% of $$z$$\n\\end{obs}"
    found = kinds(text)
    assert ("macro", "newtheorem", "obs") in found and ("env", "obs", None) in found
    assert [f[1] for f in scan(text) if f[0] == "math"] == ["$", "\\[", "$$"]
    assert [f[2] for f in scan(text) if f[1] == "label"] == ["a"]
    env = next(f for f in scan(text) if f[0] == "env")
    assert env[3] == "T" and text[env[4] : env[5]].startswith("\\begin{obs}") and env[8:10] == (3, 5)


def test_scanner_spans_are_code_points():
    text = "\U0001d53dé $x$"
    math = scan(text)[0]
    assert text[math[4] : math[5]] == "$x$" and math[10] == "x"


def test_scanner_defects_and_literals():
    assert ("defect", "unclosed", "lemma") in kinds("\\begin{lemma} x")
    assert ("defect", "unopened", "lemma") in kinds("\\end{lemma}")
    assert ("defect", "open math", "$") in kinds("a $ b")
    assert kinds("\\begin{verbatim}\\label{x}$\\end{verbatim}") == [("env", "verbatim", None), ("macro", "begin", "verbatim")]
    assert scan("") == [] and scan("plain words") == []


def test_sentences_keep_formulas_whole():
    text = "By $a. b$ it holds. Then \\[ x. y \\] ends! Last"
    plain = "One. Two? 3.5 is one.\n\nNext"
    assert [plain[a:b] for a, b in sentences(plain)] == ["One.", "Two?", "3.5 is one.", "Next"]
    assert [text[a:b] for _, a, b in split_claims(text)] == ["By $a. b$ it holds.", "Then", "\\[ x. y \\]", "ends!", "Last"]


@pytest.mark.parametrize(
    "source,text",
    [
        ("a + b \\cdot c", "(a + (b * c))"),
        ("a \\Rightarrow b \\Rightarrow c", "(a => (b => c))"),
        ("a \\land b \\lor c", "((a /\\ b) \\/ c)"),
        ("x < y", "(x < y)"),
        ("\\forall x \\in N, x \\ge 0", "(forall x in N, (x >= 0))"),
        ("f(x, y_{1})", "f(x, y_1)"),
        ("2^{n}^m", None),
        ("a < b < c", None),
        ("\\neg p \\lor q", "(~p \\/ q)"),
        ("-x + 1", "(-x + 1)"),
        ("", None),
        ("(a", None),
    ],
)
def test_formulas(source, text):
    x = fx.parse(source)
    if text is None:
        assert x[0] == "opaque" or source.startswith("2^")
    else:
        assert fx.render(x) == text and fx.status(x) == "full"


def test_alpha_substitution_and_capture():
    a, b = fx.parse("\\forall x \\in N, x > y"), fx.parse("\\forall z \\in N, z > y")
    assert a != b and fx.alpha(a) == fx.alpha(b)
    assert fx.free_names(a) == {"N", "y"}
    moved = fx.substitute(a, "y", ("id", "x"))
    assert fx.free_names(moved) == {"N", "x"} and fx.alpha(moved) != fx.alpha(fx.parse("\\forall x \\in N, x > x"))


def test_matching_and_replacement():
    template, target = fx.parse("P(x) \\Rightarrow Q(x)"), fx.parse("P(3) \\Rightarrow Q(3)")
    assert fx.match(template, target, frozenset({"x"})) == {"x": ("num", "3")}
    assert fx.match(template, fx.parse("P(3) \\Rightarrow Q(4)"), frozenset({"x"})) is None
    a, b = fx.parse("a + b = c"), fx.parse("d + b = c")
    assert fx.replacement_sites(a, b, ("id", "a"), ("id", "d")) == [(2, 2)]
    assert fx.replacement_sites(a, fx.parse("d + e = c"), ("id", "a"), ("id", "d")) is None


def test_codec_round_trip():
    lines = ["the same long phrase again and again", "the same long phrase once", "other", ""] * 5
    kept, coded = ledger.encode(lines)
    assert kept and ledger.decode(kept, coded) == lines and sum(map(len, coded)) < sum(map(len, lines))
    assert ledger.encode(["\ue000 x x x"])[0] == []


def test_closures(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 5, 6)], "project_id long, source int, target int")
    found = sorted((r.project_id, r.source, r.target) for r in reachable_pairs(edges).collect())
    assert found == [(1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 1, 2), (1, 2, 0), (1, 2, 1), (2, 5, 6)]
    doubled = sorted((r.source, r.target) for r in doubled_pairs(edges.where("project_id = 1")).collect())
    assert doubled == [(a, b) for a in range(3) for b in range(3)]


def test_intervals_merge_when_they_touch(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 1, 2)], "k int, s int, e int")
    assert sorted(map(tuple, merge_intervals(spans, ["k"]).collect())) == [(1, 0, 5), (1, 7, 9), (2, 1, 2)]


def project(spark, files):
    return Manuscript(spark.createDataFrame([(1, i, name, raw) for i, (name, raw) in enumerate(files)], "project_id long, ord int, file string, raw string"))


def result(label, proof, env="lemma"):
    return f"\\begin{{{env}}}\\label{{{label}}} x \\end{{{env}}}\n\\begin{{proof}}{proof}\\end{{proof}}\n"


def test_cycle_duplicate_missing_and_known_labels(spark):
    main = result("a", "By \\ref{b}.") + "\\input{two}\\input{three}\\begin{equation}\\label{eq}\\end{equation}"
    m = project(spark, [("main", main), ("two", result("b", "By \\cref{c, nowhere} and \\eqref{eq}.")), ("three", result("c", "By \\ref{a}, \\ref{d}.") + "\\input{four}"), ("four", result("d", "") + result("d", ""))])
    assert [r.members for r in m.cycles().collect()] == [[0, 1, 2]]
    rules = sorted((r.rule, r.subject) for r in m.findings().collect())
    assert rules == [("TH101", "d"), ("TH102", "d"), ("TH103", "nowhere"), ("TH104", "a -> b -> c -> a")]


def test_partial_workspace_resolves_nothing(spark):
    m = project(spark, [("main", result("a", "By \\ref{b}.") + "\\input{two}\\input{gone}"), ("two", result("b", ""))])
    assert [(r.label, r.resolution) for r in m.edges.collect()] == [("b", "ambiguous")]
    assert [r.workspace for r in m.status.collect()] == ["partial"]


def test_repeated_file_is_two_occurrences(spark):
    m = project(spark, [("main", result("a", "By \\ref{b}.") + "\\input{part}\\input{part}"), ("part", result("b", ""))])
    assert [r.ord for r in m.workspace.where("kind = 'file'").orderBy("occurrence").collect()] == [0, 1, 1]
    assert [r.resolution for r in m.edges.collect()] == ["ambiguous"]


def test_empty_manuscripts(spark):
    m = project(spark, [("main", "")])
    assert m.findings().count() == 0 and m.claims.count() == 0 and m.prose().count() == 0


def test_labels_and_proofs_of_environments():
    def found(text):
        return [(f[1], *more) for f, more in zip(scan(text), attached(scan(text))) if f[0] == "env"]

    proof = "\\begin{proof}P\\end{proof}"
    near = found("\\label{out}\\begin{lemma}\\label{a}x\\label{b}\\end{lemma}\n" + proof)
    assert [(r[0], r[1], r[3], r[6]) for r in near] == [("lemma", "a", 2, "P"), ("proof", None, None, None)]
    assert found("\\begin{lemma}x\\end{lemma}\\label{a}") == [("lemma", None, None, None, None, None, None)]
    edge = "\\begin{lemma}x\\end{lemma}" + "\n" * 40 + proof
    assert found(edge)[0][6] == "P" and found(edge.replace("\n", "\n\n", 1))[0][6] is None
    nested = found("\\begin{lemma}" + proof + "\\end{lemma}")
    assert nested[0][:1] == ("lemma",) and nested[0][6] is None
    assert list(attached([])) == []


def test_a_proof_belongs_to_the_last_result_before_it(spark):
    raw = "\\begin{lemma}x\\end{lemma}\n\\begin{claim}y\\end{claim}\n\\begin{proof}P\\end{proof}\n\\begin{proof}Q\\end{proof}"
    files = spark.createDataFrame([(1, 0, "main", raw), (2, 0, "main", None), (3, 0, "main", "")], "project_id long, ord int, file string, raw string")
    rows = Manuscript(files).results.orderBy("s").collect()
    assert [(r.env, r.label, r.identifier, r.proof) for r in rows] == [("lemma", None, "main:1:lemma", None), ("claim", None, "main:2:claim", "P")]
