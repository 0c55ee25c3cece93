"""Symbol introductions and uses in each form that a manuscript can hold, planted."""

from scholia.functions import symbols as sx
from scholia.operators import control, symbols
from scholia.operators.structure import Manuscript

RAW = r"""\newcommand{\defeq}[0]{\stackrel{\mathrm{def}}{=}}
Put $K_{1} := 3$ and $\rho \coloneqq 2$ and $c \defeq 5$ and $d \stackrel{\text{def}}{=} 7$ but $e = 9$.
\begin{equation}g := h\end{equation}
\begin{lemma}\label{a}
Let $x, y$ be points. For every $\varepsilon > 0$ define $f(t) = t$ and set $x_{1} = 4$. Let $T: A \to B$ be a map.
Then $\forall z \in Z, z > x_1$ and $\varepsilon < y$.
\end{lemma}
\begin{proof}
Let $\varepsilon \colon A \to B$ be a map. Here $w := 3$ and $\varepsilon > x_{1}$, for each $n \in N$ it holds.
\end{proof}
"""


def manuscript(spark, raw=RAW):
    return Manuscript(spark.createDataFrame([(0, 0, "main", raw)], "project_id long, ord int, file string, raw string"))


def test_each_form_introduces(spark):
    found = {(r.scope, r.kind, r.name, r.role) for r in symbols.all_introductions(manuscript(spark)).collect()}
    project = {("project", "define", x, "unknown") for x in ("K_1", r"\rho", "c", "d", "g")}
    result = {("let", "x", "unknown"), ("let", "y", "unknown"), ("for", r"\varepsilon", "scalar"), ("define", "f", "function"), ("set", "x_1", "unknown"), ("let", "T", "map")}
    proof = {("let", r"\varepsilon", "map"), ("for", "n", "unknown")}
    assert found == project | {("result", *x) for x in result} | {("proof", *x) for x in proof} | {("local", "quantifier", "z", "unknown")}


def test_uses_take_the_innermost_scope(spark):
    m = manuscript(spark)
    uses = {(r.name, RAW[r.use_s :].split("$")[1], r.role) for r in symbols.resolved_uses(m).collect()}
    assert {("z", r"\forall z \in Z, z > x_1", "unknown"), ("x_1", r"\forall z \in Z, z > x_1", "unknown"), (r"\varepsilon", r"\varepsilon < y", "scalar"), ("y", r"\varepsilon < y", "unknown"), (r"\varepsilon", r"\varepsilon > x_{1}", "map"), ("x_1", r"\varepsilon > x_{1}", "unknown")} <= uses
    names = {r.name: r.resolution for r in control.name_references(m).collect()}
    assert names["x_1"] == names["T"] == "resolved" and names[r"\varepsilon"] == "ambiguous" and names["w"] == "unresolved"
    # the roles of \varepsilon stand in two scopes
    assert symbols.role_conflicts(m).count() == 0


def test_conflict_in_a_proof(spark):
    raw = "\\begin{lemma}a\\end{lemma}\\begin{proof}Let $\\alpha > 0$ be small. Define $\\alpha(t) = t$.\\end{proof}"
    assert [r.subject for r in symbols.role_conflicts(manuscript(spark, raw)).collect()] == ["\\alpha: scalar, function"]


def test_names_and_operators():
    assert sx.introduced(r"x \left( y", "for") == [] and sx.introduced("xy", "let") == []
    assert sx.defines(r"\overset{def}{{=}}") and not sx.defines(r"\stackrel{!}{=}") and not sx.defines(":= 3")
    assert sx.mentions(r"\mathbb{R} + R + \L + L", ["R", "L"]) == [("R", 13), ("L", 22)]
