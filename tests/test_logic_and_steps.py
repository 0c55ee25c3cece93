"""Statements in words, their rendering and parts, Lean text, what steps do, control structures, and symbols of the project."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.functions import formula as fx
from scholia.functions import logic
from scholia.functions.scan import scan_manuscripts
from scholia.operators import ledger, symbols, transform
from scholia.operators.structure import Manuscript
from scholia.plans.queries import QUERIES
from scholia.sources import frontends, sinks


@pytest.mark.parametrize(
    "text,shown",
    [
        ("For every natural $n$, $P(n)$ implies $Q(n)$.", "forall n in ℕ, P(n) => Q(n)"),
        ("for all x in X, if $a$ then $b$ or $c$", "forall x in X, a => b \\/ c"),
        ("there exists an integer $m$ such that $m > 0$", "exists m in Z, m > 0"),
        ("$a$ if and only if $b$ and $c$", "a <=> b /\\ c"),
        ("$x$ is at most $y + z$", "x <= y + z"),
        ("$x$ does not belong to $(A)$", "x notin A"),
        ("not $p$", "~p"),
        ("$(a \\lor b) \\land c$", "(a \\/ b) /\\ c"),
        ("$a - (b - c)$", "a - (b - c)"),
        ("$(a \\Rightarrow b) \\Rightarrow c \\Rightarrow d$", "(a => b) => c => d"),
        ("$\\forall n \\in \\mathbb{N}, P(n)$", "forall n in ℕ, P(n)"),
        ("We like $x$ a lot", "?[We like x a lot]"),
        ("One. Two and three.", "?[One. Two and three]"),
        ("", "?[]"),
    ],
)
def test_statements(text, shown):
    assert logic.show(logic.read(text)) == shown


names = st.sampled_from("abcxyz").map(lambda n: ("id", n))
terms = st.recursive(names, lambda x: st.tuples(st.just("bin"), st.sampled_from("+-*/^"), x, x), max_leaves=5)
statements = st.recursive(
    st.tuples(st.just("rel"), st.sampled_from(["=", "<", "<="]), terms, terms) | names,
    lambda x: st.tuples(st.sampled_from(["and", "or", "implies", "iff"]), x, x) | st.tuples(st.just("not"), x),
    max_leaves=6,
)


@given(statements)
@settings(max_examples=300, deadline=None)
def test_plain_rendering_reads_back(x):
    shown = logic.show(x)
    for sign, command in (("<=>", "\\iff "), ("=>", "\\implies "), ("\\/", "\\lor "), ("/\\", "\\land "), ("<=", "\\le "), ("~", "\\neg ")):
        shown = shown.replace(f" {sign} ", f" {command} ") if sign != "~" else shown.replace("~", command)
    assert fx.parse(shown) == x, logic.show(x)


def test_parts_and_paths():
    x = fx.parse("\\forall n \\in N, P(n, 2) \\Rightarrow a = b")
    found = dict(logic.parts(x))
    assert found[("body", "left", "argument 1")] == ("num", "2") and found[("domain",)] == ("id", "N")
    assert all(logic.part(x, path) == inner for path, inner in found.items())
    with pytest.raises(KeyError):
        logic.part(x, ("body", "operand"))


def test_applications():
    rule = logic.read("for every natural $n$, if $P(n)$ then $Q(n)$")
    three = ("num", "3")
    assert logic.application(rule, fx.parse("Q(3)")) == ({"n": three}, ("app", "P", (three,)))
    assert logic.application(rule, fx.parse("P(3) \\Rightarrow Q(3)")) == ({"n": three}, None)
    assert logic.application(rule, fx.parse("P(3) \\Rightarrow Q(4)")) is None
    assert logic.application(logic.read("for every $x$, for every $y$, $R(x)$"), fx.parse("R(1)")) is None  # nothing fixes y
    swap = logic.read("for all $x$, for all $y$, if $S(x, y)$ then $S(y, x)$")
    assert logic.application(swap, fx.parse("S(y, x)"))[1] == fx.parse("S(x, y)")
    assert logic.instantiation(fx.parse("\\forall x \\in X, x > y"), fx.parse("3 > y")) == ("x", three)
    assert logic.instantiation(fx.parse("\\forall x \\in X, x > x"), fx.parse("3 > 4")) is None


def test_lean_text():
    rule = "for every natural $n$, if $P(n)$ then $Q(n)$"
    assert logic.lean_export("thm:A", "$Q(3)$", [("r", rule)]) == ("theorem scholia_thm_a (P Q : Nat → Prop) (h1 : ∀ n : Nat, P n → Q n) : Q 3 := by exact h1 3 sorry", "partial", ["P(3)"])
    assert logic.lean_export("1", "$Q(3)$", [("r", "for every natural $k$, $Q(k)$")])[:2] == ("theorem scholia_result_1 (Q : Nat → Prop) (h1 : ∀ k : Nat, Q k) : Q 3 := by exact h1 3", "complete")
    assert logic.lean_export("a", "$Q(3)$", [])[1] == "unsupported"  # a numeral alone says nothing of Q's domain
    assert logic.lean_export("a", "for every natural $let$, $Q(n)$", [])[1] == "unsupported"
    with pytest.raises(logic.Unsupported):
        logic.lean_name("theorem")


RAW = r"""\begin{lemma}\label{rule}
For every natural $n$, if $P(n)$ then $Q(n)$.
\end{lemma}
\begin{theorem}\label{goal}
There exists $m$ such that $Q(m)$.
\end{theorem}
\begin{proof}
We have $P(2)$. By \ref{rule}, $Q(2)$. By \ref{rule}, $Q(5)$. By the definition, $e = f$. We claim that $e > 1$. Hence $f > 1$. So $e > 1$.
Either $a \lor b$. If so, $a \Rightarrow c$. Else $b \Rightarrow c$. By continuity, $g$. Now $\neg g$. Suppose not.
\end{proof}
\begin{lemma}
If $a$, then $b$.
\end{lemma}
\begin{proof}
Assume $\neg b$. Show $\neg b \Rightarrow \neg a$. And $R(0)$. Next $R(k) \Rightarrow R(k + 1)$.
\end{proof}
"""


def project(spark, files):
    return Manuscript(spark.createDataFrame([(p, o, name, raw) for p, rows in enumerate(files) for o, (name, raw) in enumerate(rows)], "project_id long, ord int, file string, raw string"))


@pytest.fixture(scope="module")
def proofs(spark):
    held = project(spark, [[("main", RAW)]])
    yield held
    held.release()


def test_steps_of_a_proof(proofs):
    found = {(r.idx, r.step): (r.source, r.status, r.bindings, r.premise) for r in transform.transformations(proofs).collect()}
    assert found[1, "result_application"] == ("rule", "confident", "n = 2", "P(2)")
    assert found[2, "result_application"] == ("rule", "unresolved", "n = 5", "P(5)")
    assert found[3, "definition_use"][1] == "confident"
    assert found[5, "equality_rewrite"] == ("4", "confident", "e -> f", None)
    assert any(step == "named_property" and v[0] == "continuity" for (_, step), v in found.items())


def test_structures_of_proofs(proofs):
    found = {(r.node, r.structure): (r.asserted, r.support_status) for r in transform.structures(proofs).collect()}
    assert found == {
        (1, "subproof"): (True, "confident"), (1, "cases"): (False, "confident"), (1, "contradiction"): (True, "confident"), (1, "witness"): (False, "confident"),
        (2, "contraposition"): (False, "confident"), (2, "induction"): (False, "confident"),
    }


def test_lean_of_a_project(proofs):
    assert {r.node: r.lean_status for r in transform.lean_exports(proofs).collect()} == {0: "partial", 1: "unsupported", 2: "unsupported"}


def test_graph_of_a_project(proofs, spark):
    edges = [(r.source, r.target, r.status, r.sources) for r in sinks.overview_edges(proofs).collect()]
    assert edges == [(0, 1, "confident", 2)]
    odd = project(spark, [[("main", "\\begin{lemma}\\label{x}</script>&\\end{lemma}")]])
    page = sinks.graph_pages(odd).first().html
    assert page.count("</script>") == 2 and "\\u003c/script\\u003e\\u0026" in page


DEFINE = "Put $K := 1$.\n"
USE = "\\begin{lemma}\\label{%s}\nHere $K > 0$.\n\\end{lemma}\n"


def test_project_symbols_by_occurrence(spark):
    cases = {
        "before": [("main", DEFINE + USE % "a")],
        "after": [("main", USE % "a" + DEFINE)],
        "in an earlier include": [("main", "\\input{d}" + USE % "a"), ("d", DEFINE)],
        "in a later include": [("main", USE % "a" + "\\input{d}"), ("d", DEFINE)],
        "latest": [("main", DEFINE + "Put $K \\coloneqq 2$.\n" + USE % "a")],
        "differs by occurrence": [("main", DEFINE + "\\input{u}Put $K := 2$.\\input{u}"), ("u", USE % "a")],
        "agrees in both": [("main", DEFINE + "\\input{u}\\input{u}"), ("u", USE % "a")],
        "partial": [("main", DEFINE + USE % "a" + "\\input{gone}")],
        "shadowed": [("main", DEFINE + "\\begin{lemma}Let $K > 2$ be given. Here $K > 0$.\\end{lemma}")],
        "through another": [("main", "Put $K := 1$. Put $L := K + 1$.\n\\begin{lemma}Here $L > 0$.\\end{lemma}")],
    }
    m = project(spark, list(cases.values()))
    number = {name: i for i, name in enumerate(cases)}
    found = {(r.project_id, r.name): r.symbol for r in symbols.project_uses(m).where("ord >= 0").collect()}
    expected = {"before": 0, "after": None, "in an earlier include": 0, "in a later include": None, "latest": 1, "differs by occurrence": None, "agrees in both": 0, "partial": None}
    assert {name: found[number[name], "K"] for name in expected} == expected
    assert (number["shadowed"], "K") not in found
    closed = {(r.node, r.symbol) for r in symbols.symbol_closure(m).where(f"project_id = {number['through another']}").collect()}
    assert closed == {(0, 0), (0, 1)}
    scopes = {(r.name, r.scope, r["rank"], r.nearest) for r in symbols.visible(m).where(f"project_id = {number['shadowed']}").collect()}
    assert scopes == {("K", "result", 2, True)}


def test_scanners_by_name(spark):
    assert frontends.get_scanner() and frontends.get_scanner("regex")
    for name in ("tree-sitter", "nothing"):
        with pytest.raises(ValueError):
            frontends.get_scanner(name)
    frontends.register("few", lambda files: scan_manuscripts(files).drop("sc"))
    files = spark.createDataFrame([(0, 0, "main", "x")], "project_id long, ord int, file string, raw string")
    with pytest.raises(ValueError, match="sc"):
        Manuscript(files, frontends.get_scanner("few")).facts.count()


def test_sequences_of_long_texts(spark):
    words = [f"w{i % 300}" for i in range(1200)]
    texts = spark.createDataFrame([(" ".join(words),), ("a b", ), (None,), ("",), ("a b",)], "t string")
    found = {r.gram: r.n for r in ledger.ngrams(texts, "t", 4).collect()}
    expected = {}
    for text in (" ".join(words), "a b", "a b"):
        w = text.split()
        for i in range(len(w)):
            for n in range(1, min(4, len(w) - i) + 1):
                gram = " ".join(w[i : i + n])
                if 3 <= len(gram) <= 192:
                    expected[gram] = expected.get(gram, 0) + 1
    assert found == {k: n for k, n in expected.items() if n > 1}
    tails = {r.gram: r.n for r in ledger.ngrams(texts, "t", 4, tails=True).collect()}
    assert tails["a b"] == 4


def test_first_sequences_are_found_without_a_shuffle_of_all(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(3000, 0, -1), k=80)) for _ in range(2000)]
    texts += [*texts[:9], *texts[:4], " ".join(rng.choices(vocabulary, k=1500)), "a  b c ", " ", "", None, "é é é"]
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).write.parquet(folder)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    found = QUERIES["ngram_candidates"](spark, str(tmp_path)).collect()
    moved = written() - before
    assert moved < 20 * sum(len((t or "").encode()) for t in texts), moved
    whole = ledger.ranked_dictionary(ledger.ngrams(spark.read.parquet(folder), "text")).collect()
    assert found == whole and len(found) == 1024


def test_first_sequences_of_flat_and_few_counts(spark):
    # all pairs save the same, so that bounds alone decide nothing and the order of the texts does
    flat = spark.createDataFrame([(f"{i:05d} {i % 7 + 1:03d}",) for i in range(3000) for _ in range(2)], "t string")
    few = spark.createDataFrame([("a b c",), ("a b",), ("x y z",), (None,)], "t string")
    for texts, top, words in ((flat, 5, 20), (flat, 40, 1), (few, 1024, 20), (few, 1, 2), (few.where("t is null"), 3, 20)):
        whole = ledger.ranked_dictionary(ledger.ngrams(texts, "t", words), top).collect()
        assert ledger.ranked_ngrams(texts, "t", words, top).collect() == whole


def test_sequences_of_one_hash_are_kept_apart():
    words, code = np.array(["a", "b", "c"], dtype=object), np.array([0, 1, 0, 1, 0, 2, 2])
    first, n = np.array([0, 2, 4, 4, 6]), np.array([2, 2, 2, 1, 1])
    grams, count = ledger._told(words, code, first, n, np.zeros(5, np.uint64))
    assert sorted(zip(grams, count.tolist())) == [("a", 1), ("a b", 2), ("a c", 1), ("c", 1)]


def test_words_outside_results_introduce_for_the_project(spark):
    raw = r"""Let $A$ be odd. \begin{document}
Define $g(t) = t^2$. Set $B = 3$. Let $C = [0, 1]$. Let $T \colon X \to Y$ be a map. Let $D$ be a set. For every $n > 0$ we go.
For each $m > 0$ throughout the text. We write $a \sim b$ to mean $a = b + 1$. But $a \approx b$ is $c$.
\begin{lemma}Set $E = 5$. Here $B > 1$ and $T$ and $a \sim c$.\end{lemma}
\end{document} Set $F = 6$."""
    m = project(spark, [[("main", raw)]])
    found = {(r.name, r.kind, r.role) for r in symbols.project_context(m).collect()}
    assert found == {("g", "define", "function"), ("B", "set", "unknown"), ("C", "let", "unknown"), ("T", "let", "map"), ("m", "for", "scalar"), ("\\sim", "define", "unknown")}
    uses = {r.name for r in symbols.project_uses(m).where("symbol is not null").collect()}
    assert {"B", "T"} <= uses
    m.release()


@given(st.lists(st.lists(st.text(alphabet="ab @0:\\é", min_size=1, max_size=30).filter(lambda x: x.strip()), min_size=1, max_size=8), min_size=1, max_size=3))
@settings(max_examples=150, deadline=None)
def test_wire_text_comes_back(packets):
    wire = ledger.to_wire(packets)
    assert ledger.from_wire(wire) == packets and len(wire.encode()) <= len(ledger.to_wire(packets, []).encode())


def test_wire_text_shrinks_and_rejects_damage():
    packets = [["T0:the same long phrase", "C1:the same long phrase", "C2:another"], ["T0:the same long phrase"]]
    wire = ledger.to_wire(packets)
    assert len(wire) < len(ledger.to_wire(packets, [])) and wire.startswith("SC1\nD")
    for damaged in (wire[1:], wire.replace("@0", "@z"), wire[:-1], "SC1\nD9\n\nx\n", wire.replace("@0", "@")):
        with pytest.raises(ValueError):
            ledger.from_wire(damaged)
    with pytest.raises(ValueError):
        ledger.to_wire([["a\nb"]])


def test_large_projects_are_closed_by_joins(spark):
    from scholia.plans.fixpoint import cyclic_components, reachable_pairs

    rows = [(1, i, i + 1) for i in range(12)] + [(1, 12, 0)] + [(2, 0, 1), (2, 1, 2)] + [(3, 5, 5)]
    edges = spark.createDataFrame(rows, "project_id long, source int, target int")
    plain, joined = (sorted(map(tuple, reachable_pairs(edges, most=most).collect())) for most in (100, 2))
    assert plain == joined and len(plain) == 13 * 12 + 3
    assert sorted((r.project_id, r.members) for r in cyclic_components(edges).collect()) == [(1, list(range(13))), (3, [5])]


def test_contexts_and_open_obligations(proofs):
    from scholia.operators import review

    told = {r.node: json.loads(r.context) for r in review.result_contexts(proofs).collect()}
    assert told[1]["behind"] == [{"target": 0, "identifier": "rule"}] and told[0]["identifier"] == "rule" and "behind" not in told[0]
    assert any(line["address"].startswith("E") for line in told[1]["lines"])
    found = {(r.node, r.kind, r.expected) for r in review.open_obligations(proofs).collect()}
    assert (1, "application_precondition", "P(5)") in found and not any(e == "P(2)" and k == "application_precondition" for _, k, e in found)
    unsure = project(proofs.files.sparkSession, [[("main", "\\begin{lemma}x\\end{lemma}\\begin{proof}One. By old habits, $a$. Two. Three. Four.\\end{proof}")]])
    assert [r.context for r in review.targeted_contexts(unsure).collect()] == ["C0 One.\nC1 By old habits, $a$.\nC2 Two."]


def test_typed_parts_and_endings(proofs, spark):
    from scholia.operators import ir

    parts = ir.typed(ir.proof_ir(proofs))
    shown = {(r.node, r.address, r.path): (r.kind, r.shown) for r in parts.collect()}
    goal = next((n, a) for (n, a, p), (k, s) in shown.items() if s == "a => c")
    assert shown[(*goal, "left")] == ("id", "a") and shown[(*goal, "right")] == ("id", "c")
    status = {(r.node, r.address): r.expression_status for r in ir.typed_status(parts).collect()}
    assert status[goal] == "full" and "opaque" in status.values()
    raw = "\\begin{lemma}If $a$, then $b$.\\end{lemma}\\begin{proof}%s\\end{proof}"
    m = project(spark, [[("main", raw % text)] for text in ("So $a \\Rightarrow b$.", "So $a \\Rightarrow b$. Done with $c$.", "Clear.")])
    assert {r.project_id: r.ending for r in transform.terminal_steps(m).collect()} == {0: "exact", 1: "earlier", 2: "open"}
    assert m.faults().count() == 0
    m.release()


def test_layers_by_name(proofs):
    from scholia.operators.layers import layers

    found = layers(proofs)
    assert {"facts", "ir", "typed", "structures", "open"} <= set(found) and found["endings"].count() == 2
    assert fx.parse("a ⇒ b ∧ c") == fx.parse("a \\Rightarrow b \\land c")
