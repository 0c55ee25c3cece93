"""Proof IR, groups of uncertain support, recheck reasons, response accounting and evaluation on golden inputs."""

import json

import pytest
from pyspark.sql import functions as F

from scholia.functions import canonical as cn
from scholia.functions import text as tx
from scholia.operators import evaluation, ir, review, support
from scholia.operators.structure import Manuscript

RAW = r"""\begin{lemma}\label{a}
If $a$, then $b$.
\end{lemma}
\begin{theorem}\label{t}
Let $x > 0$ be small and define $f(t) = t^2$.
\end{theorem}
\begin{proof}
Using \ref{a} and \ref{none}, $b$. Some words. We note $c$. % Thus $no$.
Hence $c$. Therefore $d \Rightarrow e$. By old habits, $g$ holds. Let $y \leq 2$ be given.
\[ h = 1 \]
for every $k$ in sight. Hence $z$. Since $u$, we go on.
\end{proof}
"""


@pytest.fixture(scope="module")
def manuscript(spark):
    held = Manuscript(spark.createDataFrame([(0, 0, "main", RAW)], "project_id long, ord int, file string, raw string"))
    yield held
    held.release()


def test_phrases_and_atoms():
    assert [cn.canonical_text(t) for t in ("For all $x$, if $a$ then $b$.", "there exists $y$ with $p$", "$a$ iff $b$", "$a$ or $b$", "not $p$", "so $x$")] == ["∀x.(a⇒b)", "∃y.p", "a⇔b", "a∨b", "¬p", None]
    assert cn.normalize("a \\leq b \\quad \\notin  c \\, ") == "a ≤ b ∉ c" and cn.normalize("\\input") == "\\input"
    assert cn.claim_atom("prose", "Hence, $x$.", set()) is None and cn.claim_atom("prose", "Hence, $x$.", {"prior_claim"}) == "x"
    assert cn.math_atom("a $x$, $y$ and \\(x\\)") == "x|y" and cn.math_atom("none") is None


def test_claims_keep_gaps_and_qualifiers(manuscript):
    found = {r.claim: (r.idx, r.follows, r.qualifiers) for r in manuscript.claims.collect()}
    assert found["Hence $c$."] == (3, False, []) and found["Therefore $d \\Rightarrow e$."] == (4, True, [])
    assert found["\\[ h = 1 \\]"][2] == ["for every $k$ in sight."] and not any("no" in c.split("$") for c in found)


def test_every_cued_reference_counts(manuscript):
    edges = [(r.idx, r.kind, r.source) for r in manuscript.support.collect()]
    assert (0, "result_reference", "a") in edges and (4, "prior_claim", "3") in edges and not any(i == 3 for i, *_ in edges)
    m = Manuscript(manuscript.files.withColumn("raw", F.replace("raw", F.lit("\\ref{none}"), F.lit("\\ref{t}"))))
    assert {r.source for r in m.support.where("kind = 'result_reference'").collect()} == {"a", "t"}


def test_edge_identifiers_are_numbered_over_the_project(manuscript):
    assert [r.edge.split(":")[0] for r in manuscript.support.collect()] == ["t"] * manuscript.support.count()
    assert sorted(int(r.edge.rsplit(":", 1)[1]) for r in manuscript.support.collect()) == list(range(1, manuscript.support.count() + 1))


def test_ir_lines(manuscript):
    lines = {(r.node, r.address): r for r in ir.proof_ir(manuscript).collect()}
    assert lines[0, "T0"].atom == "a⇒b"
    shown = {a: r.atom for (n, a), r in lines.items() if n == 1}
    assert shown["H1"] == "x>0" and shown["L1"] == "y≤2" and shown["D1"] == "f=t^2" and shown["R1"] == "a:a⇒b"
    assert shown["C1"] == "b"
    assert lines[1, "Q1"].kind == "quantifier" and shown["Q1"] == "∀k" and lines[1, "Q1"].target == next(a for (n, a), r in lines.items() if n == 1 and r.atom == "h = 1")
    kinds = [r.kind for (n, _), r in sorted(lines.items(), key=lambda x: x[1].seq) if n == 1]
    assert kinds[0] == "result" and "unresolved_math" in kinds
    counts = {r.node: (r.claims, r.pruned, r.unresolved_math) for r in ir.pruned(manuscript).collect()}
    assert counts[1][1] == 1  # "Some words."
    packet = {r.node: r.packet for r in ir.packets(ir.proof_ir(manuscript)).collect()}[1]
    assert "E1 r R1>C1" in packet and " p! " in packet and packet.startswith("T0~ ")


def test_groups_join_by_claim_bridge_and_neighbourhood():
    def edge(idx, status="unresolved", source=None):
        return {"idx": idx, "status": status, "kind": "named_property" if source is None else "prior_claim", "source": None if source is None else str(source)}

    assert review.group_edges([edge(0), edge(0), edge(2), edge(3), edge(9)]) == [1, 1, 2, 2, 3]
    assert review.group_edges([edge(0), edge(5, "confident", 0), edge(5)]) == [1, 0, 1]
    assert review.group_edges([edge(0), edge(5, "confident"), edge(5), edge(7, "ambiguous", 0)]) == [1, 0, 2, 1]
    assert review.group_edges([]) == [] and review.group_edges([edge(4, "confident")]) == [0]


def test_item_ids_are_joined_by_nul(spark):
    import hashlib

    row = spark.createDataFrame([("r", ["b", "a"])], "r string, ids array<string>").select(tx.item_id(F.col("r"), F.col("ids")).alias("i")).first()
    assert row.i == hashlib.sha256(b"r\0a\0b").hexdigest()[:16]
    assert spark.range(1).select(tx.safe_uri(F.lit("/a b/é#.tex"))).first()[0] == "file:///a%20b/%C3%A9%23.tex"


def test_every_recheck_reason(spark, manuscript):
    now = review.snapshot(manuscript)
    # both results in each state of the store
    heads = {
        "no_prior_review": now.limit(0), "dependency_edge_changed": now.withColumns({"cache_key": F.lit("o"), "edges": F.lit("o"), "contract": F.lit("o")}),
        "local_ir_changed": now.withColumns({"cache_key": F.lit("o"), "packet": F.lit("o"), "contract": F.lit("o")}), "review_contract_changed": now.withColumns({"cache_key": F.lit("o"), "contract": F.lit("o")}),
        "cache_identity_changed": now.withColumn("cache_key", F.lit("o")), "cache_hit_exact_packet": now, "cache_hit_unaffected_dependency_slice": now.withColumn("content", F.lit("o")), "rescued_source_changed": now.withColumn("rescue", F.lit("o")),
    }
    for reason, old in heads.items():
        assert {r.reason for r in review.decisions(now, old).collect()} == {reason}
    assert {r.reason for r in review.decisions(now, now, now.limit(0)).collect()} == {"cache_entry_missing"}
    behind = now.withColumns({"cache_key": F.lit("o"), "dependencies": F.transform("dependencies", lambda d: F.struct(d["name"].alias("name"), F.lit("o").alias("held")))})
    assert {r.identifier: r.reason for r in review.decisions(now, behind).collect()} == {"a": "cache_identity_changed", "t": "upstream_dependency_changed"}
    asked = now.withColumn("rescue", F.lit("s"))
    total = review.cache_summary(review.decisions(asked, asked)).first()
    assert (total.units, total.reused, total.rechecked, total.requests_avoided) == (2, 2, 0, 4) and total.tokens_avoided > 0


def test_edits_upstream_are_seen(spark, manuscript):
    old = review.snapshot(manuscript)
    raw = RAW.replace("then $b$", "then $bb$")
    new = review.snapshot(Manuscript(manuscript.files.withColumn("raw", F.lit(raw))))
    assert {r.identifier: r.reason for r in review.decisions(new, old).collect()} == {"a": "local_ir_changed", "t": "upstream_dependency_changed"}
    retitled = review.snapshot(Manuscript(manuscript.files.withColumn("raw", F.replace("raw", F.lit("\\begin{theorem}"), F.lit("% note\n\\begin{theorem}")))))
    assert {r.reason for r in review.decisions(retitled, old).collect()} == {"cache_hit_exact_packet"}


TURN = "id int, stage string, allowed array<string>, max_addresses int, rescue_allowed boolean, expected array<string>"
ANSWER = "id int, action string, source_addresses array<string>, findings array<struct<id:string,payload:string>>, dispositions array<struct<item_id:string,finding:string,payload:string>>"


def test_responses_are_accounted_for(spark):
    initial, final = ("initial", ["C1", "C2"], 1, True, None), ("rescue", ["C1"], 1, True, ["i", "j"])
    cases = [
        (initial, ("need_source", ["C1"], None, None), []),
        (initial, ("need_source", ["C1", "X"], None, None), ["address was not advertised X", "too many addresses 2"]),
        (("initial", ["C1"], 1, False, None), ("need_source", ["C1"], None, None), ["source rescue is disabled "]),
        (("initial", [], 1, True, None), ("need_source", ["C1"], None, None), ["no addresses were advertised "]),
        (initial, ("done", None, [("f", "p")], [("i", None, None)]), ["initial response has dispositions "]),
        (final, ("done", None, [("f", "p")], [("i", "f", "p"), ("j", None, None)]), []),
        (final, ("done", None, None, [("i", None, None), ("i", None, None)]), ["carried item omitted j", "item answered more than once i"]),
        (final, ("done", None, [("i", "p")], [("i", None, None), ("j", None, None), ("k", None, None)]), ["finding reuses a carried id i", "unknown item answered k"]),
        (final, ("done", None, [("f", "p"), ("f", "q")], [("i", None, None), ("j", None, None)]), ["finding id comes twice f"]),
        (final, ("done", None, [("f", "p")], [("i", "f", "q"), ("j", "g", "1")]), ["finding differs from its disposition f"]),
        (final, ("done", None, None, [("i", "g", "1"), ("j", "g", "2")]), ["dispositions differ in a finding g"]),
        (final, ("done", None, None, [("i", "g", "1"), ("j", "g", "1")]), []),
        (final, (None, None, None, None), ["carried item omitted i", "carried item omitted j"]),
    ]
    turns = spark.createDataFrame([(n, *turn) for n, (turn, _, _) in enumerate(cases)], TURN)
    answers = spark.createDataFrame([(n, *answer) for n, (_, answer, _) in enumerate(cases)], ANSWER)
    found = {}
    for r in review.violations(turns, answers, ["id"]).collect():
        found.setdefault(r.id, []).append(f"{r.violation} {r.detail}")
    for n, (_, _, expected) in enumerate(cases):
        assert sorted(found.get(n, [])) == expected, n
    kept = sorted((r.id, r["payload"]) for r in review.accepted(turns, answers, ["id"]).collect())
    assert kept == [(5, "p"), (11, "1")]
    assert review.violations(turns.limit(0), answers, ["id"]).count() == 0


def test_rescue_shows_the_nearest_prerequisites_first(spark, manuscript):
    contexts = {"c": ["b"], "b": ["a"], "a": [], "d": ["c", "a"]}
    every = {"a", "b", "c", "d"}
    assert review.expanded_addresses(contexts, ["d"], every, 2) == ["c", "d"]
    assert review.expanded_addresses(contexts, ["d"], every, 9) == ["a", "b", "c", "d"]
    assert review.expanded_addresses(contexts, ["d", "d", "x"], every, 3) == ["c", "d"]
    assert review.expanded_addresses({"a": ["b"], "b": ["a"]}, ["a"], {"a", "b"}, 4) == ["b", "a"]
    with pytest.raises(ValueError):
        review.expanded_addresses(contexts, ["a", "b"], every, 1)
    lines = ir.proof_ir(manuscript)
    last = lines.where("node = 1 and kind = 'prior_claim'").orderBy(F.desc("seq")).first()
    turn = review.turns(lines)
    asked = turn.where("node = 1").select(*support.RESULT, F.array(F.lit(last.target)).alias("addresses"))
    shown = [r.address for r in review.rescue(turn, lines, asked).orderBy("seq").collect()]
    assert shown[-1] == last.target and last.source in shown
    bad = turn.where("node = 1").select(*support.RESULT, F.array(F.lit("Z9")).alias("addresses"))
    assert review.rescue(turn, lines, bad).count() == 0


def test_cases_and_expectations(spark, tmp_path):
    for name, raw in (("one", "x"), ("two", "y")):
        (tmp_path / f"{name}.tex").write_text(raw)
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "kind": "finding", "minimum_severity": "error", "other": 1}))
    assert sorted((r.name, r.raw) for r in evaluation.load_cases(spark, str(tmp_path)).collect()) == [("one", "x"), ("two", "y")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "rules.txt").write_text(json.dumps({"one": ["TH101"], "three": []}))
    expected = evaluation.load_expectations(spark, str(tmp_path / "sub" / "rules.txt"))
    assert sorted((r.name, r.rules) for r in expected.collect()) == [("one", ["TH101"]), ("three", [])]
    assert sorted(map(tuple, evaluation.coverage(evaluation.load_cases(spark, str(tmp_path)), expected, "name").collect())) == [("three", "not observed"), ("two", "not expected")]
    findings = spark.createDataFrame([(1, "TH101"), (1, "TH101"), (2, "TH102")], "project_id long, rule string")
    wanted = spark.createDataFrame([(1, ["TH101", "TH101"]), (2, []), (3, [])], "project_id long, rules array<string>")
    assert {r.project_id: r.passed for r in evaluation.evaluate_exactly(findings, wanted).collect()} == {1: True, 2: False, 3: True}
    (tmp_path / "two.tex").unlink()
    with pytest.raises(ValueError):
        evaluation.load_cases(spark, str(tmp_path))
