"""Control structures and applications on small golden inputs, with nulls and empty frames."""

from scholia.operators import control, ledger


def scoped(spark, rows):
    return spark.createDataFrame(rows, "scope long, formula string")


def test_case_split_needs_one_conclusion(spark):
    rows = [(1, "A \\lor B \\lor C"), (1, "A \\Rightarrow D"), (1, "B \\Rightarrow D"), (1, "C \\Rightarrow E"), (2, "p(x) \\lor q"), (2, "q \\Rightarrow r"), (2, "p(x) \\Rightarrow r"), (3, None), (3, "a < b < c")]
    found = {r.scope: (r.disjuncts, r.covered, r.support_status) for r in control.case_splits(scoped(spark, rows)).collect()}
    assert found == {1: (3, 2, "unresolved"), 2: (2, 2, "confident")}


def test_induction_needs_base_and_step(spark):
    rows = [(1, "P(0)"), (1, "P(n) \\Rightarrow P(n+1)"), (2, "P(0)"), (2, "P(n) \\Rightarrow Q(n+1)"), (3, "R(n) \\Rightarrow R(n+1)")]
    found = sorted((r.scope, r.predicate, r.support_status) for r in control.inductions(scoped(spark, rows)).collect())
    assert found == [(1, "P", "confident"), (2, "P", "unresolved"), (3, "R", "unresolved")]


def test_contradiction_is_blind_to_bound_names(spark):
    rows = [(1, "\\forall x \\in N, x > y"), (1, "\\neg (\\forall z \\in N, z > y)"), (2, "\\neg q"), (2, "r")]
    assert [r.scope for r in control.contradictions(scoped(spark, rows)).collect()] == [1]
    assert control.contradictions(scoped(spark, rows).limit(0)).count() == 0


def test_assertions(spark):
    claims = spark.createDataFrame([(1, 0, 0, 0, "We proceed by induction on $n$."), (1, 0, 0, 1, "Suppose not."), (1, 0, 0, 2, "A contradiction."), (1, 0, 0, 3, "Choose $x$.")], "project_id long, ord int, result_s int, idx int, claim string")
    found = {r.structure: r.idx for r in control.asserted(claims).collect()}
    assert found == {"induction": 0, "contradiction": 1, "witness": 3}


def test_greedy_choice(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 0, 9), (1, 8, 12), (1, 9, 10), (2, 1, 1)], "k int, s long, e long")
    assert sorted(map(tuple, control.greedy_spans(spans, "k").collect())) == [(1, 0, 9), (1, 9, 10), (2, 1, 1)]


def test_replay_verdicts_and_terms(spark):
    asked = spark.createDataFrame([(1, "e1", "l9"), (2, "no", "l1"), (3, "no", None)], "id int, exact string, legacy string")
    recorded = spark.createDataFrame([("e1", "l1", "r1"), ("e2", None, "r2")], "key string, legacy_key string, response string")
    assert {r.id: (r.response, r.found) for r in ledger.replay(asked, recorded).collect()} == {1: ("r1", "exact"), 2: ("r1", "legacy"), 3: (None, "miss")}
    findings = spark.createDataFrame([(1,), (2,), (3,)], "finding int")
    verdicts = spark.createDataFrame([(1, "upheld", 0.9, 1), (1, "dismissed", 0.9, 2), (2, "dismissed", 0.1, 1), (2, "upheld", 0.7, 5)], "finding int, verdict string, confidence double, at int")
    assert sorted((r.finding, r.verdict, r.confidence) for r in ledger.settle(findings, verdicts).collect()) == [(2, "upheld", 0.7), (3, "uncertain", 0.0)]
    texts = spark.createDataFrame([(1, "Open  set, open set; reopen sets"), (2, None)], "id long, body string")
    terms = spark.createDataFrame([("open set",), ("Open Set",), ("",)], "term string")
    assert [tuple(r) for r in ledger.term_matches(texts, terms, "id", "body").collect()] == [(1, "open set", 2)]
