"""Requests, recordings, replayed reviews, audits and experiments."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scholia.operators import exchange, experiment, ir
from scholia.operators.structure import Manuscript

RAW = r"""\begin{lemma}\label{a}
If $a$, then $b$.
\end{lemma}
\begin{theorem}\label{t}
Something.
\end{theorem}
\begin{proof}
By stability, $c$. Hence $d$. Using \ref{a}, $b$.
\end{proof}
\begin{theorem}\label{t2}
Other.
\end{theorem}
\begin{proof}
Clear.
\end{proof}
"""


@pytest.fixture(scope="module")
def manuscript(spark):
    held = Manuscript(spark.createDataFrame([(0, 0, "main", RAW)], "project_id long, ord int, file string, raw string"))
    yield held
    held.release()


def test_schemas_are_closed():
    schema = exchange.response_schema(["C2", "C1"], ["i"], 3)
    assert exchange.schema_faults(schema) == [] and schema["properties"]["source_addresses"] == {"type": "array", "items": {"type": "string", "enum": ["C1", "C2"]}, "maxItems": 3}
    profile = exchange.schema_profile(schema)
    assert profile["enums"] == 3 and profile["enum_values"] == 5 and profile["max_items"] == 3 and profile["depth"] == 4
    assert exchange.covers(profile, profile) == [] and exchange.covers(profile, {**profile, "enums": 9}) == ["enums"]
    bad = {"type": "object", "properties": {"x": {"type": "odd", "pattern": "y"}, "z": {"type": "array"}}}
    assert exchange.schema_faults(bad) == ["$: additional properties are allowed", "$: not all properties are required", "$.x: pattern is not supported", "$.x: unknown type odd", "$.z: an array without items"]
    assert exchange.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert exchange.canonical_fingerprint([1]) == hashlib.sha256(b"[1]").hexdigest()
    assert exchange.safe_error({"type": "x", "headers": {"key": "secret"}, "message": ["a"]}) == {"type": "x", "message": "list"}
    assert exchange.frozen({"a": "1", "b": "2"}, {"a": "1", "c": "3"}) == ["b", "c"]


def test_keys_change_with_every_part(spark, manuscript):
    turns = exchange.review.turns(ir.proof_ir(manuscript))
    keys = [{r.key for r in exchange.envelopes(t, provider="p", model=m, max_output=n).collect()} for t, m, n in ((turns, "m", 9), (turns, "m2", 9), (turns, "m", 8), (turns.withColumn("packet", F.lit("x")), "m", 9))]
    assert len(set.union(*keys)) == sum(len(k) for k in keys[:3]) + len(keys[3])
    with pytest.raises(ValueError):
        exchange.envelopes(turns, provider="p", model="m", max_output=0)
    raw = {r.node: r for r in exchange.raw_turns(manuscript.results).collect()}
    assert "Something." in raw[1].packet and "By stability" in raw[1].packet
    assert raw[1].allowed == [] and not raw[1].rescue_allowed


def test_recording(spark, tmp_path):
    schema = "key string, legacy_key string, response string, at int"
    new = spark.createDataFrame([("k", "l", "one", 1), ("k", "l", "one", 2), ("k", "l", "two", 3), ("n", None, "x", 1), ("h", None, "y", 1), ("h", None, "held", 2)], schema)
    held = spark.createDataFrame([("h", None, "held", 0)], schema)
    outcomes = exchange.record(new, held)
    assert sorted((r.key, r.response, r["at"], r.outcome) for r in outcomes.collect()) == [("h", "held", 2, "same"), ("h", "y", 1, "conflict"), ("k", "one", 1, "recorded"), ("k", "one", 2, "same"), ("k", "two", 3, "conflict"), ("n", "x", 1, "recorded")]
    assert exchange.write_exchanges(outcomes, str(tmp_path)) == {"recorded": 2, "same": 2, "conflict": 2}
    assert spark.read.parquet(f"{tmp_path}/accepted").count() == 2 and spark.read.parquet(f"{tmp_path}/conflicts").count() == 2
    rejected = spark.createDataFrame([("k", "bad", "why"), ("k", "bad", "why"), ("k", None, "why")], "key string, response string, reason string")
    assert exchange.quarantine(rejected).count() == 2


def test_a_review_in_two_turns(spark, manuscript):
    lines = ir.proof_ir(manuscript)
    asked = {}

    def transport(requests):
        """The first answer on t asks for source, all others report; t2 gets no answer."""
        answer = json.dumps({"action": "need_source", "source_addresses": ["T0"], "findings": [{"id": "f", "payload": "p"}], "dispositions": None})
        final = json.dumps({"action": "review", "source_addresses": [], "findings": [{"id": "g", "payload": "q"}], "dispositions": [{"item_id": "f", "finding": "g", "payload": "q"}]})
        first = json.dumps({"action": "review", "source_addresses": [], "findings": [{"id": "h", "payload": "r"}], "dispositions": None})
        asked[len(asked)] = requests
        response = F.when(F.col("stage") == "rescue", F.lit(final)).when(F.col("node") == 1, F.lit(answer)).when(F.col("node") == 0, F.lit(first))
        return requests.withColumn("response", response)

    found, faults = exchange.review_results(lines, transport, provider="p", model="m")
    assert sorted((r.node, r.finding, r["payload"]) for r in found.collect()) == [(0, "h", "r"), (1, "g", "q")]
    assert [(r.node, r.violation) for r in faults.collect()] == [(2, "no response")]
    second = asked[1].where("node = 1").first()
    assert second.packet.startswith("@T0\n") and "need_source" in second.transcript and second.expected == ["f"]
    # what was answered can be replayed, and an answer that breaks the contract gives nothing
    recorded = transport(asked[0]).where("response is not null").select("key", "legacy_key", "response").unionByName(transport(asked[1]).select("key", "legacy_key", "response"))
    again, missing = exchange.review_results(lines, exchange.replayed(recorded), provider="p", model="m")
    assert sorted((r.node, r.finding) for r in again.collect()) == [(0, "h"), (1, "g")] and missing.count() == 1
    bad = recorded.withColumn("response", F.replace("response", F.lit('"T0"'), F.lit('"Z9"')))
    found, faults = exchange.review_results(lines, exchange.replayed(bad), provider="p", model="m")
    assert sorted((r.node, r.finding) for r in found.collect()) == [(0, "h")] and sorted({r.violation for r in faults.collect()}) == ["address was not advertised", "no response"]
    odd = recorded.withColumn("response", F.lit("not json"))
    assert exchange.review_results(lines, exchange.replayed(odd), provider="p", model="m")[0].count() == 0


def test_audits(spark, manuscript):
    findings = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "finding int, confidence double")
    verdicts = spark.createDataFrame([(1, "dismissed", 0.9, 1), (2, "survives", 0.4, 2)], "finding int, verdict string, confidence double, at int")
    assert sorted((r.finding, r.verdict, r.defender_confidence) for r in exchange.audit(findings, verdicts).collect()) == [(2, "survives", 0.4), (3, "uncertain", 0.0)]
    assert {(r.finding, r.verdict, r.defender_confidence) for r in exchange.audit(findings, None).collect()} == {(1, "survives", 0.9), (2, "survives", 0.8), (3, "survives", 0.7)}
    keys = [{r.audit_key for r in exchange.audit_key(manuscript.results, m, "v1", d).collect()} for m, d in (("m", True), ("m", False), ("n", True))]
    assert len(set.union(*keys)) == 9


def test_experiments(spark, manuscript, tmp_path):
    rendered = experiment.arms(manuscript).persist()
    assert {(r.node, r.arm) for r in rendered.collect()} == {(n, a) for n in (1, 2) for a in experiment.ARMS}
    sizes = {r.arm: (r.results, r.chars) for r in experiment.sizes(rendered).collect()}
    assert sizes["skeleton"] == (2, sum(len(r.content) for r in rendered.where("arm = 'skeleton'").collect()))
    targets = spark.createDataFrame([(0, "t"), (0, "a"), (0, "none")], "project_id long, identifier string")
    ready = {r.identifier: (r.candidates, r.ready) for r in experiment.preflight(manuscript, targets).collect()}
    assert ready == {"t": (1, True), "a": (1, False), "none": (0, False)}
    assert {r.identifier for r in experiment.select_target(manuscript.results, targets).collect()} == {"t", "a"}
    chosen = experiment.dispatch(rendered, spark.createDataFrame([(0, "ir")], "project_id long, strategy string"))
    assert {r.strategy for r in chosen.collect()} == {"ir"} and chosen.count() == 2
    with pytest.raises(ValueError):
        experiment.dispatch(rendered, spark.createDataFrame([(0, "odd")], "project_id long, strategy string"))
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "x"), (2, "y")], [(1, "x"), (2, "z"), (3, "w")]))
    assert sorted((r.k, r.expected, r.observed) for r in experiment.drift(a, b, ["k"], "v").collect()) == [(2, "y", "z"), (3, None, "w")]
    turns = spark.createDataFrame([("r", 1, 10, 5), ("r", 2, 10, 5), ("r", 3, 90, 5), ("r", 4, 1, 1)], "run string, turn int, input_bound int, output_cap int")
    assert [r.allowed for r in experiment.guarded(turns, attempts=9, input_tokens=50, output_tokens=50).orderBy("turn").collect()] == [True, True, False, False]
    counts = {r.node: r for r in experiment.inventory(ir.proof_ir(manuscript)).collect()}
    assert counts[1].dependency == 1 and counts[1].unresolved_edges == 1 and counts[0].claim == 0


def test_manifests(spark, tmp_path):
    (tmp_path / "one.tex").write_text("x")
    manifest = {"experiment": "e", "model": "m", "inputs": [{"path": "one.tex", "sha256": hashlib.sha256(b"x").hexdigest()}], "cases": [{"name": "c", "target": "t"}]}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(manifest, indent=1))
    assert [tuple(r) for r in experiment.load_manifest(spark, str(path), str(tmp_path)).collect()] == [("e", "m", "c", "t")]
    (tmp_path / "one.tex").write_text("y")
    with pytest.raises(ValueError):
        experiment.load_manifest(spark, str(path), str(tmp_path))
