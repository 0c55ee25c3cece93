"""What a proof's steps do: applications of results, rewrites, definitions and properties, and control structures with their support.

A proof is judged in one row: its claims, edges, the statements that it refers
to and what its result supposes. Work grows with the proof; nothing is compared
across proofs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions import canonical as cn
from scholia.functions import formula as fx
from scholia.functions import logic
from scholia.operators import control
from scholia.operators.support import RESULT

STEPS = "project_id long, ord int, result_s int, node int, idx int, step string, source string, status string, bindings string, premise string"
STRUCTURES = "project_id long, ord int, result_s int, node int, structure string, support_status string"
_FORMULA = re.compile(r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$]*\$")


def expression(claim: str):
    """What a claim says: its one formula, else the whole read in words."""
    found = _FORMULA.findall(claim)
    return fx.parse(cn.inside(found[0])) if len(found) == 1 else logic.read(claim)


def _key(x) -> str:
    return fx.canonical(fx.alpha(x))


def proof_rows(manuscript) -> DataFrame:
    """One row a proof: claims, edges, statements of the results that it refers to by label, and what its own statement says and supposes."""
    m = manuscript

    def listed(frame: DataFrame, name: str, *columns: str) -> DataFrame:
        return frame.groupBy(*RESULT).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    statements = m.results.select("project_id", F.col("node").alias("target"), F.col("label").alias("name"), F.col("statement").alias("told"))
    needed = m.resolved_pairs.join(statements, ["project_id", "target"]).groupBy("project_id", F.col("source").alias("node")).agg(F.sort_array(F.collect_list(F.struct("name", "told"))).alias("results"))
    held = listed(m.claims, "claims", "idx", "form", "claim").join(listed(m.support, "edges", "number", "idx", "kind", "source", "status"), RESULT, "left")
    own = m.results.select("project_id", "ord", F.col("s").alias("result_s"), "node", "statement")
    return held.join(own, RESULT).join(needed, ["project_id", "node"], "left")


def _over_proofs(manuscript, function, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*(r[c] for c in RESULT), *out) for r in batch.to_pylist() for out in function(r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return proof_rows(manuscript).mapInArrow(run, schema)


def _steps(row: dict) -> Iterator[tuple]:
    claims = {c["idx"]: expression(c["claim"]) for c in row["claims"]}
    told = {r["name"]: logic.read(r["told"] or "") for r in row["results"] or []}
    supposed = [x[1] for x in [logic.read(row["statement"] or "")] if x[0] == "implies"]
    equations = {idx: x for idx, x in claims.items() if x[0] == "rel" and x[1] == "="}
    for e in row["edges"] or []:
        target, sure = claims[e["idx"]], e["status"] == "confident"
        if e["kind"] == "result_reference":
            found = logic.application(told[e["source"]], target) if e["source"] in told and target[0] != "opaque" else None
            if found is None:
                yield e["idx"], "result_application", e["source"], "unresolved", None, None
                continue
            values, premise = found
            known = {_key(x) for idx, x in claims.items() if idx < e["idx"]} | {_key(x) for x in supposed}
            bindings = ", ".join(f"{k} = {logic.show(v)}" for k, v in sorted(values.items())) or None
            special = premise is None and bool(values)
            shown = premise is None or _key(premise) in known
            yield e["idx"], "specialization" if special else "result_application", e["source"], "confident" if shown and sure else "unresolved", bindings, None if premise is None else logic.show(premise)
        elif e["kind"] == "prior_claim":
            source = claims[int(e["source"])]
            for idx, equation in equations.items():
                if idx >= e["idx"] or "opaque" in (source[0], target[0]) or idx == int(e["source"]):
                    continue
                for old, new in ((equation[2], equation[3]), (equation[3], equation[2])):
                    if fx.replacement_sites(source, target, old, new):
                        yield e["idx"], "equality_rewrite", e["source"], "confident", f"{logic.show(old)} -> {logic.show(new)}", None
                        break
            if (value := logic.instantiation(source, target)) is not None:
                yield e["idx"], "instantiation", e["source"], "confident", f"{value[0]} = {logic.show(value[1])}", None
        elif e["kind"] == "definition":
            yield e["idx"], "definition_use", None, "confident" if sure else e["status"], None, None
        elif e["kind"] == "named_property":
            yield e["idx"], "named_property", e["source"], e["status"], None, None


def transformations(manuscript) -> DataFrame:
    """What each support edge does (STEPS): its kind, source, status, bindings or replaced terms, and the premise that an application leaves.

    An application is sure if its premise stands earlier in the proof or is
    supposed by the statement, up to bound names. What no template explains is
    unresolved, never guessed.
    """
    return _over_proofs(manuscript, _steps, STEPS)


def _supported(row: dict) -> Iterator[tuple[str, str]]:
    said = [(c["idx"], c["claim"], expression(c["claim"])) for c in row["claims"]]
    keys = {_key(x) for _, _, x in said if x[0] != "opaque"}
    rules = {(_key(x[1]), _key(x[2])) for _, _, x in said if x[0] == "implies"}

    def outcome(*tests: bool) -> str:
        return "confident" if all(tests) else "unresolved"

    for _, _, x in said:
        if x[0] == "or":
            cases = {_key(d) for d in control._disjuncts(x)}
            reached = [{b for a, b in rules if a == case} for case in cases]
            yield "cases", outcome(bool(set.intersection(*reached)))
        if x[0] == "not":
            yield "contradiction", outcome(_key(x[1]) in keys)
        if x[0] == "implies" and x[1][0] == x[2][0] == "not":
            yield "contraposition", outcome((_key(x[2][1]), _key(x[1][1])) in rules | {(_key(g[1]), _key(g[2])) for g in [logic.read(row["statement"] or "")] if g[0] == "implies"})
        if x[0] == "app" and x[2] == (("num", "0"),):
            steps = [s for _, _, s in said if s[0] == "forall" and s[3][0] == "implies" or s[0] == "implies"]
            bodies = [s[3] if s[0] == "forall" else s for s in steps]
            yield "induction", outcome(any(b[1] == ("app", x[1], (v,)) and b[2] == ("app", x[1], (("bin", "+", v, ("num", "1")),)) for b in bodies for v in [b[1][2][0] if b[1][0] == "app" and len(b[1][2]) == 1 else None] if v))
    for idx, claim, x in said:
        if re.search(r"(?i)\b(?:we first show|it suffices to show|we claim that)\b", claim) and x[0] != "opaque":
            yield "subproof", outcome(any(j > idx and _key(y) == _key(x) for j, _, y in said))
    goal = logic.read(row["statement"] or "")
    if goal[0] == "exists":
        yield "witness", outcome(any(fx.match(goal[3], x, frozenset({goal[1]})) for _, _, x in said if x[0] != "opaque"))


def structures(manuscript) -> DataFrame:
    """Control structures of each proof: (structure, asserted, support_status).

    A structure is asserted by the proof's wording and supported by its formulas,
    each on its own: wording without support is unresolved, and formulas that bear
    out a structure nobody claims are shown as not asserted. A formula that could
    begin a structure, but neither is claimed nor comes to anything, is none.
    """
    best = F.when(F.max(F.when(F.col("support_status") == "confident", 1).otherwise(0)) == 1, "confident").otherwise("unresolved")
    borne = _over_proofs(manuscript, _supported, STRUCTURES).groupBy("project_id", "node", "structure").agg(best.alias("support_status"))
    named = manuscript.results.select("project_id", "ord", F.col("s").alias("result_s"), "node")
    told = control.asserted(manuscript.claims).join(named, ["project_id", "ord", "result_s"]).select("project_id", "node", "structure", F.lit(True).alias("asserted"))
    held = told.join(borne, ["project_id", "node", "structure"], "full")
    held = held.select("project_id", "node", "structure", F.coalesce("asserted", F.lit(False)).alias("asserted"), F.coalesce("support_status", F.lit("unresolved")).alias("support_status"))
    return held.where("asserted or support_status = 'confident'")


def lean_exports(manuscript) -> DataFrame:
    """Lean text of each result's statement from the statements that its proof refers to: (lean, lean_status, open obligations)."""
    schema = "project_id long, ord int, result_s int, node int, identifier string, lean string, lean_status string, open int"
    m = manuscript
    statements = m.results.select("project_id", F.col("node").alias("target"), F.col("identifier").alias("name"), F.col("statement").alias("told"))
    needed = m.resolved_pairs.join(statements, ["project_id", "target"]).groupBy("project_id", F.col("source").alias("node")).agg(F.sort_array(F.collect_list(F.struct("target", "name", "told"))).alias("results"))
    held = m.results.select("project_id", "ord", F.col("s").alias("result_s"), "node", "identifier", "statement").join(needed, ["project_id", "node"], "left")
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 3, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, status, left = logic.lean_export(r["identifier"], r["statement"] or "", [(d["name"], d["told"] or "") for d in r["results"] or []])
                rows.append((*(r[c] for c in RESULT), r["identifier"], text, status, len(left)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return held.mapInArrow(run, schema)


def terminal_steps(manuscript) -> DataFrame:
    """How each proof ends: ``exact`` if its last claim says what the statement does, up to bound names, ``earlier`` if an earlier one does, else ``open``."""
    schema = "project_id long, ord int, result_s int, node int, idx int, ending string"

    def function(row: dict) -> Iterator[tuple]:
        goal = logic.read(row["statement"] or "")
        same = [c["idx"] for c in row["claims"] if goal[0] != "opaque" and _key(expression(c["claim"])) == _key(goal)]
        last = row["claims"][-1]["idx"]
        yield last, "exact" if last in same else "earlier" if same else "open"

    return _over_proofs(manuscript, function, schema)
