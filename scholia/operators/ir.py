"""Canonical proof IR: addressed nodes and edges of each result's proof slice, and its renderings.

Addresses are T0 for the statement, H, L and D for hypotheses, local constraints
and definitions, R for results referred to, C, P and U for claims that are
formulas, opaque prose or unresolved formulas outside the slice, Q for
qualifiers and E for support. Prose outside the slice is pruned and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import canonical as cn
from scholia.functions import symbols as sx
from scholia.operators.support import RESULT, binder

#: The code of each kind of edge.
CODES = {"result_reference": "r", "equation_reference": "q", "definition": "d", "named_property": "p", "prior_claim": "c", "explicit_reason": "x", "qualifier": "u", "quantifier": "∀"}
#: Kinds of nodes by the letter of their address.
NODE_KINDS = {"T": "result", "H": "hypothesis", "L": "local_constraint", "D": "definition", "R": "dependency", "C": "claim", "P": "opaque_prose", "U": "unresolved_math"}
LINES = "project_id long, ord int, result_s int, node int, seq int, address string, kind string, atom string, opaque boolean, source string, target string, status string, idx int, raw string"


def status_mark(status: Column) -> Column:
    """``?`` for ambiguous and ``!`` for unresolved."""
    return F.when(status == "ambiguous", "?").when(status == "unresolved", "!").otherwise("")


def slice_numbers(claims: list[dict], edges: list[dict]) -> set[int]:
    """Numbers of the claims in the slice: the last, those that an edge enters, and all that they rest on."""
    if not claims:
        return set()
    kept = {claims[-1]["idx"], *(e["idx"] for e in edges)}
    rest = list(kept)
    while rest:
        at = rest.pop()
        for e in edges:
            if e["idx"] == at and e["kind"] == "prior_claim" and int(e["source"]) not in kept:
                kept.add(int(e["source"]))
                rest.append(int(e["source"]))
    return kept


def _lines(row: dict) -> Iterator[tuple]:
    """(address, kind, atom, opaque, source, target, status, claim number, raw) of one result."""
    text = cn.plain(row["statement"] or "")
    atom = cn.canonical_text(text)
    yield "T0", "result", atom if atom is not None else text, atom is None, None, None, None, None, row["statement"]
    counts = dict.fromkeys("HLDCPUQE", 0)

    def address(letter: str) -> str:
        counts[letter] += 1
        return f"{letter}{counts[letter]}"

    stated = [(x["scope"], *said, x["formula"]) for x in row["introductions"] or [] if (said := sx.stated(x["formula"], x["kind"]))]
    for letter, wanted in (("H", ("result", "constraint")), ("L", ("proof", "constraint")), ("D", (None, "definition"))):
        for scope, sort, said, raw in stated:
            if sort == wanted[1] and wanted[0] in (None, scope):
                yield address(letter), NODE_KINDS[letter], cn.normalize(said), False, None, None, None, None, raw
    owners = {}
    for i, d in enumerate(row["dependencies"] or [], 1):
        owners[d["label"]] = f"R{i}"
        text = cn.plain(d["statement"] or "")
        atom = cn.canonical_text(text)
        yield f"R{i}", "dependency", f"{d['label']}:{text if atom is None else atom}", atom is None, None, None, None, None, d["statement"]
    claims = row["claims"] or []
    edges = row["edges"] or []
    kept = slice_numbers(claims, edges)
    loose = {c["idx"] for c in claims if c["idx"] not in kept and cn.math_atom(c["claim"]) is not None}
    places: dict[int, str] = {}
    for c in claims:
        if c["idx"] in loose:
            places[c["idx"]] = address("U")
            yield places[c["idx"]], "unresolved_math", cn.math_atom(c["claim"]), False, None, None, None, c["idx"], c["claim"]
        elif c["idx"] in kept:
            atom = cn.claim_atom(c["form"], c["claim"], {e["kind"] for e in edges if e["idx"] == c["idx"]})
            letter = "P" if atom is None else "C"
            places[c["idx"]] = address(letter)
            yield places[c["idx"]], NODE_KINDS[letter], cn.plain(c["claim"]) if atom is None else atom, atom is None, None, None, None, c["idx"], c["claim"]
            for q in c["qualifiers"] or []:
                name = binder(q)
                atom = f"∀{name}" if name else cn.canonical_text(q) or cn.plain(q)
                yield address("Q"), "quantifier" if name else "qualifier", atom, False, None, places[c["idx"]], "confident", c["idx"], q
    for e in edges:
        if e["idx"] in places:
            source, atom = None, None
            if e["kind"] == "prior_claim":
                source = places.get(int(e["source"]))
            elif e["kind"] in ("result_reference", "equation_reference"):
                source = owners.get(e["source"], f"@{e['source']}")
            elif e["kind"] == "named_property":
                atom = cn.compact(e["source"])
            elif e["kind"] == "explicit_reason":
                atom = cn.canonical_text(e["source"]) or cn.plain(e["source"])
            yield address("E"), e["kind"], atom, False, source, places[e["idx"]], e["status"], e["idx"], e["source"]


def proof_ir(manuscript) -> DataFrame:
    """The lines of every result's IR, numbered by ``seq``; a result without a proof has its statement and dependencies alone.

    A result's own claims, edges and symbols meet in one row and are addressed
    there, so the work grows with the proof and not with the project.
    """
    m = manuscript
    from scholia.operators.symbols import introductions

    def listed(frame: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    claims = listed(m.claims, RESULT, "claims", "idx", "form", "claim", "qualifiers")
    edges = listed(m.support, RESULT, "edges", "number", "idx", "kind", "source", "status")
    intro = introductions(m).where("scope <> 'local'")
    intro = intro.groupBy("project_id", "ord", "result_s").agg(F.sort_array(F.collect_set(F.struct("s", "kind", "scope", "formula"))).alias("introductions"))
    targets = m.results.select("project_id", F.col("node").alias("target"), F.struct(F.col("node").alias("n"), F.col("identifier").alias("label"), "statement").alias("d"))
    needed = m.resolved_pairs.join(targets, ["project_id", "target"]).groupBy("project_id", F.col("source").alias("node")).agg(F.sort_array(F.collect_list("d")).alias("dependencies"))
    held = m.results.select("project_id", "ord", F.col("s").alias("result_s"), "node", "statement")
    held = held.join(claims, RESULT, "left").join(edges, RESULT, "left").join(intro, ["project_id", "ord", "result_s"], "left").join(needed, ["project_id", "node"], "left")
    names = [x.split()[0] for x in LINES.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 3, pa.bool_(), *[pa.string()] * 3, pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["project_id"], r["ord"], r["result_s"], r["node"], i, *line) for r in batch.to_pylist() for i, line in enumerate(_lines(r))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return held.mapInArrow(run, LINES)


def pruned(manuscript, ir: DataFrame | None = None) -> DataFrame:
    """For each proof: claims, those pruned from the IR, and formulas that it leaves unresolved."""
    ir = proof_ir(manuscript) if ir is None else ir
    own = ir.where("kind in ('claim', 'opaque_prose', 'unresolved_math')").groupBy(*RESULT).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("kind") == "unresolved_math").alias("unresolved_math"))
    every = manuscript.claims.groupBy(*RESULT).agg(F.count(F.lit(1)).alias("claims"))
    held = every.join(own, RESULT, "left").fillna(0, ["kept", "unresolved_math"])
    return held.select(*RESULT, "claims", (F.col("claims") - F.col("kept")).alias("pruned"), "unresolved_math")


def packets(ir: DataFrame) -> DataFrame:
    """One text a result: nodes as ``address atom``, edges as ``address code source>target atom`` with the mark of their status."""
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("kind")]
    edge = F.concat(F.col("address"), F.lit(" "), code, status_mark(F.col("status")), F.lit(" "), F.coalesce("source", F.lit("")), F.lit(">"), F.col("target"), F.coalesce(F.concat(F.lit(" "), "atom"), F.lit("")))
    node = F.concat(F.col("address"), F.when(F.col("opaque"), "~ ").otherwise(" "), "atom")
    line = F.when(F.col("target").isNull(), node).otherwise(edge)
    grouped = ir.groupBy(*RESULT).agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    return grouped.select(*RESULT, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("packet"))


def sources(ir: DataFrame) -> DataFrame:
    """Addresses that a packet advertises, with the source text behind each."""
    return ir.select(*RESULT, "address", F.col("raw").alias("text")).where("text is not null")


TYPED = "project_id long, ord int, result_s int, node int, address string, path string, kind string, shown string, opaque boolean"


def typed(lines: DataFrame) -> DataFrame:
    """Every part of every formula in an IR, by address and path from the outermost in: its kind, text, and whether it isn't understood.

    Opaque prose is one part. Edges without an atom have none.
    """
    from scholia.functions import formula as fx
    from scholia.functions import logic

    names = [x.split()[0] for x in TYPED.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 4, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                atom = r["atom"].partition(":")[2] if r["kind"] == "dependency" else r["atom"]
                x = ("opaque", atom) if r["opaque"] else fx.parse(atom)
                rows += [(*(r[c] for c in RESULT), r["address"], "/".join(path), part[0], logic.show(part), part[0] == "opaque") for path, part in logic.parts(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return lines.where("atom is not null").select(*RESULT, "address", "kind", "atom", "opaque").mapInArrow(run, TYPED)


def typed_status(parts: DataFrame) -> DataFrame:
    """Per address: full if all parts are understood, opaque if the whole isn't, else partial."""
    whole = F.bool_or((F.col("path") == "") & F.col("opaque"))
    status = F.when(whole, "opaque").when(F.bool_or("opaque"), "partial").otherwise("full")
    return parts.groupBy(*RESULT, "address").agg(status.alias("expression_status"), F.count(F.lit(1)).alias("parts"))
