"""All layers of a set of manuscripts by name, each built on those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scholia.operators import control, ir, proofs, review, support, symbols, transform


def layers(manuscript) -> dict[str, DataFrame]:
    """Frames from facts to obligations; they are evaluated when they are used."""
    m = manuscript
    lines = ir.proof_ir(m)
    return {
        "facts": m.facts, "workspace": m.workspace, "results": m.results, "references": m.references, "edges": m.edges, "findings": m.findings(),
        "symbols": symbols.all_introductions(m), "symbol_uses": symbols.resolved_uses(m), "project_uses": symbols.project_uses(m), "names": control.name_references(m),
        "claims": m.claims, "support": m.support, "slice": support.proof_slice(m), "ir": lines, "typed": ir.typed(lines), "steps": proofs.steps(m), "obligations": proofs.obligations(m),
        "transformations": transform.transformations(m), "structures": transform.structures(m), "endings": transform.terminal_steps(m), "groups": review.review_groups(m), "open": review.open_obligations(m, lines), "lean": transform.lean_exports(m),
    }
