"""Claims of a proof, cue-based support between them, load-bearing claims and the proof slice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE = ["project_id", "ord"]
RESULT = ["project_id", "ord", "result_s", "node"]
CLAIM = [*RESULT, "idx"]
_FORMULA = re.compile(r"\\\[.*?\\\]|\$\$.*?\$\$|\\\(.*?\\\)|\$[^$]*\$", re.DOTALL)
_DISPLAY = re.compile(r"\\\[.*?\\\]|\$\$.*?\$\$", re.DOTALL)
_STOP = re.compile(r"[.!?](?=\s|$)|\n\s*\n")
#: What is no document text inside a proof: comments and literal environments.
_EXCLUDED = re.compile(r"(?<!\\)(?:\\\\)*(?P<comment>%[^\n]*)|(?P<literal>\\begin\{(verbatim|lstlisting|minted|comment)\}.*?\\end\{\3\})", re.DOTALL)
#: Fixed value: prose behind a display that binds a name in it.
_BINDER = re.compile(r"(?i)^\s*for\s+(?:every|all|each)\s+\$?\s*([A-Za-z](?:_[A-Za-z0-9{}]+)?)")

#: Cue words of the support rules.
CONCLUSION = "therefore|hence|thus|consequently"
REFERENCE_CUE = "by|from|using|apply|applying|invoke|invoking"
PROPERTIES = "compactness|continuity|linearity|monotonicity|convexity"


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; a stop inside a formula does not end one, and outer white space is left out."""
    masked = _FORMULA.sub(lambda m: "x" * len(m[0]), text)
    out, at = [], 0
    for stop in [*_STOP.finditer(masked), None]:
        end = stop.end() if stop else len(text)
        piece = text[at:end]
        if piece.strip():
            low = at + len(piece) - len(piece.lstrip())
            out.append((low, low + len(piece.strip())))
        at = end
    return out


def excluded(text: str) -> list[tuple[int, int]]:
    """Spans of comments and literal environments."""
    return [found.span("comment") if found["comment"] else found.span("literal") for found in _EXCLUDED.finditer(text)]


def split_claims(text: str) -> list[tuple[str, int, int]]:
    """(form, s, e): display formulas, and the sentences of the prose between them, in source order.

    Comments and literal environments are no claims and no sentence runs across them.
    """
    out: list[tuple[str, int, int]] = []
    low = 0
    for a, b in [*excluded(text), (len(text), len(text))]:
        piece, at = text[low:a], 0
        for found in [*_DISPLAY.finditer(piece), None]:
            end = found.start() if found else len(piece)
            out += [("prose", low + at + x, low + at + y) for x, y in sentences(piece[at:end]) if re.search(r"\w", piece[at + x : at + y])]
            if found:
                out.append(("display", low + found.start(), low + found.end()))
                at = found.end()
        low = b
    return out


def numbered_claims(text: str) -> list[tuple[int, str, int, int, bool, list[str]]]:
    """(number, form, s, e, follows, qualifiers) of a proof's claims.

    A claim follows the one before if no excluded source lies between them. Prose
    that binds a name right behind a display is a qualifier of that and no claim.
    """
    gaps = excluded(text)
    out: list[tuple[int, str, int, int, bool, list[str]]] = []
    for form, a, b in split_claims(text):
        follows = bool(out) and not any(out[-1][3] < y and x < a for x, y in gaps)
        if form == "prose" and follows and out[-1][1] == "display" and _BINDER.match(text[a:b]):
            out[-1][5].append(text[a:b])
            continue
        out.append((len(out), form, a, b, follows, []))
    return out


def binder(qualifier: str) -> str | None:
    """The name that a qualifier binds."""
    found = _BINDER.match(qualifier)
    return found[1] if found else None


def claims(manuscript) -> DataFrame:
    """Numbered claims of every proof: form, span in the file, text, whether it follows on the one before, its qualifiers."""
    proofs = manuscript.results.where("proof is not null").select(*FILE, F.col("s").alias("result_s"), "node", "proof_bs", "proof")
    schema = "project_id long, ord int, result_s int, node int, idx int, form string, s int, e int, claim string, follows boolean, qualifiers array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        for batch in batches:
            rows = [
                (p, o, r, n, i, form, at + a, at + b, text[a:b], follows, held)
                for p, o, r, n, at, text in zip(*(c.to_pylist() for c in batch.columns))
                for i, form, a, b, follows, held in numbered_claims(text)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return proofs.mapInArrow(run, schema)


def cued_references(claim: Column) -> Column:
    """Reference macros of a claim, as ``name{labels}``, that have a support cue in the 96 characters before them."""
    cues: dict[int, list[str]] = {}
    for word in REFERENCE_CUE.split("|"):
        cues.setdefault(len(word), []).append(word)
    near = "|".join(rf"(?<=\b(?:{'|'.join(words)})\b.{{0,{96 - size}}})" for size, words in sorted(cues.items()))
    return F.regexp_extract_all(claim, F.lit(rf"(?is)(?:{near})\\((?:eqref|ref|autoref|cref)\{{[^{{}}]*\}})"), F.lit(1))


def support_edges(manuscript, found: DataFrame | None = None) -> DataFrame:
    """Cue edges into claims: kind, source (label, property, reason or previous claim), status, and an identifier that is numbered over the project.

    References need a cue in the 96 characters before them; ``\\eqref`` is an
    equation, other macros a result if one has the label. ``By X, Y`` without
    anything better leaves X as an unresolved property.
    """
    found = manuscript.claims if found is None else found
    labels = manuscript.results.where("label is not null").select("project_id", F.col("label").alias("source"), F.lit(True).alias("known")).distinct()
    each = found.select(*CLAIM, F.posexplode(cued_references(F.col("claim"))).alias("macro_at", "macro"))
    each = each.select(*CLAIM, "macro_at", F.regexp_extract("macro", r"^([A-Za-z]+)", 1).alias("name"), F.posexplode(F.split(F.regexp_extract("macro", r"\{(.*)\}", 1), ",")).alias("item", "source"))
    each = each.withColumn("source", F.trim("source")).where("source <> ''").join(labels, ["project_id", "source"], "left")
    kind = F.when(F.col("name") == "eqref", "equation_reference").when(F.col("known"), "result_reference")
    edge = lambda frame, kind, rank, at=None, status="confident": frame.select(*CLAIM, (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), "source", F.lit(status).alias("status"), F.lit(rank).alias("rank"), (F.array(F.lit(0), F.lit(0)) if at is None else at).alias("at"))
    references = edge(each.withColumn("kind", kind).where("kind is not null"), F.col("kind"), 0, F.array("macro_at", "item"))
    definition = edge(found.where(F.col("claim").rlike(r"(?i)\bby\s+(?:the\s+)?definition\b")).withColumn("source", F.lit(None).cast("string")), "definition", 1)
    properties = found.select(*CLAIM, F.posexplode(F.regexp_extract_all("claim", F.lit(rf"(?i)\bby\s+({PROPERTIES})\b"), F.lit(1))).alias("place", "source"))
    properties = edge(properties.withColumn("source", F.lower("source")), "named_property", 2, F.array("place", F.lit(0)))
    good = references.unionByName(definition).unionByName(properties)
    reason = F.trim(F.regexp_extract("claim", rf"(?is)^\s*(?:{REFERENCE_CUE})\s+(.+?),\s*(?:.+)$", 1))
    loose = found.withColumn("source", reason).where("source <> ''").join(good.select(*CLAIM).distinct(), CLAIM, "left_anti")
    loose = edge(loose, "named_property", 3, status="unresolved")
    since = edge(found.withColumn("source", F.trim(F.regexp_extract("claim", r"(?is)^\s*since\s+(.+?),\s*(?:.+)$", 1))).where("source <> ''"), "explicit_reason", 4)
    before = Window.partitionBy(*RESULT).orderBy("idx")
    prior = found.withColumn("source", F.lag("idx").over(before).cast("string")).where(F.col("source").isNotNull() & F.col("follows") & F.col("claim").rlike(rf"(?i)^\s*(?:{CONCLUSION})\b"))
    every = good.unionByName(loose).unionByName(since).unionByName(edge(prior, "prior_claim", 5))
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("node", "idx", "rank", "at"))
    named = manuscript.results.select("project_id", "node", F.col("identifier").alias("unit"))
    identifier = F.concat("unit", F.lit(":claim:"), F.col("idx") + 1, F.lit(":support:"), F.col("number"))
    return every.withColumn("number", number).join(named, ["project_id", "node"]).withColumn("edge", identifier).drop("unit")


def load_bearing(manuscript) -> DataFrame:
    """Claims that others rest on, and whether a confident edge supports them."""
    edges = manuscript.support
    sure = edges.where("status = 'confident'")
    used = sure.where("kind = 'prior_claim'").select(*RESULT, F.col("source").cast("int").alias("idx")).distinct()
    held = sure.select(*CLAIM).distinct().withColumn("supported", F.lit(True))
    return used.join(held, CLAIM, "left").select(*CLAIM, F.coalesce("supported", F.lit(False)).alias("supported"))


def claim_links(edges: DataFrame) -> DataFrame:
    """Claim-to-claim edges, source to target."""
    return edges.where("kind = 'prior_claim'").select(*RESULT, F.col("source").cast("int").alias("source"), F.col("idx").alias("target"), "status")


def downstream(manuscript) -> DataFrame:
    """(claim, later) of all claims that rest on a claim over confident edges; a start can reach itself."""
    links = claim_links(manuscript.support).where("status = 'confident'")

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict[int, list[int]] = {}
        for a, b in zip(rows["source"].tolist(), rows["target"].tolist()):
            adjacent.setdefault(a, []).append(b)
        out = []
        for a in sorted(adjacent):
            seen, rest = set(), list(adjacent[a])
            while rest:
                x = rest.pop()
                if x not in seen:
                    seen.add(x)
                    rest += adjacent.get(x, ())
            out += [(*rows[RESULT].iloc[0], a, b) for b in sorted(seen)]
        return pd.DataFrame(out, columns=[*RESULT, "claim", "later"])

    return links.groupBy(*RESULT).applyInPandas(close, "project_id long, ord int, result_s int, node int, claim int, later int")


def proof_slice(manuscript) -> DataFrame:
    """Each claim's place in the slice: C with a formula, P without, U outside it with a formula, pruned without.

    The slice holds the last claim, every claim that a strong edge enters, and
    all claims behind them over strong edges (an implicit, unsure edge to the
    previous claim is weak).
    """
    found, edges = manuscript.claims, manuscript.support
    last = found.groupBy(*RESULT).agg(F.max("idx").alias("idx"))
    entered = edges.select(*CLAIM)
    links = claim_links(edges)
    seeds = last.select(*CLAIM).unionByName(entered).distinct()
    # a strong edge's target is a seed, so all its sources are one step behind
    behind = links.select(*RESULT, F.col("source").alias("idx"))
    kept = seeds.unionByName(behind).distinct().withColumn("kept", F.lit(True))
    formula = F.col("claim").rlike(r"\$|\\\[|\\\(")
    kind = F.when(F.col("kept"), F.when(formula, "C").otherwise("P")).otherwise(F.when(formula, "U").otherwise("pruned"))
    return found.join(kept, CLAIM, "left").select(*CLAIM, kind.alias("kind"))
