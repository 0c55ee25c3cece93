"""Control structures, applications of results, rewrites, name resolution and ordered selection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions import formula as fx

#: Wording by which a proof claims a structure, in the order in which structures are emitted.
ASSERTIONS = (
    ("cases", r"(?i)\b(?:case \d|in the (?:first|second|other) case|distinguish|two cases)\b"),
    ("contradiction", r"(?i)\b(?:contradiction|suppose not|assume the contrary)\b"),
    ("contraposition", r"(?i)\b(?:contrapositive|contraposition)\b"),
    ("induction", r"(?i)\b(?:by induction|induction on|inductive step|base case)\b"),
    ("wlog", r"(?i)\b(?:without loss of generality|wlog)\b"),
    ("subproof", r"(?i)\b(?:we first show|it suffices to show|we claim that)\b"),
    ("witness", r"(?i)\b(?:choose|take|pick) \$"),
)


def asserted(claims: DataFrame) -> DataFrame:
    """(keys, structure, first claim) of every structure that a proof's wording claims; formulas don't matter here."""
    kinds = F.array(*[F.when(F.col("claim").rlike(pattern), F.lit(name)) for name, pattern in ASSERTIONS])
    found = claims.select("project_id", "ord", "result_s", "idx", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("structure"))
    return found.groupBy("project_id", "ord", "result_s", "structure").agg(F.min("idx").alias("idx"))


def _expressions(df: DataFrame, column: str, added: str, make) -> DataFrame:
    """``df`` with columns computed from the parsed formula by ``make``, once for each distinct formula of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in added.split(", ")]
        kinds = [pa.list_(pa.string()) if "array" in x else pa.string() for x in added.split(", ")]
        for batch in batches:
            memo: dict[str | None, tuple] = {None: (None,) * len(names)}
            texts = batch.column(column).to_pylist()
            for text in set(texts) - {None}:
                memo[text] = make(fx.parse(text))
            columns = [pa.array([memo[t][i] for t in texts], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join([*fields, added]))


def _key(x) -> str:
    return fx.canonical(fx.alpha(x))


def _disjuncts(x) -> list:
    return [*_disjuncts(x[1]), *_disjuncts(x[2])] if x[0] == "or" else [x]


def case_splits(propositions: DataFrame) -> DataFrame:
    """Disjunctions of a scope and whether one conclusion follows from every disjunct.

    ``propositions`` has scope and formula. Disjuncts meet implications by alpha
    key, so spelling of bound names doesn't matter and no pair is looped over.
    """
    parts = _expressions(
        propositions.select("scope", "formula").distinct(), "formula", "own string, disjuncts array<string>, premise string, conclusion string",
        lambda x: (_key(x), [_key(d) for d in _disjuncts(x)] if x[0] == "or" else None, _key(x[1]) if x[0] == "implies" else None, _key(x[2]) if x[0] == "implies" else None),
    )
    splits = parts.where("disjuncts is not null").select("scope", "own", F.array_distinct("disjuncts").alias("disjuncts"))
    each = splits.select("scope", "own", F.size("disjuncts").alias("needed"), F.explode("disjuncts").alias("premise"))
    rules = parts.where("premise is not null").select("scope", "premise", "conclusion").distinct()
    reached = each.join(rules, ["scope", "premise"]).groupBy("scope", "own", "needed", "conclusion").agg(F.count(F.lit(1)).alias("covered"))
    best = reached.groupBy("scope", "own").agg(F.max("covered").alias("covered"))
    out = splits.join(best, ["scope", "own"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select("scope", F.size("disjuncts").alias("disjuncts"), F.col("covered").cast("int").alias("covered"), F.when(F.col("covered") == F.size("disjuncts"), "confident").otherwise("unresolved").alias("support_status"))


def inductions(propositions: DataFrame, variable: str = "n") -> DataFrame:
    """Predicates P of a scope with P(0), and whether P(n) gives P(n + 1) there."""

    def make(x):
        base = x[1] if x[0] == "app" and x[2] == (("num", "0"),) else None
        step = None
        if x[0] == "implies" and x[1][0] == "app" and x[2][0] == "app" and x[1][1] == x[2][1]:
            if x[1][2] == (("id", variable),) and x[2][2] == (("bin", "+", ("id", variable), ("num", "1")),):
                step = x[1][1]
        return base, step

    parts = _expressions(propositions.select("scope", "formula").distinct(), "formula", "base string, step string", make)
    base = parts.where("base is not null").select("scope", F.col("base").alias("predicate"), F.lit(True).alias("has_base")).distinct()
    step = parts.where("step is not null").select("scope", F.col("step").alias("predicate"), F.lit(True).alias("has_step")).distinct()
    held = base.join(step, ["scope", "predicate"], "full")
    both = F.col("has_base") & F.col("has_step")
    return held.select("scope", "predicate", F.when(both, "confident").otherwise("unresolved").alias("support_status"))


def contradictions(propositions: DataFrame) -> DataFrame:
    """Propositions of a scope that stand there together with their negation."""
    parts = _expressions(propositions.select("scope", "formula").distinct(), "formula", "own string, denied string", lambda x: (_key(x), _key(x[1]) if x[0] == "not" else None))
    return parts.where("denied is not null").select("scope", F.col("denied").alias("own")).join(parts.select("scope", "own"), ["scope", "own"]).select("scope", F.col("own").alias("proposition")).distinct()


def applications(pairs: DataFrame, parameters: list[str]) -> DataFrame:
    """Template and target formulas with the parameters' values if the template matches and fixes all of them, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = frozenset(parameters)
        for batch in batches:
            out = []
            for template, target in zip(batch.column("template").to_pylist(), batch.column("target").to_pylist()):
                found = None if template is None or target is None else fx.match(fx.parse(template), fx.parse(target), wanted)
                out.append(", ".join(f"{k} = {fx.render(v)}" for k, v in sorted(found.items())) if found is not None and set(found) == wanted else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "bindings"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema]
    return pairs.mapInArrow(run, ", ".join([*fields, "bindings string"]))


def rewrites(pairs: DataFrame) -> DataFrame:
    """Columns before, after, old, new with the number of replaced places if old -> new explains every difference, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("before", "after", "old", "new"))):
                found = None if None in row else fx.replacement_sites(*map(fx.parse, row))
                out.append(len(found) if found else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "sites"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema]
    return pairs.mapInArrow(run, ", ".join([*fields, "sites int"]))


def name_references(manuscript) -> DataFrame:
    """Every name in a result's formulas: resolved by one introduction, ambiguous by several, bound by a quantifier alone, else unresolved."""
    from scholia.operators.symbols import canonical_name, introductions, mentions

    m = manuscript
    math = m.facts.where("kind = 'math'").select("project_id", "ord", "s", "e", F.col("text").alias("formula"))
    names = F.regexp_extract_all("formula", F.lit(r"(?<![\\A-Za-z])[A-Za-z](?:_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]+))?(?![A-Za-z])"), F.lit(0))
    used = m.placed(math).select("project_id", "ord", "result_s", F.explode(names).alias("name"))
    used = used.select("project_id", "ord", "result_s", canonical_name(F.col("name")).alias("name"))
    found = introductions(m)
    # commands and compound subscripts are names where the result introduces them
    commands = mentions(m, found.where(F.col("name").rlike(r"[\\{]"))).select("project_id", "ord", "result_s", "name")
    used = used.unionByName(commands).distinct()
    free = F.count_if(F.col("scope") != "local").alias("n")
    known = found.groupBy("project_id", "ord", "result_s", "name").agg(free, F.count_if(F.col("scope") == "local").alias("bound"))
    held = used.join(known, ["project_id", "ord", "result_s", "name"], "left").join(m.results.select("project_id", "ord", F.col("s").alias("result_s"), "node"), ["project_id", "ord", "result_s"])
    outcome = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("bound") > 0, "bound").otherwise("unresolved")
    return held.select("project_id", "ord", "node", "name", outcome.alias("resolution"))


def greedy_spans(spans: DataFrame, key: str) -> DataFrame:
    """Per key the spans that a left-to-right choice keeps: earliest start, then longest; overlaps with a kept one go.

    The choice depends on what was kept before, so it is a fold over each key's
    sorted spans.
    """
    schema = spans.schema[key].dataType.simpleString()
    ordered = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("neg")))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, starts, ends = [], [], []
            for i, row in enumerate(batch.column("spans").to_pylist()):
                reach = None
                for span in row:
                    if reach is None or span["s"] >= reach:
                        reach = -span["neg"]
                        place.append(i)
                        starts.append(span["s"])
                        ends.append(reach)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(place, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [key, "s", "e"])

    return ordered.mapInArrow(run, f"`{key}` {schema}, s long, e long")
