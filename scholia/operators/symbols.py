"""Symbol introductions by cue, quantifier and definition, roles and their conflicts, and uses resolved to the nearest declaration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import symbols as sx

FILE = ["project_id", "ord"]
PLACE = "project_id long, ord int, result_s int, part string, s int"
INTRODUCED = f"{PLACE}, scope string, kind string, at int, name string, role string, formula string"
#: Fixed value: environments that show a formula and are no formula facts.
DISPLAYS = ("equation", "equation*", "displaymath")


def canonical_name(name: Column) -> Column:
    """``x_{1}`` is ``x_1``."""
    return F.regexp_replace(name, r"^(\\[A-Za-z]+|[A-Za-z]+)_\{(\\[A-Za-z]+|[A-Za-z0-9]+)\}$", "$1_$2")


def role_family(role: Column) -> Column:
    """Maps and functions are both callable; an unknown role belongs to no family."""
    return F.when(role.isin("map", "function"), "callable").when(role != "unknown", role)


def _each(frame: DataFrame, function, schema: str) -> DataFrame:
    """The rows that ``function`` makes of each row."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in function(row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return frame.mapInArrow(run, schema)


def regions(manuscript) -> DataFrame:
    """Statements, and proofs where one belongs to the result: (result_s, part, region_s, region_e)."""
    spans = F.array(
        F.struct(F.lit("statement").alias("part"), F.col("bs").alias("region_s"), F.col("be").alias("region_e")),
        F.struct(F.lit("proof").alias("part"), F.col("proof_bs").alias("region_s"), F.col("proof_be").alias("region_e")),
    )
    return manuscript.results.select(*FILE, F.col("s").alias("result_s"), F.inline(spans)).where("region_s is not null")


def formulas(manuscript) -> DataFrame:
    """Formulas inside a result's statement or proof; ``start`` is where the formula's text begins."""
    math = manuscript.facts.where("kind = 'math'").select(*FILE, "s", "e", F.col("bs").alias("start"), F.col("text").alias("formula"), "before", "behind")
    return manuscript.placed(math).select(*FILE, "s", "start", "formula", "before", "behind", "result_s", F.col("context").alias("part"))


def _introduced(row: dict) -> Iterator[tuple]:
    place = row["project_id"], row["ord"], row["result_s"], row["part"], row["s"]
    formula = row["formula"]
    if kind := sx.cue(row["before"], row["behind"]):
        for name, at, role in sx.introduced(formula, kind):
            yield *place, "proof" if row["part"] == "proof" else "result", kind, row["start"] + at, name, role, formula
    for name, at in sx.quantified(formula):
        yield *place, "local", "quantifier", row["start"] + at, name, "unknown", formula


def project_definitions(manuscript) -> DataFrame:
    """Symbols that a file defines by an explicit operator in a formula outside all results; result_s is null."""
    m = manuscript
    math = m.facts.where("kind = 'math'").select(*FILE, "s", "e", F.col("bs").alias("start"), F.col("text").alias("formula"))
    shown = m.environments.where(F.col("name").isin(*DISPLAYS)).select(*FILE, "s", "e", F.col("bs").alias("start"), F.col("text").alias("formula"))
    covers = math.select(*FILE, F.col("s").alias("cover_s"), F.col("e").alias("cover_e"))
    shown = shown.join(covers, [shown[c] == covers[c] for c in FILE] + [F.col("cover_s") <= F.col("s"), F.col("e") <= F.col("cover_e")], "left_anti")
    blocks = math.unionByName(shown)
    held = regions(m)
    free = blocks.join(held, [blocks[c] == held[c] for c in FILE] + [F.col("region_s") <= F.col("s"), F.col("e") <= F.col("region_e")], "left_anti")
    aliases = m.macros.where("name in ('newcommand', 'renewcommand', 'providecommand') and text is not null and coalesce(trim(option), '') in ('', '0')")
    aliases = _each(aliases.select(*FILE, "arg", "text"), lambda r: [(r["project_id"], r["ord"], r["arg"])] if sx.defines(r["text"]) else [], "project_id long, ord int, macro string")
    aliases = aliases.groupBy(*FILE).agg(F.collect_set("macro").alias("macros"))

    def found(row: dict) -> Iterator[tuple]:
        if got := sx.defined(row["formula"], row["macros"] or []):
            yield row["project_id"], row["ord"], None, None, row["s"], "project", "define", row["start"] + got[1], got[0], "unknown", row["formula"]

    return _each(free.join(aliases, FILE, "left").select(*FILE, "s", "start", "formula", "macros"), found, INTRODUCED)


def project_context(manuscript) -> DataFrame:
    """Symbols that words and formulas outside all results introduce for the whole project, and signs that they give a meaning; result_s is null."""
    m = manuscript
    math = m.document_text(m.facts.where("kind = 'math'").select(*FILE, "s", "e", F.col("bs").alias("start"), F.col("text").alias("formula"), "before", "behind"))
    held = regions(m)
    free = math.join(held, [math[c] == held[c] for c in FILE] + [F.col("region_s") <= F.col("s"), F.col("e") <= F.col("region_e")], "left_anti")

    def found(row: dict) -> Iterator[tuple]:
        place = row["project_id"], row["ord"], None, None, row["s"], "project"
        if got := sx.authoritative(row["formula"], row["before"], row["behind"]):
            name, at, role, kind = got
            yield *place, kind, row["start"] + at, name, role, row["formula"]
        elif got := sx.alias(row["formula"], row["behind"]):
            yield *place, "define", row["start"] + got[1], got[0], "unknown", row["formula"]

    return _each(free.select(*FILE, "s", "start", "formula", "before", "behind"), found, INTRODUCED)


def introductions(manuscript) -> DataFrame:
    """Symbols that a result introduces in its statement or proof, with place, scope and role.

    A formula introduces behind ``let`` (and before ``be``), ``for``, ``for
    each``, ``for every``, ``define`` or ``set``, and by quantifiers. Symbols of
    a statement hold for the whole result, those of a proof in the proof, and
    quantified ones in their formula.
    """
    return _each(formulas(manuscript), _introduced, INTRODUCED)


def all_introductions(manuscript) -> DataFrame:
    """Introductions of results, and of the project outside them."""
    return introductions(manuscript).unionByName(project_symbols(manuscript))


def project_symbols(manuscript) -> DataFrame:
    """Definitions and authoritative context outside results, a place once."""
    both = project_definitions(manuscript).unionByName(project_context(manuscript))
    return both.dropDuplicates([*FILE, "at", "name"])


def role_conflicts(manuscript) -> DataFrame:
    """TH113: one name with two role families in a scope; the last introduction is the anchor."""
    found = introductions(manuscript).withColumn("family", role_family(F.col("role")))
    # quantified symbols have no role, so formulas need no scope of their own here
    grouped = found.where("scope <> 'local'").groupBy(*FILE, "result_s", "scope", "name").agg(F.collect_set("family").alias("families"), F.sort_array(F.collect_list(F.struct("at", "role"))).alias("seen"))
    story = F.concat(F.col("name"), F.lit(": "), F.array_join(F.transform("seen", lambda x: x["role"]), ", "))
    nodes = manuscript.results.select(*FILE, F.col("s").alias("result_s"), "node", F.col("sl").alias("line"))
    bad = grouped.where(F.size("families") >= 2).join(nodes, [*FILE, "result_s"])
    return manuscript._finding(bad.select("project_id", "node", "line", story.alias("subject"), F.transform("seen", lambda x: F.concat(F.lit("introduced as "), x["role"])).alias("evidence")), "TH113", "warning")


def mentions(manuscript, known: DataFrame) -> DataFrame:
    """Places ``use_at`` in formulas of a result that hold a name which the result introduces."""
    names = known.groupBy(*FILE, "result_s").agg(F.collect_set("name").alias("names"))
    held = formulas(manuscript).join(names, [*FILE, "result_s"]).select(*FILE, "result_s", "part", "s", "start", "formula", "names")

    def found(row: dict) -> Iterator[tuple]:
        for name, at in sx.mentions(row["formula"], row["names"]):
            yield row["project_id"], row["ord"], row["result_s"], row["part"], row["s"], name, row["start"] + at

    return _each(held, found, PLACE.replace("part string, s int", "use_part string, use_s int, name string, use_at int"))


def resolved_uses(manuscript) -> DataFrame:
    """Each formula that mentions an introduced name, with the innermost and then latest introduction before the mention (as-of).

    A formula's own quantifier comes first, then the proof, then the statement.
    A quantified variable's own place is no mention; a name that a cue
    introduces again mentions the introduction before.
    """
    known = introductions(manuscript).select(*FILE, "result_s", "scope", "name", F.col("s").alias("intro_s"), "at", "role")
    places = mentions(manuscript, known)
    bound = known.where("scope = 'local'").select(*FILE, "result_s", "name", F.col("at").alias("use_at"))
    places = places.join(bound, [*FILE, "result_s", "name", "use_at"], "left_anti")
    seen = F.when(F.col("scope") == "local", F.col("use_s") == F.col("intro_s")).when(F.col("scope") == "proof", F.col("use_part") == "proof").otherwise(True)
    before = places.join(known, [*FILE, "result_s", "name"]).where(seen & (F.col("at") < F.col("use_at")))
    rank = F.when(F.col("scope") == "local", 0).when(F.col("scope") == "proof", 1).otherwise(2)
    latest = Window.partitionBy(*FILE, "result_s", "name", "use_at").orderBy(rank, F.desc("at"))
    nearest = before.withColumn("rank", F.row_number().over(latest)).where("rank = 1")
    return nearest.dropDuplicates([*FILE, "result_s", "name", "use_s", "at"]).select(*FILE, "name", "use_s", "intro_s", "role")


# symbols of the project, over occurrences


def declarations(manuscript) -> DataFrame:
    """Project definitions of reachable files, numbered in project order: symbol, name, place of each occurrence and where the introducing formula ends."""
    m = manuscript
    found = project_symbols(m).select(*FILE, "s", "at", "name", "formula").join(m.order.select(*FILE, "way"), FILE)
    order = Window.partitionBy("project_id").orderBy(F.concat("way", F.array("at")))
    return found.withColumn("symbol", (F.row_number().over(order) - 1).cast("int")).drop("way")


def positions(manuscript, frame: DataFrame, at: str) -> DataFrame:
    """``frame`` once for each occurrence of its file, with ``position``, comparable over the whole project: the way to the occurrence, then ``at``."""
    ways = manuscript.workspace.where("kind = 'file'").select(*FILE, "way")
    return frame.join(ways, FILE).withColumn("position", F.concat("way", F.array(F.col(at)))).drop("way")


def _project_mentions(manuscript, known: DataFrame) -> DataFrame:
    """Every place in a formula of a reachable file that holds a name which the project defines: (file, s, name, use_at)."""
    m = manuscript
    names = known.groupBy("project_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    math = m.facts.where("kind = 'math'").select(*FILE, "s", F.col("bs").alias("start"), F.col("text").alias("formula"))
    held = math.join(m.order.select(*FILE), FILE).join(names, "project_id")

    def found(row: dict) -> Iterator[tuple]:
        for name, at in sx.mentions(row["formula"], row["names"]):
            yield row["project_id"], row["ord"], row["s"], name, row["start"] + at

    return _each(held, found, "project_id long, ord int, s int, name string, use_at int")


def project_uses(manuscript) -> DataFrame:
    """Uses of project symbols with the one symbol that all occurrences of the use agree on, else null.

    In each occurrence the latest definition before the use counts (as-of over
    the expanded project); a tie, or occurrences that differ, give none. Nothing
    is resolved in a workspace that isn't resolved. A definition's own place is
    no use, and a name that the use's own result introduces is none of the project.
    """
    m = manuscript
    known = declarations(m)
    own = known.select(*FILE, "name", F.col("at").alias("use_at"))
    uses = _project_mentions(m, known).join(own, [*FILE, "name", "use_at"], "left_anti")
    local = introductions(m).select(*FILE, "result_s", "name").distinct()
    inside = m.placed(uses.select(*FILE, F.col("use_at").alias("s"), F.col("use_at").alias("e"), "name")).select(*FILE, "result_s", "name", F.col("s").alias("use_at"))
    shadowed = inside.join(local, [*FILE, "result_s", "name"]).select(*FILE, "name", "use_at").distinct()
    uses = uses.join(shadowed, [*FILE, "name", "use_at"], "left_anti")
    use = [*FILE, "name", "s", "use_at"]
    places = positions(m, uses, "use_at")
    declared = positions(m, known.select(*FILE, "name", "symbol", "at"), "at").select("project_id", "name", "symbol", F.col("position").alias("declared"))
    met = places.join(declared, ["project_id", "name"], "left").where(F.col("declared").isNull() | (F.col("declared") < F.col("position")))
    latest = Window.partitionBy(*use, "position")
    nearest = met.withColumn("last", F.max("declared").over(latest)).where("declared = last")
    each = nearest.groupBy(*use, "position").agg(F.collect_set("symbol").alias("symbols"))
    every = places.join(each, [*use, "position"], "left")
    target = F.when(F.size("symbols") == 1, F.col("symbols")[0]).otherwise(F.lit(-1))
    agreed = every.groupBy(*use).agg(F.collect_set(target).alias("targets")).join(m.status, "project_id")
    one = (F.size("targets") == 1) & (F.col("targets")[0] >= 0) & (F.col("workspace") == "resolved")
    return agreed.select(*use, F.when(one, F.col("targets")[0]).alias("symbol"))


def symbol_dependencies(manuscript) -> DataFrame:
    """(project_id, source, target): project symbols whose defining formula uses another."""
    known = declarations(manuscript)
    uses = project_uses(manuscript).where("symbol is not null").select(*FILE, "s", F.col("symbol").alias("target"))
    return known.select(*FILE, "s", F.col("symbol").alias("source")).join(uses, [*FILE, "s"]).select("project_id", "source", "target").where("source <> target").distinct()


def symbol_closure(manuscript) -> DataFrame:
    """For each result the project symbols that it uses, directly or through their definitions."""
    from scholia.plans.fixpoint import reachable_pairs

    m = manuscript
    uses = project_uses(m).where("symbol is not null")
    direct = m.placed(uses.select(*FILE, F.col("use_at").alias("s"), F.col("use_at").alias("e"), "symbol")).select("project_id", "node", "symbol").distinct()
    behind = reachable_pairs(symbol_dependencies(m)).select("project_id", F.col("source").alias("symbol"), F.col("target").alias("through"))
    further = direct.join(behind, ["project_id", "symbol"]).select("project_id", "node", F.col("through").alias("symbol"))
    return direct.unionByName(further).distinct()


#: Scopes from the innermost out; a chain is a scope and all behind it.
SCOPES = ("local", "proof", "result", "project")


def visible(manuscript) -> DataFrame:
    """Names that a result's proof sees by scope, innermost first: (node, name, scope, rank, role)."""
    m = manuscript
    ranks = F.create_map(*[F.lit(x) for i, scope in enumerate(SCOPES) for x in (scope, i)])
    own = introductions(m).where("scope <> 'local'").join(m.results.select(*FILE, F.col("s").alias("result_s"), "node"), [*FILE, "result_s"])
    own = own.select("project_id", "node", "name", "scope", ranks[F.col("scope")].alias("rank"), "role", "at")
    return own.withColumn("nearest", F.row_number().over(Window.partitionBy("project_id", "node", "name").orderBy("rank", F.desc("at"))) == 1).drop("at")


def claim_symbols(manuscript) -> DataFrame:
    """Symbols of a proof that matter to each of its claims: those that a formula of the claim mentions, with the introduction that they resolve to."""
    from scholia.operators.structure import overlap
    from scholia.operators.support import CLAIM

    m = manuscript
    claims = m.claims.select(*CLAIM, "s", "e")
    uses = resolved_uses(m).select(*FILE, "name", "use_s", "intro_s", "role")
    # a formula lies in one proof of its file; only formulas of proofs meet claims
    placed = m.placed(uses.select(*FILE, F.col("use_s").alias("s"), F.col("use_s").alias("e"), "name", "intro_s", "role")).where("context = 'proof'")
    placed = placed.select(*FILE, "result_s", "node", F.col("s").alias("at"), "name", "intro_s", "role")
    held = claims.join(placed, [*FILE, "result_s", "node"])
    return held.where(overlap(F.col("at"), F.col("at") + 1, F.col("s"), F.col("e"))).select(*CLAIM, "name", "intro_s", "role").distinct()
