"""Review: groups of uncertain support, incremental recheck, closed-world requests and accounting of responses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions.text import fingerprint, item_id, token_estimate
from scholia.operators import ir
from scholia.operators.support import RESULT

#: A result as a stored review knows it: identifiers can repeat in a project, so the nth of a name is told apart.
REVIEWED = ["project_id", "identifier", "nth"]
#: Reasons to reuse a review and reasons to check again, the first that holds is given.
REUSED = ("cache_hit_exact_packet", "cache_hit_unaffected_dependency_slice")
RECHECKED = ("rescued_source_changed", "no_prior_review", "cache_entry_missing", "dependency_edge_changed", "upstream_dependency_changed", "local_ir_changed", "review_contract_changed", "cache_identity_changed")
#: Fixed value: addresses that one round of rescue may ask for.
MAX_ADDRESSES = 8


# groups of uncertain edges


def group_edges(edges: list[dict]) -> list[int]:
    """For each unsure edge the number of its group, in the edges' order; sure ones have 0.

    Two unsure edges belong together if they share a claim, if a sure edge joins
    a claim of one with a claim of the other, or if claims of theirs are next to
    each other.
    """

    def ends(e: dict) -> list[int]:
        return [e["idx"], int(e["source"])] if e["kind"] == "prior_claim" else [e["idx"]]

    unsure = [e for e in edges if e["status"] != "confident"]
    parent = {x: x for e in unsure for x in ends(e)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = [(x, y) for e in edges for x, y in zip(ends(e), ends(e)[1:]) if x in parent and y in parent]
    for x, y in [*links, *((x, x + 1) for x in parent if x + 1 in parent)]:
        parent[root(x)] = root(y)
    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(e["idx"]), len(numbers) + 1) if e["status"] != "confident" else 0 for e in edges]


def review_groups(manuscript) -> DataFrame:
    """Groups of unsure support edges of each result: part (from 1 in source order), number of edges, their identifiers and the group's item id."""
    edges = manuscript.support.groupBy(*RESULT).agg(F.sort_array(F.collect_list(F.struct("number", "idx", "kind", "source", "status", "edge"))).alias("edges"))
    edges = edges.where(F.exists("edges", lambda e: e["status"] != "confident"))
    schema = "project_id long, ord int, result_s int, node int, part long, edge string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.string()]
        for batch in batches:
            rows = [(*(r[c] for c in RESULT), part, e["edge"]) for r in batch.to_pylist() for e, part in zip(r["edges"], group_edges(r["edges"])) if part]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = edges.mapInArrow(run, schema).groupBy(*RESULT, "part").agg(F.count(F.lit(1)).alias("edges"), F.array_sort(F.collect_list("edge")).alias("ids"))
    named = manuscript.results.select("project_id", "node", "identifier")
    return found.join(named, ["project_id", "node"]).select(*RESULT, "part", "edges", "ids", item_id(F.col("identifier"), F.col("ids")).alias("item"))


# incremental recheck


def snapshot(manuscript, contract: Column | None = None) -> DataFrame:
    """What a review of each result rests on, as fingerprints, and the key under which it is stored.

    content is all of the result's source, semantic what its mathematics is,
    packet its IR, dependencies the contents of all results that it rests on by
    identifier, edges the references among those; contract names model, prompt
    and limits of the review.
    """
    m = manuscript
    contract = F.lit("structural") if contract is None else contract
    pairs = m.resolved_pairs
    own = m.results.select("project_id", "ord", "node", "identifier", "env", "title", "label", "statement", "proof")
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("project_id", "identifier").orderBy("node")))
    targets = pairs.join(own.select("project_id", F.col("node").alias("target"), F.col("identifier").alias("name")), ["project_id", "target"])
    direct = targets.groupBy("project_id", F.col("source").alias("node")).agg(F.array_sort(F.collect_set("name")).alias("referenced"))
    own = own.join(direct, ["project_id", "node"], "left").withColumn("referenced", F.coalesce("referenced", F.array().cast("array<string>")))
    packet = ir.packets(ir.proof_ir(m)).select("project_id", "node", F.col("packet").alias("text"))
    own = own.join(packet, ["project_id", "node"], "left")
    semantic = fingerprint(F.struct(F.col("env").alias("environment"), "proof", F.col("referenced").alias("referenced_results"), "statement"))
    content = fingerprint(F.struct(F.col("env").alias("environment"), "label", "proof", F.col("referenced").alias("referenced_results"), "statement", "title"))
    shown = F.sha2(F.concat_ws("\n", F.concat_ws(" ", "env", "identifier", F.coalesce("title", F.lit(""))), "text"), 256)
    own = own.select("project_id", "ord", "node", "identifier", "nth", "title", content.alias("content"), semantic.alias("semantic"), shown.alias("packet"), token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    # all results behind each, and the references among them and from it
    behind = m.transitive().select("project_id", F.col("source").alias("node"), F.col("target"))
    names = own.select("project_id", F.col("node").alias("target"), F.col("identifier").alias("name"), F.col("content").alias("held"))
    states = behind.join(names, ["project_id", "target"]).groupBy("project_id", "node").agg(F.array_sort(F.collect_list(F.struct("name", "held"))).alias("dependencies"))
    inner = behind.unionByName(own.select("project_id", "node", F.col("node").alias("target"))).distinct()
    hops = inner.join(targets.select("project_id", F.col("source").alias("target"), F.col("name").alias("into")), ["project_id", "target"]).join(names, ["project_id", "target"])
    edges = hops.groupBy("project_id", "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat("name", F.lit(" > "), "into"))), "\n"), 256).alias("edges"))
    held = own.join(states, ["project_id", "node"], "left").join(edges, ["project_id", "node"], "left")
    held = held.withColumns({"dependencies": F.coalesce("dependencies", F.array().cast("array<struct<name:string,held:string>>")), "edges": F.coalesce("edges", F.sha2(F.lit(""), 256)), "contract": contract})
    key = fingerprint(F.struct("contract", "dependencies", "edges", "identifier", "packet", "semantic"))
    return held.withColumns({"rescue": F.lit(None).cast("string"), "cache_key": key})


def decisions(now: DataFrame, heads: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Reuse or recheck of each result, with the reason.

    ``now`` is a snapshot, ``heads`` the last review of each result and
    ``entries`` all stored reviews by cache_key (the heads, if none are given).
    A stored review of the same key is reused, unless source that it had asked
    for has changed since. Otherwise the reason is the first difference to the
    last review: references, what is behind them, the result itself, the
    contract.
    """
    entries = heads if entries is None else entries
    same = entries.groupBy("project_id", "cache_key").agg(F.max_by(F.struct("content", "rescue"), F.struct("content", "rescue")).alias("e"))
    columns = ("edges", "dependencies", "semantic", "packet", "contract", "cache_key")
    last = heads.select(*REVIEWED, F.struct(*columns).alias("h"))
    held = now.join(same, ["project_id", "cache_key"], "left").join(last, REVIEWED, "left")
    differs = lambda c: ~F.col(f"h.{c}").eqNullSafe(F.col(c))
    reason = (
        F.when(F.col("e").isNotNull() & (F.col("e.rescue").isNull() | F.col("e.rescue").eqNullSafe(F.col("rescue"))), F.when(F.col("e.content") == F.col("content"), REUSED[0]).otherwise(REUSED[1]))
        .when(F.col("e").isNotNull(), RECHECKED[0])
        .when(F.col("h").isNull(), RECHECKED[1])
        .when(F.col("h.cache_key") == F.col("cache_key"), RECHECKED[2])
        .when(differs("edges"), RECHECKED[3])
        .when(differs("dependencies"), RECHECKED[4])
        .when(differs("semantic") | differs("packet"), RECHECKED[5])
        .when(differs("contract"), RECHECKED[6])
        .otherwise(RECHECKED[7])
    )
    out = held.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").startswith("cache_hit"), "reused").otherwise("rechecked"))
    avoided = F.when(F.col("decision") == "reused", F.when(F.col("e.rescue").isNotNull(), 2).otherwise(1)).otherwise(0)
    tokens = F.when(F.col("decision") == "reused", F.col("tokens")).otherwise(F.lit(0)).cast("long")
    return out.select("project_id", "ord", "node", "identifier", "nth", "decision", "reason", "cache_key", avoided.alias("requests_avoided"), tokens.alias("tokens_avoided"))


def cache_summary(decided: DataFrame) -> DataFrame:
    """Per project: results, those reused and rechecked, requests and tokens avoided."""
    return decided.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("decision") == "reused").alias("reused"),
        F.count_if(F.col("decision") == "rechecked").alias("rechecked"),
        F.sum("requests_avoided").alias("requests_avoided"),
        F.sum("tokens_avoided").alias("tokens_avoided"),
    )


# requests and responses


def turns(ir_lines: DataFrame, *, most: int = MAX_ADDRESSES) -> DataFrame:
    """First review turn of each result: its packet, the addresses it advertises (the closed world) and how many may be asked for."""
    packet = ir.packets(ir_lines)
    known = ir.sources(ir_lines).groupBy(*RESULT).agg(F.array_sort(F.collect_set("address")).alias("allowed"))
    return packet.join(known, RESULT, "left").withColumns({"stage": F.lit("initial"), "max_addresses": F.lit(most), "rescue_allowed": F.lit(True), "expected": F.array().cast("array<string>")})


def repeated(ids: Column) -> Column:
    """The distinct values that an array holds more than once."""
    return F.filter(F.array_distinct(ids), lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)


def violations(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """(key, violation, detail) of responses that break their turn's contract.

    Requests have stage, allowed, max_addresses, rescue_allowed and expected (ids
    of carried items); responses have action, source_addresses, findings (id,
    payload) and dispositions (item_id, finding id or null, payload). Each carried
    item must be answered once; no finding may take a carried id or come twice;
    uses of one finding id must agree; requests for source must be allowed,
    advertised and within the limit.
    """
    held = requests.select(*key, "stage", "allowed", "max_addresses", "rescue_allowed", "expected").join(responses, key)
    asks, rescue = F.col("action") == "need_source", F.col("stage") == "rescue"
    empty = F.array().cast("array<string>")
    allowed, expected, wanted = (F.coalesce(c, empty) for c in ("allowed", "expected", "source_addresses"))
    found = F.coalesce("findings", F.array().cast("array<struct<id:string,payload:string>>"))
    answers = F.coalesce("dispositions", F.array().cast("array<struct<item_id:string,finding:string,payload:string>>"))
    answered, ids = F.transform(answers, lambda d: d["item_id"]), F.transform(found, lambda f: f["id"])
    claimed = F.filter(answers, lambda d: d["finding"].isNotNull())
    at_top = F.transform(F.filter(claimed, lambda d: F.exists(found, lambda f: (f["id"] == d["finding"]) & ~f["payload"].eqNullSafe(d["payload"]))), lambda d: d["finding"])
    own = F.filter(claimed, lambda d: ~F.array_contains(ids, d["finding"]))
    uneven = F.transform(F.filter(own, lambda d: F.exists(own, lambda x: (x["finding"] == d["finding"]) & ~x["payload"].eqNullSafe(d["payload"]))), lambda d: d["finding"])
    one = lambda text: F.array(F.lit(text))
    rules = (
        ("source rescue is disabled", F.when(asks & ~F.col("rescue_allowed"), one("")).otherwise(empty)),
        ("no addresses were advertised", F.when(asks & F.col("rescue_allowed") & (F.size(allowed) == 0), one("")).otherwise(empty)),
        ("too many addresses", F.when(asks & (F.size(wanted) > F.col("max_addresses")), F.array(F.size(wanted).cast("string"))).otherwise(empty)),
        ("address was not advertised", F.when(asks & (F.size(allowed) > 0), F.array_except(wanted, allowed)).otherwise(empty)),
        ("initial response has dispositions", F.when(~rescue & (F.size(answers) > 0), one("")).otherwise(empty)),
        ("item answered more than once", F.when(rescue, repeated(answered)).otherwise(empty)),
        ("unknown item answered", F.when(rescue, F.array_except(answered, expected)).otherwise(empty)),
        ("carried item omitted", F.when(rescue, F.array_except(expected, answered)).otherwise(empty)),
        ("finding reuses a carried id", F.when(rescue, F.array_intersect(ids, expected)).otherwise(empty)),
        ("finding id comes twice", F.when(rescue, repeated(ids)).otherwise(empty)),
        ("finding differs from its disposition", F.when(rescue, F.array_distinct(at_top)).otherwise(empty)),
        ("dispositions differ in a finding", F.when(rescue, F.array_distinct(uneven)).otherwise(empty)),
    )

    def told(name: str, details: Column) -> Column:
        return F.transform(details, lambda d: F.struct(F.lit(name).alias("violation"), d.alias("detail")))

    listed = F.flatten(F.array(*[told(*rule) for rule in rules]))
    return held.select(*key, F.inline(listed))


def accepted(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Findings (key, finding, payload) of responses that break nothing; a finding that a disposition also names counts once."""
    bad = violations(requests, responses, key).select(*key).distinct()
    good = responses.join(bad, key, "left_anti")
    top = good.select(*key, F.explode("findings").alias("f")).select(*key, F.col("f.id").alias("finding"), "f.payload")
    held = good.select(*key, F.explode("dispositions").alias("d")).select(*key, "d.finding", "d.payload").where("finding is not null")
    return top.unionByName(held).dropDuplicates([*key, "finding"])


def expanded_addresses(contexts: dict[str, list[str]], requested: list[str], advertised: set[str], most: int) -> list[str]:
    """Requested addresses with the nearest of what they rest on, up to ``most``, prerequisites before what rests on them.

    ``contexts`` maps an address to those it uses. Nearness is the number of
    steps, then the order in which a breadth-first search meets them.
    """
    wanted = list(dict.fromkeys(requested))
    if len(wanted) > most:
        raise ValueError("more addresses than may be asked for")
    layer, seen, near = wanted, set(wanted), []
    while layer:
        layer = [y for x in layer for y in contexts.get(x, ())]
        layer = [y for y in dict.fromkeys(layer) if y not in seen]
        seen.update(layer)
        near += [y for y in layer if y in advertised]
    chosen = {*wanted, *near[: most - len(wanted)]}
    out: dict[str, None] = {}
    done: set[str] = set()
    for start in wanted:
        trail = [(start, iter(contexts.get(start, ())))]
        active = {start}
        while trail:
            at, rest = trail[-1]
            child = next((c for c in rest if c not in done and c not in active), None)
            if child is not None:
                active.add(child)
                trail.append((child, iter(contexts.get(child, ()))))
                continue
            trail.pop()
            active.discard(at)
            done.add(at)
            if at in chosen and at in advertised:
                out[at] = None
    return list(out)


def rescue(turn: DataFrame, ir_lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Second turn: for each result with requested addresses, the source texts of those and of their nearest prerequisites, in that order.

    ``requests`` has the result's keys and addresses; only advertised ones are
    shown, an invalid request gives no row (see ``violations``).
    """
    uses = ir_lines.where("source is not null and target is not null and kind = 'prior_claim'").groupBy(*RESULT, F.col("target").alias("address")).agg(F.sort_array(F.collect_set("source")).alias("uses"))
    uses = uses.groupBy(*RESULT).agg(F.map_from_entries(F.collect_list(F.struct("address", "uses"))).alias("uses"))
    texts = ir.sources(ir_lines).groupBy(*RESULT).agg(F.map_from_entries(F.collect_list(F.struct("address", "text"))).alias("texts"))
    held = turn.select(*RESULT, "allowed", "max_addresses").join(requests, RESULT).join(texts, RESULT).join(uses, RESULT, "left")
    held = held.where((F.size("addresses") <= F.col("max_addresses")) & (F.size(F.array_except("addresses", "allowed")) == 0))
    schema = "project_id long, ord int, result_s int, node int, seq int, address string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 2]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = expanded_addresses(dict(r["uses"] or []), r["addresses"], set(r["allowed"]), r["max_addresses"])
                rows += [(*(r[c] for c in RESULT), i, a, dict(r["texts"])[a]) for i, a in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return held.mapInArrow(run, schema)


def result_contexts(manuscript, lines: DataFrame | None = None) -> DataFrame:
    """For each result all that its review may rest on, as one JSON document: statement, lines of its IR by kind, symbols of the project, results behind it and unsure groups."""
    from scholia.operators.symbols import declarations, symbol_closure

    m = manuscript
    lines = ir.proof_ir(m) if lines is None else lines
    listed = lambda frame, name, *columns: frame.groupBy("project_id", "node").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    symbols = symbol_closure(m).join(declarations(m).select("project_id", "symbol", "name", "formula"), ["project_id", "symbol"])
    names = m.results.select("project_id", F.col("node").alias("target"), "identifier")
    behind = m.transitive().withColumnRenamed("source", "node").join(names, ["project_id", "target"])
    groups = review_groups(m)
    held = m.results.select("project_id", "node", "identifier", "env", "statement")
    held = held.join(listed(lines.where("address <> 'T0'"), "lines", "seq", "address", "kind", "atom", "status"), ["project_id", "node"], "left")
    held = held.join(listed(symbols, "symbols", "symbol", "name", "formula"), ["project_id", "node"], "left").join(listed(behind, "behind", "target", "identifier"), ["project_id", "node"], "left")
    held = held.join(listed(groups, "groups", "part", "item", "edges"), ["project_id", "node"], "left")
    return held.select("project_id", "node", F.to_json(F.struct("identifier", "env", "statement", "lines", "symbols", "behind", "groups")).alias("context"))


def targeted_contexts(manuscript, around: int = 1) -> DataFrame:
    """For each unsure group its claims and those up to ``around`` places beside them, a text once: (part, item, context)."""
    m = manuscript
    groups = review_groups(m)
    touched = groups.select(*RESULT, "part", "item", F.explode("ids").alias("edge")).join(m.support.select(*RESULT, "edge", "idx"), [*RESULT, "edge"])
    near = touched.select(*RESULT, "part", "item", F.explode(F.sequence(F.col("idx") - around, F.col("idx") + around)).alias("idx")).distinct()
    claims = near.join(m.claims.select(*RESULT, "idx", "s", "claim"), [*RESULT, "idx"]).dropDuplicates([*RESULT, "part", "s", "claim"])
    grouped = claims.groupBy(*RESULT, "part", "item").agg(F.sort_array(F.collect_list(F.struct("idx", "claim"))).alias("claims"))
    return grouped.select(*RESULT, "part", "item", F.array_join(F.transform("claims", lambda c: F.concat(F.lit("C"), c["idx"], F.lit(" "), c["claim"])), "\n").alias("context"))


def open_obligations(manuscript, lines: DataFrame | None = None) -> DataFrame:
    """What a report shows as open: (kind, address, expected) of unsure edges, opaque or unresolved claims, and premises that applications leave."""
    from scholia.operators.transform import transformations

    m = manuscript
    lines = ir.proof_ir(m) if lines is None else lines
    edges = lines.where("target is not null and status <> 'confident'").select(*RESULT, F.lit("proof_obligation").alias("kind"), "address", F.coalesce("atom", "source").alias("expected"))
    claims = lines.where("kind in ('opaque_prose', 'unresolved_math')").select(*RESULT, F.lit("proof_obligation").alias("kind"), "address", F.col("atom").alias("expected"))
    places = lines.where("idx is not null and target is null").select(*RESULT, "idx", "address")
    left = transformations(m).where("premise is not null and status <> 'confident'").join(places, [*RESULT, "idx"], "left")
    return edges.unionByName(claims).unionByName(left.select(*RESULT, F.lit("application_precondition").alias("kind"), "address", F.col("premise").alias("expected")))


def visible(findings: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Findings at or above a confidence."""
    return findings.where(F.col("confidence") >= threshold)
