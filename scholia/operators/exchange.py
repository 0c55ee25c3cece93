"""Model requests and recorded exchanges: canonical envelopes, recording, quarantine, replay and the two-turn review over recordings.

No model is called here. A transport is a function from envelopes to responses;
``replayed`` is one over recorded exchanges, and a live one can stand in its place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions.text import fingerprint, wire_bound
from scholia.operators import review
from scholia.operators.support import RESULT
from scholia.sources.store import written

#: The review's instructions, as sent with every request.
PROMPT = """You review one proof. Its packet lists nodes and support edges by address.
Report steps that do not follow, each with the addresses it rests on. If a step cannot be
judged without its source, ask for addresses that the packet advertises, once."""
#: Protocol and cap of a review's answer.
PROTOCOL, MAX_OUTPUT = "two-turn", 4096
#: Fields of an answer as JSON; its schema is part of every request.
ANSWER = "action string, source_addresses array<string>, findings array<struct<id:string,payload:string>>, dispositions array<struct<item_id:string,finding:string,payload:string>>"

Transport = Callable[[DataFrame], DataFrame]


def response_schema(allowed: list[str], items: list[str], most: int) -> dict:
    """JSON schema of a closed-world answer: addresses and carried items are enumerated, lists are bounded, nothing else is allowed."""

    def listed(values: list[str], limit: int) -> dict:
        return {"type": "array", "items": {"type": "string", "enum": sorted(values)} if values else {"type": "string"}, "maxItems": limit if values else 0}

    finding = {"type": "object", "properties": {"id": {"type": "string"}, "payload": {"type": "string"}}}
    answered = {"type": "object", "properties": {"item_id": {"type": "string", "enum": sorted(items)} if items else {"type": "string"}, "finding": {"type": ["string", "null"]}, "payload": {"type": ["string", "null"]}}}
    schema = {
        "type": "object",
        "properties": {
            "action": {"type": "string", "enum": ["need_source", "review"]},
            "source_addresses": listed(allowed, most),
            "findings": {"type": "array", "items": finding},
            "dispositions": {"type": "array", "items": answered, "minItems": len(items), "maxItems": len(items)},
        },
    }
    return strict(schema)


def strict(schema: dict) -> dict:
    """A schema in which every object requires all its properties and allows no others."""
    out = {k: strict(v) if isinstance(v, dict) else v for k, v in schema.items()}
    if "properties" in schema:
        out["properties"] = {k: strict(v) for k, v in schema["properties"].items()}
        out |= {"required": sorted(schema["properties"]), "additionalProperties": False}
    return out


#: The subset of JSON schema that a strict answer may use.
KEYWORDS = {"type", "properties", "required", "additionalProperties", "items", "enum", "minItems", "maxItems", "description"}
TYPES = {"object", "array", "string", "number", "integer", "boolean", "null"}


def schema_faults(schema: dict, at: str = "$") -> list[str]:
    """Where a schema leaves the strict subset; none if it may be sent."""
    found = [f"{at}: {k} is not supported" for k in sorted(set(schema) - KEYWORDS)]
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    found += [f"{at}: unknown type {k}" for k in kinds if k not in TYPES]
    if "object" in kinds:
        names = schema.get("properties", {})
        if schema.get("additionalProperties") is not False:
            found.append(f"{at}: additional properties are allowed")
        if sorted(schema.get("required", [])) != sorted(names):
            found.append(f"{at}: not all properties are required")
        for name, inner in names.items():
            found += schema_faults(inner, f"{at}.{name}")
    if "array" in kinds:
        found += schema_faults(schema["items"], f"{at}[]") if isinstance(schema.get("items"), dict) else [f"{at}: an array without items"]
    return found


def schema_profile(schema: dict) -> dict[str, int]:
    """Counts of what a schema holds: depth, properties, enumerations, their values and bytes, and the greatest array bound."""
    out = {"depth": 1, "properties": 0, "enums": 0, "enum_values": 0, "enum_bytes": 0, "max_items": schema.get("maxItems", 0)}
    if "enum" in schema:
        out |= {"enums": 1, "enum_values": len(schema["enum"]), "enum_bytes": sum(len(str(v).encode()) for v in schema["enum"])}
    inner = [*schema.get("properties", {}).values(), *([schema["items"]] if isinstance(schema.get("items"), dict) else [])]
    out["properties"] += len(schema.get("properties", {}))
    for part in map(schema_profile, inner):
        for k, v in part.items():
            out[k] = max(out[k], v + (k == "depth")) if k in ("depth", "max_items") else out[k] + v
    return out


def covers(proven: dict[str, int], needed: dict[str, int]) -> list[str]:
    """Counts in which a proven profile is smaller than a needed one."""
    return sorted(k for k, v in needed.items() if proven.get(k, 0) < v)


def canonical_json(payload: object) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_fingerprint(payload: object) -> str:
    """sha256 of sorted, tight JSON with characters as they are."""
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


def envelopes(turns: DataFrame, *, provider: str, model: str, prompt: str = PROMPT, max_output: int = MAX_OUTPUT) -> DataFrame:
    """``turns`` with the request's parts and its fingerprint (``key``) over the canonical JSON of all of them.

    The user content is the turn's packet; a rescue turn carries the transcript
    before it. ``bound`` is an upper bound of its tokens on the wire.
    """
    if max_output <= 0:
        raise ValueError("the cap of an answer must be positive")
    content = turns["packet"]
    rules = canonical_fingerprint(response_schema([], [], 0))
    transcript = F.col("transcript") if "transcript" in turns.columns else F.lit(None).cast("string")
    parts = {"max_output": F.lit(max_output), "model": F.lit(model), "protocol": F.lit(PROTOCOL), "provider": F.lit(provider), "schema": F.lit(rules), "system": F.lit(prompt), "transcript": transcript, "user": content}
    closed = F.array_join(F.array_sort("allowed"), ",")
    out = turns.withColumns(parts)
    out = out.withColumn("key", fingerprint(F.struct(closed.alias("allowed"), "max_output", "model", "protocol", "provider", "schema", "stage", "system", "transcript", "user")))
    return out.withColumns({"legacy_key": fingerprint(F.struct("model", "system", "user")), "bound": wire_bound(F.concat_ws("", "system", "transcript", "user"))})


def raw_turns(results: DataFrame) -> DataFrame:
    """Turns on plain text: statement and proof of each result, no addresses and no rescue."""
    text = F.concat_ws("\n\n", "statement", "proof")
    closed = {"allowed": F.array().cast("array<string>"), "stage": F.lit("initial"), "max_addresses": F.lit(0), "rescue_allowed": F.lit(False), "expected": F.array().cast("array<string>")}
    return results.select("project_id", "ord", F.col("s").alias("result_s"), "node", text.alias("packet")).withColumns(closed)


# recording


def record(new: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``new`` exchanges (key, legacy_key, response, at) with an outcome: recorded, same or conflict.

    The first payload of a key is the recorded one; the same again changes
    nothing, another is a conflict that is kept apart and never replaces it.
    """
    first = Window.partitionBy("key").orderBy("at", "response")
    out = new.withColumn("__nth", F.row_number().over(first)).withColumn("__first", F.first("response").over(first))
    if held is not None:
        out = out.join(held.groupBy("key").agg(F.min("response").alias("__held")), "key", "left")
    else:
        out = out.withColumn("__held", F.lit(None).cast("string"))
    known = F.coalesce("__held", "__first")
    fresh = F.col("__held").isNull() & (F.col("__nth") == 1)
    outcome = F.when(fresh, "recorded").when(F.col("response").eqNullSafe(known), "same").otherwise("conflict")
    return out.withColumn("outcome", outcome).drop("__nth", "__first", "__held")


def quarantine(rejected: DataFrame) -> DataFrame:
    """Rejected exchanges under a name of their content, so that the same one is kept once and none is taken for an accepted one."""
    named = F.sha2(F.concat_ws("\n", F.coalesce("response", F.lit("")), "reason"), 256)
    return rejected.withColumn("name", named).dropDuplicates(["key", "name"])


def write_exchanges(outcomes: DataFrame, path: str) -> dict[str, int]:
    """Append recorded exchanges and conflicts to their tables under ``path``; how many of each outcome there were."""
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    for outcome, name in (("recorded", "accepted"), ("conflict", "conflicts")):
        if counts.get(outcome):
            outcomes.where(F.col("outcome") == outcome).drop("outcome").write.mode("append").parquet(f"{path}/{name}")
    return counts


def replayed(recorded: DataFrame) -> Transport:
    """A transport that answers from recorded exchanges, by key and else by legacy key; without a recording the response is null."""

    def send(requests: DataFrame) -> DataFrame:
        from scholia.operators.ledger import replay

        asked = requests.withColumnsRenamed({"key": "exact", "legacy_key": "legacy"})
        known = recorded.groupBy("key").agg(F.min("legacy_key").alias("legacy_key"), F.min("response").alias("response"))
        return replay(asked, known).withColumnsRenamed({"exact": "key", "legacy": "legacy_key"}).drop("by_exact", "by_legacy")

    return send


def answers(responses: DataFrame) -> DataFrame:
    """Responses as columns; what is no answer of the protocol has null action."""
    return responses.withColumn("answer", F.from_json("response", ANSWER)).select(*responses.columns, "answer.*")


# review and audit


def review_results(ir_lines: DataFrame, transport: Transport, *, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(findings, faults) of a review in at most two turns.

    Results whose first answer asks for advertised source get a second turn with
    it; other first answers are final. An answer that breaks its contract, or is
    missing, is a fault and gives no finding. What the transport answers is
    written when it comes, so that no request is made twice.
    """
    first, _ = written(review.turns(ir_lines), "turns")
    sent, _ = written(answers(transport(envelopes(first, provider=provider, model=model))), "answers")
    broken = review.violations(first, sent.where("action is not null").select(*RESULT, "action", "source_addresses", "findings", "dispositions"), RESULT)
    missing = sent.where("action is null").select(*RESULT, F.when(F.col("response").isNull(), "no response").otherwise("no answer of the protocol").alias("violation"), F.lit("").alias("detail"))
    good = sent.where("action is not null").join(broken.select(*RESULT).distinct(), RESULT, "left_anti")
    asking = good.where("action = 'need_source'")
    shown = review.rescue(first, ir_lines, asking.select(*RESULT, F.col("source_addresses").alias("addresses")))
    texts = shown.groupBy(*RESULT).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "address", "text"))), lambda x: F.concat(F.lit("@"), x["address"], F.lit("\n"), x["text"])), "\n\n").alias("packet"))
    carried = F.transform(F.coalesce("findings", F.array().cast("array<struct<id:string,payload:string>>")), lambda f: f["id"])
    asked = asking.select(*RESULT, F.concat_ws("\n", "user", "response").alias("transcript"), carried.alias("expected"))
    second = texts.join(asked, RESULT).withColumns({"stage": F.lit("rescue"), "allowed": F.array().cast("array<string>"), "max_addresses": F.lit(0), "rescue_allowed": F.lit(False)})
    second, _ = written(second, "turns")
    final, _ = written(answers(transport(envelopes(second, provider=provider, model=model))), "answers")
    columns = [*RESULT, "action", "source_addresses", "findings", "dispositions"]
    late = review.violations(second, final.where("action is not null").select(*columns), RESULT)
    gone = final.where("action is null").select(*RESULT, F.lit("no response").alias("violation"), F.lit("second turn").alias("detail"))
    done = good.where("action <> 'need_source'").select(*RESULT, F.explode("findings").alias("f")).select(*RESULT, F.col("f.id").alias("finding"), "f.payload")
    found = done.unionByName(review.accepted(second, final.where("action is not null").select(*columns), RESULT))
    return found, broken.unionByName(missing).unionByName(late).unionByName(gone)


def audit_key(results: DataFrame, model: str, prompt_version: str, defender: bool) -> DataFrame:
    """``results`` with the key of the attack-and-defence audit: its content, model, prompt and whether a defence is asked for."""
    content = F.to_json(F.struct("env", "identifier", "label", "proof", "statement", "title"), {"ignoreNullFields": "false"})
    return results.withColumn("audit_key", F.sha2(F.concat_ws("\n", content, F.lit(model), F.lit(prompt_version), F.lit(f"defender={defender}")), 256))


def cached_audits(results: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, missing): audits that the cache (audit_key, audit) holds for results with their key, and results that it holds none for."""
    known = cache.groupBy("audit_key").agg(F.max("audit").alias("audit"))
    return results.join(known, "audit_key"), results.join(known, "audit_key", "left_anti")


def audit(findings: DataFrame, verdicts: DataFrame | None, *, source: Column | None = None) -> DataFrame:
    """Findings of an attack with the defence's last verdict on each.

    Without a defence all survive with their own confidence; a finding that the
    defence leaves out is uncertain with confidence 0, a dismissed one goes.
    """
    if verdicts is None:
        return findings.withColumns({"verdict": F.lit("survives"), "defender_confidence": F.col("confidence")})
    last = verdicts.groupBy("finding").agg(F.max_by(F.struct("verdict", "confidence"), "at").alias("v"))
    held = findings.join(last, "finding", "left")
    held = held.withColumns({"verdict": F.coalesce("v.verdict", F.lit("uncertain")), "defender_confidence": F.coalesce("v.confidence", F.lit(0.0))})
    return held.where("verdict <> 'dismissed'").drop("v")


def frozen(expected: dict[str, str], observed: dict[str, str]) -> list[str]:
    """Names whose fingerprints differ or that only one side has, so that an experiment whose inputs have moved is not run."""
    return sorted(k for k in expected.keys() | observed.keys() if expected.get(k) != observed.get(k))


def safe_error(payload: dict, allowed: tuple[str, ...] = ("type", "code", "status", "message", "request_id")) -> dict:
    """The allowed fields of an error as plain JSON values; whatever else it holds stays out of records."""
    return {k: v if isinstance(v, (str, int, float, bool, type(None))) else str(type(v).__name__) for k, v in payload.items() if k in allowed}
