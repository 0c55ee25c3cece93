"""Registered queries over the driver's tables, with their SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.operators import control, evaluation, experiment, ir, ledger, proofs, review, support, transform
from scholia.operators.structure import REFERENCES, Manuscript
from scholia.operators.symbols import all_introductions, project_uses, resolved_uses, role_conflicts
from scholia.plans.oracle import BASE, CLAIMS, FINDINGS, REACH, SHOWN
from scholia.sources.manuscripts import projected_manuscripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The manuscripts that queries share, by session and folder, until ``forget``.
_HELD: dict[str, Manuscript] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def manuscript(spark: SparkSession, sf_dir: str) -> Manuscript:
    """The manuscripts of a folder, scanned once for all queries of a session."""
    name = f"{spark.sparkContext.applicationId} {sf_dir}"
    if name not in _HELD:
        _HELD[name] = Manuscript(projected_manuscripts(spark, sf_dir))
    return _HELD[name]


def forget() -> None:
    """Give back what queries share; frames that were made from it can't be evaluated any more."""
    for held in _HELD.values():
        held.release()
    _HELD.clear()


def show(findings: DataFrame) -> DataFrame:
    return findings.select(*SHOWN.split(", "))


def _findings(base: str, *rules: str) -> str:
    return base + " union all ".join(f"(select {SHOWN} from ({FINDINGS[r]}) {r.lower()})" for r in rules)


@query(_findings(BASE, "TH101"))
def findings_duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(manuscript(spark, sf_dir).duplicate_labels())


@query(_findings(BASE, "TH102"))
def findings_ambiguous_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(manuscript(spark, sf_dir).reference_findings("ambiguous", "TH102"))


@query(_findings(BASE, "TH103"))
def findings_missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(manuscript(spark, sf_dir).reference_findings("missing", "TH103"))


@query(_findings(REACH, "TH104"))
def findings_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(manuscript(spark, sf_dir).cycle_findings())


@query(_findings(BASE, "TH113"))
def findings_role_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(role_conflicts(manuscript(spark, sf_dir)))


@query(_findings(REACH, *FINDINGS))
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(manuscript(spark, sf_dir).findings().orderBy("project_id", "file", "line", "rule", "subject"))


@query(BASE + r"""
select project_id, ord, 'label' as kind, label as key from labelled
union all select project_id, ord, 'ref', trim(unnest(string_split(keys, ','))) from (
  select project_id, ord, unnest(regexp_extract_all(t, '\\(?:ref|eqref|autoref|cref|Cref)\{([^{}]*)\}', 1)) as keys from bare) x""")
def scan_labels_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manuscript(spark, sf_dir)
    refs = m.macros.where(F.col("name").isin(*REFERENCES)).select("project_id", "ord", F.lit("ref").alias("kind"), F.explode(F.split("arg", ",")).alias("key"))
    refs = refs.withColumn("key", F.trim("key"))
    return m.labels.select("project_id", "ord", F.lit("label").alias("kind"), F.col("label").alias("key")).unionByName(refs)


@query(BASE + "select project_id, node, ord, env, title, identifier, sl as line, has_proof from m")
def theorem_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).results.select("project_id", "node", "ord", "env", "title", "identifier", F.col("sl").alias("line"), F.col("proof").isNotNull().alias("has_proof"))


@query(BASE + "select project_id, node, cast(gap as int) as gap from m where has_proof")
def proof_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = manuscript(spark, sf_dir).results.where("proof is not null")
    return r.select("project_id", "node", (F.col("proof_line") - F.col("el")).alias("gap"))


@query(BASE + "select project_id, node, context, item, label, resolution, target from edges")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).edges.select("project_id", "node", "context", "item", "label", "resolution", "target")


@query(BASE + "select project_id, source, target from pairs")
def deps_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).resolved_pairs.select("project_id", "source", "target")


@query(BASE + "select project_id, target as source, source as dependent from pairs")
def deps_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).reverse()


@query(REACH + "select project_id, source, target from reach where source <> target")
def deps_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).transitive()


NEAR = BASE.rstrip() + """,
steps as (
  select project_id, source, target, 1 as distance from pairs
  union select s.project_id, s.source, e.target, s.distance + 1 from steps s join pairs e on s.project_id = e.project_id and s.target = e.source where s.distance < 64
),
near as (select project_id, source, target, cast(min(distance) as int) as distance from steps where source <> target group by all)
"""


@query(NEAR.rstrip() + """,
trails as (
  select project_id, source, target, [source, target] as path from pairs where source <> target
  union all select t.project_id, t.source, e.target, list_append(t.path, e.target) from trails t join pairs e on t.project_id = e.project_id and t.target = e.source
    join near n on n.project_id = t.project_id and n.source = t.source and n.target = e.target and n.distance = len(t.path)
)
select project_id, source, target, array_to_string(min(path), ' ') as path from trails group by all""")
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path of results from each to each that it rests on."""
    return manuscript(spark, sf_dir).paths().select("project_id", "source", "target", F.array_join("path", " ").alias("path"))


@query(BASE + r"""
select m.project_id, p.source as node, count(*) as lines, sha256(string_agg('[' || env || ' ' || identifier || '] ' || trim(regexp_replace(stmt, '\s+', ' ', 'g')) || ' (' || file || ':' || cast(sl as varchar) || '-'
  || cast(sl + length(body) - length(replace(body, chr(10), '')) as varchar) || ')', chr(10) order by m.node)) as context
from pairs p join m on p.project_id = m.project_id and p.target = m.node group by all""")
def dependency_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manuscript(spark, sf_dir).dependency_context()
    return found.select("project_id", "node", F.size("context").cast("long").alias("lines"), F.sha2(F.array_join("context", "\n"), 256).alias("context"))


@query(BASE + """
select project_id, kind, count(*) as n from (select project_id, 'file' as kind from walk union all select project_id, kind from sites where kind <> 'file') x group by all""")
def include_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).workspace.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "select project_id, cast(row_number() over (partition by project_id order by way) - 1 as int) as occurrence, ord from walk")
def workspace_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).workspace.where("kind = 'file'").select("project_id", "occurrence", "ord")


@query(BASE + "select project_id, case when resolved then 'resolved' else 'partial' end as workspace from state")
def workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).status


COVERED = BASE.rstrip() + r""",
middles as (select project_id, ord, raw, case when ord = 0 then regexp_extract(raw, '(?s)\\begin\{document\}(.*)\\end\{document\}', 1) else raw end as mid from bare),
spans as (
  select project_id, ord, unnest(regexp_extract_all(mid, '%[^\n]*|(?s:\\begin\{verbatim\}.*?\\end\{verbatim\})|\\caption\{(?:[^{}%]|%[^\n]*\n|\{[^{}]*\})*\}|\\section\{(?:[^{}]|\{[^{}]*\})*\}|(?s:\\begin\{equation\}.*?\\end\{equation\})|(?s:\\\[.*?\\\])|\$[^$]*\$|\\(?:begin|end)\{[a-z]+\}(?:\[[^\]]*\])?|\\(?:input|cref|ref|autoref|eqref|label)\{[^{}]*\}|\\(?:foo|emph)')) as x from middles
),
covered as (select project_id, ord, cast(length(raw) - length(mid) + coalesce(n, 0) as bigint) as covered, length(raw) as size from middles left join (select project_id, ord, sum(length(x)) as n from spans group by all) y using (project_id, ord))
"""


@query(COVERED + "select project_id, ord, covered from covered where covered > 0")
def source_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).regions().groupBy("project_id", "ord").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("covered"))


@query(COVERED + "select project_id, ord, cast(size - covered as bigint) as prose from covered where size > covered")
def eligible_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).prose().groupBy("project_id", "ord").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("prose"))


@query(CLAIMS + "select project_id, node, idx, form, claim, follows, coalesce(qualifier, '') as qualifiers from claims")
def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).claims.select("project_id", "node", "idx", "form", "claim", "follows", F.array_join("qualifiers", " ").alias("qualifiers"))


@query(CLAIMS + "select project_id, node, idx, kind, source, status, edge from support")
def support_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript(spark, sf_dir).support.select("project_id", "node", "idx", "kind", "source", "status", "edge")


@query(CLAIMS + "select project_id, node, idx, cast(source as int) as prior from support where kind = 'prior_claim'")
def support_prior_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a conclusion word links to the claim before, where nothing that is no document text lies between."""
    return support.claim_links(manuscript(spark, sf_dir).support).select("project_id", "node", F.col("target").alias("idx"), F.col("source").alias("prior"))


USED = CLAIMS.rstrip() + """,
used as (select distinct project_id, node, cast(source as int) as idx from support where kind = 'prior_claim'),
bearing as (select project_id, node, idx, exists (select 1 from support s where s.project_id = u.project_id and s.node = u.node and s.idx = u.idx and s.status = 'confident') as supported from used u)
"""


@query(USED + "select project_id, node, idx, supported from bearing")
def load_bearing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.load_bearing(manuscript(spark, sf_dir)).select("project_id", "node", "idx", "supported")


@query(USED + "select project_id, node, idx from bearing where not supported")
def unsupported_load_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.load_bearing(manuscript(spark, sf_dir)).where("not supported").select("project_id", "node", "idx")


@query(CLAIMS.rstrip() + """,
links as (select project_id, node, cast(source as int) as a, idx as b from support where kind = 'prior_claim'),
chain as (select project_id, node, a, b from links union select c.project_id, c.node, c.a, l.b from chain c join links l on c.project_id = l.project_id and c.node = l.node and c.b = l.a)
select project_id, node, a as claim, b as later from chain""")
def downstream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.downstream(manuscript(spark, sf_dir)).select("project_id", "node", "claim", "later")


@query(CLAIMS + "select project_id, node, idx, kind from sliced")
def proof_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.proof_slice(manuscript(spark, sf_dir)).select("project_id", "node", "idx", "kind")


NAME = r"regexp_extract(formula, '^(\\[A-Za-z]+|[A-Za-z](?:_\{[A-Za-z0-9]+\})?)', 1)"
ROLE = r"case when contains(formula, '\to') then 'map' when regexp_matches(formula, '^[a-z]\([a-z]\) = ') then 'function' when contains(formula, ' > ') then 'scalar' else 'unknown' end"


@query(BASE.rstrip() + r""",
said as (
  select project_id, ord, 'result' as scope, unnest(regexp_extract_all(stmt, '(?:Let|For every|define) \$([^$]*)\$', 1)) as formula from m
  union all select project_id, ord, 'project', unnest(regexp_extract_all(t, 'Put \$([^$]*)\$', 1)) from bare join files using (project_id, ord)
  union all select project_id, ord, 'project', unnest(regexp_extract_all(stmt, 'Let \$([^$]*\\to[^$]*)\$ be', 1)) from found where env = 'remark' and project_id not in (select project_id from declared)
)
select project_id, ord, scope, regexp_replace(""" + NAME + r""", '_\{(.*)\}', '_\1') as name, case when contains(formula, ':=') then 'unknown' else """ + ROLE + r""" end as role, formula from said
union all select project_id, ord, 'local', regexp_extract(formula, 'forall ([a-z])', 1), 'unknown', formula from (select project_id, ord, unnest(regexp_extract_all(stmt, '\$(\\forall [^$]*)\$', 1)) as formula from m) x""")
def symbol_introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manuscript(spark, sf_dir)
    return all_introductions(m).join(m.order.select("project_id", "ord"), ["project_id", "ord"]).select("project_id", "ord", "scope", "name", "role", "formula")


@query(BASE + r"""
select project_id, ord, 'x' as name, 'scalar' as role from m where contains(stmt, 'Let $x > 0$ be') and contains(stmt, 'Let $x \colon U \to V$ be')
union all select project_id, ord, 'x', 'map' from m where contains(stmt, 'Let $x \colon A \to B$ be') and contains(stmt, 'Let $x \colon U \to V$ be')
union all select project_id, ord, unnest(['\varepsilon', 'y']), unnest(['scalar', 'unknown']) from m where contains(stmt, '$\varepsilon < y$')
union all select project_id, ord, 'z', 'unknown' from m where contains(stmt, '$\forall z \in Z, z > b$')""")
def symbol_uses_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_uses(manuscript(spark, sf_dir)).select("project_id", "ord", "name", "role")


#: The first formula of a claim with its commands as signs.
SIGNS = r"replace(replace(replace(regexp_extract(claim, '\$([^$]*)\$', 1), '\Rightarrow', '⇒'), '\lor', '∨'), '\neg', '¬')"
ADDRESSED = CLAIMS.rstrip() + r""",
atoms as (
  select s.*, case when form = 'display' then trim(claim[4:-4])
    when kind in ('C', 'P') and regexp_matches(claim, '(?i)^(?:therefore|hence|thus|consequently)\s*,?\s*\$[^$]*\$\.$') and exists (select 1 from support e where e.project_id = s.project_id and e.node = s.node and e.idx = s.idx and e.kind = 'prior_claim')
      then SIGNS
    when kind in ('C', 'P') and regexp_matches(claim, '^By [a-z]+, \$[^$]*\$\.$') and exists (select 1 from good e where e.project_id = s.project_id and e.node = s.node and e.idx = s.idx)
      then regexp_extract(claim, '\$([^$]*)\$', 1)
    when kind = 'U' then SIGNS end as atom
  from sliced s where kind <> 'pruned'
),
lettered as (select *, case when kind = 'U' then 'U' when atom is null then 'P' else 'C' end as letter from atoms),
placed as (
  select project_id, ord, node, idx, qualifier, letter || cast(row_number() over (partition by project_id, node, letter order by idx) as varchar) as address,
    case letter when 'U' then 'unresolved_math' when 'P' then 'opaque_prose' else 'claim' end as kind, coalesce(atom, claim) as atom from lettered
)
""".replace("SIGNS", SIGNS)


@query(ADDRESSED + "select project_id, node, idx, address, kind, atom from placed")
def canonical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addressed claims of each proof's IR."""
    return ir.proof_ir(manuscript(spark, sf_dir)).where("kind in ('claim', 'opaque_prose', 'unresolved_math')").select("project_id", "node", "idx", "address", "kind", "atom")


@query(ADDRESSED + r"""
, owned as (select p.project_id, p.source as node, identifier, 'R' || cast(row_number() over (partition by p.project_id, p.source order by m.node) as varchar) as address from pairs p join m on p.project_id = m.project_id and p.target = m.node),
numbered as (
  select s.*, t.address as target, 'E' || cast(row_number() over (partition by s.project_id, s.node order by number) as varchar) as address
  from support s join placed t on s.project_id = t.project_id and s.node = t.node and s.idx = t.idx)
select n.project_id, n.node, n.address, n.kind, case when n.kind = 'prior_claim' then b.address when n.kind in ('result_reference', 'equation_reference') then coalesce(o.address, '@' || n.source) end as source, n.target, n.status
from numbered n left join placed b on n.kind = 'prior_claim' and b.project_id = n.project_id and b.node = n.node and b.idx = n.idx - 1
  left join owned o on n.kind in ('result_reference', 'equation_reference') and o.project_id = n.project_id and o.node = n.node and o.identifier = n.source
union all select project_id, node, 'Q' || cast(row_number() over (partition by project_id, node order by idx) as varchar), 'quantifier', null, address, 'confident' from placed where qualifier is not null and kind <> 'unresolved_math'""")
def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support and qualifiers between the addresses of each proof's IR."""
    return ir.proof_ir(manuscript(spark, sf_dir)).where("target is not null").select("project_id", "node", "address", "kind", "source", "target", "status")


@query(BASE + r"""
select project_id, node, 'T0' as address, 'result' as kind, case when contains(stmt, 'If $a$, then $b$.') then 'a⇒b' end as atom from m
union all select project_id, node, 'H1', 'hypothesis', 'x>0' from m where contains(stmt, 'Let $x > 0$ be')
union all select project_id, node, unnest(['H1', 'H2', 'D1']), unnest(['hypothesis', 'hypothesis', 'definition']), unnest(['\varepsilon>0', 'y\inY', 'g=t']) from m where contains(stmt, 'For every $\varepsilon > 0$ define $g(t) = t$. Let $y \in Y$ be')""")
def canonical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement, hypotheses and definitions of each result's IR; a statement that is no formula shows none."""
    found = ir.proof_ir(manuscript(spark, sf_dir)).where("target is null and kind in ('result', 'hypothesis', 'local_constraint', 'definition')")
    return found.select("project_id", "node", "address", "kind", F.when(~F.col("opaque"), F.col("atom")).alias("atom"))


@query(CLAIMS + "select project_id, node, count(*) as claims, count(*) filter (where kind = 'pruned') as pruned, count(*) filter (where kind = 'U') as unresolved_math from sliced group by all")
def slice_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.pruned(manuscript(spark, sf_dir)).select("project_id", "node", "claims", "pruned", "unresolved_math")


@query(BASE.rstrip() + r""",
shown as (
  select distinct trim(unnest(regexp_extract_all(regexp_replace(t, '(?s)\\\[(.*?)\\\]', '$\1$', 'g'), '\$([^$]*)\$', 1))) as formula from bare
),
plain as (select formula, regexp_replace(formula, '_\{([A-Za-z0-9]+)\}', '_\1', 'g') as f from shown)
select formula, case when regexp_matches(f, '^[A-Za-z](_[0-9]+)?$') then f
    when regexp_matches(f, '^\S+ [<>=] \S+$') then '(' || replace(f, '\', '') || ')'
    when regexp_matches(f, '^\S+ \\in \S+$') then '(' || replace(f, '\', '') || ')'
    when contains(f, '\Rightarrow') then '(' || replace(f, '\Rightarrow', '=>') || ')'
    when contains(f, '\lor') then '(' || replace(f, '\lor', '\/') || ')' when starts_with(f, '\neg ') then '~' || substr(f, 6) when regexp_matches(f, '^[A-Z]\([0-9]\)$') then f
    when contains(f, '\forall') then '(' || regexp_replace(replace(f, '\', ''), ', (.*)$', ', (\1)') || ')'
    else '?[' || formula || ']' end as rendered,
  case when contains(f, '\to') or contains(f, ':=') then 'opaque' else 'full' end as expression_status from plain""")
def formula_lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.formulas(manuscript(spark, sf_dir)).select("formula", "rendered", "expression_status")


@query("select p_size, count(*) as formulas, count(distinct p_partkey % 3) as spellings from part group by p_size")
def alpha_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantified statements about parts: those that differ in the bound name alone share an alpha key."""
    name = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("p_partkey") % 3 + 1).cast("int"))
    formula = F.concat(F.lit(r"\forall "), name, F.lit(r" \in N, "), name, F.lit(r" \ge "), F.col("p_size"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", formula.alias("formula"))
    keyed = proofs.lowered(parts, "formula").groupBy("alpha_key").agg(F.first("p_size").alias("p_size"), F.count(F.lit(1)).alias("formulas"), F.countDistinct("rendered").alias("spellings"))
    return keyed.select("p_size", "formulas", "spellings")


FRAG = CLAIMS.rstrip() + r""",
frags as (select *, regexp_extract(claim, '\$([^$]*)\$', 1) as f, starts_with(claim, '\[') as shown from claims),
typed as (select project_id, node, idx, case when shown then trim(claim[4:-4]) else f end as f from frags)
"""


@query(FRAG + r"""
select s.project_id, s.node, s.idx, s.kind, s.source, s.status, case when s.kind in ('result_reference', 'equation_reference') then 'apply_result' when s.kind = 'definition' then 'definition_use'
  when s.kind = 'named_property' then 'named_property_application'
  when s.kind = 'prior_claim' and contains(b.f, ' \Rightarrow ') and string_split(b.f, ' \Rightarrow ')[2] = c.f
    and exists (select 1 from typed k where k.project_id = s.project_id and k.node = s.node and k.f = string_split(b.f, ' \Rightarrow ')[1]) then 'implication_elimination' else 'unknown' end as rule
from support s join typed c on c.project_id = s.project_id and c.node = s.node and c.idx = s.idx
  left join typed b on s.kind = 'prior_claim' and b.project_id = s.project_id and b.node = s.node and b.idx = s.idx - 1""")
def proof_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.steps(manuscript(spark, sf_dir)).select("project_id", "node", "idx", "kind", "source", "status", "rule")


DUTIES = CLAIMS.rstrip() + """,
duties as (
  select project_id, node, idx, kind, case when kind = 'C' and exists (select 1 from support s where s.project_id = x.project_id and s.node = x.node and s.idx = x.idx and s.status = 'confident')
    then 'discharged' else 'open' end as status from sliced x where kind <> 'pruned')
"""


@query(DUTIES + "select project_id, node, idx, kind, status from duties")
def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.obligations(manuscript(spark, sf_dir)).select("project_id", "node", "idx", "kind", "status")


@query(CLAIMS + "select project_id, node, idx, coalesce(string_agg('C' || cast(idx as varchar), ' ') over (partition by project_id, node order by idx rows between unbounded preceding and 1 preceding), '') as context from claims")
def obligation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.contexts(manuscript(spark, sf_dir)).select("project_id", "node", "idx", "context")


@query(CLAIMS + "select project_id, node, string_agg('C' || cast(idx as varchar) || ' ' || claim, chr(10) order by idx) as packet from claims group by project_id, node")
def review_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.packets(manuscript(spark, sf_dir)).select("project_id", "node", "packet")


@query(CLAIMS.rstrip() + """,
places as (select project_id, node, idx, case when idx - lag(idx) over w <= 1 then 0 else 1 end as fresh from (select distinct project_id, node, idx from support where status <> 'confident') x window w as (partition by project_id, node order by idx)),
islands as (select project_id, node, idx, cast(sum(fresh) over (partition by project_id, node order by idx) as bigint) as part from places)
select s.project_id, s.node, part, count(*) as edges, substr(sha256(identifier || chr(0) || string_agg(s.edge, chr(0) order by s.edge)), 1, 16) as item
from support s join islands i on s.project_id = i.project_id and s.node = i.node and s.idx = i.idx join m on m.project_id = s.project_id and m.node = s.node
where s.status <> 'confident' group by s.project_id, s.node, part, identifier""")
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_groups(manuscript(spark, sf_dir)).select("project_id", "node", "part", "edges", "item")


KEYED = REACH.rstrip() + r""",
told as (select project_id, node, identifier, row_number() over (partition by project_id, identifier order by node) as nth from m),
inner_nodes as (select project_id, source as node, target from reach union select project_id, node, node from m),
hops as (select distinct i.project_id, i.node, a.identifier || ' > ' || b.identifier as hop from inner_nodes i join pairs p on p.project_id = i.project_id and p.source = i.target
  join m a on a.project_id = p.project_id and a.node = p.source join m b on b.project_id = p.project_id and b.node = p.target),
now as (
  select t.project_id, t.node, identifier, cast(nth as int) as nth, coalesce((select sha256(string_agg(hop, chr(10) order by hop)) from hops h where h.project_id = t.project_id and h.node = t.node), sha256('')) as edges,
    (select count(*) from reach r where r.project_id = t.project_id and r.source = t.node and r.target <> t.node) as behind from told t
)
"""


@query(KEYED + "select project_id, node, identifier, nth, edges, cast(behind as int) as behind from now")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored review rests on: the references among all results behind it, and how many those are."""
    return review.snapshot(manuscript(spark, sf_dir)).select("project_id", "node", "identifier", "nth", "edges", F.size("dependencies").alias("behind"))


def stored_reviews(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads and entries as an earlier version might have left them: changed by the number of the result, one rule after another."""
    n = F.col("node")
    moved = {"edges": n % 6 == 2, "dependencies": n % 5 == 1, "semantic": n % 7 == 0, "contract": n % 4 == 3, "cache_key": n % 19 == 18}
    empty = F.array().cast("array<struct<name:string,held:string>>")
    lost = moved["edges"] | (moved["dependencies"] & (F.size("dependencies") > 0)) | moved["semantic"] | moved["contract"] | moved["cache_key"]
    old = now.withColumns({
        "cache_key": F.when(lost, F.concat(F.lit("old "), "cache_key")).otherwise(F.col("cache_key")),
        "edges": F.when(moved["edges"], "old").otherwise(F.col("edges")),
        "dependencies": F.when(moved["dependencies"], empty).otherwise(F.col("dependencies")),
        "semantic": F.when(moved["semantic"], "old").otherwise(F.col("semantic")),
        "contract": F.when(moved["contract"], "old").otherwise(F.col("contract")),
        "content": F.when(n % 13 == 4, "old").otherwise(F.col("content")),
        "rescue": F.when(n % 9 == 5, "asked").otherwise(F.col("rescue")),
    })
    return old.where(n % 11 != 3), old.where((n % 11 != 3) & (n % 17 != 16))


DECIDED = KEYED.rstrip() + """,
changed as (select *, node % 6 = 2 or (node % 5 = 1 and behind > 0) or node % 7 = 0 or node % 4 = 3 or node % 19 = 18 as lost from now),
decided as (
  select project_id, node, case
    when node % 11 <> 3 and node % 17 <> 16 and not lost then case when node % 9 = 5 then 'rescued_source_changed' when node % 13 = 4 then 'cache_hit_unaffected_dependency_slice' else 'cache_hit_exact_packet' end
    when node % 11 = 3 then 'no_prior_review' when not lost then 'cache_entry_missing' when node % 6 = 2 then 'dependency_edge_changed' when node % 5 = 1 and behind > 0 then 'upstream_dependency_changed'
    when node % 7 = 0 then 'local_ir_changed' when node % 4 = 3 then 'review_contract_changed' else 'cache_identity_changed' end as reason from changed
)
"""


@query(DECIDED + "select project_id, node, case when starts_with(reason, 'cache_hit') then 'reused' else 'rechecked' end as decision, reason from decided")
def cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a stored state in which every reason occurs."""
    now = review.snapshot(manuscript(spark, sf_dir))
    return review.decisions(now, *stored_reviews(now)).select("project_id", "node", "decision", "reason")


@query(DECIDED + """
select project_id, count(*) as units, count(*) filter (where starts_with(reason, 'cache_hit')) as reused, count(*) filter (where not starts_with(reason, 'cache_hit')) as rechecked,
  cast(count(*) filter (where starts_with(reason, 'cache_hit')) as bigint) as requests_avoided from decided group by project_id""")
def cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = review.snapshot(manuscript(spark, sf_dir))
    return review.cache_summary(review.decisions(now, *stored_reviews(now))).drop("tokens_avoided")


@query(REACH + CLAIMS[len(BASE.rstrip()):].rstrip() + DUTIES[len(CLAIMS.rstrip()):].rstrip() + f""",
shown as ({" union all ".join(f"(select {SHOWN} from ({sql}) {rule.lower()})" for rule, sql in FINDINGS.items())}),
tally as (select project_id, unit, ord, count(*) as n from shown group by all),
todo as (select project_id, node, count(*) as n from duties where status = 'open' group by all),
ranked as (select *, row_number() over (partition by project_id, identifier, ord order by node) as nth from m)
select m.project_id, count(*) as results, cast(sum(coalesce(t.n, 0)) as bigint) as findings, cast(sum(coalesce(o.n, 0)) as bigint) as open_obligations,
  count(*) filter (where coalesce(t.n, 0) > 0 or coalesce(o.n, 0) > 0) as attention, count(*) filter (where coalesce(t.n, 0) = 0 and coalesce(o.n, 0) = 0) as clean
from ranked m left join tally t on t.project_id = m.project_id and t.unit = m.identifier and t.ord = m.ord and m.nth = 1 left join todo o on o.project_id = m.project_id and o.node = m.node group by m.project_id""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.report_counts(manuscript(spark, sf_dir))


@query(FRAG + r"""
, last as (select project_id, node, arg_max(f, idx) as f from typed group by project_id, node)
select project_id, node, case when contains(f, ' \Rightarrow ') then 'theorem t' || cast(project_id as varchar) || '_' || cast(node as varchar) || ' (' || replace(g, ' => ', ' ') || ' : Prop) : ' || replace(g, ' => ', ' -> ') || ' := by sorry' end as lean,
  case when contains(f, ' \Rightarrow ') then 'partial' else 'unsupported' end as lean_status from (select *, replace(regexp_replace(f, '_\{([0-9]+)\}', '_\1', 'g'), '\Rightarrow', '=>') as g from last) x""")
def lean_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.lean_statements(manuscript(spark, sf_dir)).select("project_id", "node", "lean", "lean_status")


EVALUATED = REACH.rstrip() + f""",
shown as ({" union all ".join(f"(select {SHOWN} from ({sql}) {rule.lower()})" for rule, sql in FINDINGS.items())})
"""


@query(EVALUATED + """
select s.project_id, count(*) filter (where rule in ('TH101', 'TH103')) as matched, count(rule) as observed, count(*) filter (where rule in ('TH101', 'TH103')) > 0 as passed
from (select distinct project_id from p) s left join shown f using (project_id) group by s.project_id""")
def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project as a case that expects an error about a label."""
    m = manuscript(spark, sf_dir)
    cases = m.files.select("project_id").distinct().select("project_id", F.array(F.lit("TH101"), F.lit("TH103")).alias("accepted"), F.lit("error").alias("minimum"))
    return evaluation.evaluate(m.findings(), cases)


@query(EVALUATED + """
select s.project_id, list_sort(coalesce(list(rule) filter (where rule is not null), [])) = case when s.project_id % 3 = 0 then ['TH104'] else [] end as passed, cast(count(rule) as int) as observed
from (select distinct project_id from p) s left join shown f using (project_id) group by s.project_id""")
def evaluation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third project as a case that expects one cycle and nothing else, others as clean ones."""
    m = manuscript(spark, sf_dir)
    rules = F.when(F.col("project_id") % 3 == 0, F.array(F.lit("TH104"))).otherwise(F.array().cast("array<string>"))
    held = evaluation.evaluate_exactly(m.findings(), m.files.select("project_id").distinct().withColumn("rules", rules))
    return held.select("project_id", "passed", F.size("observed").alias("observed"))


@query(NEAR + """
select project_id, source, target, distance, cast(rank as int) as rank from (
  select *, row_number() over (partition by project_id, source order by distance, target) as rank from near) x where rank <= 3""")
def rescue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs.nearest(manuscript(spark, sf_dir).paths(), 3)


@query("""select event_id, cast(sum(cast(value as decimal(18, 6))) over w as double) as spent, sum(cast(value as decimal(18, 6))) over w <= 500 as within
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cost", F.col("value").cast("decimal(18,6)"))
    out = ledger.budget(events.select("event_id", "user_id", "ts", "cost"), "user_id", ["ts", "event_id"], "cost", 500)
    return out.select("event_id", F.col("spent").cast("double").alias("spent"), "within")


@query("select event_id, value - coalesce(lag(value) over (partition by user_id order by ts, event_id), 0) as delta from events")
def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    return ledger.usage_delta(events, "user_id", ["ts", "event_id"], "value").select("event_id", "delta")


@query("""select source, count(distinct sha256(text)) as payloads from documents group by source having count(distinct sha256(text)) > 1""")
def record_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.sha2("text", 256).alias("payload"))
    return ledger.conflicts(docs, ["source"], "payload")


@query("""
with recorded as (select sha256(text) as key, min(md5(text)) as legacy_key, min(conv_id) as response, max(conv_id) as last from conversations where turn % 2 = 0 group by 1),
asked as (select conv_id, turn, case when turn % 4 = 0 then sha256(text) else 'none' end as exact, md5(text) as legacy from conversations)
select conv_id, turn, coalesce(e.response, l.response) as response, case when e.response is not null then 'exact' when l.response is not null then 'legacy' else 'miss' end as found
from asked a left join recorded e on a.exact = e.key left join recorded l on a.legacy = l.legacy_key""")
def replay_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    keys = turns.withColumn("key", F.sha2("text", 256)).withColumn("legacy_key", F.md5("text"))
    recorded = keys.where("turn % 2 = 0").groupBy("key").agg(F.min("legacy_key").alias("legacy_key"), F.min("conv_id").alias("response"))
    asked = keys.select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.col("key")).otherwise("none").alias("exact"), F.col("legacy_key").alias("legacy"))
    return ledger.replay(asked, recorded).select("conv_id", "turn", "response", "found")


@query("""
with verdicts as (select doc_id, quality, case when doc_id % 3 = 0 then 'dismissed' when doc_id % 3 = 1 then 'upheld' end as verdict from labels)
select doc_id as finding, coalesce(verdict, 'uncertain') as verdict, case when verdict is null then 0.0 else 0.5 end::double as confidence
from verdicts where quality = 0 and coalesce(verdict, '') <> 'dismissed'""")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = F.when(F.col("doc_id") % 3 == 0, "dismissed").when(F.col("doc_id") % 3 == 1, "upheld")
    verdicts = labels.select(F.col("doc_id").alias("finding"), verdict.alias("verdict"), F.lit(0.5).alias("confidence"), F.lit(1).alias("at")).where("verdict is not null")
    return ledger.settle(labels.where("quality = 0").select(F.col("doc_id").alias("finding")), verdicts).select("finding", "verdict", "confidence")


@query("""
with words as (select list_filter(string_split(text, ' '), lambda x: x <> '') as w from conversations where text is not null),
starts as (select w, unnest(range(1, len(w) + 1)) as i from words),
spans as (select w, i, unnest(range(1, least(20, len(w) - i + 1) + 1)) as n from starts),
grams as (select array_to_string(w[i:i + n - 1], ' ') as gram from spans)
select gram, count(*) as n, cast((count(*) - 1) * strlen(gram) as bigint) as gain from grams where length(gram) between 3 and 192 group by gram having count(*) >= 2
order by gain desc, strlen(gram) desc, gram limit 1024""")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,024 candidates that rank first: the reference's own top-k."""
    return ledger.ranked_ngrams(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "text")


@query(CLAIMS + "select project_id, node, cast(sum(strlen('C' || cast(idx as varchar) || ' ' || claim)) + count(*) - 1 as bigint) as bytes, true as same from claims group by project_id, node")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.roundtrip(proofs.packets(manuscript(spark, sf_dir))).select("project_id", "node", "bytes", "same")


@query(CLAIMS.rstrip() + """,
sizes as (select project_id, node, cast(count(*) as int) as n from claims group by project_id, node),
asked as (select *, n + node % 3 as wanted from sizes)
select project_id, node, 'too many addresses' as violation, cast(wanted as varchar) as detail from asked where wanted > 4
union all select project_id, node, 'address was not advertised', 'K' || cast(unnest(range(n, wanted)) as varchar) from asked where wanted > n
union all select project_id, node, 'carried item omitted', 'K0' from asked where node % 4 = 1
union all select project_id, node, 'item answered more than once', 'K' || cast(n - 1 as varchar) from asked where node % 4 = 2
union all select project_id, node, 'unknown item answered', 'other' from asked where node % 4 = 3
union all select project_id, node, 'finding reuses a carried id', 'K0' from asked where node % 5 = 0""")
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to each proof's turn that ask for and answer more or less than its claims."""
    claims = manuscript(spark, sf_dir).claims.groupBy("project_id", "node").agg(F.count(F.lit(1)).cast("int").alias("n"))
    named = lambda count: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(F.lit("K"), i.cast("string")))
    turns = claims.select("project_id", "node", F.lit("rescue").alias("stage"), named(F.col("n")).alias("allowed"), F.lit(4).alias("max_addresses"), F.lit(True).alias("rescue_allowed"), named(F.col("n")).alias("expected"))
    k, own = F.col("node") % 4, named(F.col("n"))
    answered = F.when(k == 1, F.slice(own, 2, F.size(own))).when(k == 2, F.concat(own, F.slice(own, -1, 1))).when(k == 3, F.concat(own, F.array(F.lit("other")))).otherwise(own)
    dispositions = F.transform(answered, lambda i: F.struct(i.alias("item_id"), F.lit(None).cast("string").alias("finding"), F.lit(None).cast("string").alias("payload")))
    finding = F.array(F.struct(F.when(F.col("node") % 5 == 0, "K0").otherwise("new").alias("id"), F.lit("text").alias("payload")))
    responses = claims.select("project_id", "node", F.lit("need_source").alias("action"), named(F.col("n") + F.col("node") % 3).alias("source_addresses"), finding.alias("findings"), dispositions.alias("dispositions"))
    return review.violations(turns, responses, ["project_id", "node"])


@query(r"""
with halves as (select w[i] as a, w[i + 1] as b from (select string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')))) as i from benchmark) x),
terms as (select distinct lower(a) as a, lower(b) as b from halves where a <> '' and b <> ''),
split as (select doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') as w from documents),
pairs as (select doc_id, w[i] as x, w[i + 1] as y from (select *, unnest(range(1, len(w))) as i from split) p),
ends as (
  select doc_id, unnest(list_transform(list_filter(range(1, length(x) + 1), lambda j: j = 1 or not regexp_matches(substr(x, j - 1, 1), '[\pL\pN]')), lambda j: substr(x, j))) as a, y from pairs
),
both_ends as (
  select doc_id, a, unnest(list_transform(list_filter(range(1, length(y) + 1), lambda j: j = length(y) or not regexp_matches(substr(y, j + 1, 1), '[\pL\pN]')), lambda j: substr(y, 1, j))) as b from ends
)
select doc_id, a || ' ' || b as term, count(*) as n from both_ends join terms using (a, b) group by all""")
def term_text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring words of the test items, in all documents."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.split("text", " ").alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))).alias("p"))
    terms = pairs.where("p[0] <> '' and p[1] <> ''").select(F.array_join("p", " ").alias("term"))
    return ledger.term_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), terms, "doc_id", "text")


@query(r"""
select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as compacted,
  sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) as escaped,
  cast(greatest(1, (length(text) + 3) // 4) as bigint) as tokens, cast(strlen(text) + 2048 as bigint) as bound from documents""")
def text_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return docs.select("doc_id", F.sha2(tx.compact(text), 256).alias("compacted"), F.sha2(tx.html_escape(text), 256).alias("escaped"), tx.token_estimate(text).alias("tokens"), tx.wire_bound(text).alias("bound"))


@query(BASE + """
select project_id, node, trim(regexp_replace(lower(identifier), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(identifier), 1, 8) as anchor, substr(sha256(identifier || chr(0) || least(env, file) || chr(0) || greatest(env, file)), 1, 16) as item from m""")
def result_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = manuscript(spark, sf_dir).results
    return r.select("project_id", "node", tx.anchor(F.col("identifier")).alias("anchor"), tx.item_id(F.col("identifier"), F.array("env", "file")).alias("item"))


@query(BASE + r"""
select project_id, node, cast(len(regexp_extract_all(stmt, '\$[^$]*\$')) as bigint) as in_statement, cast(len(regexp_extract_all(proof, '\$[^$]*\$|(?s:\\\[.*?\\\])')) as bigint) as in_proof from m
where regexp_matches(stmt, '\$') or regexp_matches(proof, '\$|\\\[')""")
def formulas_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas in each result's statement and proof."""
    m = manuscript(spark, sf_dir)
    held = m.placed(m.facts.where("kind = 'math'").select("project_id", "ord", "s", "e"))
    return held.groupBy("project_id", "node").agg(F.count_if(F.col("context") == "statement").alias("in_statement"), F.count_if(F.col("context") == "proof").alias("in_proof"))


@query(BASE + """
select m.project_id, node, least(sl - 1, 120) as lines, sha256(array_to_string(string_split(raw, chr(10))[greatest(1, sl - 120):sl - 1], chr(10))) as context
from m join p on p.project_id = m.project_id and p.ord = m.ord""")
def local_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines before each result, up to 120."""
    m = manuscript(spark, sf_dir)
    held = m.local_context().join(m.results.select("project_id", "node", "sl"), ["project_id", "node"])
    return held.select("project_id", "node", F.least(F.col("sl") - 1, F.lit(120)).alias("lines"), F.sha2("context", 256).alias("context"))


@query(FRAG + r"""
, held as (
  select project_id, node, 'subproof' as structure, true as asserted, bool_or(exists (select 1 from typed b where b.project_id = a.project_id and b.node = a.node and b.idx > a.idx and b.f = a.f)) as sure from frags a where contains(claim, 'We claim that') group by all
  union all select project_id, node, 'cases', false, bool_or(exists (select 1 from typed x, typed y where x.project_id = a.project_id and y.project_id = a.project_id and x.node = a.node and y.node = a.node
    and string_split(x.f, ' \Rightarrow ')[1] = string_split(a.f, ' \lor ')[1] and string_split(y.f, ' \Rightarrow ')[1] = string_split(a.f, ' \lor ')[2] and string_split(x.f, ' \Rightarrow ')[2] = string_split(y.f, ' \Rightarrow ')[2]))
    from typed a where contains(f, '\lor') group by all
  union all select project_id, node, 'contradiction', false, bool_or(exists (select 1 from typed b where b.project_id = a.project_id and b.node = a.node and a.f = '\neg ' || b.f)) from typed a where starts_with(f, '\neg ') group by all)
select project_id, node, structure, asserted, case when sure then 'confident' else 'unresolved' end as support_status from held where asserted or sure""")
def proof_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control structures that a proof's wording claims or its formulas bear out."""
    return transform.structures(manuscript(spark, sf_dir))


@query(CLAIMS + """
select project_id, node, idx, case kind when 'result_reference' then 'result_application' when 'definition' then 'definition_use' else 'named_property' end as step, source,
  case when kind = 'result_reference' then 'unresolved' else status end as status from support where kind in ('result_reference', 'definition', 'named_property')""")
def proof_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each support edge does; the results here say nothing that a template could apply."""
    return transform.transformations(manuscript(spark, sf_dir)).select("project_id", "node", "idx", "step", "source", "status")


@query(BASE.rstrip() + r""",
defined as (
  select b.project_id, regexp_extract(t, 'Put \$(K_\{[0-9]+\}) :=', 1) as name, list_append(f.way, 0) as place from bare b join files f using (project_id, ord) where contains(t, 'Put $K_{')
),
used as (select project_id, node, place, unnest(regexp_extract_all(proof, 'Here \$(K_\{[0-9]+\}) > 0', 1)) as name from m where has_proof)
select u.project_id, u.node, regexp_replace(u.name, '_\{(.*)\}', '_\1') as name, resolved and d.place < u.place as resolved
from used u join state using (project_id) join defined d on d.project_id = u.project_id and d.name = u.name""")
def project_symbol_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses in results of symbols that the project defines, as-of over the expanded project."""
    m = manuscript(spark, sf_dir)
    uses = project_uses(m).select("project_id", "ord", F.col("use_at").alias("s"), F.col("use_at").alias("e"), "name", F.col("symbol").isNotNull().alias("resolved"))
    return m.placed(uses).select("project_id", "node", "name", "resolved")


@query(ADDRESSED + """
select c.project_id, c.node, count(*) filter (where kind = 'claim') as claim, count(*) filter (where kind = 'opaque_prose') as opaque_prose, count(*) filter (where kind = 'unresolved_math') as unresolved_math,
  (select count(*) from support s join placed x on x.project_id = s.project_id and x.node = s.node and x.idx = s.idx where s.project_id = c.project_id and s.node = c.node and s.status = 'unresolved') as unresolved_edges
from placed c group by c.project_id, c.node""")
def ir_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each proof's IR by kind, and its unsure edges."""
    lines = ir.proof_ir(manuscript(spark, sf_dir))
    found = experiment.inventory(lines).select("project_id", "node", "claim", "opaque_prose", "unresolved_math", "unresolved_edges")
    return found.where("claim + opaque_prose + unresolved_math > 0")


@query(CLAIMS + """
select project_id, count(distinct node) as results, cast(sum(length('C' || cast(idx as varchar) || ' ' || claim) + 1) - count(distinct node) as bigint) as chars from claims group by project_id""")
def packet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that the numbered claims of a project's proofs take."""
    return experiment.sizes(experiment.arms(manuscript(spark, sf_dir))).where("arm = 'skeleton'").select("project_id", "results", "chars")


@query("""
with parts as (select l_orderkey, count(distinct l_linenumber) as disjuncts, count(distinct case when l_returnflag <> 'R' then l_linenumber end) as covered from lineitem group by l_orderkey)
select l_orderkey as scope, cast(disjuncts as int) as disjuncts, cast(covered as int) as covered, case when covered = disjuncts then 'confident' else 'unresolved' end as support_status
from parts where disjuncts > 1""")
def case_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scopes: one of its lines holds, and lines that weren't returned give the conclusion."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    name = F.concat(F.lit("A_{"), F.col("l_linenumber"), F.lit("}"))
    either = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(name)), r" \lor ").alias("formula"))
    rules = lines.where("l_returnflag <> 'R'").select("l_orderkey", F.concat(name, F.lit(r" \Rightarrow C")).alias("formula"))
    return control.case_splits(either.unionByName(rules).withColumnRenamed("l_orderkey", "scope"))


@query("""
select c_nationkey as scope, 'P' as predicate, case when bool_or(c_custkey % 3 = 0) and bool_or(c_custkey % 3 = 1 and c_custkey % 2 = 0) then 'confident' else 'unresolved' end as support_status
from customer where c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_custkey % 2 = 0) group by c_nationkey""")
def inductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("scope"), "c_custkey")
    formula = F.when(F.col("c_custkey") % 3 == 0, "P(0)").when(F.col("c_custkey") % 3 == 1, F.when(F.col("c_custkey") % 2 == 0, r"P(n) \Rightarrow P(n + 1)").otherwise(r"P(n) \Rightarrow P(n + 2)"))
    return control.inductions(customers.withColumn("formula", formula))


@query("""
select distinct a.o_custkey as scope, '["id","Q_' || cast(a.o_orderkey % 5 as varchar) || '"]' as proposition
from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey % 5 = b.o_orderkey % 5 where a.o_orderkey % 2 = 0 and b.o_orderkey % 2 = 1""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("scope"), "o_orderkey")
    name = F.concat(F.lit("Q_{"), F.col("o_orderkey") % 5, F.lit("}"))
    return control.contradictions(orders.withColumn("formula", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(r"\neg "), name)).otherwise(name)))


@query("select s_suppkey, case when s_suppkey % 3 <> 0 then 'x = ' || cast(s_nationkey as varchar) end as bindings from supplier")
def result_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result about any x against statements about two nations, which it fits if they are the same."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    other = F.col("s_nationkey") + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)
    target = F.concat(F.lit("P("), F.col("s_nationkey"), F.lit(r") \Rightarrow Q("), other, F.lit(")"))
    pairs = s.select("s_suppkey", F.lit(r"P(x) \Rightarrow Q(x)").alias("template"), target.alias("target"))
    return control.applications(pairs, ["x"]).select("s_suppkey", "bindings")


@query("select c_custkey, cast(case c_custkey % 4 when 0 then null when 1 then 1 when 2 then 2 else null end as int) as sites from customer")
def rewrite_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations before and after a replaced name: once, twice, not at all, or beside another change."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    kind = F.col("c_custkey") % 4
    after = F.when(kind == 0, "a + b = a").when(kind == 1, "d + b = a").when(kind == 2, "d + b = d").otherwise("d + e = a")
    pairs = c.select("c_custkey", F.lit("a + b = a").alias("before"), after.alias("after"), F.lit("a").alias("old"), F.lit("d").alias("new"))
    return control.rewrites(pairs).select("c_custkey", "sites")


@query(BASE.rstrip() + r""",
texts as (
  select project_id, node, unnest(regexp_extract_all(stmt || ' ' || coalesce(regexp_replace(proof, '(?s)\\\[(.*?)\\\]', '$\1$', 'g'), ''), '\$([^$]*)\$', 1)) as f, stmt from m
),
said as (
  select distinct project_id, node, stmt, regexp_replace(unnest(regexp_extract_all(regexp_replace(f, '\\[A-Za-z]+', ' ', 'g'), '\b[A-Za-z](?:_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]+))?')), '_\{(.*)\}', '_\1') as name from texts
  union select project_id, node, stmt, '\varepsilon' from m where contains(stmt, '\varepsilon')
)
select project_id, node, name, case when name = 'x' and len(regexp_extract_all(stmt, 'Let \$x ')) = 2 then 'ambiguous' when name = 'x' and contains(stmt, 'Let $x ') then 'resolved'
  when name in ('\varepsilon', 'g', 'y') and contains(stmt, '\varepsilon') then 'resolved' when name = 'z' and contains(stmt, '\forall z') then 'bound' else 'unresolved' end as resolution from said""")
def name_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.name_references(manuscript(spark, sf_dir)).select("project_id", "node", "name", "resolution")


@query("""
with recursive spans as (
  select l_orderkey as k, l_linenumber * 5 as s, l_linenumber * 5 + cast(l_quantity as int) as e,
    row_number() over (partition by l_orderkey order by l_linenumber * 5, -(l_linenumber * 5 + cast(l_quantity as int))) as n from lineitem
), fold as (
  select k, n, s, e, e as last, true as kept from spans where n = 1
  union all select p.k, p.n, p.s, p.e, case when p.s >= f.last then p.e else f.last end, p.s >= f.last from fold f join spans p on p.k = f.k and p.n = f.n + 1
)
select k as l_orderkey, cast(s as bigint) as s, cast(e as bigint) as e from fold where kept""")
def greedy_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping choice among the lines of an order, each a span of its quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.col("l_linenumber") * 5
    return control.greedy_spans(lines.select("l_orderkey", s.cast("long").alias("s"), (s + F.col("l_quantity").cast("int")).cast("long").alias("e")), "l_orderkey")


@query(BASE + """
select distinct project_id, node, label from refs r where not exists (select 1 from owners o where o.project_id = r.project_id and o.label = r.label)""")
def closed_world_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a result asks for and no result of the project offers."""
    m = manuscript(spark, sf_dir)
    offered = m.results.where("label is not null").groupBy("project_id").agg(F.array_distinct(F.collect_list("label")).alias("allowed"))
    asked = m.references.groupBy("project_id", "node").agg(F.array_distinct(F.collect_list("label")).alias("source_addresses"))
    limits = {"stage": F.lit("initial"), "max_addresses": F.lit(1 << 30), "rescue_allowed": F.lit(True), "expected": F.array().cast("array<string>")}
    turns = asked.select("project_id", "node").join(offered, "project_id").withColumns(limits)
    responses = asked.withColumns({"action": F.lit("need_source"), "findings": F.lit(None).cast("array<struct<id:string,payload:string>>"), "dispositions": F.lit(None).cast("array<struct<item_id:string,finding:string,payload:string>>")})
    return review.violations(turns, responses, ["project_id", "node"]).select("project_id", "node", F.col("detail").alias("label"))


@query(BASE + """
, wanted as (select distinct label as name from refs), seen as (select distinct identifier as name from m)
select coalesce(s.name, w.name) as name, case when w.name is null then 'not expected' else 'not observed' end as difference from seen s full join wanted w on s.name = w.name where s.name is null or w.name is null""")
def expectation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on one side only, of observed results and expected references."""
    m = manuscript(spark, sf_dir)
    return evaluation.coverage(m.results.select(F.col("identifier").alias("name")), m.references.select(F.col("label").alias("name")), "name")
