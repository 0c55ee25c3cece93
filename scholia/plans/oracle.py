"""Shared parts of the SQL that states what a query returns, computed by regular expressions from the manuscripts' texts.

The texts are made by the projection; what stands in them is found here again by
patterns, includes are expanded by recursion, and nothing is taken from the
numbers that the projection was made with.
"""

from __future__ import annotations

from scholia.sources.manuscripts import projection_sql

_ENVS = "(?:theorem|lemma|proposition|corollary|claim|remark)"
_REF = r"\\(?:ref|eqref|autoref|cref|Cref)\{([^{}]*)\}"
_ITEM = rf"(?s)\\begin\{{{_ENVS}\}}.*?\\end\{{{_ENVS}\}}(?:\n{{1,40}}\\begin\{{proof\}}.*?\\end\{{proof\}})?|\\input\{{[^{{}}]*\}}"


def _numbered(frame: str, columns: str, found: str, name: str) -> str:
    """Rows of a list with their numbers from 1."""
    return f"select {columns}, unnest(xs) as {name}, unnest(range(1, len(xs) + 1)) as k from (select *, {found} as xs from {frame}) listed"


#: ``m`` has a row for each result: project_id, ord, file, node, env, title, label, identifier, stmt, has_proof, proof, sl.
BASE = rf"""
with recursive p as ({projection_sql()}),
bare as (
  select project_id, ord, file, doc_id, raw, regexp_replace(regexp_replace(regexp_replace(raw, '(?s)\\begin\{{verbatim\}}.*?\\end\{{verbatim\}}', '', 'g'), '%[^\n]*', '%', 'g'), '\\newcommand\{{[^{{}}]*\}}\{{\\input[^\n]*', '', 'g') as t from p
),
names as (select project_id, ord, file from p),
items as ({_numbered("bare", "project_id, ord, file, t", f"regexp_extract_all(t, '{_ITEM}')", "item")}),
inc as (
  select project_id, ord, k, target, regexp_replace(case when ord = 0 then target when starts_with(target, '../') then substr(target, 4) else 'sections/' || target end, '\.tex$', '') as path
  from (select *, regexp_extract(item, '^\\input\{{([^{{}}]*)\}}', 1) as target from items where starts_with(item, '\input')) x
),
walk as (
  select project_id, ord, cast([] as bigint[]) as way, [ord] as active from names where ord = 0
  union all
  select w.project_id, c.ord, list_append(w.way, i.k), list_append(w.active, c.ord) from walk w join inc i on i.project_id = w.project_id and i.ord = w.ord
    join names c on c.project_id = w.project_id and c.file = i.path where not list_contains(w.active, c.ord)
),
sites as (
  select w.project_id, w.way, i.k, case when c.ord is null then 'missing' when list_contains(w.active, c.ord) then 'cycle' else 'file' end as kind
  from walk w join inc i on i.project_id = w.project_id and i.ord = w.ord left join names c on c.project_id = w.project_id and c.file = i.path
),
state as (select w.project_id, coalesce(bool_and(s.kind = 'file'), true) as resolved from (select distinct project_id from walk) w left join sites s using (project_id) group by w.project_id),
files as (select project_id, ord, min(way) as way, cast(count(*) as bigint) as occurrences from walk group by project_id, ord),
declared as (select distinct project_id from bare join files using (project_id, ord) where contains(t, '\newtheorem{{remark}}')),
found as (
  select i.project_id, i.ord, i.file, i.item, list_append(f.way, i.k) as place, regexp_extract(item, '^\\begin\{{([a-z]+)\}}', 1) as env,
    regexp_extract(item, '(?s)^\\begin\{{[a-z]+\}}(?:\[[^\]]*\])?(.*?)\\end\{{{_ENVS}\}}', 1) as stmt, contains(item, '\begin{{proof}}') as has_proof,
    regexp_extract(item, '(?s)\\begin\{{proof\}}(.*)\\end\{{proof\}}$', 1) as proof, nullif(regexp_extract(item, '^\\begin\{{[a-z]+\}}\[([^\]]*)\]', 1), '') as title,
    length(regexp_extract(item, '(?s)\\end\{{{_ENVS}\}}(\n+)\\begin\{{proof\}}', 1)) as gap, substr(t, 1, strpos(t, item) - 1) as ahead, regexp_extract(item, '(?s)^(.*?\\end\{{{_ENVS}\}})', 1) as body
  from items i join files f using (project_id, ord) where starts_with(item, '\begin')
),
m as (
  select *, coalesce(label, file || ':' || cast(sl as varchar) || ':' || env) as identifier, cast(row_number() over (partition by project_id order by place) - 1 as int) as node from (
    select project_id, ord, file, place, env, stmt, has_proof, proof, title, body, gap, cast(1 + length(ahead) - length(replace(ahead, chr(10), '')) as int) as sl,
      nullif(regexp_extract(stmt, '\\label\{{([^{{}}]*)\}}', 1), '') as label
    from found where env <> 'remark' or project_id in (select project_id from declared)) x
),
owners as (select project_id, label, count(*) as owners, min(node) as target from m where label is not null group by project_id, label),
labelled as (select project_id, ord, unnest(regexp_extract_all(t, '\\label\{{([^{{}}]*)\}}', 1)) as label from bare),
known as (select project_id, label, cast(sum(occurrences) as bigint) as known from labelled join files using (project_id, ord) group by project_id, label),
listed_refs as (
  select project_id, ord, node, 'statement' as context, unnest(regexp_extract_all(stmt, '{_REF}', 1)) as keys from m
  union all select project_id, ord, node, 'proof', unnest(regexp_extract_all(proof, '{_REF}', 1)) from m where has_proof
),
refs as (select project_id, ord, node, context, unnest(range(0, len(ks))) as item, trim(unnest(ks)) as label from (select *, string_split(keys, ',') as ks from listed_refs) x),
edges as (
  select r.project_id, r.ord, r.node, r.context, cast(r.item as int) as item, r.label,
    case when owners is null then 'missing' when owners = 1 and known = 1 and resolved then 'resolved' else 'ambiguous' end as resolution,
    cast(case when owners = 1 and known = 1 and resolved then target end as int) as target
  from refs r join state using (project_id) left join owners o using (project_id, label) left join known kn using (project_id, label)
  where owners is not null or known is null
),
pairs as (select distinct project_id, node as source, target from edges where resolution = 'resolved')
"""

#: Adds ``reach``: all (source, target) that edges connect, a node to itself where it lies on a cycle; ``components`` of cycles.
REACH = BASE.rstrip() + """,
reach as (
  select project_id, source, target from pairs
  union select r.project_id, r.source, e.target from reach r join pairs e on r.project_id = e.project_id and r.target = e.source
),
members as (
  select project_id, source as node, list_sort(list(target)) as other from (
    select a.project_id, a.source, a.target from reach a join reach b on a.project_id = b.project_id and a.source = b.target and a.target = b.source
  ) mutual group by all
),
components as (
  select c.project_id, other, list(identifier order by c.node) as members, min(c.node) as head
  from members c join m on c.project_id = m.project_id and c.node = m.node group by c.project_id, other
)
"""

#: The columns of a finding that the queries show.
SHOWN = "project_id, rule, severity, ord, unit, subject"
FINDINGS = {
    "TH101": """select project_id, 'TH101' as rule, 'error' as severity, ord, identifier as unit, label as subject from (
      select *, row_number() over (partition by project_id, label order by node) as nth from m where label is not null) x where nth = 2""",
    "TH102": "select e.project_id, 'TH102' as rule, 'error' as severity, e.ord, identifier as unit, e.label as subject from edges e join m on e.project_id = m.project_id and e.node = m.node where resolution = 'ambiguous'",
    "TH103": "select e.project_id, 'TH103' as rule, 'error' as severity, e.ord, identifier as unit, e.label as subject from edges e join m on e.project_id = m.project_id and e.node = m.node where resolution = 'missing'",
    "TH104": "select c.project_id, 'TH104' as rule, 'error' as severity, ord, identifier as unit, array_to_string(members, ' -> ') || ' -> ' || members[1] as subject from components c join m on c.project_id = m.project_id and c.head = m.node",
    "TH113": r"""select project_id, 'TH113' as rule, 'warning' as severity, ord, identifier as unit, 'x: scalar, map' as subject from m
      where regexp_matches(stmt, 'Let \$x > 0\$ be') and regexp_matches(stmt, 'Let \$x \\colon U \\to V\$ be')""",
}

_PIECE = r"(?s)%|\\\[.*?\\\]|(?:[^.%\\]|\\[^\[])+\.?"
_GOOD = "('result_reference', 'equation_reference', 'definition', 'named_property')"

#: Adds ``claims`` (project_id, ord, node, idx, form, claim, follows, qualifiers) and ``support`` (with edge identifiers) of each proof.
CLAIMS = BASE.rstrip() + rf""",
pieces as (
  select project_id, ord, node, k, regexp_replace(piece, '^\s+|\s+$', '', 'g') as piece from ({_numbered("(select * from m where has_proof) proved", "project_id, ord, node", f"regexp_extract_all(proof, '{_PIECE}')", "piece")}) y
),
marked as (
  select *, max(case when piece = '%' then k end) over w as gap, starts_with(piece, '\[') as shown from pieces where piece = '%' or regexp_matches(piece, '\w')
  window w as (partition by project_id, node order by k rows between unbounded preceding and 1 preceding)
),
linked as (select *, lag(k) over w as before, lag(shown) over w as after_display from marked where piece <> '%' window w as (partition by project_id, node order by k)),
judged as (
  select *, before is not null and coalesce(gap < before, true) as follows,
    regexp_matches(piece, '^for (?:every|all|each) \$?[A-Za-z]') and after_display and before is not null and coalesce(gap < before, true) as binds from linked
),
claims as (
  select j.project_id, j.ord, j.node, cast(row_number() over (partition by j.project_id, j.node order by j.k) - 1 as int) as idx, case when shown then 'display' else 'prose' end as form,
    piece as claim, follows, (select q.piece from judged q where q.project_id = j.project_id and q.node = j.node and q.binds and q.before = j.k) as qualifier
  from judged j where not binds
),
cued as (
  select c.project_id, c.ord, c.node, idx, unnest(range(0, len(xs))) as a, unnest(xs) as macro from (
    select *, regexp_extract_all(claim, '\\((?:eqref|ref|autoref|cref)\{{[^{{}}]*\}})', 1) as xs from claims where regexp_matches(claim, '(?i)\b(?:by|from|using|apply)\b.*\\(?:eqref|ref|autoref|cref)\{{')) c
),
targets as (
  select project_id, ord, node, idx, a, unnest(range(0, len(ks))) as b, starts_with(macro, 'eqref') as eq, trim(unnest(ks)) as source from (
    select *, string_split(regexp_extract(macro, '\{{(.*)\}}', 1), ',') as ks from cued) x
),
good as (
  select project_id, ord, node, idx, case when eq then 'equation_reference' else 'result_reference' end as kind, source, 0 as rank, a, b from targets t
    where eq or exists (select 1 from owners o where o.project_id = t.project_id and o.label = t.source)
  union all select project_id, ord, node, idx, 'definition', null, 1, 0, 0 from claims where regexp_matches(claim, '(?i)\bby\s+(?:the\s+)?definition\b')
  union all select project_id, ord, node, idx, 'named_property', lower(unnest(xs)), 2, unnest(range(0, len(xs))), 0 from (
    select *, regexp_extract_all(claim, '(?i)\bby\s+(compactness|continuity|linearity|monotonicity|convexity)\b', 1) as xs from claims) x
),
every as (
  select project_id, ord, node, idx, kind, source, 'confident' as status, rank, a, b from good
  union all select project_id, ord, node, idx, 'named_property', regexp_extract(claim, '(?is)^(?:by|from|using|apply|applying|invoke|invoking)\s+(.+?),\s*.+$', 1), 'unresolved', 3, 0, 0 from claims c
    where regexp_matches(claim, '(?is)^(?:by|from|using|apply|applying|invoke|invoking)\s+(.+?),\s*.+$')
      and not exists (select 1 from good g where g.project_id = c.project_id and g.node = c.node and g.idx = c.idx)
  union all select project_id, ord, node, idx, 'explicit_reason', regexp_extract(claim, '(?is)^since\s+(.+?),\s*.+$', 1), 'confident', 4, 0, 0 from claims where regexp_matches(claim, '(?is)^since\s+(.+?),\s*.+$')
  union all select project_id, ord, node, idx, 'prior_claim', cast(idx - 1 as varchar), 'confident', 5, 0, 0 from claims where follows and regexp_matches(claim, '(?i)^(?:therefore|hence|thus|consequently)\b')
),
support as (
  select e.project_id, e.ord, e.node, e.idx, e.kind, e.source, e.status, e.number, m.identifier || ':claim:' || cast(e.idx + 1 as varchar) || ':support:' || cast(e.number as varchar) as edge
  from (select *, row_number() over (partition by project_id order by node, idx, rank, a, b) as number from every) e join m on e.project_id = m.project_id and e.node = m.node
),
kept as (
  select project_id, node, idx from support
  union select project_id, node, cast(source as int) from support where kind = 'prior_claim'
  union select project_id, node, max(idx) from claims group by project_id, node
),
sliced as (
  select c.*, case when i.idx is not null then case when regexp_matches(claim, '\$|\\\[') then 'C' else 'P' end when regexp_matches(claim, '\$|\\\[') then 'U' else 'pruned' end as kind
  from claims c left join kept i on c.project_id = i.project_id and c.node = i.node and c.idx = i.idx
)
"""
