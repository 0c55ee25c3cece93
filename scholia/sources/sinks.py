"""Sinks: findings as text, JSON or Parquet, self-contained HTML, Lean files, upserted review state, exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import html_escape
from scholia.operators.evaluation import severity_rank

SEVERITIES = ("info", "warning", "error")


def finding_lines(findings: DataFrame) -> DataFrame:
    """``file:line: rule severity subject`` by file, line, rule and title."""
    line = F.format_string("%s:%d: %s %s %s", "file", "line", "rule", "severity", "subject")
    return findings.orderBy("project_id", "file", "line", "rule", "title", "subject").select(line.alias("value"))


def write_findings(findings: DataFrame, path: str, form: str = "json") -> None:
    if form == "text":
        finding_lines(findings).write.text(path)
    else:
        findings.write.format(form).save(path)


def project_pages(findings: DataFrame, results: DataFrame) -> DataFrame:
    """One HTML document for each project, with its results and findings; all text is escaped."""
    rows = findings.groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "rule", F.concat(F.lit("<li>"), "rule", F.lit(" "), html_escape(F.col("subject")), F.lit("</li>")).alias("html")))).alias("f")
    )
    named = results.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("ord", "s", F.concat(F.lit("<li>"), html_escape(F.col("identifier")), F.lit("</li>")).alias("html")))).alias("r"))
    joined = named.join(rows, "project_id", "left")
    body = F.concat(
        F.lit("<!DOCTYPE html><meta charset=utf-8><title>Project "), F.col("project_id"), F.lit("</title><h1>Results</h1><ul>"),
        F.array_join(F.transform("r", lambda x: x["html"]), ""), F.lit("</ul><h1>Findings</h1><ul>"),
        F.coalesce(F.array_join(F.transform("f", lambda x: x["html"]), ""), F.lit("")), F.lit("</ul>"),
    )
    return joined.select("project_id", body.alias("html"))


def overview_edges(manuscript) -> DataFrame:
    """Argument graph of results: (project_id, source, target, status, sources) from what is used to what uses it, with the strongest status and how many references say so."""
    m = manuscript
    labels = m.results.select("project_id", F.col("identifier").alias("label"), "node").groupBy("project_id", "label").agg(F.max("node").alias("from"))
    rank = F.when(F.col("status") == "confident", 2).when(F.col("status") == "ambiguous", 1).otherwise(0)
    used = m.support.where("kind = 'result_reference'").select("project_id", F.col("source").alias("label"), F.col("node").alias("target"), "status", rank.alias("rank"))
    found = used.join(labels, ["project_id", "label"])
    return found.groupBy("project_id", F.col("from").alias("source"), "target").agg(F.max_by("status", "rank").alias("status"), F.count(F.lit(1)).alias("sources"))


def graph_data(manuscript) -> DataFrame:
    """One JSON document a project: results, overview edges, and each proof's claims and support."""
    m = manuscript
    listed = lambda frame, name, *columns: frame.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    results = listed(m.results.select("project_id", F.col("node").alias("order"), F.col("identifier").alias("id"), F.col("env").alias("kind"), "title", "statement", "file", F.col("sl").alias("line"), F.col("proof").isNotNull().alias("hasProof")), "results", "order", "id", "kind", "title", "statement", "file", "line", "hasProof")
    edges = listed(overview_edges(m), "overviewEdges", "source", "target", "status", "sources")
    claims = listed(m.claims, "claims", "node", "idx", "form", "claim")
    support = listed(m.support, "support", "node", "idx", "edge", "kind", "source", "status")
    held = results.join(edges, "project_id", "left").join(claims, "project_id", "left").join(support, "project_id", "left")
    return held.select("project_id", F.to_json(F.struct("results", "overviewEdges", "claims", "support")).alias("data"))


def graph_pages(manuscript) -> DataFrame:
    """One self-contained HTML document a project that draws its argument graph; the JSON inside can't end the script it stands in."""
    safe = F.col("data")
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        safe = F.replace(safe, F.lit(sign), F.lit(code))
    return graph_data(manuscript).select("project_id", F.concat(F.lit(_GRAPH[0]), safe, F.lit(_GRAPH[1])).alias("html"))


_GRAPH = (
    "<!DOCTYPE html><meta charset=utf-8><title>Argument graph</title><style>body{font:14px sans-serif}li{margin:.3em}small{color:#666}</style><h1>Results</h1><ol id=r></ol><script type=application/json id=d>",
    """</script><script>
const d = JSON.parse(document.getElementById('d').textContent), list = document.getElementById('r');
for (const r of d.results) {
  const item = document.createElement('li'), name = document.createElement('b'), more = document.createElement('small');
  name.textContent = r.kind + ' ' + r.id; item.id = 'n' + r.order;
  const used = (d.overviewEdges || []).filter(e => e.target === r.order).map(e => d.results[e.source].id + (e.status === 'confident' ? '' : ' (' + e.status + ')'));
  more.textContent = ' ' + r.file + ':' + r.line + (used.length ? ' uses ' + used.join(', ') : '') + (r.hasProof ? '' : ' without proof');
  item.append(name, more);
  const steps = document.createElement('ul');
  for (const c of (d.claims || []).filter(c => c.node === r.order)) { const s = document.createElement('li'); s.textContent = c.claim; steps.append(s); }
  item.append(steps); list.append(item);
}
</script>
""",
)


def write_pages(pages: DataFrame, path: str) -> None:
    """One text row a project, under a folder for each project."""
    pages.select("project_id", F.col("html").alias("value")).write.partitionBy("project_id").mode("overwrite").text(path)


def write_lean(statements: DataFrame, path: str) -> None:
    """A text part file set with the statements that have a form, one a line."""
    statements.where("lean is not null").orderBy("project_id", "ord").select(F.col("lean").alias("value")).write.text(path)


def write_lean_files(exports: DataFrame, path: str) -> None:
    """The exports that have a text, in a folder for each result."""
    exports.where("lean is not null").select("project_id", "node", F.col("lean").alias("value")).write.partitionBy("project_id", "node").mode("overwrite").text(path)


def report_pages(manuscript) -> DataFrame:
    """One HTML document a project: its counts, results with their state, findings by place with evidence, and open obligations; all text is escaped."""
    from scholia.operators.proofs import report_counts
    from scholia.operators.review import open_obligations

    m = manuscript

    def items(frame: DataFrame, name: str, order: list[str], html) -> DataFrame:
        rows = frame.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.concat(F.lit("<li>"), html, F.lit("</li>")).alias("html")))).alias(name))
        return rows.select("project_id", F.array_join(F.transform(name, lambda x: x["html"]), "").alias(name))

    findings = m.findings()
    bad = findings.select("project_id", F.col("unit").alias("identifier")).distinct().withColumn("state", F.lit("attention"))
    results = m.results.join(bad, ["project_id", "identifier"], "left")
    told = items(results, "results", ["node"], F.concat(html_escape(F.concat_ws(" ", "env", "identifier")), F.lit(": "), F.coalesce("state", F.lit("no finding")), F.when(F.col("proof").isNull(), ", no proof").otherwise("")))
    found = items(findings, "findings", ["file", "line", "rule", "title", "subject"], F.concat("rule", F.lit(" "), "severity", F.lit(" "), html_escape(F.concat_ws(":", "file", "line")), F.lit(" "), html_escape(F.concat_ws(" ", "title", "subject")), F.lit("<ul>"), F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("<li>"), html_escape(e), F.lit("</li>"))), ""), F.lit("</ul>")))
    left = items(open_obligations(m).withColumn("text", F.coalesce("expected", F.lit(""))), "obligations", ["node", "address", "kind"], html_escape(F.concat_ws(" ", "address", "kind", "text")))
    held = told.join(report_counts(m).drop("findings").withColumnRenamed("results", "n"), "project_id").join(found, "project_id", "left").join(left, "project_id", "left")
    summary = F.format_string("%d results, %d need attention, %d clean, %d open obligations", "n", "attention", "clean", "open_obligations")
    section = lambda title, name: F.concat(F.lit(f"<h2>{title}</h2><ul>"), F.coalesce(name, F.lit("")), F.lit("</ul>"))
    html = F.concat(F.lit("<!DOCTYPE html><meta charset=utf-8><title>Report</title><h1>Project "), "project_id", F.lit("</h1><p>"), summary, F.lit("</p>"), section("Results", "results"), section("Findings", "findings"), section("Open obligations", "obligations"))
    return held.select("project_id", html.alias("html"))


def upsert(state: DataFrame | None, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key in the state and the new rows."""
    every = new if state is None else state.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    latest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return latest.select(*keys, "row.*").select(*every.columns)


def exit_code(findings: DataFrame, fail_on: str = "error") -> int:
    """1 if the worst finding is as severe as ``fail_on``, else 0; ``never`` is always 0."""
    if fail_on == "never":
        return 0
    worst = findings.agg(F.max(severity_rank(F.col("severity")))).first()[0]
    return int(worst is not None and worst >= SEVERITIES.index(fail_on))
