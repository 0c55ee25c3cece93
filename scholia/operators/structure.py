"""Results, proofs, the include workspace, references, the dependency graph and deterministic findings.

A result is known by its node, its number in project order: identifiers can
repeat. Frames are keyed by project_id; ord is the file and s the offset in it.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions.scan import scan_manuscripts
from scholia.operators.support import claims, support_edges
from scholia.plans.fixpoint import cyclic_components, reachable_pairs, shortest_paths
from scholia.sources.store import forget, written

#: Result environments and reference macros.
RESULT_ENVIRONMENTS = ("theorem", "lemma", "proposition", "corollary", "claim")
REFERENCES = ("ref", "eqref", "autoref", "cref", "Cref")
#: Titles of the findings by rule.
TITLES = {"TH101": "Duplicate theorem/result label", "TH102": "Ambiguous theorem/result reference", "TH103": "Missing internal reference", "TH104": "Circular theorem/result dependency", "TH113": "Conflicting symbol roles"}
FILE = ["project_id", "ord"]
FINDING = ["project_id", "rule", "severity", "ord", "file", "line", "unit", "title", "subject", "evidence"]


def inside(inner_s: Column, inner_e: Column, outer_s: Column, outer_e: Column) -> Column:
    """Half-open span containment."""
    return (outer_s <= inner_s) & (inner_e <= outer_e)


def overlap(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    return (a_s < b_e) & (b_s < a_e)


class Manuscript:
    """The relational facts of scanned manuscripts; each frame is declared once.

    The scan, the results and what else many frames read is written to the shared
    folder when first asked for, and read from there until ``release``: plans stay
    small, and a lost executor costs a part of one frame. Files that the main file
    doesn't reach by includes are no part of a project.
    """

    def __init__(self, files: DataFrame, scanner: Callable[[DataFrame], DataFrame] = scan_manuscripts) -> None:
        self.files = files
        self.scanner = scanner
        self._kept: dict[str, str] = {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        held, self._kept[name] = written(frame, name)
        return held

    def release(self) -> None:
        """Delete the written frames; they are made anew if asked for again."""
        for name, path in self._kept.items():
            forget(self.files.sparkSession, path)
            self.__dict__.pop(name, None)
        self._kept.clear()

    @cached_property
    def facts(self) -> DataFrame:
        return self.keep(self.scanner(self.files), "facts")

    @cached_property
    def environments(self) -> DataFrame:
        return self.facts.where("kind = 'env'")

    @cached_property
    def macros(self) -> DataFrame:
        return self.facts.where("kind = 'macro'")

    @cached_property
    def labels(self) -> DataFrame:
        return self.macros.where("name = 'label' and arg is not null").select(*FILE, F.col("arg").alias("label"), F.col("s").alias("label_s"), F.col("e").alias("label_e"))

    @cached_property
    def declared(self) -> DataFrame:
        """Environment names that a project declares as results."""
        own = self.macros.where("name = 'newtheorem' and arg is not null").join(self.order.select(*FILE), FILE)
        return own.select("project_id", F.col("arg").alias("name"), F.lit(True).alias("own")).distinct()

    @cached_property
    def results(self) -> DataFrame:
        """Result environments in project order, with title, first label, identifier (label, else file place) and nearest proof.

        ``place`` is the way to a result: the offsets of the includes that first
        lead to its file, then its own.
        """
        known = self.environments.join(self.declared, ["project_id", "name"], "left")
        known = known.where(F.col("name").isin(*RESULT_ENVIRONMENTS) | F.col("own")).join(self.order.select(*FILE, "file", "way"), FILE)
        after = Window.partitionBy(*FILE).orderBy("s")
        known = known.select(*FILE, "file", F.col("name").alias("env"), F.col("option").alias("title"), "s", "e", "bs", "be", "sl", "el", F.col("text").alias("statement"), "label", "proof_s", "proof_line", "proof_bs", "proof_be", "proof", F.lead("s").over(after).alias("next_s"), F.concat("way", F.array("s")).alias("place"))
        nearest = F.col("next_s").isNull() | (F.col("proof_s") < F.col("next_s"))
        known = known.withColumns({c: F.when(nearest, F.col(c)) for c in ("proof_line", "proof_bs", "proof_be", "proof")}).drop("proof_s")
        named = F.concat_ws(":", "file", "sl", "env")
        number = F.row_number().over(Window.partitionBy("project_id").orderBy("place")) - 1
        return self.keep(known.withColumns({"identifier": F.coalesce("label", named), "node": number.cast("int")}), "results")

    def placed(self, frame: DataFrame) -> DataFrame:
        """Rows of ``frame`` (with s and e) that lie in a result's statement or proof, with its node, result_s and context.

        Each row meets the last result that starts before it (as-of, one sort of
        a file's rows); results around other results are joined by containment.
        """
        spans = self.results.select(*FILE, "node", F.col("s").alias("result_s"), "bs", "be", "proof_bs", "proof_be", F.coalesce(F.col("next_s") < F.col("be"), F.lit(False)).alias("outer"))
        rest = [c for c in frame.columns if c not in FILE]
        marks = spans.select(*FILE, F.col("result_s").alias("at"), F.lit(0).alias("rank"), F.struct(*[c for c in spans.columns if c not in FILE]).alias("own"))
        rows = frame.select(*FILE, F.col("s").alias("at"), F.lit(1).alias("rank"), F.struct(*rest).alias("row"))
        before = Window.partitionBy(*FILE).orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
        met = marks.unionByName(rows, allowMissingColumns=True).withColumn("own", F.last("own", ignorenulls=True).over(before))
        met = met.where("row is not null and not own.outer").select(*FILE, "row", "own")
        around = rows.select(*FILE, "row").join(spans.where("outer").select(*FILE, F.struct(*[c for c in spans.columns if c not in FILE]).alias("own")), FILE)
        found = met.unionByName(around)
        s, e, own = F.col("row.s"), F.col("row.e"), F.col("own")
        context = F.when(inside(s, e, own["bs"], own["be"]), "statement").when(inside(s, e, own["proof_bs"], own["proof_be"]), "proof")
        return found.withColumn("context", context).where("context is not null").select(*FILE, "own.node", "own.result_s", "context", *[F.col("row")[c].alias(c) for c in rest])

    # the include workspace

    @cached_property
    def includes(self) -> DataFrame:
        """Include sites that are executed: not in another macro's argument. Target is null where no complete one is given."""
        sites = self.macros.where("name in ('input', 'include') and not nested")
        return sites.select(*FILE, F.col("s").alias("at"), F.col("arg").alias("target"))

    @cached_property
    def workspace(self) -> DataFrame:
        """Expansion of each project from its main file, in depth-first order.

        Rows are occurrences (kind ``file``: number, ord, its way) and includes
        that aren't expanded: ``missing``, ``cycle``, ``unresolved`` (the target
        needs TeX to expand it) or ``malformed`` (no complete target). Targets
        are relative to the including file. A file has as many occurrences as
        there are ways to it, so a project whose includes fork and join often has
        very many; one project is expanded in one task.
        """

        def expand(rows: pd.DataFrame) -> pd.DataFrame:
            project = int(rows["project_id"].iloc[0])
            named = rows[rows["file"].notna()]
            files = dict(zip(named["ord"].astype(int), named["file"]))
            numbers = {posixpath.normpath(name): o for o, name in sorted(files.items(), reverse=True)}
            sites: dict[int, list] = {}
            listed = rows[rows["at"].notna()]
            for ord_, at, target in sorted(zip(listed["ord"].astype(int), listed["at"].astype(int), listed["target"]), key=lambda r: r[:2]):
                sites.setdefault(ord_, []).append((at, target))

            def resolve(ord_: int, target: str | None) -> tuple[str, int | None]:
                if target is None or not target.strip():
                    return "malformed", None
                if "\\" in target or "#" in target:
                    return "unresolved", None
                path = posixpath.normpath(posixpath.join(posixpath.dirname(files[ord_]), target.strip().removesuffix(".tex")))
                return ("file", numbers[path]) if path in numbers else ("missing", None)

            out: list[tuple] = []
            number = 0
            todo: list[tuple] = [("file", 0, None, None, None, (), ())] if 0 in files else []
            while todo:
                kind, ord_, parent, at, target, active, way = todo.pop()
                if kind == "file" and ord_ in active:
                    kind = "cycle"
                if kind != "file":
                    out.append((project, kind, None, None, None, parent, at, target, None))
                    continue
                out.append((project, "file", number, ord_, files[ord_], parent, at, target, list(way)))
                number += 1
                for site, name in reversed(sites.get(ord_, [])):
                    found, child = resolve(ord_, name)
                    todo.append((found, child, ord_, site, name, (*active, ord_), (*way, site)))
            columns = ["project_id", "kind", "occurrence", "ord", "file", "parent", "at", "target", "way"]
            return pd.DataFrame(out, columns=columns).astype({"occurrence": "Int64", "ord": "Int64", "parent": "Int64", "at": "Int64"})

        files = self.files.select(*FILE, "file", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("target"))
        rows = files.unionByName(self.includes.select(*FILE, F.lit(None).cast("string").alias("file"), "at", "target"))
        schema = "project_id long, kind string, occurrence int, ord int, file string, parent int, at int, target string, way array<int>"
        return self.keep(rows.groupBy("project_id").applyInPandas(expand, schema), "workspace")

    @cached_property
    def order(self) -> DataFrame:
        """Each reachable file's earliest occurrence, the way to it, and its number of occurrences."""
        first = F.min_by(F.struct("file", "way"), "occurrence")
        found = self.workspace.where("kind = 'file'").groupBy(*FILE).agg(first.alias("first"), F.min("occurrence").alias("position"), F.count(F.lit(1)).alias("occurrences"))
        return found.select(*FILE, "first.file", "first.way", "position", "occurrences")

    @cached_property
    def status(self) -> DataFrame:
        """Per project: resolved, partial (an include isn't expanded) or source_error (environments or a target aren't complete)."""
        odd = self.workspace.groupBy("project_id").agg(F.bool_or(F.col("kind") != "file").alias("partial"), F.bool_or(F.col("kind") == "malformed").alias("malformed"))
        bad = self.facts.where("kind = 'defect' and name in ('unclosed', 'unopened')").join(self.order.select(*FILE), FILE)
        bad = bad.select("project_id", F.lit(True).alias("bad")).distinct()
        state = F.when(F.col("bad") | F.col("malformed"), "source_error").when(F.col("partial"), "partial").otherwise("resolved")
        return odd.join(bad, "project_id", "left").select("project_id", state.alias("workspace"))

    # proofs

    @cached_property
    def claims(self) -> DataFrame:
        return self.keep(claims(self), "claims")

    @cached_property
    def support(self) -> DataFrame:
        return self.keep(support_edges(self), "support")

    # references and the graph of results

    @cached_property
    def references(self) -> DataFrame:
        """One row for each label that a result's statement or proof refers to, in source order."""
        macros = self.macros.where(F.col("name").isin(*REFERENCES)).where("arg is not null").select(*FILE, "s", "e", "sl", "arg")
        items = self.placed(macros).select(*FILE, "node", "result_s", "context", F.col("s").alias("ref_s"), F.col("sl").alias("ref_line"), F.posexplode(F.split("arg", ",")).alias("item", "label"))
        return items.withColumn("label", F.trim("label")).where("label <> ''")

    @cached_property
    def edges(self) -> DataFrame:
        return self.keep(self._edges(), "edges")

    def _edges(self) -> DataFrame:
        """Dependency edges: resolved to the one result of that label if all occurrences agree, ambiguous, or missing.

        A reference to a label that is known but marks no result gives no edge.
        Every occurrence of a reference leads to the same place exactly if the
        label stands once in the whole expansion, which a workspace that isn't
        resolved can't show.
        """
        owners = self.results.where("label is not null").groupBy("project_id", "label").agg(F.count(F.lit(1)).alias("owners"), F.min("node").alias("target"))
        known = self.labels.join(self.order, FILE).groupBy("project_id", "label").agg(F.sum("occurrences").alias("known"))
        found = self.references.join(owners, ["project_id", "label"], "left").join(known, ["project_id", "label"], "left").join(self.status, "project_id", "left")
        sure = (F.col("owners") == 1) & (F.col("known") == 1) & (F.col("workspace") == "resolved")
        outcome = F.when(F.col("owners").isNull(), F.when(F.col("known").isNull(), "missing")).when(sure, "resolved").otherwise("ambiguous")
        found = found.withColumn("resolution", outcome).where("resolution is not null")
        return found.select(*FILE, "node", "result_s", "context", "ref_s", "ref_line", "item", "label", "resolution", F.when(F.col("resolution") == "resolved", F.col("target")).alias("target"))

    @cached_property
    def resolved_pairs(self) -> DataFrame:
        """Distinct direct dependencies (source, target) of results."""
        return self.edges.where("resolution = 'resolved'").select("project_id", F.col("node").alias("source"), "target").distinct()

    def reverse(self) -> DataFrame:
        """(source, dependent): the results that a result is used by."""
        return self.resolved_pairs.select("project_id", F.col("target").alias("source"), F.col("source").alias("dependent"))

    def transitive(self) -> DataFrame:
        return reachable_pairs(self.resolved_pairs)

    def paths(self) -> DataFrame:
        """A shortest path of nodes from each result to each that it depends on; of several the least in project order."""
        return shortest_paths(self.resolved_pairs)

    def cycles(self) -> DataFrame:
        """Cyclic components with their members in project order."""
        return cyclic_components(self.resolved_pairs)

    def dependency_context(self) -> DataFrame:
        """For each result the statements that it refers to directly, as ``[env identifier] statement (file:line-line)``."""
        line = F.concat(F.lit("["), "env", F.lit(" "), "identifier", F.lit("] "), F.trim(F.regexp_replace("statement", r"(?U)\s+", " ")), F.lit(" ("), "file", F.lit(":"), "sl", F.lit("-"), "el", F.lit(")"))
        held = self.results.select("project_id", F.col("node").alias("target"), line.alias("line"))
        lines = self.resolved_pairs.join(held, ["project_id", "target"]).groupBy("project_id", F.col("source").alias("node")).agg(F.sort_array(F.collect_list(F.struct("target", "line"))).alias("lines"))
        return lines.select("project_id", "node", F.transform("lines", lambda x: x["line"]).alias("context"))

    # findings

    def _finding(self, frame: DataFrame, rule: str, severity: str = "error") -> DataFrame:
        """Rows with node, line, subject and evidence as findings of a rule."""
        place = self.results.select("project_id", "node", "ord", "file", F.col("identifier").alias("unit"))
        held = frame.join(place, ["project_id", "node"])
        return held.withColumns({"rule": F.lit(rule), "severity": F.lit(severity), "title": F.lit(TITLES[rule])}).select(*FINDING)

    def duplicate_labels(self) -> DataFrame:
        """TH101: a label on two results or more; the second in project order is the anchor and all places are evidence."""
        where = F.concat(F.lit("label "), "label", F.lit(" occurs at "), "file", F.lit(":"), "sl", F.lit("-"), "el")
        placed = self.results.where("label is not null").select("project_id", "label", F.struct("node", F.col("sl").alias("line"), where.alias("where")).alias("member"))
        grouped = placed.groupBy("project_id", "label").agg(F.sort_array(F.collect_list("member")).alias("members")).where(F.size("members") >= 2)
        second = F.col("members")[1]
        return self._finding(grouped.select("project_id", second["node"].alias("node"), second["line"].alias("line"), F.col("label").alias("subject"), F.transform("members", lambda x: x["where"]).alias("evidence")), "TH101")

    def reference_findings(self, resolution: str, rule: str) -> DataFrame:
        """TH102 or TH103: one for each reference that isn't resolved."""
        found = self.edges.where(F.col("resolution") == resolution)
        evidence = F.array(F.concat(F.lit("target label: "), "label"))
        return self._finding(found.select("project_id", "node", F.col("ref_line").alias("line"), F.col("label").alias("subject"), evidence.alias("evidence")), rule)

    def cycle_findings(self) -> DataFrame:
        """TH104: one for each cyclic component, as ``a -> b -> a`` by identifiers in project order."""
        named = self.results.select("project_id", "node", "identifier", F.col("sl").alias("line"))
        members = self.cycles().select("project_id", F.col("members")[0].alias("head"), F.explode("members").alias("node"))
        grouped = members.join(named, ["project_id", "node"]).groupBy("project_id", "head").agg(F.sort_array(F.collect_list(F.struct("node", "identifier", "line"))).alias("members"))
        path = F.concat(F.array_join(F.transform("members", lambda x: x["identifier"]), " -> "), F.lit(" -> "), F.col("members")[0]["identifier"])
        return self._finding(grouped.select("project_id", F.col("head").alias("node"), F.col("members")[0]["line"].alias("line"), path.alias("subject"), F.array(path).alias("evidence")), "TH104")

    def findings(self) -> DataFrame:
        """All deterministic findings of structure and symbols, with the columns FINDING."""
        from scholia.operators.symbols import role_conflicts

        frames = [self.duplicate_labels(), self.reference_findings("ambiguous", "TH102"), self.reference_findings("missing", "TH103"), self.cycle_findings(), role_conflicts(self)]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def faults(self) -> DataFrame:
        """(project_id, fault) of what must never be: nodes or occurrences that aren't numbered from 0 without gaps, and edges to no result."""
        nodes = self.results.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("distinct"), F.max("node").alias("last"))
        places = self.workspace.where("kind = 'file'").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("occurrence").alias("distinct"), F.max("occurrence").alias("last"))
        uneven = "n <> distinct or last <> n - 1"
        lost = self.edges.where("resolution = 'resolved'").join(self.results.select("project_id", F.col("node").alias("target")), ["project_id", "target"], "left_anti")
        named = lambda frame, fault: frame.select("project_id", F.lit(fault).alias("fault")).distinct()
        return named(nodes.where(uneven), "nodes").unionByName(named(places.where(uneven), "occurrences")).unionByName(named(lost, "edges"))

    # texts around a place

    def local_context(self, lines: int = 120) -> DataFrame:
        """For each result the ``lines`` lines before its first line (fewer at the start of a file)."""
        raw = self.files.select(*FILE, F.split("raw", "\n").alias("lines"))
        first = F.greatest(F.lit(1), F.col("sl") - lines)
        return self.results.select(*FILE, "node", "sl").join(raw, FILE).select(*FILE, "node", F.array_join(F.slice("lines", first, F.col("sl") - first), "\n").alias("context"))

    def excerpts(self, places: DataFrame, *, around: int = 1, most: int = 12) -> DataFrame:
        """``places`` (project_id, ord, sl, el) with the source lines there and ``around`` more on each side, at most ``most``."""
        raw = self.files.select(*FILE, F.split("raw", "\n").alias("lines"))
        first = F.greatest(F.lit(1), F.col("sl") - around)
        last = F.least(F.size("lines"), F.col("el") + around, first + most - 1)
        return places.join(raw, FILE).withColumn("excerpt", F.array_join(F.slice("lines", first, F.greatest(F.lit(0), last - first + 1)), "\n")).drop("lines")

    # regions

    def regions(self) -> DataFrame:
        """Spans that aren't prose: comments, literal environments, math, macros and what stands outside a ``document`` environment; touching ones are merged."""
        literal = self.environments.where("name in ('verbatim', 'lstlisting', 'minted', 'comment', 'equation')")
        size = self.files.select(*FILE, F.length("raw").alias("size"))
        document = self.environments.where("name = 'document'").join(size, FILE)
        outside = document.select(*FILE, F.inline(F.array(F.struct(F.lit(0).alias("s"), F.col("bs").alias("e")), F.struct(F.col("be").alias("s"), F.col("size").alias("e")))))
        spans = self.facts.where("kind in ('comment', 'math', 'macro')").select(*FILE, "s", "e").unionByName(literal.select(*FILE, "s", "e")).unionByName(outside)
        return merge_intervals(spans, FILE)

    def prose(self) -> DataFrame:
        """The complement of the regions in each file; none in a file whose environments aren't complete, as its regions aren't known."""
        bad = self.facts.where("kind = 'defect' and name in ('unclosed', 'unopened')").select(*FILE).distinct()
        size = self.files.select(*FILE, F.length("raw").alias("size")).join(bad, FILE, "left_anti")
        order = Window.partitionBy(*FILE).orderBy("s")
        regions = self.regions().join(bad, FILE, "left_anti")
        before = regions.select(*FILE, F.coalesce(F.lag("e").over(order), F.lit(0)).alias("a"), F.col("s").alias("b"))
        last = size.join(regions.groupBy(*FILE).agg(F.max("e").alias("a")), FILE, "left").select(*FILE, F.coalesce("a", F.lit(0)).alias("a"), F.col("size").alias("b"))
        return before.unionByName(last).where("a < b").select(*FILE, F.col("a").alias("s"), F.col("b").alias("e"))

    def document_text(self, frame: DataFrame) -> DataFrame:
        """Rows (with s) that stand in a file's ``document`` environment, or in a reachable file that has none."""
        document = self.environments.where("name = 'document'").groupBy(*FILE).agg(F.min("bs").alias("text_s"), F.max("be").alias("text_e"))
        held = frame.join(self.order.select(*FILE), FILE).join(document, FILE, "left")
        return held.where("text_s is null or text_s <= s and s < text_e").drop("text_s", "text_e")

    def eligible(self, spans: DataFrame) -> DataFrame:
        """The spans (project_id, ord, s, e) that lie wholly in prose."""
        held = self.prose().select(*FILE, F.col("s").alias("prose_s"), F.col("e").alias("prose_e"))
        return spans.join(held, FILE).where(inside(F.col("s"), F.col("e"), F.col("prose_s"), F.col("prose_e"))).drop("prose_s", "prose_e")


def merge_intervals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of half-open spans per key; touching spans become one and empty ones vanish (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("s < e").withColumn("fresh", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")
