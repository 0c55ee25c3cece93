"""``python -m scholia FOLDER``: findings of the LaTeX projects in a folder tree."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from scholia.operators.structure import Manuscript
from scholia.sources.frontends import DEFAULT, get_scanner
from scholia.sources.manuscripts import read_manuscripts
from scholia.sources.sinks import exit_code, finding_lines, graph_pages, report_pages, write_findings, write_pages


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scholia", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--limit", type=int, help="print at most so many findings")
    parser.add_argument("--out", help="write the findings here instead")
    parser.add_argument("--format", choices=("text", "json", "parquet"), default="text")
    parser.add_argument("--fail-on", choices=("info", "warning", "error", "never"), default="error")
    parser.add_argument("--main", default="main", help="name of a project's main file, without suffix")
    parser.add_argument("--frontend", default=DEFAULT, help="scanner of the sources")
    parser.add_argument("--graph", help="write a page with each project's argument graph here")
    parser.add_argument("--report", help="write a page with each project's results and findings here")
    parser.add_argument("--partitions", type=int, default=4, help="shuffle partitions; a folder on one machine is small")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("scholia").config("spark.sql.shuffle.partitions", args.partitions).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    manuscripts = Manuscript(read_manuscripts(spark, args.folder, main=args.main), get_scanner(args.frontend))
    findings = manuscripts.keep(manuscripts.findings(), "findings")
    if args.out:
        write_findings(findings, args.out, args.format)
    else:
        lines = finding_lines(findings)
        for row in (lines.limit(args.limit) if args.limit else lines).toLocalIterator():
            print(row.value)
    if args.graph:
        write_pages(graph_pages(manuscripts), args.graph)
    if args.report:
        write_pages(report_pages(manuscripts), args.report)
    code = exit_code(findings, args.fail_on)
    manuscripts.release()
    return code


if __name__ == "__main__":
    sys.exit(main())
