"""Manuscript sources: LaTeX files on any store, and a deterministic projection of ``documents``.

Every source gives the same columns: project_id, ord (the file's number in its
project; 0 is the main file), file, raw.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ["project_id", "ord", "file", "raw"]

#: Documents of a project.
PROJECT = 20

#: The projection, in SQL that Spark and DuckDB both read. Whole texts are kept.
_ENV = "case doc_id % 6 when 0 then 'theorem' when 1 then 'lemma' when 2 then 'proposition' when 3 then 'corollary' when 4 then 'claim' else 'remark' end"


def _s(x: str) -> str:
    return f"cast({x} as varchar(20))"


def _tex(text: str) -> str:
    """SQL for LaTeX text: a backslash and a line feed are spelled by ``chr``, which both engines read; ``<<x>>`` is the number x."""
    out = []
    for i, part in enumerate(text.replace("<<", "\0").replace(">>", "\0").split("\0")):
        if i % 2:
            out.append(_s(part))
            continue
        for j, piece in enumerate(part.replace("\n", "\0n\0").replace("\\", "\0b\0").split("\0")):
            if j % 2:
                out.append("chr(10)" if piece == "n" else "chr(92)")
            elif piece:
                out.append(f"'{piece}'")
    return " || ".join(out)


#: Parts of a manuscript in order: (condition, text). Conditions are of doc_id, ord and project_id.
TEMPLATE: tuple[tuple[str, str], ...] = (
    ("ord = 0", "\\documentclass{article}\n"),
    ("ord = 0 and project_id % 2 = 0", "\\newtheorem{remark}{Remark}\n"),
    ("ord = 0 and project_id % 5 = 0", "\\newcommand{\\later}{\\input{sections/s2}}\n"),
    ("ord = 0", "\\begin{document}\n"),
    ("ord % 4 = 1", "\\section{Part <<doc_id>> \\label{sec:<<doc_id>>}}\n"),
    ("doc_id % 9 = 4", "% a note with \\label{r:hidden} and \\input{nowhere}\n"),
    ("doc_id % 8 = 6", "\\begin{verbatim}\\ref{r:none} \\input{ghost}\\end{verbatim}\n"),
    ("doc_id % 3 = 2", "Put $K_{<<doc_id>>} := <<doc_id % 7>>$ and \\foo{a}{\\emph{b}}.\n"),
    # the first result
    ("true", "\\begin{@env@}[Title <<doc_id>>]"),
    ("doc_id % 17 <> 9", "\\label{r:<<lab>>}\n"),
    ("doc_id % 2 = 0", "Let $x > 0$ be fixed. "),
    ("doc_id % 2 = 1", "Let $x \\colon A \\to B$ be a map. "),
    ("doc_id % 10 = 4", "Let $x \\colon U \\to V$ be a map. "),
    ("true", "@prose@\n"),
    ("doc_id % 5 = 2", "\\begin{equation}\\label{eq:<<doc_id>>}x = y\\end{equation}\n"),
    ("true", "\\end{@env@}\n"),
    ("doc_id % 11 = 7", "@gap@"),
    ("true", "\\begin{proof}\nBy Lemma \\cref{r:<<t1>>"),
    ("doc_id % 4 = 0", ", r:<<t2>>"),
    ("true", "}, $A_{<<doc_id % 5>>}$ holds."),
    ("doc_id % 3 = 0", " By the definition, $B$ holds."),
    ("doc_id % 4 = 1", " By compactness, $C$."),
    ("doc_id % 7 = 1", " Since $u > v$, $w$ holds."),
    ("doc_id % 9 = 2", " % Thus $hidden$ holds.\n"),
    ("doc_id % 2 = 0", " Therefore $D_{<<doc_id % 3>>}$."),
    ("doc_id % 5 = 2", " We apply \\eqref{eq:<<doc_id>>}."),
    ("doc_id % 14 = 3", " See \\ref{q:<<doc_id>>}."),
    ("doc_id % 25 = 6", " Compare \\autoref{r:<<lab>>}."),
    ("doc_id % 4 = 2", " Here $K_{<<key>>} > 0$."),
    ("true", " Hence $A_{<<doc_id % 5>>} \\Rightarrow D_{<<doc_id % 3>>}$.\n"),
    ("doc_id % 6 = 1", "\\[ E_{<<doc_id % 4>>} = F \\]\nfor all $t$ in $T$.\n"),
    ("true", "\\end{proof}\n"),
    ("doc_id % 3 = 1", "\\begin{figure}\\caption{Shows % \\ref{r:ghost}\n\\cref{r:<<lab>>} \\label{fig:<<doc_id>>}}\\end{figure}\n"),
    ("3 * ord + 1 < @size@", "\\input{@sub@s<<3 * ord + 1>>}\n"),
    # the second result stands between includes, so project order isn't file order
    ("doc_id % 2 = 1", "\\begin{lemma}\\label{q:<<doc_id>>}\nFor every $\\varepsilon > 0$ define $g(t) = t$. Let $y \\in Y$ be given. Then $\\varepsilon < y$.\n\\end{lemma}\n\\begin{proof}\nUsing \\ref{r:<<lab>>} and \\autoref{fig:<<doc_id>>}, $Q_{<<doc_id % 4>>}$ holds."),
    ("doc_id % 6 = 3", " Assume $p$. We claim that $p \\Rightarrow s$. Thus $s$."),
    ("doc_id % 6 = 5", " By stability under limits, $R$ holds. From old habits, $S$ holds."),
    ("doc_id % 12 = 9", " Either $h \\lor k$ holds. Here $h \\Rightarrow n$. There $k \\Rightarrow n$. Not so if $\\neg e$. Yet $e$."),
    ("doc_id % 12 = 1", " Either $h \\lor k$ holds. Here $h \\Rightarrow n$. First comes $P(0)$. We claim that $p$. So $p$."),
    ("doc_id % 2 = 1", " Thus $Q_{<<doc_id % 4>>}$.\n\\end{proof}\n"),
    # the third has a statement alone, which refers to the second of another file
    ("doc_id % 4 = 3", "\\begin{corollary}\nIf $a$, then $b$.\n\\end{corollary}\n\\begin{corollary}\\label{c:<<doc_id>>}\nIt follows from \\ref{q:<<t3>>} that $\\forall z \\in Z, z > b$.\n\\end{corollary}\n"),
    ("3 * ord + 2 < @size@", "\\input{@sub@s<<3 * ord + 2>>}\n"),
    ("3 * ord + 3 < @size@", "\\input{@sub@s<<3 * ord + 3>>.tex}\n"),
    ("ord = 4 and project_id % 4 = 1", "\\input{s99}\n"),
    ("ord = 4 and project_id % 4 = 2", "\\input{../main}\n"),
    ("ord = 6 and project_id % 4 = 3", "\\input{s19}\n"),
    ("ord = 0", "\\end{document}\nBehind \\ref{r:never} the end.\n"),
)


def projection_sql(table: str = "documents") -> str:
    """A subquery with project_id, ord, file, doc_id and the raw text of each manuscript.

    A project is a main file and up to 19 in a subfolder, a tree of includes.
    Labels repeat (doc_id % 13 = 5), are missing (doc_id % 17 = 9) or stand in
    captions, sections and equations; targets miss, proofs stand too far
    (doc_id % 11 = 7), files are missing, cyclic or included twice by project, and
    comments, literal text and what stands outside the document holds decoys, so
    that every outcome of the operators occurs.
    """
    marks = {"@env@": "' || env || '", "@prose@": "' || prose || '", "@gap@": "' || repeat(chr(10), 45) || '", "@sub@": "' || sub || '", "@size@": str(PROJECT)}
    parts = []
    for condition, text in TEMPLATE:
        part = _tex(text)
        for mark, value in marks.items():
            part, condition = part.replace(mark, value), condition.replace(mark, value)
        parts.append(f"({part})" if condition == "true" else f"case when {condition} then {part} else '' end")
    raw = "\n  || ".join(parts)
    return f"""
select project_id, ord, file, doc_id,
  {raw} as raw
from (
  select doc_id, cast(floor(doc_id / {PROJECT}.0) as bigint) as project_id, cast(doc_id % {PROJECT} as int) as ord,
    case when doc_id % {PROJECT} = 0 then 'main' else 'sections/s' || {_s(f"doc_id % {PROJECT}")} end as file,
    case when doc_id % {PROJECT} = 0 then 'sections/' else '' end as sub,
    {_ENV} as env,
    case when doc_id % 13 = 5 and doc_id % {PROJECT} > 0 then doc_id - 1 else doc_id end as lab,
    cast(floor(doc_id / {PROJECT}.0) as bigint) * {PROJECT} + (doc_id * 7 + 3) % 23 as t1,
    cast(floor(doc_id / {PROJECT}.0) as bigint) * {PROJECT} + (doc_id * 3 + 1) % {PROJECT} as t2,
    cast(floor(doc_id / {PROJECT}.0) as bigint) * {PROJECT} + (doc_id * 4 + 1) % {PROJECT} as t3,
    cast(floor(doc_id / {PROJECT}.0) as bigint) * {PROJECT} + 2 + 3 * (doc_id % 3) as key,
    translate(coalesce(text, ''), '$%#&{{}}_^~' || chr(92), '') as prose
  from {table} where doc_id is not null and doc_id >= 0
) projected"""


def projected_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manuscripts that ``documents`` are projected to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    name = f"scholia_documents_{uuid.uuid4().hex}"
    docs.createOrReplaceTempView(name)
    out = spark.sql(projection_sql(name)).select(*COLUMNS)
    spark.catalog.dropTempView(name)
    return out


def read_manuscripts(spark: SparkSession, path: str, pattern: str = "*.tex", *, main: str = "main") -> DataFrame:
    """LaTeX files of a folder tree, named by their path in the project without the suffix.

    A project is the topmost folder that holds a file called ``main``, with all
    folders under it; a folder outside all such is a project of its own, whose
    first name is its main file. Undecodable bytes become replacement
    characters; a missing folder raises.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    raw = raw.select("path", F.decode("content", "UTF-8").alias("raw"))
    raw = raw.unionByName(_empty_files(raw).withColumn("raw", F.lit("")))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    files = raw.select("path", stem.alias("stem"), folder.alias("folder"))
    roots = files.where(F.substring_index("stem", "/", -1) == main).select(F.col("folder").alias("above")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    top = files.select("path", F.explode(above).alias("above")).join(roots, "above").groupBy("path").agg(F.min_by("above", F.length("above")).alias("top"))
    # paths alone are joined; contents are read beside them
    named = files.join(top, "path", "left").withColumn("root", F.coalesce("top", "folder"))
    named = named.select("path", F.xxhash64("root").alias("project_id"), F.substr("stem", F.length("root") + 2).alias("file"))
    first = Window.partitionBy("project_id").orderBy(F.when(F.col("file") == main, 0).otherwise(1), "file")
    named = named.withColumn("ord", F.row_number().over(first) - 1)
    return raw.join(named, "path").select(*COLUMNS)


def _empty_files(read: DataFrame) -> DataFrame:
    """Paths that Spark has listed for ``read`` but that give no row, as they hold no byte. Names are fetched only where some are missing."""
    spark = read.sparkSession
    listed = read._jdf.inputFiles()
    if len(listed) == read.select("path").count():
        return spark.createDataFrame([], "path string")
    plain = [re.sub("^file:/+", "file:/", unquote(name)) for name in listed]
    return spark.createDataFrame([(name,) for name in plain], "path string").join(read.select("path"), "path", "left_anti")
