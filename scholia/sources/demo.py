"""A small project in which every kind of finding, support and structure occurs, for pages and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = (
    ("main", r"""\documentclass{article}
\newtheorem{fact}{Fact}
\begin{document}
\section{Start \label{sec:start}}
Set $K = 3$. Write $a \sim b$ to mean $a = b$.
\input{parts/one}
\begin{theorem}[Main]\label{thm:main}
For every natural $n$, $Q(n)$.
\end{theorem}
\begin{proof}
By \ref{fact:rule}, $Q(n)$. Since $n > K$, $m > 0$. By stability under limits, $m = 1$.
We claim that $p$. Hence $p$.
\[ h = 1 \]
for every $k$ in range. See \ref{sec:start} and \ref{thm:lost}.
\end{proof}
\begin{lemma}\label{lem:twice} One. \end{lemma}
\begin{lemma}\label{lem:twice} Two, by \ref{lem:twice}. \end{lemma}
\end{document}
"""),
    ("parts/one", r"""\begin{fact}\label{fact:rule}
For every natural $n$, if $P(n)$ then $Q(n)$.
\end{fact}
\begin{proof}
By \ref{lem:back}, it holds.
\end{proof}
\begin{lemma}\label{lem:back}
Let $x > 0$ be small. Let $x \colon A \to B$ be a map.
\end{lemma}
\begin{proof}
Using \ref{fact:rule}, it holds.
\end{proof}
"""),
)


def demo_manuscripts(spark: SparkSession) -> DataFrame:
    """The project's files, as any source gives them."""
    return spark.createDataFrame([(0, i, name, raw) for i, (name, raw) in enumerate(FILES)], "project_id long, ord int, file string, raw string")
