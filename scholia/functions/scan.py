"""Source scanner: macros, environments, math, comments and defects of a LaTeX text, with exact spans.

Offsets are code points, spans half-open, lines and columns counted from 1.
Scanning goes on behind a command's name, so macros inside arguments are facts
too; only comments and literal environments are passed over. Braces nest, so
this is a small machine and no SQL expression; it runs over Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Required arguments that the scanner reads after a macro's optional one.
ARITY = {"begin": 1, "end": 1, "label": 1, "ref": 1, "eqref": 1, "autoref": 1, "cref": 1, "Cref": 1, "input": 1, "include": 1, "newtheorem": 2, "documentclass": 1, "usepackage": 1, "cite": 1, "newcommand": 2, "renewcommand": 2, "providecommand": 2, "caption": 1, "section": 1}
#: Macros that define macros; their replacement is the fact's text.
COMMANDS = ("newcommand", "renewcommand", "providecommand")
LITERAL = ("verbatim", "lstlisting", "minted", "comment")
#: Environments that are no results and may hold a whole file; facts carry no text of theirs.
STRUCTURAL = ("document", "figure", "figure*", "table", "table*", "center", "itemize", "enumerate", "description", "quote", "quotation", "appendix", "appendices", "abstract", "minipage", "subequations", "landscape", "multicols", "frame")
SCHEMA = "project_id long, ord int, kind string, name string, arg string, option string, s int, e int, bs int, be int, sl int, el int, text string, before string, behind string, sc int, ec int, nested boolean, label string, proof_s int, proof_line int, proof_bs int, proof_be int, proof string"
#: Fixed value: the longest gap between an environment and its proof in lines.
PROOF_GAP = 40
#: Characters of source whose facts a task holds before it passes them on; a longer file is held alone.
HELD_CHARS = 2 << 20
#: Characters of context that a formula carries on its left and right.
BEFORE, BEHIND = 96, 96

_MARK = re.compile(r"\\(?:([A-Za-z]+)(\*?)|(.))|%[^\n]*|\$\$?", re.DOTALL)
_FEED = re.compile("\n")
_SPACE = re.compile(r"[ \t]*")
_COMMAND = re.compile(r"[ \t]*(\\[A-Za-z@]+)")
_ARGUMENT = re.compile(r"\\(?:[A-Za-z@]+\*?|.)\s*\Z", re.DOTALL)
_INNER = re.compile(r"\\.|[{}]|%[^\n]*", re.DOTALL)


def group(text: str, at: int, opening: str = "{", closing: str = "}") -> tuple[str, int] | None:
    """The balanced group that starts at ``at`` and the offset after it; escaped braces and comments don't count."""
    if at >= len(text) or text[at] != opening:
        return None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "%":
            feed = text.find("\n", i)
            if feed < 0:
                return None
            i = feed
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
        i += 1
    return None


def in_argument(text: str, at: int) -> bool:
    """Whether ``at`` lies in a braced argument of some macro."""
    open_at: list[int] = []
    for found in _INNER.finditer(text, 0, at):
        if found[0] == "{":
            open_at.append(found.start())
        elif found[0] == "}" and open_at:
            open_at.pop()
    for brace in open_at:
        if group(text, brace) is None:
            continue
        before = text[max(0, brace - 400) : brace].rstrip()
        while before and before[-1] in "]}":  # earlier arguments of the same macro
            cut = before.rfind("[" if before[-1] == "]" else "{")
            if cut < 0:
                break
            before = before[:cut].rstrip()
        if _ARGUMENT.search(before):
            return True
    return False


def scan(text: str) -> list[tuple]:
    """Facts (kind, name, arg, option, s, e, body s, body e, first line, last line, text, context, columns, nested) in source order.

    The context, for formulas alone, is the text shortly before and behind. An
    include inside another macro's argument is nested. A macro whose required
    argument isn't complete has no arg.
    """
    lines = [m.start() for m in _FEED.finditer(text)]

    def line(at: int) -> int:
        return bisect_right(lines, at - 1) + 1

    facts: list[tuple] = []

    def column(at: int) -> int:
        n = bisect_right(lines, at - 1)
        return at - (lines[n - 1] + 1 if n else 0) + 1

    def add(kind, name, arg, option, s, e, bs=None, be=None, body=None, nested=None) -> None:
        context = (text[max(0, s - BEFORE) : s], text[e : e + BEHIND]) if kind == "math" else (None, None)
        facts.append((kind, name, arg, option, s, e, bs, be, line(s), line(max(s, e - 1)), body, *context, column(s), column(e), nested))

    stack: list[tuple] = []
    math: tuple[str, int, int] | None = None
    at, size = 0, len(text)
    while at < size:
        found = _MARK.search(text, at)
        if not found:
            break
        s, at = found.start(), found.end()
        token = found[0]
        if token[0] == "%":
            add("comment", None, None, None, s, at, body=token)
        elif token[0] == "$":
            if math and math[0] == token:
                add("math", token, None, None, math[1], at, math[2], s, text[math[2] : s])
                math = None
            elif math is None:
                math = token, s, at
            elif token == "$$" and math[0] == "$":  # the first of the two closes
                at = s + 1
                add("math", "$", None, None, math[1], at, math[2], s, text[math[2] : s])
                math = None
        elif found[3] is not None:
            if found[3] in "[(" and math is None:
                math = "\\" + found[3], s, at
            elif found[3] in "])" and math and math[0] == "\\" + {"]": "[", ")": "("}[found[3]]:
                add("math", math[0], None, None, math[1], at, math[2], s, text[math[2] : s])
                math = None
        else:
            name = found[1]
            option, args, end = None, [], at
            if name in ARITY:
                place = _SPACE.match(text, end).end()
                if name != "begin" and name != "end" and (got := group(text, place, "[", "]")):
                    option, end = got
                if name in COMMANDS and option is None and (own := _COMMAND.match(text, end)):  # an unbraced name
                    args, end = [own[1]], own.end()
                for _ in range(ARITY[name] - len(args)):
                    if args and name in COMMANDS and (got := group(text, _SPACE.match(text, end).end(), "[", "]")):
                        option, end = got
                    if not (got := group(text, _SPACE.match(text, end).end())):
                        break
                    args.append(got[0])
                    end = got[1]
                if name == "begin" and args and (got := group(text, end, "[", "]")):
                    option, end = got
                if name in ("begin", "end"):
                    at = _name_end(text, at, end)
            arg = args[0].strip() if args else None
            nested = in_argument(text, s) if name in ("input", "include") else None
            add("macro", name, arg, option, s, end, body=args[1] if name in COMMANDS and len(args) > 1 else None, nested=nested)
            if name == "begin" and arg:
                if arg in LITERAL:
                    close = text.find("\\end{" + arg + "}", end)
                    if close < 0:
                        add("defect", "unclosed", arg, None, s, size)
                        at = size
                    else:
                        at = close + len(arg) + 6
                        add("env", arg, None, option, s, at, end, close, text[end:close])
                else:
                    stack.append((arg, s, end, option))
            elif name == "end" and arg:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == arg:
                        _, bs, body, opt = stack.pop(i)
                        add("env", arg, None, opt, bs, end, body, s, None if arg in STRUCTURAL else text[body:s])
                        break
                else:
                    add("defect", "unopened", arg, None, s, end)
    for name, s, e, _ in stack:
        add("defect", "unclosed", name, None, s, e)
    if math:
        add("defect", "open math", math[0], None, math[1], size)
    return sorted(facts, key=lambda f: (f[4], -f[5]))


def _name_end(text: str, at: int, end: int) -> int:
    """Where scanning goes on behind ``begin`` or ``end``: after the environment's name, before its options."""
    found = group(text, _SPACE.match(text, at).end())
    return min(found[1], end) if found else at


def attached(facts: list[tuple]) -> Iterator[tuple]:
    """For each fact, in order: the first label in an environment's body, and start, line, body span and body of the first proof behind it.

    A file is scanned as a whole, so both are found here and need no join. The
    proof is null if it starts more than ``PROOF_GAP`` lines after the environment,
    and for structural environments and proofs themselves.
    """
    labels = [(f[4], f[5], f[2]) for f in facts if f[0] == "macro" and f[1] == "label" and f[2] is not None]
    proofs = [(f[4], f[8], f[6], f[7], f[10]) for f in facts if f[0] == "env" and f[1] == "proof"]
    label_starts, proof_starts = [x[0] for x in labels], [x[0] for x in proofs]
    for f in facts:
        label, proof = None, (None,) * 5
        if f[0] == "env":
            if (i := bisect_left(label_starts, f[6])) < len(labels) and labels[i][1] <= f[7]:
                label = labels[i][2]
            if f[1] not in STRUCTURAL and f[1] != "proof" and (i := bisect_left(proof_starts, f[5])) < len(proofs) and proofs[i][1] - f[9] <= PROOF_GAP:
                proof = proofs[i]
        yield label, *proof


def scan_manuscripts(manuscripts: DataFrame) -> DataFrame:
    """One row for each fact; math and all but structural environments carry their body's text, environments their label and proof. Null raw has no facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4, *[pa.int32()] * 6, *[pa.string()] * 3, *[pa.int32()] * 2, pa.bool_(), pa.string(), *[pa.int32()] * 4, pa.string()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            for p, o, raw in zip(*(batch.column(c).to_pylist() for c in ("project_id", "ord", "raw"))):
                facts = scan(raw or "")
                rows += [(p, o, *f, *more) for f, more in zip(facts, attached(facts))]
                held += len(raw or "")
                if rows and held >= HELD_CHARS:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return manuscripts.select("project_id", "ord", "raw").mapInArrow(run, SCHEMA)
