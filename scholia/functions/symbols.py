"""Symbols in formulas: names, what a cue or quantifier introduces, explicit definitions, and mentions of known names."""

from __future__ import annotations

import re
from functools import lru_cache

from scholia.functions.scan import group

_NAME = r"(?:\\[A-Za-z]+|[A-Za-z])(?:_(?:\{[^{}]+\}|\\[A-Za-z]+|[A-Za-z0-9]+))?"
_NAMES = re.compile(_NAME)
_ONE = re.compile(rf"\s*({_NAME})\s*$")
_SEVERAL = re.compile(rf"\s*{_NAME}(?:\s*,\s*{_NAME})+\s*$")
_MAP = re.compile(rf"\s*({_NAME})\s*(?::|\\colon(?![A-Za-z]))\s*.+?\s*\\(?:to|rightarrow|longrightarrow)(?![A-Za-z])\s*.+?\s*$")
_FUNCTION = re.compile(rf"\s*({_NAME})\s*\([^()]*\)\s*(:=|=|\\coloneqq)\s*(.+?)\s*$")
_EQUAL = re.compile(rf"\s*({_NAME})\s*(:=|=|\\coloneqq)\s*(.+?)\s*$")
_RELATION = re.compile(rf"\s*({_NAME})\s*(>|<|\\(?:geq?|leq?|in)(?![A-Za-z]))\s*(.+?)\s*$")
_QUANTIFIER = re.compile(rf"\\(?:forall|exists)(?![A-Za-z])\s*({_NAME})")
_CUES = (("let", re.compile(r"(?i)\blet\s*$")), ("for", re.compile(r"(?i)\bfor(?:\s+(?:each|every))?\s*$")), ("define", re.compile(r"(?i)\bdefine\s*$")), ("set", re.compile(r"(?i)\bset\s*$")))
_BE = re.compile(r"(?i)\s+be\b")
_DEFINED = re.compile(rf"(?s)\s*({_NAME})\s*(?::=|\\coloneqq)\s*.+?\s*$")
_STACKED = re.compile(rf"(?i)\s*({_NAME})\s*(?=\\(?:stackrel|overset))")
_STACK = re.compile(r"(?i)\\(?:stackrel|overset)\s*")
_BY_MACRO = re.compile(rf"\s*({_NAME})\s*(\\[A-Za-z@]+)")
_DEF = re.compile(r"(?i)(?<![A-Za-z])def(?:inition)?(?![A-Za-z])")
_WRAPPED = re.compile(r"\\(?:mathbb|mathbf|mathrm|mathcal|mathfrak|operatorname)\s*(?:\{[^{}]*\}|[A-Za-z])")
_BRACED = re.compile(r"(\\[A-Za-z]+|[A-Za-z])_\{(\\[A-Za-z]+|[A-Za-z0-9]+)\}")
_SUBSCRIPT = re.compile(r"(\\[A-Za-z]+|[A-Za-z])_(\\[A-Za-z]+|[A-Za-z0-9]+)")


def canonical(name: str) -> str:
    """``x_{1}`` is ``x_1``."""
    found = _BRACED.fullmatch(name)
    return f"{found[1]}_{found[2]}" if found else name


#: Characters before and behind a formula in which a result's cues stand.
NEAR, BEHIND = 80, 24
_CONVENTION = re.compile(r"(?i)\s*(?:in\s+what\s+follows|throughout|henceforth|from\s+now\s+on)\b")
_BRIDGE = re.compile(r"(?i)\s*(?:to\s+mean|means?|is\s+defined\s+(?:as|to\s+be))\s*$")
_INFIX = re.compile(rf"\s*{_NAME}\s*(\\[A-Za-z]+)\s*{_NAME}\s*$")


def cue(before: str, behind: str) -> str | None:
    """The introducing word right before a formula; ``let`` also needs ``be`` behind it."""
    kind = next((k for k, pattern in _CUES if pattern.search(before[-NEAR:])), None)
    return None if kind == "let" and not _BE.match(behind[:BEHIND]) else kind


def authoritative(formula: str, before: str, behind: str) -> tuple[str, int, str, str] | None:
    """(name, offset, role, kind) of the one symbol that a formula outside results introduces for the whole project, if it does so beyond doubt.

    ``define`` and ``set`` need a definition, ``let`` a definition or a map and
    ``be``, ``for`` a relation that is said to hold from here on: a symbol taken
    for the project by mistake would be seen in every later result.
    """
    kind = next((k for k, pattern in _CUES if pattern.search(before)), None)
    if kind is None:
        return None
    grammar = "set" if kind == "let" and not introduced(formula, kind) else kind
    found, said = introduced(formula, grammar), stated(formula, grammar)
    if len(found) != 1:
        return None
    name, at, role = found[0]
    sort = said[0] if said else None
    if kind == "for":
        sure = sort == "constraint" and bool(_CONVENTION.match(behind))
    else:
        sure = sort == "definition" or kind == "let" and role == "map" and bool(_BE.match(behind))
    return (name, at, role, kind) if sure else None


def alias(formula: str, behind: str) -> tuple[str, int] | None:
    """The sign between two names that the words before the next formula give a meaning, as in ``$a \\sim b$ means $..$``."""
    bridge = behind.partition("$")
    found = _INFIX.match(formula)
    return (found[1], found.start(1)) if found and bridge[1] and _BRIDGE.match(bridge[0]) else None


def introduced(formula: str, kind: str) -> list[tuple[str, int, str]]:
    """(name, offset, role) of the symbols that a formula introduces behind a cue."""
    if kind == "define" and (found := _FUNCTION.match(formula)):
        return [(canonical(found[1]), found.start(1), "function")]
    if kind in ("define", "set") and (found := _EQUAL.match(formula)):
        return [(canonical(found[1]), found.start(1), "unknown")]
    if found := _MAP.match(formula):
        return [(canonical(found[1]), found.start(1), "map")]
    if found := _RELATION.match(formula):
        return [(canonical(found[1]), found.start(1), "unknown" if found[2] == "\\in" else "scalar")]
    if found := _ONE.match(formula):
        return [(canonical(found[1]), found.start(1), "unknown")]
    if _SEVERAL.match(formula):
        return [(canonical(x[0]), x.start(), "unknown") for x in _NAMES.finditer(formula)]
    return []


def stated(formula: str, kind: str) -> tuple[str, str] | None:
    """What an introducing formula says of its symbol: (``constraint`` or ``definition``, name, sign and term in one), if anything."""
    if kind == "define" and (found := _FUNCTION.match(formula)) or kind in ("define", "set") and (found := _EQUAL.match(formula)):
        return "definition", canonical(found[1]) + found[2] + found[3]
    if not _MAP.match(formula) and (found := _RELATION.match(formula)):
        return "constraint", canonical(found[1]) + found[2] + found[3]
    return None


def quantified(formula: str) -> list[tuple[str, int]]:
    return [(canonical(x[1]), x.start(1)) for x in _QUANTIFIER.finditer(formula)]


def _stacked_end(text: str, at: int) -> int | None:
    """Offset behind a stacked equals sign marked ``def`` that starts at ``at``."""
    found = _STACK.match(text, at)
    if not found or not (mark := group(text, found.end())):
        return None
    place = mark[1] + len(text[mark[1] :]) - len(text[mark[1] :].lstrip())
    sign = group(text, place)
    return sign[1] if sign and _DEF.search(mark[0]) and re.sub(r"[{}\s]", "", sign[0]) == "=" else None


def defines(replacement: str) -> bool:
    """Whether a macro's replacement is nothing but a definition operator."""
    text = replacement.strip()
    if text in (":=", "\\coloneqq"):
        return True
    end = _stacked_end(text, 0)
    return end is not None and not text[end:].strip()


def defined(formula: str, macros: list[str]) -> tuple[str, int] | None:
    """Name and offset of a symbol that a formula defines by an explicit operator, or by one of ``macros``."""
    if found := _DEFINED.match(formula):
        return canonical(found[1]), found.start(1)
    if (found := _BY_MACRO.match(formula)) and found[2] in macros and formula[found.end() :].strip():
        return canonical(found[1]), found.start(1)
    if (found := _STACKED.match(formula)) and (end := _stacked_end(formula, found.end())) is not None and formula[end:].strip():
        return canonical(found[1]), found.start(1)
    return None


@lru_cache(4096)
def _spelling(name: str) -> re.Pattern[str]:
    found = _SUBSCRIPT.fullmatch(name)
    if found:
        base, sub = re.escape(found[1]), re.escape(found[2])
        text = rf"{base}_(?:{sub}|\{{{sub}\}})"
    else:
        text = re.escape(name)
    return re.compile(rf"{text}(?![A-Za-z])" if name[0] == "\\" else rf"(?<![\\A-Za-z]){text}(?![A-Za-z])")


def mentions(formula: str, names: list[str]) -> list[tuple[str, int]]:
    """(name, offset) of every place where a formula holds one of ``names``; wrapped letters such as ``\\mathbb{R}`` are none."""
    masked = _WRAPPED.sub(lambda x: " " * len(x[0]), formula)
    return [(name, x.start()) for name in names for x in _spelling(name).finditer(masked)]
