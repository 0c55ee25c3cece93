"""Formulas: normal source, parser with binding powers, rendering, bound names and template matching.

An expression is a nested tuple: ("id", name), ("num", digits), ("app", f, args),
("bin", op, a, b), ("rel", op, a, b), ("not", a), ("neg", a), ("and" | "or" |
"implies" | "iff", a, b), ("forall" | "exists", name, domain or None, body) and
("opaque", text). A text that does not parse is opaque, never guessed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Commands and the symbol that each stands for.
COMMANDS = {
    "Rightarrow": "=>", "implies": "=>", "Longrightarrow": "=>", "iff": "<=>", "Leftrightarrow": "<=>", "land": "/\\", "wedge": "/\\", "lor": "\\/", "vee": "\\/",
    "neg": "~", "lnot": "~", "le": "<=", "leq": "<=", "ge": ">=", "geq": ">=", "ne": "!=", "neq": "!=", "in": "in", "notin": "notin", "subset": "subset", "subseteq": "subseteq",
    "cdot": "*", "times": "*", "forall": "forall", "exists": "exists", "colon": ":", "to": "->", "mapsto": "|->", "infty": "infty", "mathbb": "", "mathrm": "", "mathcal": "",
}
SPACING = ("quad", "qquad", ",", ";", "!", ":", " ")
RELATIONS = ("=", "<", ">", "<=", ">=", "!=", "in", "notin", "subset", "subseteq", "->", ":")
#: Left and right binding powers; implication and power bind to the right, relations do not chain.
POWER = {"<=>": (1, 2), "=>": (4, 3), "\\/": (5, 6), "/\\": (7, 8), **dict.fromkeys(RELATIONS, (10, 10)), "+": (11, 12), "-": (11, 12), "*": (13, 14), "/": (13, 14), "^": (18, 17)}
NAMES = {"<=>": "iff", "=>": "implies", "\\/": "or", "/\\": "and"}
_TOKEN = re.compile(r"\s+|\\([A-Za-z]+)|\\(.)|([A-Za-zℕ](?:_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]))?)|([0-9]+(?:\.[0-9]+)?)|(<=>|=>|\|->|->|<=|>=|!=|.)", re.DOTALL)


class Unreadable(ValueError):
    pass


_NATURALS = re.compile(r"\\mathbb\s*\{N\}")


#: Signs and the command that each is written with.
SIGNS = {"⇔": "iff", "⇒": "Rightarrow", "∧": "land", "∨": "lor", "¬": "neg", "≠": "ne", "≤": "le", "≥": "ge", "∈": "in", "∉": "notin", "⊂": "subset", "⊆": "subseteq", "∀": "forall", "∃": "exists", "→": "to"}
_SPELLED = str.maketrans({sign: f"\\{name} " for sign, name in SIGNS.items()})


def tokenize(source: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(_NATURALS.sub("ℕ", source.translate(_SPELLED))):
        if m[1] is not None:
            if m[1] in SPACING:
                continue
            if m[1] in COMMANDS:
                if COMMANDS[m[1]]:
                    out.append(("op", COMMANDS[m[1]]))
            else:
                out.append(("id", m[1]))
        elif m[2] is not None:
            if m[2] not in SPACING:
                out.append(("op", m[2]))
        elif m[3] is not None:
            out.append(("id", re.sub(r"_\{(\w+)\}", r"_\1", m[3])))
        elif m[4] is not None:
            out.append(("num", m[4]))
        elif m[5] is not None:
            out.append(("op", m[5]))
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value:
            raise Unreadable(value)
        self.at += 1
        return token

    def expression(self, least: int = 0):
        left = self.operand()
        chained = False
        while (op := self.peek())[0] == "op" and op[1] in POWER:
            low, high = POWER[op[1]]
            if low < least or low == high == least:
                break
            if op[1] in RELATIONS and chained:
                raise Unreadable("chained relation")
            self.take()
            right = self.expression(high if low != high else high + 1)
            if op[1] in RELATIONS:
                left, chained = ("rel", op[1], left, right), True
            elif op[1] in NAMES:
                left, chained = (NAMES[op[1]], left, right), False
            else:
                left = ("bin", op[1], left, right)
        return left

    def operand(self):
        kind, value = self.take()
        if kind == "num":
            return "num", value
        if kind == "op" and value in ("forall", "exists"):
            name = self.take()
            if name[0] != "id":
                raise Unreadable("binder")
            domain = None
            if self.peek() == ("op", "in"):
                self.take()
                domain = self.expression(11)
            if self.peek()[1] in (",", ":", "."):
                self.take()
            return value, name[1], domain, self.expression(1)
        if kind == "op" and value == "~":
            return "not", self.expression(9)
        if kind == "op" and value == "-":
            return "neg", self.expression(15)
        if value in ("(", "{", "["):
            inner = self.expression()
            self.take({"(": ")", "{": "}", "[": "]"}[value])
            return inner
        if kind != "id":
            raise Unreadable(value or "end")
        if self.peek() == ("op", "("):
            self.take()
            args = []
            while self.peek()[1] != ")":
                args.append(self.expression())
                if self.peek()[1] == ",":
                    self.take()
                elif self.peek()[1] != ")":
                    raise Unreadable("arguments")
            self.take(")")
            return "app", value, tuple(args)
        return "id", value


def parse(source: str):
    """The expression of a formula, or ("opaque", text)."""
    try:
        reader = _Reader(tokenize(source))
        out = reader.expression()
        if reader.at != len(reader.tokens):
            raise Unreadable("rest")
        return out
    except (Unreadable, RecursionError):
        return "opaque", " ".join(source.split())


def walk(x) -> Iterator[tuple]:
    """The expression and its parts, parents first."""
    yield x
    for part in x[1:]:
        if isinstance(part, tuple):
            for inner in [part] if part and isinstance(part[0], str) else part:
                yield from walk(inner)


def status(x) -> str:
    """full, partial (an opaque part) or opaque."""
    if x[0] == "opaque":
        return "opaque"
    return "partial" if any(p[0] == "opaque" for p in walk(x)) else "full"


def render(x) -> str:
    """Text with explicit brackets around every compound part."""
    kind = x[0]
    if kind in ("id", "num"):
        return x[1]
    if kind == "opaque":
        return f"?[{x[1]}]"
    if kind == "app":
        return f"{x[1]}({', '.join(map(render, x[2]))})"
    if kind in ("bin", "rel"):
        return f"({render(x[2])} {x[1]} {render(x[3])})"
    if kind in ("not", "neg"):
        return f"{'~' if kind == 'not' else '-'}{render(x[1])}"
    if kind in ("forall", "exists"):
        domain = f" in {render(x[2])}" if x[2] else ""
        return f"({kind} {x[1]}{domain}, {render(x[3])})"
    return f"({render(x[1])} { {v: k for k, v in NAMES.items()}[kind]} {render(x[2])})"


def alpha(x, bound: tuple[str, ...] = ()):
    """Bound names become @0, @1, .. by the depth of their binder."""
    kind = x[0]
    if kind == "id":
        return ("id", f"@{len(bound) - 1 - bound[::-1].index(x[1])}") if x[1] in bound else x
    if kind in ("forall", "exists"):
        return kind, f"@{len(bound)}", alpha(x[2], bound) if x[2] else None, alpha(x[3], (*bound, x[1]))
    if kind == "app":
        return kind, alpha(("id", x[1]), bound)[1], tuple(alpha(a, bound) for a in x[2])
    return tuple(alpha(p, bound) if isinstance(p, tuple) else p for p in x)


def free_names(x, bound: frozenset = frozenset()) -> set[str]:
    kind = x[0]
    if kind == "id":
        return set() if x[1] in bound else {x[1]}
    if kind in ("forall", "exists"):
        return (free_names(x[2], bound) if x[2] else set()) | free_names(x[3], bound | {x[1]})
    if kind == "app":
        return ({x[1]} - bound).union(*(free_names(a, bound) for a in x[2]))
    return set().union(*(free_names(p, bound) for p in x[1:] if isinstance(p, tuple)), set())


def substitute(x, name: str, value):
    """Replace free ``name``; a binder that would capture a name of ``value`` is renamed."""
    kind = x[0]
    if kind == "id":
        return value if x[1] == name else x
    if kind in ("forall", "exists"):
        domain = substitute(x[2], name, value) if x[2] else None
        if x[1] == name:
            return kind, x[1], domain, x[3]
        own, body = x[1], x[3]
        if own in free_names(value) and name in free_names(body):
            fresh = own
            while fresh in free_names(value) | free_names(body):
                fresh += "'"
            own, body = fresh, substitute(body, own, ("id", fresh))
        return kind, own, domain, substitute(body, name, value)
    if kind == "app":
        return kind, x[1], tuple(substitute(a, name, value) for a in x[2])
    return tuple(substitute(p, name, value) if isinstance(p, tuple) else p for p in x)


def match(template, x, parameters: frozenset, found: dict | None = None) -> dict | None:
    """Bindings of the parameters that make the template equal to ``x``, or None; a parameter keeps one value."""
    found = {} if found is None else found
    if template[0] == "id" and template[1] in parameters:
        if template[1] in found:
            return found if alpha(found[template[1]]) == alpha(x) else None
        return {**found, template[1]: x}
    if template[0] != x[0] or len(template) != len(x) or template[0] in ("forall", "exists"):
        return found if alpha(template) == alpha(x) else None
    for a, b in zip(template[1:], x[1:]):
        if isinstance(a, tuple) and isinstance(b, tuple):
            pairs = [(a, b)] if a and isinstance(a[0], str) else list(zip(a, b)) if len(a) == len(b) else None
            for p, q in pairs or ():
                found = match(p, q, parameters, found)
                if found is None:
                    return None
            if pairs is None:
                return None
        elif a != b:
            return None
    return found


def replacement_sites(a, b, old, new, path: tuple[int, ...] = ()) -> list[tuple[int, ...]] | None:
    """Paths where ``a`` has old and ``b`` has new, if that explains every difference; None otherwise."""
    if a == b:
        return []
    if a == old and b == new:
        return [path]
    if a[0] != b[0] or len(a) != len(b) or a[0] in ("forall", "exists"):
        return None
    out = []
    for i, (p, q) in enumerate(zip(a[1:], b[1:]), 1):
        if isinstance(p, tuple) and isinstance(q, tuple) and p and q and isinstance(p[0], str):
            inner = replacement_sites(p, q, old, new, (*path, i))
            if inner is None:
                return None
            out += inner
        elif p != q:
            return None
    return out


def canonical(x) -> str:
    """Canonical JSON of an expression, to be used as a key."""
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))
