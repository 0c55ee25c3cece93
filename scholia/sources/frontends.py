"""Scanners by name: a scanner turns manuscripts (project_id, ord, raw) into the facts of ``functions.scan.SCHEMA``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from scholia.functions.scan import SCHEMA, scan_manuscripts

Scanner = Callable[[DataFrame], DataFrame]
DEFAULT = "current"
#: Scanners that need packages which aren't part of this engine; they can be registered.
ABSENT = ("tree-sitter", "pylatexenc")
_SCANNERS: dict[str, Scanner] = {"current": scan_manuscripts, "regex": scan_manuscripts}


def register(name: str, scanner: Scanner) -> None:
    """Make a scanner known; its columns are checked when it is used."""
    _SCANNERS[name] = scanner


def get_scanner(name: str = DEFAULT) -> Scanner:
    """The scanner of a name; an unknown or absent one raises."""
    if name not in _SCANNERS:
        raise ValueError(f"scanner {name!r} is not installed" if name in ABSENT else f"no scanner {name!r}; there are {', '.join(sorted(_SCANNERS))}")
    scanner = _SCANNERS[name]

    def checked(files: DataFrame) -> DataFrame:
        facts = scanner(files)
        missing = {x.split()[0] for x in SCHEMA.split(", ")} - set(facts.columns)
        if missing:
            raise ValueError(f"scanner {name!r} gives no {', '.join(sorted(missing))}")
        return facts

    return checked
