"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: LaTeX commands and what normal text shows for them, in the order of replacement.
SYMBOLS = (("Rightarrow", "=>"), ("implies", "=>"), ("iff", "<=>"), ("leq", "<="), ("le", "<="), ("geq", ">="), ("ge", ">="), ("neq", "!="), ("ne", "!="), ("to", "->"), ("colon", ":"), ("in", "in"), ("land", "/\\"), ("lor", "\\/"), ("neg", "~"), ("forall", "forall"), ("exists", "exists"))


def compact(text: Column) -> Column:
    """White space of any kind becomes single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_delimiters(math: Column) -> Column:
    """The inside of a formula that is delimited on both sides, else the text."""
    return F.regexp_replace(F.trim(math), r"(?s)^(?:\$\$(.*)\$\$|\$(.*)\$|\\\[(.*)\\\]|\\\((.*)\\\))$", "$1$2$3$4")


def normal_math(math: Column) -> Column:
    """Commands become symbols, simple index braces go, white space is compacted."""
    out = without_delimiters(math)
    for name, shown in SYMBOLS:
        out = F.regexp_replace(out, rf"\\{name}(?![A-Za-z])", shown.replace("\\", "\\\\"))
    out = F.regexp_replace(out, r"\\(?:quad|qquad|,|;|!|:)", " ")
    return compact(F.regexp_replace(out, r"_\{([A-Za-z0-9]+)\}", "_$1"))


def anchor(identifier: Column) -> Column:
    """Slug with the first eight digits of the identifier's sha256, so that equal slugs stay apart."""
    slug = F.trim(F.regexp_replace(F.lower(identifier), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(slug, F.lit("-"), F.substr(F.sha2(identifier, 256), F.lit(1), F.lit(8)))


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def wire_bound(text: Column) -> Column:
    return (F.octet_length(text) + 2048).cast("long")


def item_id(owner: Column, ids: Column) -> Column:
    """Identity of an owner's set of ids, whatever their order: 16 digits of the sha256 of all, joined by NUL."""
    return F.substr(F.sha2(F.array_join(F.concat(F.array(owner), F.array_sort(ids)), "\0"), 256), F.lit(1), F.lit(16))


def fingerprint(content: Column) -> Column:
    """sha256 of a struct's JSON; fields must be in alphabetical order, nulls are kept."""
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def safe_uri(path: Column) -> Column:
    """A file URI whose path holds nothing but safe characters; others are percent-encoded byte by byte."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))
