"""Text expressions: normalisation, tokens, rule classifiers and code lookups."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters with marks and their base letters, from the Unicode tables."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)
        if len(plain) == 1:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()


def fold(c: Column) -> Column:
    """Base letters; what has none in ASCII is dropped, combining marks too."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[^\x00-\x7F]", "")


def norm(c: Column) -> Column:
    """Upper-case A-Z and 0-9 with single spaces; null stays null."""
    return F.trim(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]+", " "))


def name_key(c: Column) -> Column:
    """Lower-case letters and digits with nothing between them."""
    return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "")


def tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct folded words of ``least`` letters or more that aren't stop words, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stop))))


def names_match(a: Column, b: Column, least: float = 0.5) -> Column:
    """True if both token sets have members and share ``least`` of the smaller."""
    small = F.least(F.size(a), F.size(b))
    return F.coalesce((small > 0) & (F.size(F.array_intersect(a, b)) >= least * small), F.lit(False))


def classify(c: Column, rules: list[tuple[int, str, str]], default: str = "unclassifiable") -> Column:
    """First rule that matches, by priority: (priority, regular expression, class)."""
    out = None
    for _, pattern, name in sorted(rules):
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def overlay(c: Column, rules: list[tuple[int, str, str]], default: str = "unclassifiable") -> Column:
    """The same decision by overwriting: rules are applied from the last priority
    to the first, each replacing what stood before."""
    out = F.lit(default)
    for _, pattern, name in sorted(rules, reverse=True):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def hierarchy_class(levels: Column, crosswalk: dict[str, str], default: str = "unclassifiable") -> Column:
    """Class of 'h0/h1' if that is known, else of 'h0', else the default."""
    table = F.create_map(*[F.lit(x) for kv in crosswalk.items() for x in kv])
    first = F.try_element_at(levels, F.lit(1))
    both = F.concat_ws("/", first, F.try_element_at(levels, F.lit(2)))
    return F.coalesce(table[both], table[first], F.lit(default))


def longest_prefix(codes: DataFrame, code: str, crosswalk: DataFrame, least: int = 2) -> DataFrame:
    """``codes`` with the class of the longest prefix in ``crosswalk(prefix, class)``.

    Prefixes of a code are exploded and joined by equality, so the join is
    hashed; codes are looked up once however often they occur."""
    distinct = codes.select(code).where(F.length(code) >= least).distinct()
    tried = distinct.select(code, F.explode(F.transform(F.sequence(F.lit(least), F.length(code)), lambda n: F.substr(F.col(code), F.lit(1), n))).alias("prefix"))
    best = tried.join(crosswalk, "prefix").groupBy(code).agg(F.max_by("class", F.length("prefix")).alias("class"))
    return codes.join(best, code, "left")


def label_or_fail(c: Column, mapping: dict[str, str]) -> Column:
    """Mapped label; a value without one is an error."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(table[c].isNotNull(), table[c]).otherwise(F.raise_error(F.concat(F.lit("no label for "), F.coalesce(c, F.lit("null")))))


def digits_key(c: Column, width: int = 8) -> Column:
    return F.lpad(F.regexp_replace(c, "[^0-9]", ""), width, "0")


def decimal_comma(c: Column) -> Column:
    """Number with a decimal comma; what isn't one counts as 0."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def datasets(sources: Column, prop: str | None = None) -> Column:
    """Datasets credited for a property, else those of the whole feature (an empty
    property), distinct, in order, joined with '+'."""
    whole = F.filter(sources, lambda s: F.coalesce(s["property"], F.lit("")) == "")
    chosen = whole
    if prop is not None:
        own = F.filter(sources, lambda s: s["property"] == prop)
        chosen = F.when(F.size(own) > 0, own).otherwise(whole)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda s: s["dataset"]))), "+")
