"""Stored filters as column predicates: a rule names a field, an operator and a value; rule sets combine them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_OPS = {
    "contains": lambda c, v: c.contains(v),
    "not_contains": lambda c, v: ~c.contains(v),
    "starts": lambda c, v: c.startswith(v),
    "ends": lambda c, v: c.endswith(v),
    "is": lambda c, v: c == v,
}
NUMBER_OPS = {"over": lambda c, v: c > v, "under": lambda c, v: c < v}
ENUM_OPS = {"is": lambda c, v: c == v, "is_not": lambda c, v: ~c.eqNullSafe(F.lit(v))}
LIST_OPS = {"in": lambda c, v: c.isin(v), "not_in": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False))}
MOST_RULES = 20


@dataclass(frozen=True)
class Field:
    """What a rule may ask of a column: kind is text, number, enum, list, recent or flag."""

    kind: str
    column: Column
    values: frozenset[str] = frozenset()
    scale: float = 1.0


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class RuleSet:
    match: str = "all"
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def predicate(rule: Rule, fields: dict[str, Field], asof: str | None = None) -> Column:
    """Validated; text is compared in lower case on both sides, a missing number counts as 0."""
    f = fields.get(rule.field)
    if f is None:
        raise ValueError(f"no such field: {rule.field}")
    ops = {"text": TEXT_OPS, "number": NUMBER_OPS, "enum": ENUM_OPS, "list": LIST_OPS, "recent": {"days": None}, "flag": {"is": None}}[f.kind]
    if rule.op not in ops:
        raise ValueError(f"{rule.field} has no operator {rule.op}")
    if f.kind == "text":
        return TEXT_OPS[rule.op](F.lower(F.coalesce(f.column, F.lit(""))), str(rule.value).lower())
    if f.kind == "number":
        return NUMBER_OPS[rule.op](F.coalesce(f.column, F.lit(0)), F.lit(float(rule.value) * f.scale))
    if f.kind == "enum":
        if rule.value not in f.values:
            raise ValueError(f"{rule.field} can't be {rule.value}")
        return ENUM_OPS[rule.op](f.column, rule.value)
    if f.kind == "list":
        wanted = [x.lstrip(".").lower() for x in str(rule.value).replace(",", " ").split()]
        return LIST_OPS[rule.op](F.lower(f.column), wanted)
    if f.kind == "recent":
        if asof is None:
            raise ValueError("a recent rule needs asof")
        return f.column >= F.lit(asof).cast("timestamp") - F.make_interval(days=F.lit(min(int(rule.value), 3650)))
    return F.coalesce(f.column, F.lit(False)) if rule.value else ~F.coalesce(f.column, F.lit(False))


def compiled(rules: RuleSet, fields: dict[str, Field], asof: str | None = None) -> Column:
    """all: every rule; any: at least one; an empty set holds for every row."""
    if len(rules.rules) > MOST_RULES:
        raise ValueError("too many rules")
    found = [predicate(r, fields, asof) for r in rules.rules]
    return reduce((lambda a, b: a & b) if rules.match == "all" else (lambda a, b: a | b), found) if found else F.lit(True)


def counted(df: DataFrame, views: dict[str, Column]) -> DataFrame:
    """All views' counts in one pass, as rows (view, n)."""
    row = df.agg(*(F.count_if(c).alias(v) for v, c in views.items()))
    return row.unpivot([], list(views), "view", "n")
