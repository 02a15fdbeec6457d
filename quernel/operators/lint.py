"""Checks of notes against a contract: findings, gates with reasons, filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a filter may name.
FILTER_KEYS = ("tag", "kind", "project", "status", "group")


def findings(notes: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, finding) for each check that a note fails."""
    named = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))
    return notes.select(key, F.explode(named).alias("finding"))


def first_reason(gates: dict[str, Column]) -> Column:
    """The first gate that refuses, else null."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in gates.items()))


def parse_filter(spec: str) -> dict[str, str]:
    """``k=v AND k=v``, in whatever case the keys and AND are, values perhaps in quotes; what is no ``k=v`` and an unknown
    key are errors."""
    out = {}
    for part in filter(None, (p.strip() for p in re.split(r"(?i)\s+AND\s+", spec.strip()))):
        k, eq, v = part.partition("=")
        if not eq or k.strip().lower() not in FILTER_KEYS:
            raise ValueError(f"no filter is {part!r}; keys are {', '.join(FILTER_KEYS)}")
        out[k.strip().lower()] = v.strip().strip("'\"")
    return out


def matches(criteria: dict[str, str], columns: dict[str, str]) -> Column:
    """All criteria; a tag is part of the raw tags, all else is equal."""
    out = F.lit(True)
    for k, v in criteria.items():
        c = F.col(columns[k])
        out = out & (c.contains(v) if k == "tag" else c == v)
    return out


def in_scope(path: Column, scope: list[str]) -> Column:
    """A path in the scope or below it; an empty scope holds nothing."""
    out = F.lit(False)
    for p in scope:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def kebab(value: Column) -> Column:
    return value.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def taxonomy(values: DataFrame, column: str, known: list[str], retired: list[str]) -> DataFrame:
    """How often each value occurs, and whether it is known, retired or unrecognised."""
    label = F.when(F.col(column).isin(*known), "known").when(F.col(column).isin(*retired), "retired").otherwise("unrecognised")
    return values.groupBy(column).agg(F.count("*").alias("n")).withColumn("label", label)


def front_keys(front: Column) -> Column:
    """The keys of a front matter in their order."""
    return F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_]+):"), 1)


def schema_findings(front: Column, order: tuple[str, ...], slug: Column, name: Column, arc: Column, arcs: tuple[str, ...]) -> Column:
    """What a front matter has against its schema: known keys out of their order, each key that is not known, a slug that is
    not the file's name, an arc that is no kebab-case word or not registered. A slug or an arc that is not there is fine."""
    keys, known = F.coalesce(front_keys(front), F.array().cast("array<string>")), F.array(*(F.lit(k) for k in order))
    present = F.filter(keys, lambda k: F.array_contains(known, k))
    moved = present != F.filter(known, lambda k: F.array_contains(keys, k))
    unknown = F.transform(F.filter(keys, lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown key "), k))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    of_arc = F.when(has(arc) & ~kebab(arc), "arc is not kebab").when(has(arc) & ~arc.isin(*arcs), "arc is unknown")
    one = lambda c: F.array_compact(F.array(c))
    return F.concat(one(F.when(moved, "fields out of order")), unknown, one(F.when(has(slug) & (slug != name), "slug is not the file name")), one(of_arc))
