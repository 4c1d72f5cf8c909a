"""Label-set helpers: canonical text, fingerprints and series matchers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_text(labels: Column | str) -> Column:
    """Canonical text of a label map: entries sorted by key, ``k=v`` joined by commas.

    Reproducible in SQL engines without map ordering guarantees, so it is the identity
    we group, join and compare on.
    """
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(
        F.concat_ws(",", F.transform(F.array_sort(F.map_entries(m)),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"]))),
        F.lit(""))


def series_key(metric: Column | str, labels: Column | str) -> Column:
    mc = F.col(metric) if isinstance(metric, str) else metric
    return F.concat(mc, F.lit("{"), label_text(labels), F.lit("}"))


def fingerprint(labels: Column | str) -> Column:
    """Stable id of a label set: md5 over the canonical text."""
    return F.md5(label_text(labels))


def label(labels: Column | str, key: str) -> Column:
    """Label value with the absent-label-is-empty rule of series selectors."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.element_at(m, F.lit(key)), F.lit(""))


def matcher(labels: Column | str, key: str, op: str, value: str) -> Column:
    """One series matcher: ``=``, ``!=``, ``=~``, ``!~``; regexes are fully anchored."""
    v = label(labels, key)
    if op == "=":
        return v == F.lit(value)
    if op == "!=":
        return v != F.lit(value)
    if op == "=~":
        return v.rlike(f"^(?:{value})$")
    if op == "!~":
        return ~v.rlike(f"^(?:{value})$")
    raise ValueError(f"unknown matcher op {op!r}")


def trim_space(c: Column | str) -> Column:
    """Text without white space (of any kind) at its ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
