"""Feature spaces compiled to columns: rule values, policies, vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.regex import groups, match_count, match_exists
from pagemill.sources.specs import Feature, FeatureRule


def _total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values, F.lit(0).cast("long"))


def _extreme(pick: Callable[..., Column]) -> Callable[[list[Column]], Column]:
    def run(values: list[Column]) -> Column:
        if not values:
            raise ValueError("max and min need a value")
        return pick(*values) if len(values) > 1 else values[0]

    return run


def _mean(values: list[Column]) -> Column:
    """The mean, rounded down."""
    if not values:
        raise ValueError("avg needs a value")
    return F.floor(_total(values) / len(values)).cast("long")


def _ratio(values: list[Column]) -> Column:
    """The first by the rounded mean of the rest, rounded down; the first alone where that is zero."""
    if len(values) < 2:
        raise ValueError("div needs two values")
    below = _mean(values[1:])
    return F.when(below == 0, values[0]).otherwise(F.floor(values[0] / below).cast("long"))


#: prod is the mean, as avg is: what users of the name get.
POLICIES: dict[str, Callable[[list[Column]], Column]] = {
    "sum": _total, "max": _extreme(F.greatest), "min": _extreme(F.least), "avg": _mean, "prod": _mean, "div": _ratio,
}


def rule_value(rule: FeatureRule, part: Column) -> Column:
    bad = [p for p in rule.patterns if groups(p) is None]
    if bad:
        raise ValueError(f"bad patterns: {bad}")
    if rule.kind == "reg":
        value = match_count(part, rule.patterns[0]) if rule.policy == "count" else match_exists(part, rule.patterns[0])
    else:
        value = POLICIES[rule.policy]([match_count(part, p) for p in rule.patterns])
    return F.lit(rule.weight).cast("long") * value


def feature_value(feature: Feature, parts: dict[str, Column]) -> Column:
    missing = {r.sel for r in feature.rules} - set(parts)
    if missing:
        raise KeyError(f"unknown parts: {sorted(missing)}")
    return POLICIES[feature.policy]([rule_value(r, parts[r.sel]) for r in feature.rules])


def column_name(feature: Feature) -> str:
    return f"f_{feature.id}"


def with_features(df: DataFrame, space: list[Feature], parts: dict[str, Column]) -> DataFrame:
    """``df`` with a long column f_<id> for each feature: one projection, no shuffle."""
    return df.withColumns({column_name(f): feature_value(f, parts) for f in space})


def ordered(space: list[Feature]) -> list[Feature]:
    """By id as text: "10" comes before "2"."""
    return sorted(space, key=lambda f: f.id)


def vector(space: list[Feature]) -> Column:
    """Values in the order of ids as text."""
    return F.array(*(F.col(column_name(f)) for f in ordered(space)))


def vector_line(space: list[Feature], mark: str = ",") -> Column:
    return F.array_join(vector(space).cast("array<string>"), mark)


def names_in_document_order(space: list[Feature]) -> list[str]:
    """As a header has them: not the order of ``vector``; see ``names_in_vector_order``."""
    return [f.name for f in space]


def names_in_vector_order(space: list[Feature]) -> list[str]:
    return [f.name for f in ordered(space)]


def described(spark: SparkSession, space: list[Feature]) -> DataFrame:
    return spark.createDataFrame([(f.id, f.name, f.policy, f.description) for f in space], "id string, name string, policy string, description string")
