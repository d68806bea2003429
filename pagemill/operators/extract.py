"""Rules compiled to columns: scope, match, substring, actions; records; the vote of a layout."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.regex import between, found_joined, groups, stripped, without_tags
from pagemill.functions.scalars import cut, from_extractor
from pagemill.operators import parts as parts_
from pagemill.operators.store import record
from pagemill.sources.specs import Entity, Rule

DATE_FORMATS = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy", "d.M.yyyy", "EEEE, d MMMM yyyy", "EEEE d MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm"]
TIME_FORMATS = ["HH:mm:ss", "HH:mm", "h:mm a", "h a", "h:mma", "ha", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm"]
WEEKDAY = r"^(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,? +"
MISSING = "None"


def _first_parsed(text: Column, formats: list[str], shape: str) -> Column:
    one = F.regexp_replace(F.regexp_replace(stripped(text), r"(?<=[0-9])(?:st|nd|rd|th)\b", ""), WEEKDAY, "")
    tries = [F.try_to_timestamp(one, F.lit(f)) for f in formats if not f.startswith("EEEE")]
    return F.date_format(F.coalesce(*tries), shape)


def parsed_date(text: Column) -> Column:
    """yyyy-MM-dd; null if no format fits."""
    return _first_parsed(text, DATE_FORMATS, "yyyy-MM-dd")


def parsed_time(text: Column) -> Column:
    """HH:mm:ss; null if no format fits."""
    return _first_parsed(F.upper(text), TIME_FORMATS, "HH:mm:ss")


def parsed_any(shape: str = "%Y-%m-%d") -> Callable[[Column], Column]:
    """For free-form dates beyond the formats: a pandas UDF on dateutil. The default day is fixed, so that a rerun agrees."""

    def run(series: pd.Series) -> pd.Series:
        from datetime import datetime

        from dateutil import parser

        def one(text: str | None) -> str | None:
            try:
                return parser.parse(text, default=datetime(1970, 1, 1)).strftime(shape) if text and text.strip() else None
            except (ValueError, OverflowError, TypeError):
                return None

        return series.map(one)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)


def _or_free_form(parsed: Column, text: Column, shape: str) -> Column:
    """What no format fits is tried in free form; of the rest Python sees nulls only."""
    return F.coalesce(parsed, parsed_any(shape)(F.when(parsed.isNull(), text)))


def compatible(parsed: Column) -> Column:
    """What could not be parsed reads "None"."""
    return F.coalesce(parsed, F.lit(MISSING))


#: number -> (name, description, column builder)
ACTIONS: dict[int, tuple[str, str, Callable[[Column], Column]]] = {
    1: ("removeHTML", "tags go", without_tags),
    2: ("strip", "white space at both ends goes", stripped),
    3: ("parseDate", "a date as yyyy-MM-dd", lambda c: compatible(_or_free_form(parsed_date(c), c, "%Y-%m-%d"))),
    4: ("parseTime", "a time as HH:mm:ss", lambda c: compatible(_or_free_form(parsed_time(c), c, "%H:%M:%S"))),
}


def scopes(rules: Iterable[Rule]) -> list[parts_.Scope]:
    """Of the rules on content."""
    out = []
    for r in rules:
        if r.on != "content":
            continue
        try:
            out.append((H.compiled_selector(r.sel or "html"), r.target))
        except ValueError:
            out.append((None, r.target))  # beyond the subset: nothing is selected
    return out


def with_scopes(pages: DataFrame, rules: list[Rule], html: str = "html", url: str = "url", into: str = "__scopes") -> DataFrame:
    """``pages`` with an array of the scoped contents of the rules on content; a page is parsed once for all."""
    return parts_.with_parts(pages, [], html, url, into, scopes=scopes(rules)).withColumn(into, F.col(f"{into}.scopes"))


def attribute_value(rule: Rule, source: Column) -> Column:
    """The rule's value from the content it is on. A pattern that does not compile makes the whole value ""."""
    value = source
    if rule.match is not None:
        if groups(rule.match) is None:
            return F.lit("")
        value = found_joined(value, rule.match)
    if rule.after is not None or rule.before is not None:
        if groups(rule.after or "^") is None or groups(f"{rule.after or '^'}(.*?){rule.before or '$'}") is None:
            return F.lit("")
        value = between(value, rule.after or "", rule.before or "")
    for number in rule.actions:
        if number not in ACTIONS:
            raise KeyError(f"unknown action: {number}")
        value = ACTIONS[number][2](value)
    return F.coalesce(value, F.lit(""))


def with_rule_values(pages: DataFrame, rules: dict[str, Rule], parts: dict[str, Column], html: str = "html", url: str = "url", scoped: Column | None = None) -> DataFrame:
    """``pages`` with a column for each named rule. Only rules on content parse the page, unless their ``scopes`` are at hand, ``scoped``."""
    on_content = {name: r for name, r in rules.items() if r.on == "content"}
    unknown = {r.on for r in rules.values()} - {"content"} - set(parts)
    if unknown:
        raise KeyError(f"unknown parts: {sorted(unknown)}")
    out = pages
    if on_content:
        out = with_scopes(pages, [*on_content.values()], html, url) if scoped is None else pages.withColumn("__scopes", scoped)
    place = {name: i for i, name in enumerate(on_content)}
    source = lambda name, r: F.col("__scopes")[place[name]] if r.on == "content" else parts[r.on]
    return out.withColumns({name: attribute_value(r, source(name, r)) for name, r in rules.items()}).drop("__scopes")


def rules_of(entity: Entity) -> dict[str, Rule]:
    return {f"__{a.id}_{n}": r for a in entity.attributes.values() for n, r in a.rules.items()}


def with_records(pages: DataFrame, entity: Entity, extractor: Column, parts: dict[str, Column], html: str = "html", url: str = "url", scoped: Column | None = None) -> DataFrame:
    """``pages`` with a column (the attribute's db_col, cut to max_len) for each attribute of its extractor.

    Position i of the extractor is the number of the rule for attribute i; 0, none
    and unknown numbers leave it blank. Pages may have different extractors: a CASE
    over the rules of an attribute picks the one, in one projection.
    """
    out = with_rule_values(pages.withColumn("__extractor", extractor), rules_of(entity), parts, html, url, scoped)
    columns = {}
    for a in entity.attributes.values():
        number = F.get("__extractor", F.lit(a.id - 1))
        value = F.lit("")
        for n in a.rules:
            value = F.when(number == n, F.col(f"__{a.id}_{n}")).otherwise(value)
        columns[a.db_col] = cut(value, a.max_len) if a.max_len else value
    return out.select(*pages.columns, *record(columns))


def votes(url_lib: DataFrame) -> DataFrame:
    """layout_hash, extractor (as text), n: how many pages of a layout have each known extractor."""
    text = from_extractor(F.col("extractor"))
    return url_lib.filter(text != "[-1]").groupBy("layout_hash", text.alias("extractor")).agg(F.count("*").alias("n"))


def elected(url_lib: DataFrame, more_than: int = 0) -> DataFrame:
    """layout_hash, extractor, n: the extractor with most votes, the first as text of equals. One row a layout."""
    top = Window.partitionBy("layout_hash").orderBy(F.col("n").desc(), "extractor")
    return votes(url_lib).withColumn("__rank", F.row_number().over(top)).filter((F.col("__rank") == 1) & (F.col("n") > more_than)).drop("__rank")


def by_vote(queue: DataFrame, url_lib: DataFrame) -> DataFrame:
    """``queue`` (with layout_hash) with voted: the elected extractor as an array, null if its layout has none."""
    chosen = elected(url_lib).select(F.col("layout_hash").alias("__layout"), F.from_json("extractor", "array<int>").alias("voted"))
    return queue.join(chosen, F.col("layout_hash") == F.col("__layout"), "left").drop("__layout")


def rule_catalogue(spark: SparkSession, entity: Entity) -> DataFrame:
    rows = [(a.id, a.name, n, r.on, r.description) for a in entity.attributes.values() for n, r in a.rules.items()]
    return spark.createDataFrame(rows, "attribute int, name string, rule int, on_part string, description string")


def attribute_catalogue(spark: SparkSession, entity: Entity) -> DataFrame:
    rows = [(a.id, a.name, a.db_col, a.max_len, a.file, a.description) for a in entity.attributes.values()]
    return spark.createDataFrame(rows, "attribute int, name string, db_col string, max_len int, file string, description string")


def action_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, a[0], a[1]) for n, a in ACTIONS.items()], "action int, name string, description string")
