"""Scalar functions on hashes, URLs, extractor lists and display values."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE, MULTIPLE, UNKNOWN, NO = 1, 2, 0, -1
TARGETS = (SINGLE, MULTIPLE)
NO_EXTRACTOR = [-1]


def text_hash(text: Column) -> Column:
    """MD5 of the UTF-8 bytes, in hexadecimal digits."""
    return F.md5(text.cast("binary"))


def media_type(content_type: Column) -> Column:
    return F.substring_index(content_type, ";", 1)


def file_name(row_id: Column, content_type: Column) -> Column:
    """<id>.<subtype>"""
    return F.concat_ws(".", row_id.cast("string"), F.element_at(F.split(media_type(content_type), "/"), -1))


def to_extractor(text: Column) -> Column:
    """A list such as [1, 0, 3] from its text; null if it is none."""
    return F.from_json(text, "array<int>")


def from_extractor(extractor: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(extractor, lambda x: x.cast("string")), ", "), F.lit("]"))


def short_url(url: Column, most: int = 100, edge: int = 46) -> Column:
    """Both ends of a long URL."""
    return F.when(F.length(url) >= most, F.concat(F.substring(url, 1, edge), F.lit("......"), F.right(url, F.lit(edge)))).otherwise(url)


def js_string(text: Column) -> Column:
    """Line ends as a backslash and a blank."""
    return F.replace(text, F.lit("\n"), F.lit("\\ "))


def decision_value(letter: Column) -> Column:
    """M, S, N to the codes of decisions; null otherwise."""
    return F.when(letter == "M", MULTIPLE).when(letter == "S", SINGLE).when(letter == "N", NO)


def decision_style(decision: Column) -> Column:
    """A display class for each decision."""
    return F.when(decision == SINGLE, "success").when(decision == MULTIPLE, "info").when(decision == UNKNOWN, "warning").when(decision == NO, "danger")


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def cut(text: Column, most: int) -> Column:
    """At most so many characters (not bytes: no character is split)."""
    return F.substring(text, 1, most)


def host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) URL, "" otherwise."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def extension(url: Column) -> Column:
    """Lower-case extension of the path's last part, without the dot."""
    return F.lower(F.regexp_extract(path(url), r"\.([^./]+)$", 1))


def absolute(base: Column, reference: Column) -> Column:
    """The reference as an absolute URL, seen from the base."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, references in parts:
            yield pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(bases, references)])

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(base, reference)
