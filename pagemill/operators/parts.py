"""Parts of a page: text, html, tag, title, keyword, description, url, layout.

Parts that regular expressions can give are columns of SQL functions; those that
need a tree come from one UDF that parses a page once and returns only the parts
asked for. It is a plain one: a worker holds a hundred pages, while an Arrow batch
holds ten thousand, with their parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.regex import java_pattern
from pagemill.functions.scalars import cut, text_hash

TITLE_LIMIT = 128
NAMES = ("text", "html", "tag", "title", "keyword", "description", "url", "layout")
ENTITIES = {"&quot;": '"', "&middot;": "·", "&copy;": "©", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&#39;": "'", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The usual entities as characters; &amp; last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def native_title(html: Column) -> Column:
    """Texts of all title elements, with blanks between."""
    return decoded(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), " "))


def short_title(title: Column) -> Column:
    return cut(title, TITLE_LIMIT)


def native_tags(html: Column) -> Column:
    """All tags that end on their line, with blanks between."""
    return F.array_join(F.regexp_extract_all(html, F.lit(java_pattern("<.*?>")), F.lit(0)), " ")


def native_text(html: Column) -> Column:
    """Tags as line ends: close to the tree's text, and JVM-side."""
    return F.regexp_replace(html, "<[^>]*>", "\n")


def native_meta(html: Column, name: str) -> Column:
    """Contents of meta elements named Name, then of those named name."""
    one = lambda n: F.regexp_extract_all(html, F.lit(rf'<meta\s[^>]*?name="{n}"[^>]*?content="([^"]*)"'), F.lit(1))
    return decoded(F.array_join(F.concat(one(name.capitalize()), one(name.lower())), " "))


def native(html: Column, url: Column) -> dict[str, Column]:
    """Parts without a tree; text, html and tag are those of the raw bytes."""
    return {
        "text": native_text(html), "html": html, "tag": native_tags(html), "title": native_title(html),
        "keyword": native_meta(html, "keywords"), "description": native_meta(html, "description"), "url": url,
    }


#: A selector, None if it is beyond the subset, and what to take of the elements: html or text.
Scope = tuple[list[list[H.Step]] | None, str]


def page_parts(html: str, url: str, names: list[str], script_text: bool = True, scopes: list[Scope] = []) -> dict[str, str | list[str]]:
    """From the tree. script_text: whether text takes what stands in script and style. scopes: what to select besides, as the part scopes."""
    out: dict[str, str | list[str]] = {}
    if scopes or set(names) - {"url"}:
        root = H.parse(html)
        if "layout" in names:  # before references change
            out["layout"] = H.layout(root)
        H.absolute_references(root, url)
        markup = H.serialised(root) if {"html", "tag"} & set(names) else ""
        for name in names:
            if name == "text":
                skip = set() if script_text else {id(c) for n in root.walk() if n.tag in ("script", "style") for c in n.children}
                out[name] = "\n".join(t for t in root.texts() if id(t) not in skip)
            elif name == "html":
                out[name] = markup
            elif name == "tag":
                out[name] = " ".join(H.re.findall("<.*?>", markup))
            elif name == "title":
                out[name] = " ".join(n.text() for n in root.walk() if n.tag == "title")
            elif name == "keyword":
                out[name] = H.meta(root, "Keywords", "keywords")
            elif name == "description":
                out[name] = H.meta(root, "Description", "description")
        if scopes:
            out["scopes"] = [H.scope(root, s, t) if s is not None else "" for s, t in scopes]
    if "url" in names:
        out["url"] = url
    return out


def with_parts(pages: DataFrame, names: list[str], html: str = "html", url: str = "url", into: str = "parts", script_text: bool = True, scopes: list[Scope] = []) -> DataFrame:
    """``pages`` with a struct of the parts asked for, and of scopes if there are any, from the tree. Null html counts as empty."""
    unknown = set(names) - set(NAMES)
    if unknown:
        raise KeyError(f"unknown parts: {sorted(unknown)}")

    def run(markup: str | None, at: str | None) -> tuple:
        found = page_parts(markup or "", at or "", names, script_text, scopes)
        return tuple(found[n] for n in wanted)

    wanted = [*names, *["scopes"] * bool(scopes)]
    schema = ", ".join(f"{n} {'array<string>' if n == 'scopes' else 'string'}" for n in wanted)
    return pages.withColumn(into, F.udf(run, schema, useArrow=False)(F.col(html), F.col(url)))


def hashed(pages: DataFrame, into: str | None = None) -> DataFrame:
    """``pages`` (url, html) with title, content_hash, layout_hash; ``into``: the struct of parts, if they have title and layout already."""
    p = into or "__p"
    out = pages if into else with_parts(pages, ["title", "layout"], into=p)
    out = out.withColumns({"title": short_title(F.col(f"{p}.title")), "content_hash": text_hash(F.col("html")), "layout_hash": text_hash(F.col(f"{p}.layout"))})
    return out if into else out.drop(p)
