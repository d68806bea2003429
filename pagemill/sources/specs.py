"""Specifications: feature spaces, entities and rules, as dataclasses read from XML or made in code."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

REG_POLICIES = ("count", "exist")
POLICY_NAMES = ("sum", "max", "min", "avg", "prod", "div")


@dataclass(frozen=True)
class FeatureRule:
    """kind reg: one pattern; kind list: the patterns of a lexicon."""

    kind: str
    patterns: tuple[str, ...]
    sel: str = "text"
    weight: int = 1
    policy: str = ""

    def __post_init__(self):
        if self.kind not in ("reg", "list"):
            raise ValueError(f"neither reg nor list: {self.kind}")
        own = self.policy or ("count" if self.kind == "reg" else "sum")
        if own not in (REG_POLICIES if self.kind == "reg" else POLICY_NAMES):
            raise ValueError(f"no policy of {self.kind}: {own}")
        object.__setattr__(self, "policy", own)


@dataclass(frozen=True)
class Feature:
    id: str
    name: str
    rules: tuple[FeatureRule, ...]
    policy: str = "sum"
    description: str = "n/a"

    def __post_init__(self):
        if self.policy not in POLICY_NAMES:
            raise ValueError(f"no policy of a feature: {self.policy}")


@dataclass(frozen=True)
class Rule:
    """on: "content" (then sel and target say what of it) or the name of a part."""

    on: str
    actions: tuple[int, ...] = ()
    sel: str = ""
    target: str = "text"
    match: str | None = None
    after: str | None = None
    before: str | None = None
    description: str = ""

    def __post_init__(self):
        if self.on == "content" and self.target not in ("html", "text"):
            raise ValueError(f"neither html nor text: {self.target}")


@dataclass
class Attribute:
    id: int
    name: str
    db_col: str
    max_len: int
    file: str = ""
    description: str = ""
    rules: dict[int, Rule] = field(default_factory=dict)


@dataclass
class Entity:
    name: str
    attributes: dict[int, Attribute]

    def __post_init__(self):
        if sorted(self.attributes) != [*range(1, len(self.attributes) + 1)]:
            raise ValueError("the ids of attributes run from 1 without a gap")


@lru_cache(maxsize=256)
def lexicon(path: str) -> tuple[str, ...]:
    """One pattern a line. A missing file has none; an empty one has one, the empty pattern."""
    file = Path(path)
    return tuple(file.read_text().strip().split("\n")) if file.is_file() else ()


def feature_space(path: str) -> list[Feature]:
    """The features of an XML file, in document order; lexicons lie beside it."""
    home, out = Path(path).parent, []
    for node in ET.parse(path).getroot().iter("feature"):
        rules = []
        for r in node:
            text = r.text or ""
            patterns = (text,) if r.tag == "reg" else lexicon(str(home / text.strip()))
            rules.append(FeatureRule(r.tag, patterns, r.get("sel", "text"), int(r.get("weight", "1")), r.get("policy", "")))
        out.append(Feature(node.get("id", ""), node.get("name", ""), tuple(rules), node.get("policy", "sum"), node.get("description", "n/a")))
    return out


def rule_from_form(form: dict) -> Rule:
    """A rule as a web form sends it: match only where it is not empty, substring always."""
    return Rule(
        on=form["on"], sel=form.get("sel", ""), target=form.get("target", "text") or "text", match=form.get("match") or None,
        after=form.get("after", ""), before=form.get("before", ""), actions=tuple(int(a) for a in form.get("actions", ())), description=form.get("description", ""),
    )


def rules_of(path: str) -> dict[int, Rule]:
    out: dict[int, Rule] = {}
    if not Path(path).is_file():
        return out
    for node in ET.parse(path).getroot().iter("rule"):
        scope, match, sub = node.find("scope"), node.find("match"), node.find("substring")
        content = node.get("on") == "content" and scope is not None
        out[int(node.get("id"))] = Rule(
            on=node.get("on"), sel=scope.get("sel", "") if content else "", target=scope.get("target", "text") if content else "text",
            match=None if match is None else match.get("reg"), after=None if sub is None else sub.get("after", ""), before=None if sub is None else sub.get("before", ""),
            actions=tuple(int(a.get("id")) for a in node.iter("action")), description=node.get("description", ""),
        )
    return out


def entity(path: str, rules_dir: str) -> Entity:
    root = ET.parse(path).getroot()
    found = {}
    for a in root.iter("attribute"):
        file = (a.text or "").strip()
        found[int(a.get("id"))] = Attribute(
            int(a.get("id")), a.get("name", ""), a.get("db-col", ""), int(a.get("max-len", "0")), file, a.get("description", ""), rules_of(f"{rules_dir}/{file}")
        )
    return Entity(root.get("name", ""), found)


def add_rule(attribute: Attribute, rule: Rule, rules_dir: str | None = None) -> int:
    """The number of the new rule: one more than the largest. With ``rules_dir`` its file is written anew."""
    number = max(attribute.rules, default=0) + 1
    attribute.rules[number] = rule
    if rules_dir is not None:
        root = ET.Element("ruleset")
        for i, r in attribute.rules.items():
            node = ET.SubElement(root, "rule", id=str(i), description=r.description, on=r.on)
            if r.on == "content":
                ET.SubElement(node, "scope", sel=r.sel, target=r.target)
            if r.match is not None:
                ET.SubElement(node, "match", reg=r.match)
            if r.after is not None or r.before is not None:
                ET.SubElement(node, "substring", after=r.after or "", before=r.before or "")
            actions = ET.SubElement(node, "actions")
            for a in r.actions:
                ET.SubElement(actions, "action", id=str(a))
        ET.ElementTree(root).write(f"{rules_dir}/{attribute.file}", encoding="unicode")
    return number
