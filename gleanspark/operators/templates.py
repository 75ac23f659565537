"""Extraction templates: user-declared record schemas, checked before any job starts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

TYPES = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean"}
RESERVED = {"doc_id", "_grounded", "_value_grounded", "_unit_grounded", "_ungrounded"}


class TemplateError(ValueError):
    """The message names the field at fault."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    enum: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Template:
    name: str
    fields: tuple[Field, ...]
    key_fields: tuple[str, ...] = field(default=())

    @property
    def keys(self) -> tuple[str, ...]:
        return self.key_fields or tuple(f.name for f in self.fields[:2])

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.fields if f.type in ("number", "integer")]

    @property
    def units(self) -> list[str]:
        return [f.name for f in self.fields if f.type == "string" and (f.name == "unit" or f.name.endswith("_unit"))]

    def unit_of(self, name: str) -> str | None:
        own = f"{name}_unit"
        return own if own in self.units else "unit" if "unit" in self.units else None

    def raw_schema(self) -> str:
        """All texts: values are cast after parsing, so that '1,165' isn't lost."""
        return ", ".join(f"`{f.name}` string" for f in self.fields)

    def json_schema(self) -> dict:
        kinds = {f.name: {"type": [f.type, "null"], **({"enum": [*f.enum, None]} if f.enum else {}), **({"description": f.description} if f.description else {})} for f in self.fields}
        row = {"type": "object", "properties": kinds, "required": list(kinds), "additionalProperties": False}
        return {"type": "object", "properties": {"records": {"type": "array", "items": row}}, "required": ["records"], "additionalProperties": False}


def parse_template(data: dict) -> Template:
    if not isinstance(data, dict):
        raise TemplateError("a template is an object")
    rows = data.get("fields")
    if not isinstance(rows, list) or not rows:
        raise TemplateError("fields: a list with entries is needed")
    seen: list[Field] = []
    for i, r in enumerate(rows):
        where = f"fields[{i}]"
        if not isinstance(r, dict) or set(r) - {"name", "type", "description", "enum"}:
            raise TemplateError(f"{where}: an object of name, type, description and enum is needed")
        name, kind, enum = r.get("name"), r.get("type", "string"), r.get("enum")
        if not isinstance(name, str) or not name.strip() or name in RESERVED or name in {f.name for f in seen}:
            raise TemplateError(f"{where}: the name {name!r} is missing, reserved or used twice")
        if kind not in TYPES:
            raise TemplateError(f"{name}: unknown type {kind!r}")
        if enum is not None and (kind != "string" or not isinstance(enum, list) or not enum):
            raise TemplateError(f"{name}: enum is a list with entries, for strings only")
        seen.append(Field(name, kind, tuple(enum or ()), r.get("description", "")))
    keys = data.get("key_fields", [])
    names = {f.name for f in seen}
    if not isinstance(keys, list) or set(keys) - names:
        raise TemplateError("key_fields: unknown fields")
    if "source_span" not in names:
        raise TemplateError("source_span is missing")
    return Template(data.get("name", "template"), tuple(seen), tuple(keys))


GENERIC = parse_template(
    {
        "name": "generic",
        "key_fields": ["subject", "attribute"],
        "fields": [{"name": n} for n in ("subject", "attribute")] + [{"name": "value", "type": "number"}] + [{"name": n} for n in ("value_text", "unit", "qualifier", "comparator")]
        + [{"name": "direction", "enum": ["higher", "lower", "no_change", "mixed", "na"]}, {"name": "significant", "enum": ["yes", "no", "na"]}, {"name": "p_value"}, {"name": "section"}, {"name": "value_source", "enum": ["text", "table", "figure", "na"]}, {"name": "notes"}, {"name": "source_span"}],
    }
)
STARTER = parse_template({"name": "starter", "key_fields": ["subject"], "fields": [{"name": "subject"}, {"name": "measure"}, {"name": "value", "type": "number"}, {"name": "unit"}, {"name": "status", "enum": ["confirmed", "unconfirmed", "na"]}, {"name": "notes"}, {"name": "source_span"}]})
BUILT_IN = {t.name: t for t in (GENERIC, STARTER)}


def load_template(what=None) -> Template:
    """A template by itself, dictionary, built-in name or path of a JSON file; nothing is the generic one."""
    if not what:
        return GENERIC
    if isinstance(what, Template):
        return what
    if isinstance(what, dict):
        return parse_template(what)
    if what in BUILT_IN:
        return BUILT_IN[what]
    if Path(what).is_file():
        return parse_template(json.loads(Path(what).read_text()))
    raise TemplateError(f"unknown template {what!r}")
