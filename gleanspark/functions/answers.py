"""Recovery of JSON from model answers, cut off or wrapped in prose as they may be; errors are data."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf


def strip_fences(text: str) -> str:
    return re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```[A-Za-z]*\s*", "", text.strip())).strip()


_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}]', re.S)


def salvage(text: str) -> list[dict]:
    """Complete outermost objects of a text that may be cut off; braces within strings don't count, nor do inner objects of a cut one."""
    found, depth, start = [], 0, 0
    for m in _MARK.finditer(text):
        mark = m[0]
        if mark == '"':
            break  # a string without an end: nothing after it is complete
        if mark == "{":
            start = start if depth else m.start()
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    found.append(json.loads(text[start : m.end()]))
                except ValueError:
                    pass
    return found


def _inside(text: str, left: str, right: str):
    a, b = text.find(left), text.rfind(right)
    if 0 <= a < b:
        try:
            return json.loads(text[a : b + 1])
        except ValueError:
            pass
    return None


def object_of(text: str | None) -> dict:
    """The object that a text is or holds; {} without one."""
    s = strip_fences(text or "")
    try:
        whole = json.loads(s)
        return whole if isinstance(whole, dict) else {}
    except ValueError:
        found = _inside(s, "{", "}")
        return found if isinstance(found, dict) else {}


def array_of(text: str | None, key: str = "records") -> list:
    """The records of an answer: an array, an envelope's list, a lone object, or what can be salvaged; ValueError without any."""
    if text is None:
        raise ValueError("no answer")
    s = strip_fences(text)
    if not s:
        return []
    try:
        whole = json.loads(s)
    except ValueError:
        whole = None
    if isinstance(whole, list):
        return whole
    if isinstance(whole, dict):
        return whole[key] if isinstance(whole.get(key), list) else next((v for v in whole.values() if isinstance(v, list)), [whole])
    if isinstance(found := _inside(s, "[", "]"), list):
        return found
    # a list that was cut off: its complete objects
    if "[" in s and (kept := salvage(s[s.index("[") :])):
        return kept
    raise ValueError("there is no JSON list in the answer")


def payload_of(text: str | None) -> list[dict]:
    """Records for a comparison: the list's objects, or else the object itself as the only one."""
    try:
        return [r for r in array_of(text) if isinstance(r, dict)]
    except ValueError:
        found = object_of(text)
        return [found] if found else []


def verdicts_of(text: str | None) -> list[dict]:
    """Verdicts of a screening answer: a list, or an envelope's ``verdicts``."""
    try:
        return [v for v in array_of(text, "verdicts") if isinstance(v, dict)]
    except ValueError:
        return []


def response_text(raw: dict) -> str:
    """The text of a responses-style answer: its ready-made text, else all text parts of its messages."""
    ready = raw.get("output_text")
    ready = "".join(t for t in ready if isinstance(t, str)) if isinstance(ready, list) else ready
    if isinstance(ready, str) and ready.strip():
        return ready
    messages = (m for m in raw.get("output") or () if isinstance(m, dict) and m.get("type", "message") in ("message", None))
    parts = (p for m in messages for p in m.get("content") or () if isinstance(p, dict))
    return "".join(p.get("text", "") for p in parts if p.get("type") in ("output_text", "text"))


def usage_from(payload: dict) -> dict:
    """Tokens under either naming; the total is their sum where it isn't given."""
    u = payload.get("usage") or {}
    n = {k: int(next((u[a] for a in names if u.get(a)), 0)) for k, names in (("prompt_tokens", ("prompt_tokens", "input_tokens")), ("completion_tokens", ("completion_tokens", "output_tokens")), ("total_tokens", ("total_tokens",)))}
    return n | {"total_tokens": n["total_tokens"] or n["prompt_tokens"] + n["completion_tokens"]}


FIGURE_SHAPE = {"figure_type": None, "caption": None, "axis_x": None, "axis_y": None, "items": [], "tables": [], "text_blocks": [], "notes": None}


def figure_payload(payload: dict) -> dict:
    """A figure's reading in its full shape: nothing missing, lists where lists belong."""
    given = {k: payload[k] for k in FIGURE_SHAPE if payload.get(k) is not None}
    return {k: given.get(k, v) if not isinstance(v, list) or isinstance(given.get(k), list) else [] for k, v in FIGURE_SHAPE.items()}


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def make_key(api: str, model: str, messages, temperature, max_tokens, json_schema=None, extra=None) -> str:
    """A call's key: SHA-256 of all that its answer depends on."""
    call = {"v": "1", "api": api, "model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, "json_schema": json_schema, "extra": extra or {}}
    return hashlib.sha256(canonical_json(call).encode()).hexdigest()


def records_column(answer: Column, key: str = "records") -> Column:
    """struct(records: array of JSON objects as text, error)."""

    @arrow_udf("struct<records: array<string>, error: string>")
    def parse(column: pa.Array) -> pa.Array:
        records, errors = [], []
        for text in column.to_pylist():
            try:
                records.append([json.dumps(r, ensure_ascii=False) for r in array_of(text, key) if isinstance(r, dict)])
                errors.append(None)
            except ValueError as e:
                records.append([])
                errors.append(str(e))
        return pa.StructArray.from_arrays([pa.array(records, pa.list_(pa.string())), pa.array(errors, pa.string())], ["records", "error"])

    return parse(answer)
