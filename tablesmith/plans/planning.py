"""Planning of a run behind the model seam: what is asked, which columns, which searches. A run has one row of each."""

from __future__ import annotations

import json
from typing import Any, Protocol

from tablesmith.operators.validate import Field


class TextModel(Protocol):
    def complete(self, task: str, prompt: str) -> str:
        """The model's answer (a JSON text) to one of the tasks interpret, schema, searches, expand, image_queries, scores."""


def decode(text: str, kind: type) -> Any:
    """The JSON value of a model's answer; ValueError where it isn't JSON of this kind."""
    found = json.loads(text)
    if not isinstance(found, kind):
        raise ValueError(f"expected {kind.__name__}, got {type(found).__name__}")
    return found


def _texts(value: Any, what: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{what} is not a list of texts")
    return value


def interpret(query: str, model: TextModel) -> dict:
    """What a query asks for: original_query, entity_type, attributes, constraints, languages (English if none)."""
    found = decode(model.complete("interpret", query), dict)
    if not isinstance(found.get("entity_type"), str):
        raise ValueError("entity_type is missing")
    lists = {k: _texts(found.get(k), k) for k in ("attributes", "constraints", "languages")}
    return {**found, **lists, "languages": lists["languages"] or ["en"], "original_query": query}


def plan_schema(intent: dict, model: TextModel) -> list[Field]:
    """The columns of the table to build; at least one."""
    found = decode(model.complete("schema", json.dumps(intent)), dict).get("columns")
    if not isinstance(found, list) or not found:
        raise ValueError("a schema needs columns")
    return [Field(c["name"], c.get("type", "text"), bool(c.get("required", False)), c.get("description", "")) for c in found]


def named_only(fields: list[Field]) -> list[Field]:
    """Without columns whose trimmed name is empty; ValueError if none is left."""
    left = [f for f in fields if f.name.strip()]
    if not left:
        raise ValueError("a schema needs a column with a name")
    return left


def plan_searches(intent: dict, fields: list[Field], model: TextModel) -> list[dict]:
    """The searches (query_text, language, priority 0 to 255) for the columns; at least one."""
    found = decode(model.complete("searches", json.dumps({"intent": intent, "columns": [f.name for f in fields]})), dict).get("queries")
    if not isinstance(found, list) or not found:
        raise ValueError("a plan needs searches")
    made = [{"query_text": q["query_text"], "language": q.get("language", "en"), "priority": q.get("priority", 1)} for q in found]
    if any(not isinstance(q["priority"], int) or not 0 <= q["priority"] <= 255 for q in made):
        raise ValueError("a priority lies outside 0..255")
    return made


def expand(queries: list[dict], languages: list[str], model: TextModel) -> list[dict]:
    """Further searches in the languages; there may be none, and equal ones stay."""
    found = decode(model.complete("expand", json.dumps({"queries": queries, "languages": languages})), dict).get("queries")
    if not isinstance(found, list):
        raise ValueError("queries are missing")
    return [{"query_text": q["query_text"], "language": q.get("language", "en"), "priority": q.get("priority", 1)} for q in found]


def positive(value: str | float | None, default: float) -> float:
    """A stop limit given by the user: it counts only if it is a number above 0."""
    try:
        found = float(value)
    except (TypeError, ValueError):
        return default
    return found if 0 < found < float("inf") else default


class OfflineModel:
    """Deterministic answers that need no service: the query is its own only search, two columns, words in common as score."""

    def complete(self, task: str, prompt: str) -> str:
        if task == "interpret":
            return json.dumps({"entity_type": prompt, "attributes": [], "constraints": [], "languages": []})
        if task == "schema":
            return json.dumps({"columns": [{"name": "name", "required": True}, {"name": "website", "type": "url", "required": True}]})
        if task == "searches":
            return json.dumps({"queries": [{"query_text": json.loads(prompt)["intent"]["original_query"]}]})
        if task == "scores":
            told = json.loads(prompt)
            want = set(told["query"].lower().split())
            return json.dumps([len(want & set(t.lower().split())) / max(1, len(want)) for t in told["titles"]])
        if task == "expand":
            return json.dumps({"queries": []})
        raise ValueError(f"no offline answer to {task}")
