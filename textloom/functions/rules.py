"""Recursive rules from JSON."""

from __future__ import annotations

import json

from textloom.functions.spans import DEFAULT_RULES, Level


def rules_from_json(data: str, default: tuple[Level, ...] = DEFAULT_RULES) -> tuple[Level, ...]:
    """An array of {"delimiters": [...], "attach": "prev"} or {"token": true}. An empty text gives `default`, an empty array the default rules."""
    if not data.strip():
        return default
    try:
        rows = json.loads(data)
    except ValueError as e:
        raise ValueError(f"rules: {e}") from None
    if not isinstance(rows, list):
        raise ValueError("rules: want an array of levels")
    out = []
    for i, row in enumerate(rows):
        if not isinstance(row, dict) or set(row) - {"delimiters", "attach", "token"}:
            raise ValueError(f"rules: level {i}: want an object with delimiters, attach or token")
        delimiters, token, attach = row.get("delimiters") or [], row.get("token", False), row.get("attach", "")
        if not isinstance(delimiters, list) or any(not isinstance(d, str) for d in delimiters) or not isinstance(token, bool):
            raise ValueError(f"rules: level {i}: delimiters are strings and token is true or false")
        if bool(delimiters) == token:
            raise ValueError(f"rules: level {i}: want either delimiters or token")
        if any(not d for d in delimiters):
            raise ValueError(f"rules: level {i}: delimiters must not be empty strings")
        if attach not in ("", "prev"):
            raise ValueError(f"rules: level {i}: attach must be prev")
        out.append(Level(tuple(delimiters), "prev", token))
    return tuple(out) or DEFAULT_RULES
