"""Checks of queries in text and of their parameters, before anything runs."""

from __future__ import annotations

import re
from typing import Any

from narralake.operators.validation import ENUMS

#: Operations that change a graph.
DANGEROUS = ("DELETE", "DROP", "CREATE", "MERGE", "SET", "REMOVE", "DETACH")
#: Parameters that a query can't do without, and those of an enumeration.
REQUIRED = ("story_id", "user_id")
ENUM_PARAMETERS = ("knowledge_type", "importance_level", "severity", "relationship_type", "emotional_valence", "confidence_level")
#: What a query that holds all these words is told.
HINTS = (
    (("CHARACTER", "KNOWS"), "Consider using 'character_knowledge_at_time' template for character knowledge queries"),
    (("RELATIONSHIP", "CHARACTER"), "Consider using 'character_relationships_detailed' template for relationship analysis"),
    (("CONTRADICTS",), "Consider using 'contradictions_by_severity' template for contradiction analysis"),
)
WANTED = (("STORY_ID", "Add story_id filter for better performance and data isolation"), ("USER_ID", "Add user_id filter for proper data isolation"))
ADVICE = ((("ORDER BY",), "Consider adding appropriate indexes for ORDER BY clauses"), (("VALID_FROM", "VALID_TO"), "Use temporal indexes for better performance on temporal queries"))
ENUM_HINT = "Use enum constraints to improve query performance"


def enum_error(name: str, value: Any, enums: dict[str, tuple[str, ...]] = ENUMS) -> str:
    """Empty if the value is allowed."""
    if name not in enums:
        return f"Enum '{name}' not found in schema"
    return "" if value in enums[name] else f"Value '{value}' not in allowed enum values: {list(enums[name])}"


def parameter_errors(params: dict[str, Any]) -> list[str]:
    found = [f"Missing required parameter: {name}" for name in REQUIRED if name not in params]
    found += [f"Parameter '{name}': {error}" for name in ENUM_PARAMETERS if name in params for error in [enum_error(name, params[name])] if error]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 1 <= x <= 10
    return found + [f"{name} must be an integer between 1 and 10" for name in ("relationship_strength", "trust_level") if name in params and not whole(params[name])]


def _balanced(query: str) -> bool:
    open_, pairs = {"(": 0, "[": 0, "{": 0}, {")": "(", "]": "[", "}": "{"}
    for ch in query:
        if ch in open_:
            open_[ch] += 1
        elif ch in pairs:
            open_[pairs[ch]] -= 1
            if open_[pairs[ch]] < 0:
                return False
    return not any(open_.values())


def query_error(query: str, strict_substring: bool = False, enums: dict[str, tuple[str, ...]] = ENUMS) -> str:
    """Empty if a pattern query may run. strict_substring: a forbidden word counts inside others too (created_at holds CREATE)."""
    upper, lower = query.upper(), query.lower()
    for word in DANGEROUS:
        if word in upper if strict_substring else re.search(rf"\b{word}\b", upper):
            return f"Dangerous operation '{word}' detected. Only read operations are allowed."
    if "STORY_ID" not in upper:
        return "Query must include story_id filter for data isolation"
    if not _balanced(query) or "MATCH" not in upper or "RETURN" not in upper:
        return "Invalid Cypher syntax detected"
    unbound = "valid_from" in lower and not any(op in query for op in "<>=")
    open_end = "valid_to" in lower and "is null" not in lower and "is not null" not in lower
    if unbound or open_end:
        return "Invalid temporal query pattern. Use proper temporal constraints."
    literals = re.findall(r"'([^']+)'", query) + re.findall(r'"([^"]+)"', query)
    wrong = [f"Enum value '{x}' has incorrect case. Use: {list(values)}" for values in enums.values() for x in literals if x not in values and x.lower() in [v.lower() for v in values]]
    return f"Enum validation errors: {'; '.join(wrong)}" if wrong else ""


def suggestions(query: str, enums: dict[str, tuple[str, ...]] = ENUMS) -> list[str]:
    upper = query.upper()
    out = [text for words, text in HINTS if all(w in upper for w in words)]
    out += [text for word, text in WANTED if word not in upper]
    out += [text for words, text in ADVICE if any(w in upper for w in words)]
    return out + [ENUM_HINT] * any(name.upper() in upper for name in enums)
