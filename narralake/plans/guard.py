"""Free SQL over a scope: the statement must be a query, and every relation it reads must be one of the scope's tables.

The scope's tables are put into the text under an alias that nobody can guess; a walk over the analysed plan accepts what
lies under such an alias and constants, and refuses every other relation: files named by path, tables and views of the
catalog, streams. Statements that do something are refused before they are analysed, for they would run at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from narralake.plans.adapter import DRIVER, TABLES, Scope

#: Leaves that hold no stored rows, and functions that call into the JVM.
CONSTANTS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")
CALLS = re.compile(r"\b(reflect|try_reflect|java_method)\s*\(", re.I)
READS = ("SELECT", "WITH", "VALUES", "FROM", "(", "TABLE")


def _each(items: Any) -> Iterator[Any]:
    for i in range(items.size()):
        yield items.apply(i)


def foreign(plan: Any, mark: str, in_view: bool = False) -> list[str]:
    """Relations of an analysed plan, subqueries included, that don't lie under an alias that begins with the mark. Constants
    are no relations but in a view: its maker's rows may be constants, too."""
    name = plan.nodeName()
    if name == "SubqueryAlias" and plan.alias().startswith(mark):
        return []
    in_view = in_view or name == "View"
    below = [*_each(plan.children()), *_each(plan.subqueries())]
    if not below:
        return [] if name in CONSTANTS and not in_view else [name]
    return [x for child in below for x in foreign(child, mark, in_view)]


def guarded(scope: Scope, text: str, args: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a query over the scope's tables, named as {name}; PermissionError for anything else."""
    bare = re.sub(r"/\*.*?\*/|--[^\n]*", " ", text, flags=re.S).strip()
    if not bare:
        raise ValueError("Empty query")
    if not bare.upper().startswith(READS) or CALLS.search(bare):
        raise PermissionError("only queries are allowed")
    if re.search(r"\b(INSERT|CREATE|DROP|ALTER|SET|LOAD|REFRESH|CACHE|TRUNCATE|MERGE|DELETE|UPDATE|COPY|CALL|EXECUTE)\s+(INTO|OVERWRITE|TABLE|VIEW|OR|TEMPORARY|GLOBAL|DATABASE|SCHEMA|FUNCTION|LOCAL|IMMEDIATE)\b", bare, re.I):
        raise PermissionError("only queries are allowed")
    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))
    unknown = [n for n in names if n not in TABLES and n not in DRIVER]
    if unknown:
        raise ValueError(f"unknown table: {', '.join(unknown)}")
    mark = f"bound_{uuid.uuid4().hex}"
    found = scope.spark.sql(text, args=args or None, **{n: scope[n].alias(f"{mark}_{n}") for n in names})
    others = foreign(found._jdf.queryExecution().analyzed(), mark)
    if others:
        raise PermissionError(f"the query reads what the scope doesn't hold: {', '.join(sorted(set(others)))}")
    return found
