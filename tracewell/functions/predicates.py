"""Match blocks as two-valued Columns.

A missing value (null, or an empty text) satisfies only ``eq: ""``; any other test of it is false, so its negation is
true. Every leaf is therefore coalesced before it is negated.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clean_path, glob_regex, in_cidr, java_regex

TEXT_OPS = ("eq", "in", "contains", "prefix", "suffix", "glob", "regex", "not", "nocase")
NUMBER_OPS = ("eq", "in", "gt", "gte", "lt", "lte", "not")
REFERENCE = re.compile(r"^\$([A-Za-z_][A-Za-z0-9_]*)\.([a-z_]+)$")


class PatternError(ValueError):
    """A pattern that can't be compiled; the text names the field or role."""


def normal(spec: Any) -> dict[str, Any]:
    """The object form: a scalar means eq, a list means in."""
    return spec if isinstance(spec, dict) else {"in": spec} if isinstance(spec, list) else {"eq": spec}


def check(field: str, kind: str, spec: Any) -> None:
    """Raise for an operator that a field of this kind doesn't have, or a value it can't take."""
    legal = NUMBER_OPS if kind == "number" else (*TEXT_OPS, "cidr") if kind == "address" else TEXT_OPS
    spec = normal(spec)
    if not set(spec) - {"nocase"}:
        raise PatternError(f"{field}: no operator")
    for op, value in spec.items():
        if op not in legal:
            raise PatternError(f'{field}: operator "{op}" is not valid for a {kind} field')
        try:
            if op == "not":
                check(field, kind, value)
            elif kind == "number":
                [int(str(v)) for v in (value if op == "in" else [value])]
            elif op == "glob":
                glob_regex(value)
            elif op == "regex":
                re.compile(re.sub(r"\\z", r"\\Z", value))
                java_regex(value)
            elif op == "cidr":
                [ipaddress.ip_network(v, strict=False) for v in (value if isinstance(value, list) else [value])]
            if op == "in" and not value:
                raise ValueError("empty list")
        except PatternError:
            raise
        except (ValueError, TypeError, re.error) as e:
            raise PatternError(f"{field}: {op}: {e}") from e


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def predicate(col: Column, kind: str, spec: Any, captures: dict[str, tuple[Column, str]] | None = None) -> Column:
    """All operators of one field's object, and-ed. ``captures``: (column, kind) by ``name.field`` inside sequences."""
    spec = normal(spec)
    if kind == "number":
        return _all([F.coalesce(_number(col, op, v, captures), F.lit(False)) for op, v in spec.items()])
    nocase = bool(spec.get("nocase"))
    present = F.coalesce(col, F.lit("")) != ""
    tests = []
    for op, value in spec.items():
        if op == "nocase":
            continue
        if op == "not":
            tests.append(~predicate(col, kind, value, captures))
        elif op == "eq" and value == "":
            tests.append(~present)
        else:
            tests.append(present & F.coalesce(_text(col, kind, op, value, nocase, captures), F.lit(False)))
    return _all(tests)


def _number(col: Column, op: str, value: Any, captures) -> Column:
    if op == "not":
        return ~predicate(col, "number", value, captures)
    if op == "in":
        return col.isin([int(str(v)) for v in value])
    right = captured(value, captures)[0] if captured(value, captures) else F.lit(int(str(value)))
    return {"eq": col == right, "gt": col > right, "gte": col >= right, "lt": col < right, "lte": col <= right}[op]


def captured(value: Any, captures: dict[str, tuple[Column, str]] | None) -> tuple[Column, str] | None:
    if captures is None or not isinstance(value, str) or not (m := REFERENCE.match(value)):
        return None
    if f"{m[1]}.{m[2]}" not in captures:
        raise PatternError(f"{value}: no earlier step captures it")
    return captures[f"{m[1]}.{m[2]}"]


def _text(col: Column, kind: str, op: str, value: Any, nocase: bool, captures) -> Column:
    values = value if isinstance(value, list) else [value]
    if op in ("eq", "in", "prefix", "suffix", "contains") and (ref := captured(values[0], captures)) and len(values) == 1:
        right = ref[0]
        if kind == "path" and ref[1] == "path":
            col, right = clean_path(col), clean_path(right)
        right = F.when(F.coalesce(right, F.lit("")) != "", right)
        op = "eq" if op == "in" else op
    else:
        right = F.lit(values[0])
    if op == "in":
        return F.lower(col).isin([v.lower() for v in values]) if nocase else col.isin(values)
    if op in ("eq", "contains", "prefix", "suffix"):
        if nocase:
            col, right = F.lower(col), F.lower(right)
        return {"eq": lambda: col == right, "contains": lambda: F.contains(col, right), "prefix": lambda: F.startswith(col, right), "suffix": lambda: F.endswith(col, right)}[op]()
    if op == "glob":
        return col.rlike(("(?iu)" if nocase else "") + glob_regex(value))
    if op == "regex":
        return col.rlike(java_regex(value, nocase))
    return in_cidr(col, values)


def block(where: dict[str, Any] | None, kinds: dict[str, str], columns: dict[str, Column] | None = None, captures=None) -> Column:
    """All fields of a match block, and at least one of its any_of; an empty block holds."""
    tests = []
    for field, spec in (where or {}).items():
        if field == "any_of":
            if not spec:
                raise PatternError("any_of: empty")
            tests.append(reduce(lambda a, b: a | b, [block(x, kinds, columns, captures) for x in spec]))
            continue
        if field not in kinds:
            raise PatternError(f'unknown field "{field}", fields are {", ".join(sorted(kinds)) or "none"}')
        if not _refers(spec):
            check(field, kinds[field], spec)
        tests.append(predicate(columns[field] if columns else F.col(field), kinds[field], spec, captures))
    return _all(tests)


def _refers(spec: Any) -> bool:
    values = [v for op in normal(spec).values() for v in (op if isinstance(op, list) else [op])]
    return any(isinstance(v, str) and REFERENCE.match(v) for v in values)


def without_references(where: dict[str, Any] | None) -> dict[str, Any]:
    """The part of a block that needs no captured value: it can prune before the joins of a sequence."""
    return {f: s for f, s in (where or {}).items() if f == "any_of" and not any(_refers(s2) for x in s for s2 in x.values()) or f != "any_of" and not _refers(s)}
