"""The pattern language: YAML to validated patterns and back. Plain driver-side Python."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..fields import EVENT_TYPES, PROCESS, SEVERITIES, fields_of
from ..functions.predicates import REFERENCE, PatternError, check

# Fixed limits of the language.
MAX_STEPS, MAX_COUNT, DEFAULT_DEPTH, MAX_DEPTH, DEFAULT_RATE = 8, 1000, 5, 16, 20
KEYS = {
    "pattern": {"name", "severity", "title", "description", "processes", "relationships", "exclude", "max_findings_per_window", "sequence"},
    "process": {"id", "conditions", "match", "events"}, "event": {"type", "count", "within", "distinct", "where"},
    "relationship": {"type", "parent", "child", "max_depth"}, "role exclusion": {"role", "match", "description"},
    "sequence": {"within", "order_tolerance", "steps"}, "step": {"role", "type", "where", "capture"}, "condition": {"type", "value"}, "exclusion": {"rules", "match", "description"},
}


@dataclass
class Requirement:
    type: str
    where: dict[str, Any] = field(default_factory=dict)
    count: int = 0
    distinct: str = ""
    within_us: int | None = None


@dataclass
class Role:
    id: str
    match: dict[str, Any] = field(default_factory=dict)
    conditions: list[tuple[str, str]] = field(default_factory=list)
    events: list[Requirement] = field(default_factory=list)


@dataclass
class Edge:
    type: str
    parent: str
    child: str
    max_depth: int = 1


@dataclass
class Step:
    role: str
    type: str
    where: dict[str, Any] = field(default_factory=dict)
    capture: str = ""


@dataclass
class Sequence:
    steps: list[Step]
    within_us: int | None = None
    tolerance_us: int | None = None


@dataclass
class Pattern:
    name: str
    severity: str = "MEDIUM"
    title: str = ""
    description: str = ""
    roles: list[Role] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    exclude: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    max_findings: int = DEFAULT_RATE
    sequence: Sequence | None = None


@dataclass
class Exclusion:
    rules: list[str]
    match: dict[str, Any]
    description: str = ""


@dataclass
class PatternSet:
    patterns: list[Pattern]
    exclusions: list[Exclusion] = field(default_factory=list)
    #: (entry, message) of entries that couldn't be loaded; the others are.
    problems: list[tuple[str, str]] = field(default_factory=list)
    #: Those entries as they were read, by section, so that saving doesn't lose them.
    rejected: dict[str, list[Any]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def duration_us(text: str) -> int:
    """``30s``, ``5m``, ``1m30s`` as microseconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|h|m|s)", str(text))
    if str(text) == "0":
        return 0
    if not parts or "".join(a + b for a, b in parts) != str(text):
        raise PatternError(f'"{text}" is not a duration')
    return round(sum(float(n) * _UNITS[u] for n, u in parts))


def duration_text(us: int) -> str:
    """The shortest spelling of a duration."""
    out = ""
    for unit in ("h", "m", "s", "ms", "us"):
        n, us = divmod(us, _UNITS[unit])
        out += f"{n}{unit}" if n else ""
    return out or "0s"


def _strict(node: Any, kind: str, path: str) -> dict:
    if not isinstance(node, dict):
        raise PatternError(f"{path}: a mapping is expected")
    for k in node:
        if k not in KEYS[kind]:
            raise PatternError(f'{path}: unknown key "{k}"')
    return node


def pattern_of(node: dict, path: str = "pattern") -> Pattern:
    node = _strict(node, "pattern", path)
    roles = []
    for i, p in enumerate(node.get("processes") or []):
        at = f"{path}.processes[{i}]"
        _strict(p, "process", at)
        events = []
        for j, e in enumerate(p.get("events") or []):
            _strict(e, "event", f"{at}.events[{j}]")
            events.append(Requirement(e.get("type", ""), e.get("where") or {}, int(e.get("count", 0)), e.get("distinct", ""), duration_us(e["within"]) if "within" in e else None))
        conditions = [(_strict(c, "condition", f"{at}.conditions")["type"], str(c.get("value", ""))) for c in p.get("conditions") or []]
        roles.append(Role(p.get("id", ""), p.get("match") or {}, conditions, events))
    edges = []
    for i, r in enumerate(node.get("relationships") or []):
        _strict(r, "relationship", f"{path}.relationships[{i}]")
        edges.append(Edge(r.get("type", ""), r.get("parent", ""), r.get("child", ""), int(r.get("max_depth", DEFAULT_DEPTH if r.get("type") == "DESCENDANT" else 1))))
    exclude = [(_strict(x, "role exclusion", f"{path}.exclude[{i}]")["role"], x["match"]) for i, x in enumerate(node.get("exclude") or [])]
    sequence = None
    if "sequence" in node:
        s = _strict(node["sequence"], "sequence", f"{path}.sequence")
        steps = [Step(_strict(x, "step", f"{path}.sequence.steps[{i}]").get("role", ""), x.get("type", ""), x.get("where") or {}, x.get("capture", "")) for i, x in enumerate(s.get("steps") or [])]
        sequence = Sequence(steps, duration_us(s["within"]) if "within" in s else None, duration_us(s["order_tolerance"]) if "order_tolerance" in s else None)
    return Pattern(node.get("name", ""), node.get("severity", "MEDIUM"), node.get("title", ""), node.get("description", ""), roles, edges, exclude, int(node.get("max_findings_per_window", 0)) or DEFAULT_RATE, sequence)


def _check_block(where: dict, kinds: dict[str, str], path: str, captures: dict[str, str] | None = None) -> None:
    for f, spec in (where or {}).items():
        if f == "any_of":
            if not spec:
                raise PatternError(f"{path}: any_of: empty")
            for x in spec:
                _check_block(x, kinds, path, captures)
            continue
        if f not in kinds:
            raise PatternError(f'{path}: unknown field "{f}", fields are {", ".join(sorted(kinds)) or "none"}')
        for op, v in (spec.items() if isinstance(spec, dict) else [("eq", spec)]):
            if captures is not None and isinstance(v, str) and (m := REFERENCE.match(v)):
                if op not in ("eq", "in", "prefix", "suffix", "contains"):
                    raise PatternError(f'{path}: {f}: operator "{op}" takes no captured value')
                known = fields_of(captures[m[1]]) | PROCESS if m[1] in captures else None
                if known is None or m[2] not in known:
                    raise PatternError(f"{path}: {f}: {v}: no earlier step captures it")
                if (kinds[f] == "number") != (known[m[2]] == "number"):
                    raise PatternError(f"{path}: {f}: {v}: the kinds differ")
                break
        else:
            check(f"{path}: {f}", kinds[f], spec)


def validate(p: Pattern, window_us: int = 300_000_000) -> None:
    """Raise the first structural, kind, threshold or sequence error."""
    if not p.name:
        raise PatternError("a pattern needs a name")
    if p.severity not in SEVERITIES:
        raise PatternError(f'severity "{p.severity}" is not one of {", ".join(SEVERITIES)}')
    if p.max_findings < 0:
        raise PatternError("max_findings_per_window is negative")
    ids = [r.id for r in p.roles]
    if len(set(ids)) != len(ids) or "" in ids:
        raise PatternError("role ids must be given and unique")
    for r in p.roles:
        _check_block(r.match, PROCESS, f"role {r.id}")
        for kind, _ in r.conditions:
            if kind not in ("PROCESS_NAME", "PROCESS_USER"):
                raise PatternError(f'role {r.id}: unknown condition "{kind}"')
        for e in r.events:
            at = f"role {r.id}: {e.type}"
            if e.type not in EVENT_TYPES:
                raise PatternError(f'role {r.id}: unknown event type "{e.type}", types are {", ".join(sorted(EVENT_TYPES))}')
            _check_block(e.where, fields_of(e.type), at)
            if e.count < 0 or e.count > MAX_COUNT:
                raise PatternError(f"{at}: count must be between 1 and {MAX_COUNT}")
            if (e.distinct or e.within_us is not None) and not e.count:
                raise PatternError(f"{at}: distinct and within need a count")
            if e.distinct and e.distinct not in fields_of(e.type):
                raise PatternError(f'{at}: unknown field "{e.distinct}"')
            if e.within_us is not None and not 0 < e.within_us <= window_us:
                raise PatternError(f"{at}: within must be positive and at most the window")
    for e in p.edges:
        if e.type not in ("SPAWNED", "DESCENDANT"):
            raise PatternError(f'unknown relationship "{e.type}"')
        if e.parent not in ids or e.child not in ids:
            raise PatternError(f"relationship names an unknown role: {e.parent}, {e.child}")
        if e.parent == e.child:
            raise PatternError(f"role {e.parent} can't be its own parent")
        if not 1 <= e.max_depth <= MAX_DEPTH or e.type == "SPAWNED" and e.max_depth != 1:
            raise PatternError(f"max_depth must be between 1 and {MAX_DEPTH}, for DESCENDANT only")
    if len(ids) > 1 and set(ids) - {x for e in p.edges for x in (e.parent, e.child)}:
        raise PatternError("every role must be related to another")
    if len(ids) > 1:
        met, grew = {ids[0]}, True
        while grew:
            grew = {x for e in p.edges if e.parent in met or e.child in met for x in (e.parent, e.child)} - met
            met |= grew
        if set(ids) - met:
            raise PatternError(f"the roles are not all connected: {', '.join(sorted(set(ids) - met))}")
    for role, match in p.exclude:
        if role not in ids:
            raise PatternError(f'exclude names an unknown role "{role}"')
        _check_block(match, PROCESS, f"exclude {role}")
    if (s := p.sequence) is not None:
        if not 1 <= len(s.steps) <= MAX_STEPS:
            raise PatternError(f"a sequence has 1 to {MAX_STEPS} steps")
        if s.within_us is not None and not 0 < s.within_us <= window_us or s.tolerance_us is not None and not 0 <= s.tolerance_us <= window_us:
            raise PatternError("within and order_tolerance must lie within the window")
        seen: dict[str, str] = {}
        for i, step in enumerate(s.steps):
            if step.role not in ids or step.type not in EVENT_TYPES:
                raise PatternError(f"step {i + 1}: unknown role or event type")
            _check_block(step.where, fields_of(step.type), f"step {i + 1}", seen)
            if step.capture:
                if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", step.capture) or step.capture in seen:
                    raise PatternError(f'step {i + 1}: capture "{step.capture}" must be a new identifier')
                seen[step.capture] = step.type


def load(text: str, window_us: int = 300_000_000) -> PatternSet:
    """Patterns and exclusions of a YAML document; a bad entry is reported and the rest loads."""
    tree = yaml.safe_load(text) or {}
    out = PatternSet([], warnings=[f'unknown key "{k}"' for k in tree if k not in ("patterns", "exclusions")])
    for i, node in enumerate(tree.get("patterns") or []):
        name = node.get("name", f"patterns[{i}]") if isinstance(node, dict) else f"patterns[{i}]"
        try:
            p = pattern_of(node, f"patterns[{i}]")
            validate(p, window_us)
            if any(q.name == p.name for q in out.patterns):
                raise PatternError(f'the name "{p.name}" is taken')
            out.patterns.append(p)
        except (PatternError, KeyError, TypeError, ValueError) as e:
            out.problems.append((name, str(e)))
            out.rejected.setdefault("patterns", []).append(node)
    for i, node in enumerate(tree.get("exclusions") or []):
        try:
            x = _strict(node, "exclusion", f"exclusions[{i}]")
            if not x.get("rules") or not x.get("match"):
                raise PatternError("an exclusion needs rules and a match")
            _check_block(x["match"], PROCESS, f"exclusions[{i}]")
            out.exclusions.append(Exclusion(list(x["rules"]), x["match"], x.get("description", "")))
        except PatternError as e:
            out.problems.append((f"exclusions[{i}]", str(e)))
            out.rejected.setdefault("exclusions", []).append(node)
    return out


def _plain(p: Pattern) -> dict:
    node: dict[str, Any] = {"name": p.name, "severity": p.severity, "title": p.title, "description": p.description, "processes": [], "relationships": []}
    for r in p.roles:
        own: dict[str, Any] = {"id": r.id}
        if r.conditions:
            own["conditions"] = [{"type": t, "value": v} for t, v in r.conditions]
        if r.match:
            own["match"] = r.match
        own["events"] = [{"type": e.type} | ({"count": e.count} if e.count else {}) | ({"within": duration_text(e.within_us)} if e.within_us is not None else {}) | ({"distinct": e.distinct} if e.distinct else {}) | ({"where": e.where} if e.where else {}) for e in r.events]
        node["processes"].append(own)
    node["relationships"] = [{"type": e.type, "parent": e.parent, "child": e.child} | ({"max_depth": e.max_depth} if e.type == "DESCENDANT" else {}) for e in p.edges]
    if p.exclude:
        node["exclude"] = [{"role": r, "match": m} for r, m in p.exclude]
    if p.max_findings != DEFAULT_RATE:
        node["max_findings_per_window"] = p.max_findings
    if p.sequence:
        s: dict[str, Any] = {} if p.sequence.within_us is None else {"within": duration_text(p.sequence.within_us)}
        if p.sequence.tolerance_us is not None:
            s["order_tolerance"] = duration_text(p.sequence.tolerance_us)
        s["steps"] = [{"role": x.role, "type": x.type} | ({"where": x.where} if x.where else {}) | ({"capture": x.capture} if x.capture else {}) for x in p.sequence.steps]
        node["sequence"] = s
    return node


def dump(found: PatternSet) -> str:
    tree: dict[str, Any] = {"patterns": [_plain(p) for p in found.patterns]}
    if found.exclusions:
        tree["exclusions"] = [{"rules": x.rules, "match": x.match} | ({"description": x.description} if x.description else {}) for x in found.exclusions]
    for section, nodes in found.rejected.items():
        tree[section] = tree.get(section, []) + nodes
    return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True)


def save(found: PatternSet, path: str) -> None:
    """Write beside the file, then rename."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(dump(found))
    os.replace(f"{path}.new", path)


class Reloader:
    """Loads a file again when its content has changed; a broken file leaves the last good patterns."""

    def __init__(self, path: str):
        self.path, self.digest, self.current = path, "", PatternSet([])

    def poll(self) -> bool:
        with open(self.path, "rb") as f:
            raw = f.read()
        if (digest := hashlib.sha256(raw).hexdigest()) == self.digest:
            return False
        self.digest = digest
        try:
            new = load(raw.decode())
        except (yaml.YAMLError, UnicodeDecodeError):
            return False
        if new.patterns or not new.problems:
            self.current = new
            return True
        return False


def draft_exclusion(rule: str, process: dict[str, str], modes: dict[str, str] | None = None) -> Exclusion:
    """An exclusion for a finding's process: its executable and user, and the first word of its command line.

    ``modes`` names the fields to go by instead, and how each is compared: ``eq`` and ``contains`` with the whole value, ``prefix``
    with the folder of an executable, or a command without its arguments. Fields that the process doesn't have are left out.
    """
    if modes is not None:
        chosen: dict[str, Any] = {}
        for name, mode in modes.items():
            if name not in PROCESS or mode not in ("eq", "prefix", "contains"):
                raise PatternError(f'"{name}: {mode}" is not a way to exclude a process')
            if not (value := process.get(name)):
                continue
            folder, _, _ = value.rpartition("/")
            if mode == "prefix" and name == "exe" and folder:
                value = folder + "/"
            elif mode == "prefix" and name == "cmdline" and " " in value:
                value = value.split(" ", 1)[0] + " "
            chosen[name] = {mode: value}
        if not chosen:
            raise PatternError("nothing is known about the process to exclude it by")
        return Exclusion([rule], chosen)
    match: dict[str, Any] = {k: {"eq": process[k]} for k in ("exe", "user") if process.get(k)}
    if not process.get("exe") and process.get("name"):
        match["name"] = {"eq": process["name"]}
    if words := (process.get("cmdline") or "").split():
        match["cmdline"] = {"prefix": words[0]}
    return Exclusion([rule], match)
