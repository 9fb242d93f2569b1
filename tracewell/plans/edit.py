"""Editing a pattern file by lines: what is wrong with an entry and where, and changes that leave the rest as it is written."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import yaml

from ..fields import PROCESS, fields_of
from ..functions.predicates import PatternError
from . import dsl

#: Which kind of mapping a key of each kind of mapping holds, or holds a list of.
_WITHIN = {
    "file": {"patterns": "pattern", "exclusions": "exclusion"},
    "pattern": {"processes": "process", "relationships": "relationship", "exclude": "role exclusion", "sequence": "sequence"},
    "process": {"conditions": "condition", "events": "event"}, "sequence": {"steps": "step"},
}


@dataclass(frozen=True)
class Problem:
    """``line`` counts from 1; 0 where none is known."""

    line: int
    path: str
    message: str


def _compose(text: str) -> tuple[yaml.Node | None, list[Problem]]:
    try:
        return yaml.compose(text, yaml.SafeLoader), []
    except yaml.MarkedYAMLError as e:
        mark = e.problem_mark or e.context_mark
        return None, [Problem(mark.line + 1 if mark else 0, "", e.problem or str(e))]


def _unknown(node: yaml.Node, kind: str, path: str, out: list[Problem]) -> None:
    """Every key, at any depth, that a mapping of its kind doesn't have."""
    if not isinstance(node, yaml.MappingNode):
        return
    for key, value in node.value:
        here = f"{path}.{key.value}" if path else key.value
        if key.value not in dsl.KEYS[kind]:
            out.append(Problem(key.start_mark.line + 1, here, "unknown key; there are " + ", ".join(sorted(dsl.KEYS[kind]))))
        elif inner := _WITHIN.get(kind, {}).get(key.value):
            items = value.value if isinstance(value, yaml.SequenceNode) else [value]
            for i, item in enumerate(items):
                _unknown(item, inner, f"{here}[{i}]" if isinstance(value, yaml.SequenceNode) else here, out)


def _at(node: yaml.Node, *path: str | int) -> yaml.Node:
    """The node at a path, or as near to it as there is one."""
    for step in path:
        if isinstance(node, yaml.SequenceNode) and isinstance(step, int) and step < len(node.value):
            node = node.value[step]
        elif isinstance(node, yaml.MappingNode) and (found := [v for k, v in node.value if k.value == step]):
            node = found[0]
        else:
            break
    return node


def _blocks(tree: dict) -> list[tuple[tuple, Any, dict[str, str]]]:
    """(path, match block, fields) of all blocks of an entry whose surroundings are sound enough to tell."""
    each = lambda x: [(i, y) for i, y in enumerate(x) if isinstance(y, dict)] if isinstance(x, list) else []
    out = []
    for i, p in each(tree.get("processes")):
        out.append((("processes", i, "match"), p.get("match"), PROCESS))
        out += [(("processes", i, "events", j, "where"), e.get("where"), fields_of(e.get("type"))) for j, e in each(p.get("events"))]
    out += [(("exclude", i, "match"), x.get("match"), PROCESS) for i, x in each(tree.get("exclude"))]
    return [(path, block, kinds) for path, block, kinds in out if block is not None]


def pattern_problems(text: str, window_us: int = 300_000_000) -> list[Problem]:
    """Everything that is wrong with one pattern that an editor holds, by line: syntax, keys, every match block, and, once
    these are right, the first thing that the pattern as a whole breaks. Empty if it can be saved."""
    node, out = _compose(text)
    if out or node is None:
        return out or [Problem(0, "", "there is no pattern")]
    if not isinstance(node, yaml.MappingNode):
        return [Problem(node.start_mark.line + 1, "", "a mapping is expected")]
    _unknown(node, "pattern", "", out)
    tree = yaml.safe_load(text)
    for path, block, kinds in _blocks(tree):
        parts = block.items() if isinstance(block, dict) else [(None, block)]
        for name, spec in parts:
            try:
                dsl._check_block({name: spec} if name is not None else spec, kinds, "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path).lstrip("."))
            except (PatternError, TypeError, ValueError) as e:
                at = _at(node, *path, *([name] if name is not None else []))
                out.append(Problem(at.start_mark.line + 1, ".".join(map(str, path)) + (f".{name}" if name else ""), str(e)))
    if not out:
        try:
            dsl.validate(dsl.pattern_of(tree, "pattern"), window_us)
        except (PatternError, KeyError, TypeError, ValueError, AttributeError) as e:
            out.append(Problem(node.start_mark.line + 1, "", str(e)))
    return sorted(out, key=lambda p: p.line)


def exclusion_problems(text: str) -> list[Problem]:
    """The same for a list of exclusions, by itself or under its key."""
    node, out = _compose(text)
    if out or node is None:
        return out
    if isinstance(node, yaml.MappingNode):
        out += [Problem(k.start_mark.line + 1, k.value, "unknown key; there is exclusions") for k, _ in node.value if k.value != "exclusions"]
        node = _at(node, "exclusions")
    if not isinstance(node, yaml.SequenceNode):
        return out or [Problem(node.start_mark.line + 1, "", "a list is expected")]
    for i, item in enumerate(node.value):
        before = len(out)
        _unknown(item, "exclusion", f"[{i}]", out)
        if len(out) == before:
            entry = yaml.safe_load(yaml.serialize(item))
            found = dsl.load(yaml.safe_dump({"exclusions": [entry]})).problems
            out += [Problem(item.start_mark.line + 1, f"[{i}]", message) for _, message in found]
    return sorted(out, key=lambda p: p.line)


def _span(lines: list[str], node: yaml.Node) -> tuple[int, int]:
    """Lines of a node; blank lines and comments after it belong to what follows."""
    block = isinstance(node, yaml.CollectionNode) and not node.flow_style
    end = node.end_mark.line + (0 if block else 1)  # a block ends where what follows begins
    while end > node.start_mark.line + 1 and (not lines[end - 1].strip() or lines[end - 1].lstrip().startswith("#")):
        end -= 1
    return node.start_mark.line, end


def _block(value: Any, indent: int) -> list[str]:
    return [" " * indent + x + "\n" for x in yaml.safe_dump(value, sort_keys=False, allow_unicode=True).splitlines()]


def _section(text: str, name: str) -> tuple[list[str], yaml.Node | None, yaml.Node | None]:
    """The file's lines, and the key and the list of a section."""
    lines = text.splitlines(keepends=True)
    if lines and not lines[-1].endswith("\n"):
        lines[-1] += "\n"
    root = yaml.compose("".join(lines), yaml.SafeLoader)
    for key, value in root.value if isinstance(root, yaml.MappingNode) else []:
        if key.value == name:
            return lines, key, value
    return lines, None, None


def append_exclusion(text: str, exclusion: dsl.Exclusion) -> str:
    """The file with one more exclusion at the end of its list; every other line, comments too, stays as it is."""
    entry = {"rules": exclusion.rules, "match": exclusion.match} | ({"description": exclusion.description} if exclusion.description else {})
    lines, key, held = _section(text, "exclusions")
    if key is None:
        return "".join([*lines, "exclusions:\n", *_block([entry], 2)])
    if not isinstance(held, yaml.SequenceNode) or held.flow_style or not held.value:
        old = yaml.safe_load(yaml.serialize(held)) or []
        return replace_exclusions(text, [*old, entry])
    at = _span(lines, held.value[-1])[1]
    lines[at:at] = _block([entry], held.start_mark.column)
    return "".join(lines)


def replace_exclusions(text: str, entries: list[dict]) -> str:
    """The file with other exclusions; nothing else changes. Without entries the section goes."""
    lines, key, held = _section(text, "exclusions")
    new = ["exclusions:\n", *_block(entries, 2)] if entries else []
    if key is None:
        return "".join([*lines, *new])
    lines[key.start_mark.line : max(_span(lines, held)[1], key.start_mark.line + 1)] = new
    return "".join(lines)


def replace_pattern(text: str, name: str, edited: str) -> str:
    """The file with the pattern of that name as ``edited`` describes it; nothing else changes. Refuses what has problems."""
    if problems := pattern_problems(edited):
        raise PatternError("; ".join(f"line {p.line}: {p.message}" for p in problems))
    lines, key, held = _section(text, "patterns")
    for item in held.value if isinstance(held, yaml.SequenceNode) else []:
        if isinstance(item, yaml.MappingNode) and any(k.value == "name" and v.value == name for k, v in item.value):
            if held.flow_style:
                raise PatternError("a list in brackets is edited as a whole")
            begin, end = _span(lines, item)
            dash = held.start_mark.column
            body = edited.strip("\n").splitlines()
            lines[begin:end] = [" " * dash + ("- " if i == 0 else "  ") + x + "\n" if x.strip() else "\n" for i, x in enumerate(body)]
            return "".join(lines)
    raise PatternError(f'there is no pattern "{name}"')
