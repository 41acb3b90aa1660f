"""Syntax trees as indented text and as Graphviz source."""

from __future__ import annotations

from dataclasses import fields, is_dataclass


def _parts(node) -> tuple[str, list[tuple[str, object]]]:
    """Label and children."""
    if is_dataclass(node):
        plain, children = [], []
        for f in fields(node):
            value = getattr(node, f.name)
            if is_dataclass(value) or isinstance(value, tuple) and any(map(is_dataclass, value)):
                children.append((f.name, value))
            elif value not in (None, (), False):
                plain.append(f"{f.name}={','.join(map(str, value)) if isinstance(value, tuple) else value}")
        return " ".join([type(node).__name__, *plain]), children
    return "list", [(str(i), x) for i, x in enumerate(node)]


def to_text(node, depth: int = 0, role: str = "") -> str:
    label, children = _parts(node)
    line = "  " * depth + (f"{role}: " if role else "") + label + "\n"
    return line + "".join(to_text(child, depth + 1, name) for name, child in children)


def to_dot(node) -> str:
    lines, count = ["digraph ast {", "  node [shape=box];"], 0

    def walk(part) -> int:
        nonlocal count
        own, (label, children) = count, _parts(part)
        count += 1
        lines.append('  n%d [label="%s"];' % (own, label.replace("\\", "\\\\").replace('"', '\\"')))
        for name, child in children:
            lines.append(f'  n{own} -> n{walk(child)} [label="{name}"];')
        return own

    walk(node)
    return "\n".join([*lines, "}", ""])
