"""Expression trees of the statistic language.

Three kinds of node: a name, a constant, and a call. Operators, assignments, blocks,
conditions and loops are calls too, of `+`, `<-`, `{`, `if`, `for` and so on, so that one
walk handles every form. Nodes are immutable and compare by value, which is what common
sub-expressions are found by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass


class StatError(ValueError):
    """A statistic that can't be compiled or run."""


@dataclass(frozen=True)
class Name:
    id: str


@dataclass(frozen=True)
class Const:
    """A constant: a float, int or bool, None for NA, or a tuple of these."""

    value: float | int | bool | None | tuple

    # 1, 1.0 and True are different constants
    def __eq__(self, other: object) -> bool:
        return isinstance(other, Const) and repr(self.value) == repr(other.value)

    def __hash__(self) -> int:
        return hash(repr(self.value))


@dataclass(frozen=True)
class Call:
    """fn(args). names: the argument names, None where an argument is given by place."""

    fn: str
    args: tuple[Node, ...] = ()
    names: tuple[str | None, ...] = ()

    def __post_init__(self) -> None:
        if not self.names:
            object.__setattr__(self, "names", (None,) * len(self.args))


Node = Name | Const | Call

BINARY = {"||": 1, "|": 1, "&&": 2, "&": 2, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%%": 7, "%/%": 7, ":": 8, "^": 10}
ASSIGN = ("<-", "=")


def is_call(node: Node, *fns: str) -> bool:
    return isinstance(node, Call) and node.fn in fns


def rewrite(node: Node, f: Callable[[Node], Node]) -> Node:
    """f on every node, the inner ones first."""
    if isinstance(node, Call):
        node = Call(node.fn, tuple(rewrite(a, f) for a in node.args), node.names)
    return f(node)


def walk(node: Node) -> Iterator[Node]:
    """Every node, the inner ones first, from left to right."""
    if isinstance(node, Call):
        for a in node.args:
            yield from walk(a)
    yield node


def assigned(node: Node) -> list[str]:
    """The names that a node assigns, in order."""
    out: list[str] = []
    for n in walk(node):
        if is_call(n, *ASSIGN) and isinstance(n.args[0], Name):
            out.append(n.args[0].id)
        elif is_call(n, "for"):
            out.append(n.args[0].id)
    return list(dict.fromkeys(out))


def free_names(node: Node) -> list[str]:
    """Names that are used before anything assigns them, in order of appearance."""
    found: dict[str, None] = {}

    def go(n: Node, bound: set[str]) -> set[str]:
        """The names bound after n."""
        if isinstance(n, Name):
            if n.id not in bound:
                found.setdefault(n.id)
            return bound
        if not isinstance(n, Call):
            return bound
        if n.fn in ASSIGN and isinstance(n.args[0], Name):
            return go(n.args[1], bound) | {n.args[0].id}
        if n.fn == "for":
            bound = go(n.args[1], bound) | {n.args[0].id}
            go(n.args[2], bound)  # the body may not run
            return bound | set(assigned(n.args[2]))
        if n.fn == "if":
            bound = go(n.args[0], bound)
            after = [go(b, bound) for b in n.args[1:]]
            return set.intersection(*after) if len(after) == 2 else bound
        for a in n.args:
            bound = go(a, bound)
        return bound

    go(node, set())
    return list(found)


def show(node: Node, level: int = 0) -> str:
    """The source text of a tree."""
    if isinstance(node, Name):
        return node.id
    if isinstance(node, Const):
        return _show_value(node.value)
    pad, a = "    " * level, node.args
    if node.fn == "{":
        inner = "".join(f"{pad}    {show(x, level + 1)}\n" for x in a)
        return f"{{\n{inner}{pad}}}"
    if node.fn in ASSIGN:
        return f"{show(a[0], level)} <- {show(a[1], level)}"
    if node.fn == "if":
        text = f"if ({show(a[0], level)}) {show(a[1], level)}"
        return text + (f" else {show(a[2], level)}" if len(a) > 2 else "")
    if node.fn == "for":
        return f"for ({show(a[0])} in {show(a[1], level)}) {show(a[2], level)}"
    if node.fn == "[":
        return f"{_grouped(a[0], 99, level)}[{', '.join(show(x, level) for x in a[1:])}]"
    if node.fn in BINARY and len(a) == 2:
        p = BINARY[node.fn]
        left, right = (p + 1, p) if node.fn == "^" else (p, p + 1)
        space = "" if node.fn in ("^", ":") else " "
        return f"{_grouped(a[0], left, level)}{space}{node.fn}{space}{_grouped(a[1], right, level)}"
    if node.fn in ("-", "+", "!") and len(a) == 1:
        return f"{node.fn}{_grouped(a[0], 9 if node.fn != '!' else 3, level)}"
    return f"{node.fn}({', '.join((f'{n} = ' if n else '') + show(x, level) for n, x in zip(node.names, a))})"


def _grouped(node: Node, least: int, level: int) -> str:
    own = 99
    if isinstance(node, Call) and node.fn in BINARY and len(node.args) == 2:
        own = BINARY[node.fn]
    elif is_call(node, "-", "+", "!"):
        own = 9 if node.fn != "!" else 3
    elif is_call(node, "if", "for", *ASSIGN):
        own = 0
    elif isinstance(node, Const) and not isinstance(node.value, (tuple, bool)) and node.value is not None and node.value < 0:
        own = 9
    return show(node, level) if own >= least else f"({show(node, level)})"


def _show_value(v: object) -> str:
    if v is None:
        return "NA"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, tuple):
        return f"c({', '.join(map(_show_value, v))})"
    if isinstance(v, int):
        return f"{v}L"
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Inf" if v > 0 else "-Inf"
    return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
