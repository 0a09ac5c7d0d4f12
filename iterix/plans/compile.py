"""Statistics: from source to a checked, rewritten tree, and from arguments to bindings."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from iterix.functions.registry import FUNCTIONS, required
from iterix.plans.local import Local, as_vector
from iterix.plans.parse import parse
from iterix.plans.tree import ASSIGN, Call, Const, Name, Node, StatError, assigned, free_names, is_call, rewrite, show, walk

DOTS = "..."


class Expr:
    """A tree that Python's operators build on; what a traced Python function works with."""

    def __init__(self, node: Node):
        self.node = node

    def _op(self, fn: str, other: object, swap: bool = False) -> Expr:
        pair = (as_node(other), self.node) if swap else (self.node, as_node(other))
        return Expr(Call(fn, pair))

    def __neg__(self):
        return Expr(Call("-", (self.node,)))

    def __pos__(self):
        return Expr(Call("+", (self.node,)))

    def __invert__(self):
        return Expr(Call("!", (self.node,)))

    def __getitem__(self, i):
        return self._op("[", i)

    def __bool__(self):
        raise StatError("a traced value has no truth; use fn.ifelse, or write the statistic as text")

    def __iter__(self):
        raise StatError("a traced value can't be looped over; write the statistic as text")

    __hash__ = None


for _name, _fn in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "pow": "^", "and": "&", "or": "|"}.items():
    setattr(Expr, f"__{_name}__", lambda self, other, f=_fn: self._op(f, other))
    setattr(Expr, f"__r{_name}__", lambda self, other, f=_fn: self._op(f, other, True))
for _name, _fn in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}.items():
    setattr(Expr, f"__{_name}__", lambda self, other, f=_fn: self._op(f, other))


class _Functions:
    """fn.sum(x, na_rm=True) builds a call; a trailing underscore is dropped, other underscores of argument names are dots."""

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        name = name.rstrip("_")

        def call(*args: object, **named: object) -> Expr:
            nodes = (*map(as_node, args), *map(as_node, named.values()))
            return Expr(Call(name, nodes, (*(None for _ in args), *(k.replace("_", ".") for k in named))))

        return call


fn = _Functions()


def as_node(x: object) -> Node:
    if isinstance(x, Expr):
        return x.node
    if isinstance(x, (Name, Const, Call)):
        return x
    v = as_vector(x)
    return Const(v[0]) if len(v) == 1 and (x is None or isinstance(x, (bool, int, float))) else Const(tuple(v))


class Checked(list):
    """A result with what came of comparing it with plain evaluation of the code as it was written."""

    def __init__(self, values: list, identical: bool, all_equal: bool):
        super().__init__(values)
        self.identical, self.all_equal = identical, all_equal


@dataclass(frozen=True)
class Stat:
    """A compiled statistic. original: as written; processed: what runs."""

    params: tuple[str, ...]
    original: Node
    processed: Node
    defaults: Mapping[str, Node] = field(default_factory=dict)
    env: Mapping[str, object] = field(default_factory=dict)
    plain: Node | None = None  # what check compares with

    def code(self, raw: bool = False) -> str:
        """The source: as processed, or as written."""
        return show(self.original if raw else self.processed)

    def __call__(self, *args: object, **named: object) -> list:
        """The statistic of plain vectors, on the driver."""
        bound = bind(self, dict(enumerate(args)) | named, {})
        out = bound.local({k: as_vector(v) for k, v in bound.data.items()})
        if self.plain is None:
            return out
        want = replace(self, processed=self.plain, plain=None)(*args, **named)
        close = len(out) == len(want) and all(a is b or a == b or a != a and b != b or None not in (a, b) and abs(a - b) <= 1.5e-8 * max(abs(a), abs(b)) for a, b in zip(out, want))
        return Checked(out, repr(out) == repr(want), close)


def stat(source: str | Node | Expr | Callable, params: Sequence[str] | None = None, *, defaults: Mapping[str, object] | None = None, env: Mapping[str, object] | None = None, optimize: bool = True, check: bool = False) -> Stat:
    """Compile a statistic.

    source: text, a tree, or a Python function, which is traced with its parameters.
    params: names of the parameters; by default the free names, in order of appearance.
    env: constants and functions that iteration-constant expressions may use.
    check: whether calls on plain vectors are compared with evaluation without any rewriting.
    """
    defaults, env = {k: as_node(v) for k, v in (defaults or {}).items()}, dict(env or {})
    if callable(source) and not isinstance(source, Expr):
        found = inspect.signature(source).parameters.values()
        params = [DOTS if p.kind is p.VAR_POSITIONAL else p.name for p in found]
        defaults = {p.name: as_node(p.default) for p in found if p.default is not p.empty} | defaults
        source = source(*(Expr(Name(p)) for p in params))
    original = parse(source) if isinstance(source, str) else as_node(source)
    if params is None:
        params = [n for n in _visible(original, env) if n not in env]
        if not params:
            raise StatError("the statistic has no free name; name its parameters")
    if len(set(params)) < len(params):
        raise StatError("parameters must differ")
    matched = _match(original, tuple(params), env)
    tree = _transform(matched)
    _check(tree)
    return Stat(tuple(params), original, reuse_calls(tree) if optimize else tree, defaults, env, _transform(matched, squares=False) if check else None)


def _visible(node: Node, env: Mapping[str, object]) -> list[str]:
    """Free names outside calls of functions that are not of the language."""
    hidden = rewrite(node, lambda n: Const(0.0) if isinstance(n, Call) and n.fn not in FUNCTIONS else n)
    return [DOTS if n.startswith("..") and n[2:].isdigit() else n for n in dict.fromkeys(free_names(hidden))]


def _match(node: Node, params: tuple[str, ...], env: Mapping[str, object]) -> Node:
    """Arguments by place get theirs; left-out ones their defaults. Data arguments go by place after that, constants by name."""

    def one(n: Node) -> Node:
        if not isinstance(n, Call):
            return n
        f = FUNCTIONS.get(n.fn)
        if f is None:
            if n.fn not in env:
                raise StatError(f"`{n.fn}` is not supported")
            return n
        if n.fn in ("+", "-") and len(n.args) == 1:
            return Call({"+": "uplus", "-": "uminus"}[n.fn], n.args)
        has_dots = any(isinstance(a, Name) and a.id == DOTS for a in n.args)
        open_ended = DOTS in f.params
        given: dict[str, Node] = {}
        rest: list[Node] = []
        names = [p for p in f.params if p != DOTS]
        for name, a in zip(n.names, n.args):
            if name is None or (open_ended and name not in names):
                rest.append(a)
            elif name not in names:
                raise StatError(f"`{n.fn}` has no argument `{name}`")
            elif name in given:
                raise StatError(f"`{n.fn}` gets `{name}` twice")
            else:
                given[name] = a
        if not open_ended:
            left = [p for p in names if p not in given]
            if len(rest) > len(left) and not has_dots:
                raise StatError(f"`{n.fn}` gets too many arguments")
            if has_dots:
                return Call(n.fn, n.args, n.names)
            given |= dict(zip(left, rest))
            lacks = [p for p in required(f) if p not in given]
            if lacks:
                raise StatError(f"`{n.fn}` needs `{lacks[0]}`")
        data = [given[p] for p in names if p in given and p not in f.constant]
        constants = {k: given.get(k, Const(v)) for k, v in f.defaults}
        if n.fn == "numeric":
            data = []
        return Call(n.fn, (*(rest if open_ended else ()), *data, *constants.values()), (*(None for _ in (rest if open_ended else ())), *(None for _ in data), *constants))

    return rewrite(node, one)


def _transform(node: Node, squares: bool = True) -> Node:
    def one(n: Node) -> Node:
        if squares and is_call(n, "^") and n.args[1] in (Const(2.0), Const(2)):
            return Call("square", n.args[:1])
        if is_call(n, *ASSIGN) and is_call(n.args[0], "["):
            x, *i = n.args[0].args
            if not isinstance(x, Name) or len(i) != 1:
                raise StatError("only `x[i] <- y` of a name x can be assigned to")
            return Call("<-", (x, Call("subassign", (x, i[0], n.args[1]))))
        if is_call(n, "="):
            return Call("<-", n.args)
        return n

    return rewrite(node, one)


def _check(tree: Node) -> None:
    def go(n: Node, may_assign: bool) -> None:
        if not isinstance(n, Call):
            return
        if n.fn == "<-":
            if not may_assign:
                raise StatError("an assignment can't be an argument")
            if not isinstance(n.args[0], Name):
                raise StatError(f"can't assign to `{show(n.args[0])}`")
            go(n.args[1], is_call(n.args[1], "<-", "{", "if"))
        elif n.fn in ("{", "if", "for"):
            for k, a in enumerate(n.args):
                go(a, may_assign and not (k == 0 and n.fn == "if") and not (k == 1 and n.fn == "for"))
        else:
            for a in n.args:
                go(a, False)
        if n.fn == "mean":
            trim = dict(zip(n.names, n.args)).get("trim")
            if isinstance(trim, Const) and trim.value != 0:
                raise StatError("`trim` of `mean` must be 0")

    go(tree, True)


def reuse_calls(tree: Node) -> Node:
    """Give calls that occur twice or more, with the same names in them, a name of their own.

    Works on statements without branches and loops; a value found there may not be
    computed on every path. The largest repeated calls come first.
    """
    statements = tree.args if is_call(tree, "{") else (tree,)
    if any(is_call(n, "if", "for") for s in statements for n in walk(s)):
        return tree
    out: list[Node] = []
    done: dict[Node, Name] = {}
    version: dict[str, int] = {}

    def seen(node: Node, counts: dict[Node, int]) -> None:
        if isinstance(node, Call) and node.fn != "<-":
            counts[node] = counts.get(node, 0) + 1
            if counts[node] > 1:
                return  # what is inside is counted once
        if isinstance(node, Call):
            for a in node.args[1:] if node.fn == "<-" else node.args:
                seen(a, counts)

    # a name that is assigned again is another value
    def stamped(node: Node) -> Node:
        return rewrite(node, lambda n: Name(f"{n.id}@{version[n.id]}") if isinstance(n, Name) and version.get(n.id) else n)

    def plain(node: Node) -> Node:
        return rewrite(node, lambda n: Name(n.id.partition("@")[0]) if isinstance(n, Name) else n)

    marked: list[Node] = []
    for s in statements:
        names = []
        while is_call(s, "<-"):
            names.append(s.args[0])
            s = s.args[1]
        s = stamped(s)
        for n in names:
            version[n.id] = version.get(n.id, 0) + 1
        for n in names:
            s = Call("<-", (n, s))
        marked.append(s)
    counts: dict[Node, int] = {}
    for s in marked:
        seen(s, counts)
    repeated = {n for n, k in counts.items() if k > 1 and any(isinstance(x, Name) for x in walk(n))}

    def use(node: Node) -> Node:
        if node in done:
            return done[node]
        if not isinstance(node, Call):
            return node
        new = Call(node.fn, (node.args[0], *map(use, node.args[1:])) if node.fn == "<-" else tuple(map(use, node.args)), node.names)
        if node in repeated:
            done[node] = Name(f".reused_{len(done) + 1}")
            out.append(Call("<-", (done[node], plain(new))))
            return done[node]
        return new

    for s in marked:
        new = plain(use(s))
        out.append(new)
    return out[0] if len(out) == 1 else Call("{", tuple(out))


@dataclass(frozen=True)
class Bound:
    """A statistic with its arguments. data: varying ones by name; constants: vectors by name."""

    tree: Node
    data: dict[str, object]
    constants: dict[str, list]
    env: Mapping[str, object]

    def local(self, data: Mapping[str, list]) -> list:
        return Local(self.constants | dict(data), _callables(self.env))(self.tree)


def _callables(env: Mapping[str, object]) -> dict[str, Callable]:
    return {k: v for k, v in env.items() if callable(v)}


def bind(s: Stat, data: Mapping[int | str, object] | Sequence, more: Mapping[int | str, object]) -> Bound:
    """Match arguments to parameters: by name, then by place, data before the constants of more."""
    given = [(k, v, True) for k, v in (data if isinstance(data, Mapping) else dict(enumerate(data))).items()]
    given += [(k, v, False) for k, v in (more if isinstance(more, Mapping) else dict(enumerate(more))).items()]
    params = [p for p in s.params if p != DOTS]
    matched: dict[str, tuple[object, bool]] = {}
    rest: list[tuple[str | int, object, bool]] = []
    for k, v, varies in given:
        if isinstance(k, str) and k in params:
            if k in matched:
                raise StatError(f"`{k}` is given twice")
            matched[k] = (v, varies)
        else:
            rest.append((k, v, varies))
    dots: list[tuple[str | int, object, bool]] = []
    left = [p for p in params if p not in matched]
    for k, v, varies in rest:
        if isinstance(k, str):
            if DOTS not in s.params:
                raise StatError(f"the statistic has no parameter `{k}`")
            dots.append((k, v, varies))
        elif left and not (DOTS in s.params and s.params.index(left[0]) > s.params.index(DOTS)):
            matched[left.pop(0)] = (v, varies)
        elif DOTS in s.params:
            dots.append((k, v, varies))
        else:
            raise StatError(f"the statistic takes {len(params)} arguments, got more")
    tree = s.processed
    if DOTS in s.params:
        matched |= {f"..{k}": (v, varies) for k, (_, v, varies) in enumerate(dots, 1)}
        labels = [k if isinstance(k, str) else None for k, _, _ in dots]

        def spread(n: Node) -> Node:
            if not isinstance(n, Call) or not any(isinstance(a, Name) and a.id == DOTS for a in n.args):
                return n
            args, names = [], []
            for name, a in zip(n.names, n.args):
                if isinstance(a, Name) and a.id == DOTS:
                    args += [Name(f"..{k}") for k in range(1, len(dots) + 1)]
                    names += labels
                else:
                    args.append(a)
                    names.append(name)
            keep = {x: y for x, y in zip(names, args) if x in FUNCTIONS[n.fn].constant} if n.fn in FUNCTIONS else {}
            rest_args = [(x, y) for x, y in zip(names, args) if x not in keep]
            args, names = [y for _, y in rest_args] + list(keep.values()), [x for x, _ in rest_args] + list(keep)
            return Call(n.fn, tuple(args), tuple(names))

        tree = _match(rewrite(tree, spread), s.params, s.env)
    constants = {k: as_vector(v) for k, v in s.env.items() if not callable(v)}
    constants |= {k: as_vector(v) for k, (v, varies) in matched.items() if not varies}
    varying = {k: v for k, (v, varies) in matched.items() if varies}
    for p in params:
        if p not in matched:
            if p not in s.defaults:
                raise StatError(f"parameter `{p}` is not given")
            default = _transform(_match(s.defaults[p], s.params, s.env))
            constants[p] = _constant(default, constants, varying, s.env)
    return Bound(_fold(tree, constants, varying, s.env), varying, constants, s.env)


def _constant(node: Node, constants: Mapping[str, list], varying: Mapping[str, object], env: Mapping[str, object], set_here: frozenset[str] = frozenset()) -> list:
    for n in walk(node):
        if isinstance(n, Name) and (n.id in varying or n.id in set_here):
            raise StatError(f"`{n.id}` varies by iteration, but `{show(node)}` must be constant")
    return Local(constants, _callables(env))(node)


def _fold(tree: Node, constants: Mapping[str, list], varying: Mapping[str, object], env: Mapping[str, object]) -> Node:
    """Replace calls of the caller's functions, and constant arguments, by their values."""
    set_here = frozenset(assigned(tree))

    def value(node: Node) -> Const:
        v = _constant(node, constants, varying, env, set_here)
        return Const(v[0]) if len(v) == 1 else Const(tuple(v))

    def go(n: Node) -> Node:
        if not isinstance(n, Call):
            return n
        f = FUNCTIONS.get(n.fn)
        if f is None:
            return value(n)
        args = tuple(value(a) if name in f.constant else go(a) for name, a in zip(n.names, n.args))
        for name, a in zip(n.names, args):
            if name == "na.rm" and a.value not in (True, False):
                raise StatError("`na.rm` must be TRUE or FALSE")
            if name == "trim" and a.value != 0:
                raise StatError("`trim` of `mean` must be 0")
        return replace(n, args=args)

    return go(tree)
