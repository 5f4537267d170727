"""What Python files define, call, inherit, compose, branch on and import, as one table of facts."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, fact string, owner string, name string, receiver string, kind string, line long, line_end long, visibility string, parent string, value string, ordinal int"
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
#: Bases of enums, types that are no classes of a project, and types that wrap one.
_ENUMS = {a + b for a in ("", "enum.") for b in ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")}
_PLAIN = set("int str bool float list dict tuple set bytes None".split())
_WRAPPERS = set(
    "list List dict Dict Optional Union set Set frozenset FrozenSet Sequence Iterable Iterator Collection Mapping MutableMapping MutableSequence MutableSet Deque DefaultDict OrderedDict Counter ChainMap Tuple tuple".split()
)
_MAPS = {"dict", "mapping", "mutablemapping", "defaultdict", "ordereddict"}
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_of(path: str) -> str:
    parts = path.removeprefix("src/").removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def composed_class(x: ast.expr) -> str | None:
    """The class that an annotation is about: inside wrappers, without None; null where there are several or only plain types."""
    if isinstance(x, ast.Constant) and isinstance(x.value, str):
        return None
    if isinstance(x, ast.BinOp) and isinstance(x.op, ast.BitOr):
        return _only_one(_alternatives(x))
    if isinstance(x, ast.Subscript):
        outer, inner = ast.unparse(x.value), x.slice.elts if isinstance(x.slice, ast.Tuple) else [x.slice]
        if outer == "Union":
            return _only_one(inner)
        if outer.lower() in _MAPS and outer in _WRAPPERS:
            return next((c for a in reversed(inner) if (c := composed_class(a))), None)
        if outer in _WRAPPERS:
            return composed_class(inner[0]) if inner else None
        return None if _is_plain(outer) else outer
    text = ast.unparse(x)
    return None if _is_plain(text) or "." in text else text


def _alternatives(x: ast.expr) -> list[ast.expr]:
    return [*_alternatives(x.left), *_alternatives(x.right)] if isinstance(x, ast.BinOp) and isinstance(x.op, ast.BitOr) else [x]


def _is_plain(text: str) -> bool:
    return text in _PLAIN or len(text) == 1 and text.isupper()


def _only_one(types: list[ast.expr]) -> str | None:
    left = [t for t in types if not _is_plain(ast.unparse(t))]
    return composed_class(left[0]) if len(left) == 1 else None


def _is_literal(x: ast.expr | None, nested: bool = True) -> bool:
    if isinstance(x, ast.UnaryOp):
        x = x.operand
        nested = False
    if isinstance(x, ast.Constant):
        return x.value is not ...
    return nested and isinstance(x, (ast.Tuple, ast.List, ast.Set)) and all(_is_literal(e) for e in x.elts)


def _own(body):
    """Nodes below the statements of body but not those of definitions within it, in order."""
    todo = list(reversed(body))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (*_DEF, ast.ClassDef)):
            todo.extend(reversed(list(ast.iter_child_nodes(n))))


def _names(x: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(x) if isinstance(n, ast.Name)}


def _branches(f) -> list[str]:
    """Parameters that a condition of f's own code looks at."""
    a = f.args
    params = {p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))} - {"self", "cls"}
    tests = [n.test for n in _own(f.body) if isinstance(n, (ast.If, ast.While, ast.IfExp))] + [n.subject for n in _own(f.body) if isinstance(n, ast.Match)]
    return sorted(params & set().union(*map(_names, tests)))


class _File:
    """Facts of one file. Definitions in functions and in classes' classes are private; a call belongs to the innermost definition of its line."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.rows, self.spans = path, text, [], []
        tree = ast.parse(text)
        self.body(tree.body, module_of(path), top=True)
        self.uses(tree)
        self.imports(tree.body)

    def add(self, fact: str, owner: str | None, name: str, line: int, **more) -> None:
        self.rows.append(tuple((more | {"path": self.path, "fact": fact, "owner": owner, "name": name, "line": line}).get(c) for c in _COLUMNS))

    def symbol(self, n, prefix: str, kind: str, private: bool, parent: str | None = None, name: str | None = None) -> str:
        name = name or n.name
        full = f"{prefix}.{name}" if prefix else name
        public = not private and (not name.startswith("_") or bool(re.fullmatch(r"__\w+__", name)))
        self.add("symbol", full, name, n.lineno, kind=kind, line_end=n.end_lineno, visibility="public" if public else "private", parent=parent)
        if kind != "constant":
            self.spans.append((-n.lineno, n.end_lineno, full, kind))
        return full

    def body(self, body, prefix: str, top: bool = False) -> None:
        """Definitions among statements: of a module, or anywhere in a function."""
        for n in body if top else _own(body):
            if isinstance(n, _DEF):
                self.function(n, prefix, "function", not top)
            elif isinstance(n, ast.ClassDef):
                self.klass(n, prefix, not top, top)
            elif top and isinstance(n, (ast.Assign, ast.AnnAssign)):
                self.constant(n, prefix)

    def function(self, n, prefix: str, kind: str, private: bool, parent: str | None = None) -> None:
        full = self.symbol(n, prefix, kind, private, parent)
        for p in _branches(n):
            self.add("branch", full, p, n.lineno)
        self.body(n.body, full)

    def klass(self, n: ast.ClassDef, prefix: str, private: bool, top: bool) -> None:
        bases = [b.value if isinstance(b, ast.Subscript) else b for b in n.bases]
        bases = [ast.unparse(b) for b in bases if isinstance(b, (ast.Name, ast.Attribute))]
        enum = top and bool(_ENUMS & set(bases))
        full = self.symbol(n, prefix, "enum" if enum else "class", private)
        for b in bases if not enum else ():
            self.add("edge", full, b, n.lineno, kind="inherits")
        place = 0
        for m in n.body:
            if isinstance(m, _DEF):
                self.function(m, full, "method", False, n.name)
                if m.name == "__init__":
                    for s in m.body:
                        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Attribute) and isinstance(s.target.value, ast.Name) and s.target.value.id == "self":
                            self.composes(full, s, s.target.attr)
            elif isinstance(m, ast.ClassDef):
                self.klass(m, full, True, False)
            elif isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name):
                self.composes(full, m, m.target.id)
            if isinstance(m, (ast.Assign, ast.AnnAssign)) and isinstance(t := m.targets[0] if isinstance(m, ast.Assign) else m.target, ast.Name):
                self.add("member" if enum else "slot", full, t.id, m.lineno, value=self.source(m.value) if _is_literal(m.value, False) else None, ordinal=place)
                place += 1

    def composes(self, full: str, n: ast.AnnAssign, attribute: str) -> None:
        if target := composed_class(n.annotation):
            self.add("edge", full, target, n.lineno, kind="composes", value=attribute)

    def constant(self, n, prefix: str) -> None:
        target = n.target if isinstance(n, ast.AnnAssign) else n.targets[0] if len(n.targets) == 1 else None
        if isinstance(target, ast.Name) and (isinstance(n, ast.AnnAssign) or re.fullmatch(r"_?[A-Z][A-Z0-9_]*", target.id)) and n.value is not None and _is_literal(n.value):
            full = self.symbol(n, prefix, "constant", False, name=target.id)
            self.add("member", full, target.id, n.lineno, value=self.source(n.value), ordinal=0)

    def source(self, x: ast.expr) -> str:
        return ast.get_source_segment(self.text, x)

    def uses(self, tree: ast.Module) -> None:
        self.spans.sort()
        for n in ast.walk(tree):
            if not isinstance(n, ast.Call):
                continue
            owner = next((full for lo, hi, full, _ in self.spans if -lo <= n.lineno <= hi), None)
            f = n.func
            if owner is None:
                continue
            if isinstance(f, ast.Name) and f.id != "super":
                self.add("call", owner, f.id, n.lineno)
                if re.fullmatch(r"[A-Z][A-Za-z0-9]*", f.id):
                    self.add("edge", owner, f.id, n.lineno, kind="instantiates")
            elif isinstance(f, ast.Attribute):
                x = f.value
                if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == "super":
                    self.add("call", owner, f"super.{f.attr}", n.lineno, receiver="super")
                elif isinstance(x, (ast.Name, ast.Attribute)):
                    on = ast.unparse(x)
                    self.add("call", owner, f"{on}.{f.attr}", n.lineno, receiver=on)

    def imports(self, body) -> None:
        """Imports of the module's own statements, in order: owner is the module, name what it binds, value its name there; ordinal counts, as the last binding holds."""
        folder = self.path.split("/")[:-1]
        for i, n in enumerate(body):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.add("import", a.name.replace(".", "/"), a.asname or a.name, n.lineno, ordinal=i, kind="absolute")
            elif isinstance(n, ast.ImportFrom):
                at = [*folder[: len(folder) - n.level + 1], *(n.module or "").split(".")] if n.level else (n.module or "").split(".")
                for a in n.names:
                    self.add("import", "/".join(filter(None, at)), a.asname or a.name, n.lineno, value=a.name, ordinal=i, kind="relative" if n.level else "absolute")


def python_facts(files: DataFrame) -> DataFrame:
    """FACTS of files (path, text), a row each; a file that does not parse has one, `error`. Null texts count as empty.

    symbol: kind, lines, visibility, parent class. call: the callee as written, its receiver. edge: inherits, instantiates (a
    bare call of a capitalised name) or composes (value: the attribute). member: of enums by place, and constants. slot: what would be members if a class were an enum. branch: a
    parameter that a condition looks at. import: see imports.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    rows += _File(path, text or "").rows
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append(tuple({"path": path, "fact": "error", "name": str(e)}.get(c) for c in _COLUMNS))
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({c: "Int64" for c in ("line", "line_end", "ordinal")})

    # many paths may stand in one small file, which makes one task; AQE would put few bytes into one again, so the number is given
    parts = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "text").repartition(parts, "path").mapInPandas(run, FACTS)
