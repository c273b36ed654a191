"""Facts of one Python source: imports, calls, functions, classes, constants. Standard library only; runs in parse tasks.

Sizes and shapes are counted on the standard syntax tree, so two functions have equal shapes exactly when their trees agree
up to names and literals.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections import Counter

#: Heads of calls that never lead to another module.
SKIPPED_HEADS = frozenset(
    "self cls super print len range isinstance issubclass type str int float bool list tuple dict set frozenset bytes bytearray "
    "iter next getattr setattr hasattr delattr callable id hash repr open zip map filter sorted reversed enumerate min max sum "
    "abs round any all vars dir object Exception ValueError TypeError KeyError AttributeError RuntimeError StopIteration "
    "NotImplementedError ImportError IndexError OSError FileNotFoundError".split()
)
#: Calls and raised names that end a program, those of the latter that are errors to a framework.
EXIT_CALLS = ("sys.exit", "os._exit", "exit")
EXIT_ERRORS = ("ClickException", "UsageError", "Abort", "Exit")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_DEFS, ast.ClassDef)


def decode(raw: bytes) -> str:
    """The text of a source by its declared encoding; undecodable bytes are replaced."""
    try:
        name, _ = tokenize.detect_encoding(io.BytesIO(raw).readline)
        return raw.decode(name, "replace")
    except (SyntaxError, LookupError):
        return raw.decode("utf-8", "replace")


def _is_name(node: ast.AST, dotted: str) -> bool:
    try:
        return ast.unparse(node) == dotted
    except (ValueError, AttributeError):
        return False


def _guards_main(test: ast.AST) -> bool:
    if isinstance(test, ast.BoolOp):
        return isinstance(test.op, ast.And) and any(map(_guards_main, test.values))
    if not isinstance(test, ast.Compare) or len(test.ops) != 1 or not isinstance(test.ops[0], ast.Eq):
        return False
    sides = (test.left, test.comparators[0])
    return any(isinstance(s, ast.Name) and s.id == "__name__" for s in sides) and any(isinstance(s, ast.Constant) and s.value == "__main__" for s in sides)


def _branches(node: ast.AST) -> int:
    """What a node adds to the cyclomatic complexity."""
    if isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp):
        return 1
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.match_case):
        return 1 + (node.guard is not None)
    return 0


def _token(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        v = node.value
        return "BOOL" if isinstance(v, bool) else "NONE" if v is None else "STR" if isinstance(v, str | bytes) else type(v).__name__.upper()
    return "STR" if isinstance(node, ast.JoinedStr) else type(node).__name__


def _body(fn) -> tuple[int, list[str], list[str]]:
    """Complexity, folded tokens and exact tokens of a function's body without nested definitions."""
    count, shape, exact, todo = 1, [], [], list(reversed(fn.body))
    while todo:
        n = todo.pop()
        if isinstance(n, _SCOPES):
            todo.extend(reversed(n.decorator_list))
            continue
        count += _branches(n)
        shape.append(_token(n))
        exact.append(_token(n) + ":" + repr([v for _, v in ast.iter_fields(n) if not isinstance(v, ast.AST | list)]))
        if not isinstance(n, ast.JoinedStr):
            todo.extend(reversed(list(ast.iter_child_nodes(n))))
    return count, shape, exact


def _digest(tokens: list[str]) -> str:
    return hashlib.blake2b("\0".join(tokens).encode("utf-8", "replace"), digest_size=16).hexdigest() if tokens else ""


def _trivial(fn) -> bool:
    """A body of a docstring, pass, ..., one plain return or a raise of NotImplementedError at most."""
    rest = [s for s in fn.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    if not rest:
        return True
    s = rest[0]
    plain = lambda v: v is None or isinstance(v, ast.Constant | ast.Name | ast.Attribute)
    return len(rest) == 1 and (isinstance(s, ast.Pass) or (isinstance(s, ast.Return) and plain(s.value)) or (isinstance(s, ast.Raise) and s.exc is not None and "NotImplementedError" in ast.unparse(s.exc)))


def _depth(body: list) -> int:
    """The deepest nesting of compound statements."""
    deep = 0
    for s in body:
        if isinstance(s, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.Try | ast.Match):
            inner = [*getattr(s, "body", []), *getattr(s, "orelse", []), *getattr(s, "finalbody", [])]
            for h in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
                inner += h.body
            deep = max(deep, 1 + _depth(inner))
    return deep


def _dotted(node: ast.AST | None) -> str:
    """a.b.c of names and attributes, else nothing."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return ""


def _exit_of(stmt: ast.stmt) -> tuple[str, str, int | None] | None:
    """(gate or error, kind, literal code) of a statement that ends the program."""
    call = stmt.exc if isinstance(stmt, ast.Raise) else stmt.value if isinstance(stmt, ast.Expr) else None
    if call is None or (isinstance(stmt, ast.Expr) and not isinstance(call, ast.Call)):
        return None
    name = _dotted(call.func if isinstance(call, ast.Call) else call)
    last = name.rpartition(".")[2]
    if isinstance(stmt, ast.Raise):
        if last in EXIT_ERRORS:
            return ("error", last, None)
        if last != "SystemExit":
            return None
        name = last
    elif name not in EXIT_CALLS and last != "exit":
        return None
    first = call.args[0] if isinstance(call, ast.Call) and call.args else None
    return ("gate", name, first.value if isinstance(first, ast.Constant) and isinstance(first.value, int) else None)


def _flags(fn) -> dict[str, str]:
    """Parameters that command-line options or arguments fill, and how these are written."""
    out = {}
    for d in fn.decorator_list:
        if isinstance(d, ast.Call) and _dotted(d.func).rpartition(".")[2] in ("option", "argument"):
            said = [a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            plain, long = [s for s in said if not s.startswith("-")], max((s for s in said if s.startswith("--")), key=len, default="")
            if plain or long:
                out[plain[0] if plain else long.lstrip("-").replace("-", "_")] = long or plain[0]
    return out


def _lever(test: ast.expr | None, params: set[str], flags: dict[str, str]) -> str:
    """What decides over the innermost test: a flag, an attribute of a configuration, a parameter, or nothing."""
    nodes = [] if test is None else list(ast.walk(test))
    names = [n.id for n in nodes if isinstance(n, ast.Name)]
    read = sorted(filter(None, (_dotted(n) for n in nodes if isinstance(n, ast.Attribute))))
    by_flag, by_param = [n for n in names if n in flags], [n for n in names if n in params]
    return f"flag:{flags[by_flag[0]]}" if by_flag else f"config:{read[0]}" if read else f"param:{by_param[0]}" if by_param else "hardcoded"


def _gates(fn) -> list[dict]:
    """Exits of a function's own statements, each with what the innermost if above it asks for."""
    flags, params = _flags(fn), {a.arg for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs)}
    command = any(_dotted(d.func if isinstance(d, ast.Call) else d).endswith(("command", "group")) for d in fn.decorator_list)
    out, todo = [], [(s, None) for s in reversed(fn.body)]
    while todo:
        s, test = todo.pop()
        found = _exit_of(s)
        if found:
            out.append({"function": fn.name, "category": found[0], "kind": found[1], "code": found[2], "control": _lever(test, params, flags), "is_command": command})
        elif not isinstance(s, _SCOPES):
            blocks = [(getattr(s, "body", []), s.test if isinstance(s, ast.If) else test), *((getattr(s, k, []), test) for k in ("orelse", "finalbody"))]
            blocks += [(h.body, test) for h in getattr(s, "handlers", [])]
            todo += [(c, t) for block, t in reversed(blocks) for c in reversed(block)]
    return out


class _Facts:
    def __init__(self, package: bool):
        self.package = package
        self.imports, self.calls, self.functions, self.classes, self.constants, self.assigned, self.raised, self.gates = [], [], [], [], [], [], [], []

    def walk(self, node: ast.AST, path: tuple[str, ...], guarded: bool, top: bool) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.imports.append({"module": a.name, "level": 0, "names": [], "alias": a.asname, "line": node.lineno, "type_checking": guarded})
        elif isinstance(node, ast.ImportFrom):
            names = [{"name": a.name, "alias": a.asname or a.name} for a in node.names if a.name != "*"]
            self.imports.append({"module": node.module or "", "level": node.level, "names": names, "alias": None, "line": node.lineno, "type_checking": guarded})
        elif isinstance(node, ast.Call):
            chain, head = [], node.func
            while isinstance(head, ast.Attribute):
                chain.append(head.attr)
                head = head.value
            if isinstance(head, ast.Name) and head.id not in SKIPPED_HEADS:
                self.calls.append({"head": head.id, "chain": chain[::-1], "line": node.lineno})
        elif isinstance(node, ast.Raise) and node.exc is not None:
            what = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
            if isinstance(what, ast.Name | ast.Attribute):
                self.raised.append({"scope": ".".join(path), "error": ast.unparse(what), "line": node.lineno})
        if isinstance(node, _DEFS):
            self.function(node, path)
        elif isinstance(node, ast.ClassDef):
            self.cls(node, path)
        elif top and isinstance(node, ast.Assign | ast.AnnAssign):
            self.assignment(node)
        inner = path + ((node.name,) if isinstance(node, _SCOPES) else ())
        local = isinstance(node, (*_DEFS, ast.Lambda))
        if isinstance(node, ast.If) and (_is_name(node.test, "TYPE_CHECKING") or _is_name(node.test, "typing.TYPE_CHECKING")):
            for s in node.body:
                self.walk(s, inner, True, top)
            for s in node.orelse:
                self.walk(s, inner, guarded, top)
            return
        for child in ast.iter_child_nodes(node):
            self.walk(child, inner, guarded and not local, top and not isinstance(node, (*_SCOPES, ast.Lambda)))

    def function(self, fn, path: tuple[str, ...]) -> None:
        count, shape, exact = _body(fn)
        args = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs, *filter(None, (fn.args.vararg, fn.args.kwarg))]
        counted = args[1:] if args and args[0].arg in ("self", "cls") and path else args
        self.gates += _gates(fn)
        self.functions.append(
            {
                "name": fn.name, "qualified_name": ".".join((*path, fn.name)), "line": fn.lineno, "end_line": fn.end_lineno, "cyclomatic": count, "size": len(shape),
                "shape_hash": _digest(shape), "concrete_hash": _digest(exact), "decorators": [ast.unparse(d) for d in fn.decorator_list], "is_trivial": _trivial(fn),
                "n_args": len(counted), "n_hinted": sum(a.annotation is not None for a in counted) + (fn.returns is not None), "nesting": _depth(fn.body), "tokens": dict(Counter(shape)),
            }
        )

    def cls(self, node: ast.ClassDef, path: tuple[str, ...]) -> None:
        def target(b):
            return ast.unparse(b.value if isinstance(b, ast.Subscript) else b)

        fields = [(s.target.id, ast.unparse(s.annotation)) for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
        settings = " ".join(ast.unparse(x) for x in [*node.decorator_list, *node.keywords, *[s for s in node.body if isinstance(s, ast.Assign)]])
        self.classes.append({"name": node.name, "qualified_name": ".".join((*path, node.name)), "line": node.lineno, "bases": [target(b) for b in node.bases], "frozen": "frozen=True" in settings, "n_fields": len(fields), "n_tuple": sum(a.startswith("tuple") for _, a in fields), "n_list": sum(a.startswith("list") for _, a in fields)})
        for s in node.body:
            if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant):
                self.constants += [{"cls": node.name, "name": t.id, "value": repr(s.value.value)} for t in s.targets if isinstance(t, ast.Name)]

    def assignment(self, node) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        ctor = ast.unparse(node.value.func) if isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name | ast.Attribute) else None
        listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] if isinstance(node.value, ast.List | ast.Tuple) else []
        self.assigned += [{"name": t.id, "ctor": ctor, "listed": listed} for t in targets if isinstance(t, ast.Name)]


_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?", re.M)
_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]+\(?([\w ,]+)", re.M)


def _scan_imports(text: str) -> list[dict]:
    """Imports of a source that doesn't parse, line by line."""
    line = lambda m: text.count("\n", 0, m.start()) + 1
    out = [{"module": m[1], "level": 0, "names": [], "alias": m[2], "line": line(m), "type_checking": False} for m in _IMPORT.finditer(text)]
    for m in _FROM.finditer(text):
        names = [(p.split(" as ")[0].strip(), p.split(" as ")[-1].strip()) for p in m[3].split(",") if p.strip()]
        out.append({"module": m[2], "level": len(m[1]), "names": [{"name": a, "alias": b} for a, b in names], "alias": None, "line": line(m), "type_checking": False})
    return out


def parse(raw: bytes, package: bool = False) -> dict:
    """All facts of a source. One that doesn't parse still gives its imports, and has_errors."""
    text, facts = decode(raw), _Facts(package)
    try:
        tree = ast.parse(text)
        facts.walk(tree, (), False, True)
        broken = False
        main = any(isinstance(s, ast.If) and _guards_main(s.test) for s in tree.body)
    except (SyntaxError, ValueError, RecursionError):
        facts, broken, main = _Facts(package), True, False
        facts.imports = _scan_imports(text)
    out = {k: getattr(facts, k) for k in ("imports", "calls", "functions", "classes", "constants", "assigned", "raised", "gates")}
    out["imports"].sort(key=lambda i: (i["line"], i["module"]))
    return out | {"has_errors": broken, "has_main_guard": main}
