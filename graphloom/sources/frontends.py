"""Source files to graphs: one parser task a file, in Arrow batches.

Python is read with the standard library's parser; C, C++, Java, Go, JavaScript, TypeScript, Rust and Scala with one
tolerant parser of brace languages that a table of `Spec`s adapts. Ids are file_id * 2^20 + preorder, so they rise in
evaluation order within a file and stay when other files change. Text that can't be parsed gives what was understood.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import EDGES, FILES, NODES, Graph, shaped
from ..plans.storage import kept

ROOM = 1 << 20
DEEPEST = 200_000
EXTENSIONS = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cxx": "cpp", "java": "java", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "scala": "scala", "py": "python", "rb": "ruby"}
ORDER_OF_LANGUAGES = ["c", "cpp", "java", "go", "javascript", "typescript", "python", "ruby", "rust", "scala"]


@dataclass
class Built:
    """Rows of one file under construction."""

    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=dict)
    bound: set[tuple[int, str]] = field(default_factory=set)

    def add(self, kind: str, parent: int | None = None, **columns) -> int:
        i = len(self.nodes)
        self.nodes.append({"id": i, "kind": kind, **columns})
        if parent is not None:
            self.child(parent, i)
        return i

    def child(self, parent: int, i: int, kind: str = "AST") -> None:
        n = self.counts[parent] = self.counts.get(parent, 0) + (kind == "AST")
        self.edges.append((parent, i, kind, n))

    def local(self, parent: int, name: str, method: int | None, line: int | None) -> None:
        """A LOCAL for the first binding of a name in a method that isn't a parameter."""
        if method is not None and (method, name) not in self.bound:
            self.bound.add((method, name))
            self.add("LOCAL", parent, name=name, code=name, method=method, line=line)

    def receives(self, call: int, i: int) -> None:
        """Makes the latest argument edge from a call to a node its receiver."""
        for at in range(len(self.edges) - 1, -1, -1):
            if self.edges[at][:3] == (call, i, "ARGUMENT"):
                self.edges[at] = (call, i, "RECEIVER", 0)
                return

    def argument(self, call: int, i: int, index: int) -> None:
        self.nodes[i]["argument_index"] = index
        self.edges.append((call, i, "ARGUMENT", index))


class PythonBuilder(ast.NodeVisitor):
    """The standard library's tree to graph rows; control structures hold condition, body, else."""

    def __init__(self, text: str, path: str):
        self.text, self.out = text, Built()
        self.method: int | None = None
        self.owner: str | None = None
        self.top = self.out.add("FILE", name=path, code=path)

    def code(self, n: ast.AST) -> str:
        return ast.get_source_segment(self.text, n) or ""

    def node(self, kind: str, parent: int, n: ast.AST | None = None, **columns) -> int:
        return self.out.add(kind, parent, line=getattr(n, "lineno", None), column_number=getattr(n, "col_offset", None), method=self.method, **columns)

    def function(self, n, parent: int) -> None:
        name = ".".join(filter(None, (self.owner, n.name)))
        old, old_owner = self.method, self.owner
        self.method = m = self.out.add("METHOD", parent, name=n.name, full_name=name, type_full_name=self.owner, line=n.lineno, code=f"def {n.name}")
        self.out.nodes[m]["method"] = m
        params = [a.arg for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]]
        params = params[1:] if self.owner and params[:1] in (["self"], ["cls"]) else params
        for k, p in enumerate(params, 1):
            self.node("METHOD_PARAMETER_IN", m, n, name=p, code=p, order_=k)
            self.out.bound.add((m, p))
        self.owner = None
        block = self.node("BLOCK", m, n)
        for s in n.body:
            self.statement(s, block)
        self.node("METHOD_RETURN", m, n, name="RET", code="RET")
        self.method, self.owner = old, old_owner

    def statement(self, s: ast.stmt, parent: int) -> None:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(s, parent)
        elif isinstance(s, ast.ClassDef):
            t = self.node("TYPE_DECL", parent, s, name=s.name, full_name=s.name, bases=[self.code(b) for b in s.bases])
            old, self.owner = self.owner, s.name
            for x in s.body:
                self.statement(x, t)
            self.owner = old
        elif isinstance(s, ast.Return):
            r = self.node("RETURN", parent, s, code=self.code(s))
            if s.value is not None:
                self.out.argument(r, self.value(s.value, r), 1)
        elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = s.targets if isinstance(s, ast.Assign) else [s.target]
            if s.value is not None:
                name = f"{_OPS.get(type(s.op), '?')}=" if isinstance(s, ast.AugAssign) else "="
                for t in targets:
                    if isinstance(t, ast.Name):
                        self.out.local(parent, t.id, self.method, s.lineno)
                    self.call(name, s, parent, [t, s.value])
        elif isinstance(s, ast.Expr):
            self.value(s.value, parent)
        elif isinstance(s, (ast.If, ast.While, ast.For, ast.AsyncFor)):
            word = "if" if isinstance(s, ast.If) else "while"
            c = self.node("CONTROL_STRUCTURE", parent, s, name=word, code=f"{word} ({self.code(s.test if hasattr(s, 'test') else s.iter)})")
            if hasattr(s, "test"):
                self.value(s.test, c)
            else:
                self.call("=", s, c, [s.target, s.iter])
            self.block(s.body, c)
            if s.orelse:
                self.block(s.orelse, c)
        elif isinstance(s, (ast.Break, ast.Continue)):
            word = "break" if isinstance(s, ast.Break) else "continue"
            self.node("CONTROL_STRUCTURE", parent, s, name=word, code=word)
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            for a in s.names:
                self.node("IMPORT", parent, s, name=a.asname or a.name, imported_entity=".".join(filter(None, (getattr(s, "module", None), a.name))), imported_as=a.asname or a.name, code=self.code(s))
        elif isinstance(s, (ast.With, ast.AsyncWith, ast.Try)):
            for item in getattr(s, "items", []):
                self.value(item.context_expr, parent)
            for part in (s.body, *(h.body for h in getattr(s, "handlers", [])), getattr(s, "orelse", []), getattr(s, "finalbody", [])):
                self.block(part, parent)
        else:
            for x in ast.iter_child_nodes(s):
                if isinstance(x, ast.expr):
                    self.value(x, parent)

    def block(self, body: list[ast.stmt], parent: int) -> None:
        b = self.node("BLOCK", parent, body[0] if body else None)
        for x in body:
            self.statement(x, b)

    def call(self, name: str, n: ast.AST, parent: int, args: list[ast.expr], **columns) -> int:
        c = self.node("CALL", parent, n, name=name, code=self.code(n), **columns)
        for k, a in enumerate(args, 1):
            self.out.argument(c, self.value(a, c), k)
        return c

    def value(self, n: ast.expr, parent: int) -> int:
        if isinstance(n, ast.Name):
            return self.node("IDENTIFIER", parent, n, name=n.id, code=n.id)
        if isinstance(n, ast.Constant):
            return self.node("LITERAL", parent, n, code=self.code(n), name=None)
        if isinstance(n, ast.Call):
            f = n.func
            name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else self.code(f)
            receiver = self.code(f.value) if isinstance(f, ast.Attribute) else None
            return self.call(name, n, parent, [*n.args, *(k.value for k in n.keywords)], receiver_name=receiver)
        if isinstance(n, ast.BinOp):
            return self.call(_OPS.get(type(n.op), "?"), n, parent, [n.left, n.right])
        if isinstance(n, ast.BoolOp):
            return self.call("and" if isinstance(n.op, ast.And) else "or", n, parent, n.values)
        if isinstance(n, ast.Compare):
            return self.call(_OPS.get(type(n.ops[0]), "?"), n, parent, [n.left, *n.comparators])
        if isinstance(n, ast.UnaryOp):
            return self.call(_OPS.get(type(n.op), "not"), n, parent, [n.operand])
        if isinstance(n, ast.Attribute):
            return self.call(n.attr, n, parent, [n.value])
        if isinstance(n, ast.Subscript):
            return self.call("[]", n, parent, [n.value, n.slice])
        if isinstance(n, ast.IfExp):
            return self.call("?:", n, parent, [n.test, n.body, n.orelse])
        return self.call(f"<operator>.{type(n).__name__.lower()}", n, parent, [x for x in ast.iter_child_nodes(n) if isinstance(x, ast.expr)])


#: Operators of the standard library's tree.
_OPS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "**", ast.FloorDiv: "//", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.LShift: "<<", ast.RShift: ">>", ast.Eq: "==", ast.NotEq: "!=",
    ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.In: "in", ast.NotIn: "not in", ast.Is: "is", ast.IsNot: "is not", ast.USub: "-", ast.UAdd: "+", ast.Not: "not", ast.Invert: "~",
}


def build_python(text: str, path: str) -> Built:
    b = PythonBuilder(text, path)
    try:
        body = ast.parse(text).body
    except SyntaxError as e:  # what stands before the broken line
        head = "\n".join(text.split("\n")[: max(0, (e.lineno or 1) - 1)])
        try:
            body, b.text = ast.parse(head).body, head
        except (SyntaxError, RecursionError, MemoryError):
            body = []
    except (RecursionError, MemoryError):  # the standard parser's own limit: all other top-level statements are kept
        body = []
        for part in re.finditer(r"^\S.*(?:\n(?:[ \t)\]}].*)?)*", text, re.M):
            try:
                tree = ast.parse("\n" * text.count("\n", 0, part.start()) + part.group())
            except (SyntaxError, RecursionError, MemoryError):
                continue
            body += tree.body
    for s in body:
        b.statement(s, b.top)
    return b.out


@dataclass(frozen=True)
class Spec:
    """What tells one brace language from another."""

    function_word: str | None = None  # func, fn, function, def: else a function is `type name(...) {`
    type_words: tuple[str, ...] = ("class", "struct", "interface", "trait", "enum", "impl", "object")
    name_first: bool = False  # parameters are `name type` or `name: type`
    joiner: str = "."
    tail_return: bool = False


SPECS = {
    "c": Spec(type_words=("struct", "enum", "union")),
    "cpp": Spec(joiner="::"),
    "java": Spec(),
    "go": Spec("func", name_first=True, type_words=()),
    "javascript": Spec("function", name_first=True),
    "typescript": Spec("function", name_first=True),
    "rust": Spec("fn", name_first=True, joiner="::", tail_return=True),
    "scala": Spec("def", name_first=True, tail_return=True),
}
_LEX = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$]\w*!?(?=\()|[A-Za-z_$]\w*)|(?P<sign>->|::|=>|<<=|>>=|===|!==|\+\+|--|&&|\|\||[-+*/%&|^=!<>:]=|<<|>>|[^\s\w])""", re.S | re.M)
_BINARY = {w: p for p, row in enumerate(["= += -= *= /= %= &= |= ^= <<= >>= :=", "?", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >=", "<< >>", "+ -", "* / %"], 1) for w in row.split()}
_CONTROL = {"if", "while", "for", "do", "switch", "match", "loop"}
_NOISE = {"let", "var", "const", "mut", "val", "final", "static", "public", "private", "protected", "async", "await", "unsafe", "export", "inline", "extern", "virtual", "override", "pub", "new", "auto", "register"}


class BraceBuilder:
    """Recursive descent over tokens (kind, text, line); never fails, but skips what it can't place."""

    def __init__(self, text: str, path: str, spec: Spec):
        self.spec, self.out, self.i = spec, Built(), 0
        ends = [m.start() for m in re.finditer("\n", text)]
        self.t = [(m.lastgroup, m.group(), bisect.bisect_left(ends, m.start()) + 1) for m in _LEX.finditer(text) if m.lastgroup != "skip"]
        self.closes: dict[int, int] | None = None
        self.method: int | None = None
        self.owner: str | None = None
        self.top = self.out.add("FILE", name=path, code=path)

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if 0 <= self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if 0 <= self.i + k < len(self.t) else ""

    def line(self) -> int | None:
        return self.t[min(self.i, len(self.t) - 1)][2] if self.t else None

    def node(self, kind: str, parent: int | None, line: int | None = None, **columns) -> int:
        return self.out.add(kind, parent, line=line or self.line(), method=self.method, **columns)

    def closing(self, start: int) -> int:
        """Index of the bracket that closes the one at start; brackets of all kinds count alike."""
        if self.closes is None:
            self.closes, open_ = {}, []
            for j, (kind, w, _) in enumerate(self.t):
                if kind == "sign" and w in "([{":
                    open_.append(j)
                elif kind == "sign" and w in ")]}" and open_:
                    self.closes[open_.pop()] = j
        return self.closes.get(start, len(self.t) - 1 if self.at(start - self.i) in ("(", "[", "{") else start)

    def text(self, a: int, b: int) -> str:
        out, last = [], ""
        for _, w, _ in self.t[a:b]:
            if last and last[-1].isalnum() and w[0].isalnum():
                out.append(" ")
            out.append(w)
            last = w
        return "".join(out)

    def file(self) -> Built:
        while self.i < len(self.t):
            before = self.i
            self.declaration(self.top)
            self.i = max(self.i, before + 1)
        return self.out

    def declaration(self, parent: int) -> None:
        s = self.spec
        if self.at() in s.type_words and self.kind(1) == "name":
            name, j = self.at(1), self.i + 2
            bases = []
            while j < len(self.t) and self.t[j][1] not in "{;(":
                if self.t[j][0] == "name" and self.t[j][1] not in ("extends", "implements", "for", "public", "private", "with"):
                    bases.append(self.t[j][1])
                j += 1
            if j < len(self.t) and self.t[j][1] == "{":
                if self.at() == "impl" and bases:
                    name, bases = bases[-1], [name]
                t = self.node("TYPE_DECL", parent, name=name, full_name=name, bases=bases)
                end, self.i, old, self.owner = self.closing(j), j + 1, self.owner, name
                while self.i < end:
                    before = self.i
                    self.declaration(t)
                    self.i = max(self.i, before + 1)
                self.i, self.owner = end + 1, old
                return
            self.i = j
        f = self.function_head()
        if f:
            self.function(parent, *f)
        elif self.owner and self.kind() == "name" and (m := self.member()):
            self.node("MEMBER", parent, name=m[0], type_full_name=m[1], code=self.text(self.i, m[2]))
            self.i = m[2]

    def member(self):
        """name, type, end of `type name;` or `name: type;`."""
        j = self.i
        while j < len(self.t) and self.t[j][1] not in ";{}(=\n":
            j += 1
        words = [w for k, w, _ in self.t[self.i : j] if k == "name" and w not in _NOISE]
        if j < len(self.t) and self.t[j][1] in ";=" and len(words) >= 2:
            smart = words[-2] if words[-2] not in ("unique_ptr", "shared_ptr") else words[-1]
            return (words[0], words[-1], j + 1) if self.spec.name_first else (words[-1], smart, j + 1)
        return None

    def function_head(self):
        """(name, start and end of parameters, start of body, receiver type) if a function starts here."""
        j, word = self.i, self.spec.function_word
        if word and self.at() == word:
            j, receiver = self.i + 1, None
            if j < len(self.t) and self.t[j][1] == "(":  # Go's receiver
                end = self.closing(j)
                names = [w for k, w, _ in self.t[j:end] if k == "name"]
                receiver, j = names[-1] if names else None, end + 1
            if j + 1 < len(self.t) and self.t[j][0] == "name":
                name, p = self.t[j][1], j + 1
                while p < len(self.t) and self.t[p][1] not in "({;":
                    p += 1
                return self.body_after(name, p, receiver)
            return None
        if self.kind() == "name" and self.at(1) == "=" and self.spec.name_first:  # name = (a) => {
            p = self.i + 2
            while self.t[p : p + 1] and self.t[p][1] in ("async", "function"):
                p += 1
            if self.t[p : p + 1] and self.t[p][1] == "(" and (self.t[self.closing(p) + 1 : self.closing(p) + 2] or [("", "", 0)])[0][1] in ("=>", "{"):
                return self.body_after(self.at(), p, None)
        if self.at() in ("const", "let", "var") and self.kind(1) == "name" and self.at(2) == "=":
            self.i += 1
            head = self.function_head()
            self.i -= 0 if head else 1
            return head
        while j < len(self.t) and (self.t[j][0] == "name" or self.t[j][1] in ("*", "&", "<", ">", ",", "::", "[", "]", "~", "@", ".")):
            if self.t[j][1] in _CONTROL or self.t[j][1] in ("return", "else", "case"):
                return None
            if self.t[j][0] == "name" and j + 1 < len(self.t) and self.t[j + 1][1] == "(" and (j > self.i or self.owner):
                owner = self.t[j - 2][1] if j >= 2 and self.t[j - 1][1] == "::" else None
                return self.body_after(self.t[j][1], j + 1, owner)
            j += 1
        return None

    def body_after(self, name: str, p: int, receiver):
        if p >= len(self.t) or self.t[p][1] != "(":
            return None
        end = self.closing(p)
        b = end + 1
        while b < len(self.t) and self.t[b][1] not in "{;}" and not (self.t[b][1] == "=" and self.spec.function_word != "def"):
            b += 1
        return (name, p, end, b, receiver) if b < len(self.t) and self.t[b][1] == "{" else None

    def parameters(self, p: int, end: int) -> list[tuple[str, str | None]]:
        out, start = [], p + 1
        j, depth = p + 1, 0
        while j <= end:
            w = self.t[j][1]
            if j == end or (w == "," and depth == 0):
                part = [x for x in self.t[start:j] if x[0] == "name" and x[1] not in _NOISE]
                if part and not (len(part) == 1 and part[0][1] in ("void", "self", "this")):
                    name_first = self.spec.name_first or any(x[1] == ":" for x in self.t[start:j])
                    name, rest = (part[0][1], part[1:]) if name_first else (part[-1][1], part[:-1])
                    if name_first or len(part) > 1:
                        out.append((name, rest[-1][1] if rest else None))
                start = j + 1
            depth += (w in "([{<") - (w in ")]}>") if len(w) == 1 else 0
            j += 1
        return out

    def function(self, parent: int, name: str, p: int, end: int, body: int, receiver) -> None:
        owner = receiver or self.owner
        old = self.method
        self.method = m = self.out.add("METHOD", parent, name=name, full_name=f"{owner}{self.spec.joiner}{name}" if owner else name, type_full_name=owner, line=self.t[p][2], code=self.text(self.i, end + 1))
        self.out.nodes[m]["method"] = m
        for k, (n, t) in enumerate(self.parameters(p, end), 1):
            self.node("METHOD_PARAMETER_IN", m, name=n, code=n, order_=k, type_full_name=t)
            self.out.bound.add((m, n))
        self.i = body
        old_owner, self.owner = self.owner, None
        self.block(m, self.spec.tail_return)
        self.node("METHOD_RETURN", m, name="RET", code="RET")
        self.method, self.owner = old, old_owner

    def block(self, parent: int, tail: bool = False) -> int:
        b, end = self.node("BLOCK", parent), self.closing(self.i)
        self.i += 1
        while self.i < end:
            before = self.i
            self.statement(b, end if tail else None)
            self.i = max(self.i, before + 1)
        self.i = end + 1
        return b

    def body(self, parent: int) -> None:
        if self.at() == "{":
            self.block(parent)
        else:
            b = self.node("BLOCK", parent)
            self.statement(b, None)

    def statement(self, parent: int, tail: int | None) -> None:
        w = self.at()
        if w in (";", ","):
            self.i += 1
        elif w == "{":
            self.block(parent)
        elif w in _CONTROL and not (w == "match" and self.at(1) == "("  and False):
            self.control(parent)
        elif w in ("break", "continue"):
            self.node("CONTROL_STRUCTURE", parent, name=w, code=w)
            self.i += 1
        elif w in ("case", "default", "when"):
            n = self.node("JUMP_TARGET", parent, name=w, code=w)
            while self.i < len(self.t) and self.at() not in (":", "=>", "{", "}"):
                self.i += 1
            del n
            self.i += self.at() in (":", "=>")
        elif w == "return":
            start = self.i
            r = self.node("RETURN", parent, code="return")
            self.i += 1
            if self.at() not in (";", "}", ""):
                self.out.argument(r, self.value(r), 1)
            self.out.nodes[r]["code"] = self.text(start, self.i)
        else:
            head = self.function_head()
            if head:
                self.function(parent, *head)
                return
            self.declared_value(parent, tail)

    def declared_value(self, parent: int, tail: int | None) -> None:
        """An expression, or a declaration, which keeps its assignment alone."""
        start = self.i
        while self.at() in _NOISE:
            self.i += 1
        j, last = self.i, None
        while self.kind(j - self.i) == "name" or (self.at(j - self.i) in ("*", "&", ":", "::", "<", ">", "[", "]", ".") and last is not None):
            last = self.t[j][1]
            j += 1
        names = [k for k in range(self.i, j) if self.t[k][0] == "name"]
        after = self.t[j][1] if j < len(self.t) else ""
        if len(names) > 1 and names[-1] > self.i and (self.t[names[-1] - 1][0] == "name" or self.t[names[-1] - 1][1] in ("*", "&", ">", ":")):
            typed_first = not any(self.t[k][1] == ":" for k in range(self.i, j))
            if after in (";", ",") or after == "":
                self.out.local(parent, self.t[names[-1]][1], self.method, self.t[names[-1]][2])
                self.i = j
                return
            if after in ("=", ":="):
                target = self.t[names[-1]] if typed_first else self.t[names[0]]
                self.assignment(parent, target, j, start)
                return
            if after == "(" and typed_first and self.t[names[-1] - 1][0] == "name":  # T x(args): direct initialisation
                self.i = names[-1]
        if self.i > start and self.kind() == "name" and self.at(1) == "=":
            self.out.local(parent, self.at(), self.method, self.line())
        elif self.kind() == "name" and self.at(1) == ":=":
            self.out.local(parent, self.at(), self.method, self.line())
        got = self.value(parent)
        if tail is not None and self.i >= tail and self.out.nodes[got]["kind"] in ("CALL", "IDENTIFIER", "LITERAL"):
            line = self.out.nodes[got].get("line")
            r = self.out.add("RETURN", parent, code=self.text(start, self.i), line=line, method=self.method)
            self.out.edges = [e for e in self.out.edges if not (e[1] == got and e[2] == "AST" and e[0] == parent)]
            self.out.child(r, got)
            self.out.argument(r, got, 1)

    def assignment(self, parent: int, target, j: int, start: int) -> None:
        self.out.local(parent, target[1], self.method, target[2])
        c = self.node("CALL", parent, name="=")
        x = self.node("IDENTIFIER", c, name=target[1], code=target[1])
        self.out.argument(c, x, 1)
        self.i = j + 1
        self.out.argument(c, self.value(c), 2)
        self.out.nodes[c]["code"] = self.text(start, self.i)

    def control(self, parent: int) -> None:
        w, start = self.at(), self.i
        c = self.node("CONTROL_STRUCTURE", parent, name=w, code=w)
        self.i += 1
        if w == "do":
            self.body(c)
            self.i += self.at() == "while"
            self.bracketed(c)
        elif w == "for":
            self.for_head(c)
            self.body(c)
        elif w == "loop":
            self.out.nodes[c]["code"] = "while (true)"
            self.node("LITERAL", c, code="true")
            self.body(c)
        else:
            self.bracketed(c)
            code = "switch" if w == "match" else w
            self.out.nodes[c]["code"] = f"{code} {self.text(start + 1, self.i)}"
            self.body(c)
            if w == "if" and self.at() == "else":
                self.i += 1
                if self.at() == "if":
                    b = self.node("BLOCK", c)
                    self.control(b)
                else:
                    self.body(c)
            return
        if w != "loop":
            self.out.nodes[c]["code"] = f"{w} {self.text(start + 1, min(self.i, start + 12))}"

    def bracketed(self, parent: int) -> None:
        if self.at() == "(":
            end = self.closing(self.i)
            self.i += 1
            self.value(parent)
            self.i = end + 1
        elif self.at() not in ("{", ""):
            self.value(parent)

    def for_head(self, parent: int) -> None:
        end = self.closing(self.i) if self.at() == "(" else self.i
        if self.at() != "(":
            while end < len(self.t) and self.t[end][1] != "{":
                end += 1
        else:
            self.i += 1
        stop = {k for k in range(self.i, end) if self.t[k][1] == ";"}
        if len(stop) == 2:
            for cut in [*sorted(stop), end]:
                b = self.node("BLOCK", parent)
                if self.i < cut:
                    self.declared_value(b, None)
                self.i = cut + 1
        else:
            self.value(parent)
        self.i = end + (self.t[end][1] == ")" if end < len(self.t) else 0)

    # expressions
    def value(self, parent: int, level: int = 1) -> int:
        start = self.i
        left = self.unary(parent)
        while self.i < len(self.t) and (p := _BINARY.get(self.at())) and p >= level and self.kind() == "sign":
            op = self.at()
            self.i += 1
            name = "=" if op == ":=" else "?:" if op == "?" else op
            c = self.wrap(parent, left, name)
            if op == "?":
                self.out.argument(c, self.value(c), 2)
                self.i += self.at() == ":"
                self.out.argument(c, self.value(c, 2), 3)
            else:
                self.out.argument(c, self.value(c, p if p == 1 else p + 1), 2)
            self.out.nodes[c]["code"] = self.text(start, self.i)
            left = c
        return left

    def wrap(self, parent: int, inner: int, name: str) -> int:
        """A call in the place of inner, which becomes its first argument."""
        c = self.node("CALL", None, line=self.out.nodes[inner].get("line"), name=name)
        self.out.edges = [(a, c if b == inner and k == "AST" and a == parent else b, k, o) for a, b, k, o in self.out.edges]
        self.out.child(c, inner)
        self.out.argument(c, inner, 1)
        return c

    def unary(self, parent: int) -> int:
        w, start = self.at(), self.i
        if self.kind() == "sign" and w in ("!", "-", "+", "*", "&", "~", "++", "--"):
            c = self.node("CALL", parent, name=w)
            self.i += 1
            self.out.argument(c, self.unary(c), 1)
            self.out.nodes[c]["code"] = self.text(start, self.i)
            return c
        return self.postfix(parent)

    def postfix(self, parent: int) -> int:
        start, receiver = self.i, None
        while self.at() in _NOISE:
            self.i += 1
        if self.at() == "(":
            end = self.closing(self.i)
            self.i += 1
            left = self.value(parent) if self.i < end else self.node("LITERAL", parent, code="()")
            self.i = end + 1
        elif self.kind() == "name":
            name = self.at()
            self.i += 1
            left = self.node("IDENTIFIER", parent, name=name.rstrip("!"), code=name)
        elif self.kind() in ("number", "string"):
            left = self.node("LITERAL", parent, code=self.at())
            self.i += 1
        elif self.at() in ("[", "{"):
            end = self.closing(self.i)
            left = self.node("CALL", parent, name="<operator>.initializer", code=self.text(self.i, end + 1))
            self.arguments(left, end)
        else:
            left = self.node("UNKNOWN", parent, code=self.at())
            self.i += 1
        while True:
            w = self.at()
            if w in (".", "->", "::") and self.kind(1) == "name":
                member = self.at(1)
                receiver = self.text(start, self.i)
                self.i += 2
                if self.at() == "(":
                    c = self.wrap(parent, left, member.rstrip("!"))
                    self.out.nodes[c]["receiver_name"] = receiver
                    self.out.nodes[left]["argument_index"] = 0
                    self.out.receives(c, left)
                    self.arguments(c, self.closing(self.i))
                else:
                    c = self.wrap(parent, left, member)
                left = c
            elif w == "(" and self.out.nodes[left]["kind"] == "IDENTIFIER":
                n = self.out.nodes[left]
                n["kind"] = "CALL"
                self.arguments(left, self.closing(self.i))
            elif w == "[":
                end = self.closing(self.i)
                left = self.wrap(parent, left, "[]")
                self.i += 1
                if self.i < end:
                    self.out.argument(left, self.value(left), 2)
                self.i = end + 1
            elif w in ("++", "--"):
                left = self.wrap(parent, left, w)
                self.i += 1
            else:
                break
            self.out.nodes[left]["code"] = self.text(start, self.i)
        return left

    def arguments(self, call: int, end: int) -> None:
        self.i += 1
        k = 1
        while self.i < end:
            before = self.i
            if self.at() in (",", ";"):
                self.i += 1
                continue
            self.out.argument(call, self.value(call), k)
            k += 1
            self.i = max(self.i, before + 1)
        self.i = end + 1


def build(path: str, text: str, language: str) -> Built:
    """The rows of one file. Python frames live on the heap, so the limit may be as deep as a file is long; what is
    nested deeper than that, or than the standard library's parser reads, is kept as far as it was understood."""
    builder, limit = None, sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEEPEST))
    try:
        if language == "python":
            return build_python(text, path)
        builder = BraceBuilder(text, path, SPECS.get(language, SPECS["c"]))
        return builder.file()
    except (RecursionError, MemoryError):
        if builder is not None and builder.out.nodes:
            return builder.out
        out = Built()
        out.add("FILE", name=path)
        return out
    finally:
        sys.setrecursionlimit(limit)


def node_id(file_id: int, path: str, n: int) -> int:
    """Ids of a file's nodes: ROOM in a row, and for files with more nodes further rooms of their own."""
    if n < ROOM:
        return file_id * ROOM + n
    room = int.from_bytes(hashlib.blake2b(f"{path}#{n // ROOM}".encode(), digest_size=8).digest(), "little") % (1 << 42)
    return room * ROOM + n % ROOM


_NODE_ROW = "id long, kind string, file_id long, method_id long, name string, full_name string, code string, type_full_name string, bases array<string>, receiver_name string, line int, column_number int, order_ int, argument_index int, imported_entity string, imported_as string"


def with_language(files: DataFrame) -> DataFrame:
    """files (path, text) with file_id, language (by extension) and digest."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)
    return files.select(F.pmod(F.xxhash64("path"), F.lit(1 << 42)).alias("file_id"), "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit("c")).alias("language"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def dominant_language(files: DataFrame) -> str:
    """The language of most files; ties to the earlier of the list, none to C."""
    got = {r[0]: r[1] for r in with_language(files).groupBy("language").count().collect()}
    return min(ORDER_OF_LANGUAGES, key=lambda x: (-got.get(x, 0), ORDER_OF_LANGUAGES.index(x))) if got else "c"


def build_graph(files: DataFrame, exclude: tuple[str, ...] = ()) -> Graph:
    """files (path, text) to a graph; paths with any of the excluded parts are left out."""
    for part in exclude:
        files = files.where(~F.col("path").contains(part))
    files = with_language(files)

    columns = [x.split()[0] for x in _NODE_ROW.split(", ")]
    kinds = dict(zip(columns, (x.split()[1] for x in _NODE_ROW.split(", "))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in [*columns, "src", "dst", "edge", "ord"]}
            for f, path, text, lang in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file_id", "path", "text", "language"))):
                got = build(path, text, lang)
                ids = [node_id(f, path, i) for i in range(len(got.nodes))]
                for n in got.nodes:
                    n = {**n, "id": ids[n["id"]], "file_id": f, "method_id": None if n.get("method") is None else ids[n["method"]]}
                    for c in out:
                        out[c].append(n.get(c))
                for src, dst, kind, place in got.edges:
                    for c in out:
                        out[c].append({"src": ids[src], "dst": ids[dst], "edge": kind, "ord": place}.get(c))
            more = {"src": pa.int64(), "dst": pa.int64(), "edge": pa.string(), "ord": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, more.get(c) or types[kinds[c]]) for c, v in out.items()], names=list(out))

    built = kept(files.mapInArrow(rows, _NODE_ROW + ", src long, dst long, edge string, ord int"), "built")
    nodes = built.where("edge IS NULL").withColumn("order_presence", F.when(F.col("order_").isNull(), "Absent").otherwise("Present"))
    edges = built.where("edge IS NOT NULL").select("src", "dst", F.col("edge").alias("kind"), "ord")
    return Graph(shaped(nodes, NODES), shaped(edges, EDGES), shaped(files, FILES))


def read_sources(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))
