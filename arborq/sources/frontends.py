"""Parsers: source text to node tables in interval encoding.

Python goes through the standard library's grammar, HTML through its tokenizer; other grammars enter as exported node tables with the same
columns. Each text is parsed on its own inside mapInPandas, so parsing is one pass without a shuffle.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

NODE_SCHEMA = "node_id string, parent_id string, pre long, last long, depth long, kind string, native_kind string, name string, operator string, type_kind string, text string, start_line int, end_line int, start_byte long, end_byte long, is_error boolean, n_arms long, n_handlers long, n_clauses long"
#: What a Python grammar node is in the common tree.
PYTHON_KINDS = {
    "Module": "File", "FunctionDef": "FunctionDecl", "AsyncFunctionDef": "FunctionDecl", "Lambda": "Unknown", "ClassDef": "TypeDecl",
    "If": "IfStmt", "For": "ForStmt", "AsyncFor": "ForStmt", "While": "WhileStmt", "Match": "MatchStmt", "Try": "TryStmt", "TryStar": "TryStmt",
    "ExceptHandler": "CatchClause", "With": "WithStmt", "AsyncWith": "WithStmt", "Assert": "AssertStmt", "Return": "ReturnStmt",
    "Break": "BreakStmt", "Continue": "ContinueStmt", "Raise": "Unknown", "Expr": "ExprStmt", "Assign": "AssignExpr", "AugAssign": "AssignExpr",
    "AnnAssign": "AssignExpr", "BinOp": "BinaryExpr", "BoolOp": "BinaryExpr", "Compare": "BinaryExpr", "UnaryOp": "UnaryExpr", "IfExp": "ConditionalExpr",
    "Call": "CallExpr", "Attribute": "Unknown", "ListComp": "Comprehension", "SetComp": "Comprehension", "DictComp": "Comprehension",
    "GeneratorExp": "Comprehension", "Name": "Identifier", "arg": "Identifier", "Constant": "Literal",
}


def node_hash(language: str, native: str, start: int, end: int, parent: str) -> str:
    """Eight bytes of BLAKE2b over the node's place and its parent's hash, in hexadecimal."""
    return hashlib.blake2b(f"{language}|{native}|{start}|{end}|{parent}".encode(), digest_size=8).hexdigest()


class _Rows:
    """Collects nodes in pre-order; ``last`` is set when a node is closed."""

    def __init__(self, language: str):
        self.language, self.rows, self.open = language, [], []

    def push(self, kind: str, native: str, start: int, end: int, lines: tuple[int, int], **more) -> dict:
        parent = self.rows[self.open[-1]] if self.open else None
        pid = parent["node_id"] if parent else ""
        row = {
            "node_id": node_hash(self.language, f"{native}#{len(self.rows)}", start, end, pid), "parent_id": pid or None, "pre": len(self.rows), "last": len(self.rows),
            "depth": len(self.open), "kind": kind, "native_kind": native, "name": None, "operator": None, "type_kind": None, "text": "",
            "start_line": lines[0], "end_line": lines[1], "start_byte": start, "end_byte": end, "is_error": False, "n_arms": 0, "n_handlers": 0, "n_clauses": 0,
        }
        row.update(more)
        self.open.append(len(self.rows))
        self.rows.append(row)
        return row

    def pop(self) -> None:
        self.rows[self.open.pop()]["last"] = len(self.rows) - 1


def _bare_main_guard(n: ast.AST) -> bool:
    return isinstance(n, ast.If) and not n.orelse and isinstance(n.test, ast.Compare) and isinstance(n.test.left, ast.Name) and n.test.left.id == "__name__" and any(isinstance(c, ast.Constant) and c.value == "__main__" for c in n.test.comparators)


def parse_python(source: str, skip_tests: bool = True) -> list[dict]:
    """Nodes of a Python file. A file that does not parse has one node, marked as an error."""
    out = _Rows("python")
    raw = source.encode()
    lines = [0]
    for line in source.split("\n"):
        lines.append(lines[-1] + len(line.encode()) + 1)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out.push("File", "module", 0, len(raw), (1, len(lines) - 1), is_error=True)
        out.pop()
        return out.rows

    def span(n):
        if not hasattr(n, "lineno"):
            return None
        return lines[n.lineno - 1] + n.col_offset, lines[n.end_lineno - 1] + n.end_col_offset, (n.lineno, n.end_lineno)

    def block(native: str, body: list, todo: list):
        a, b = span(body[0]), span(body[-1])
        todo.append(("push", "Unknown", native, a[0], b[1], (a[2][0], b[2][1]), {}, body))

    todo: list = [("node", tree)]
    while todo:  # an explicit stack: deep nesting must not overflow
        item = todo.pop()
        if item[0] == "pop":
            out.pop()
            continue
        if item[0] == "open":
            out.push("FinallyClause", "finally_clause", *item[1:])
            continue
        parts: list = []
        if item[0] == "push":
            _, kind, native, a, b, ln, more, body = item
            out.push(kind, native, a, b, ln, **more)
            parts = [("node", x) for x in body]
        else:
            n = item[1]
            if skip_tests and _bare_main_guard(n):
                continue
            native, where = type(n).__name__, span(n)
            if where is None and not isinstance(n, (ast.Module, ast.match_case, ast.comprehension)):
                todo.extend(("node", c) for c in reversed(list(ast.iter_child_nodes(n))))
                continue
            if where is None:
                inner = [s for c in ast.walk(n) if (s := span(c))]
                where = (min(s[0] for s in inner), max(s[1] for s in inner), (min(s[2][0] for s in inner), max(s[2][1] for s in inner))) if inner and not isinstance(n, ast.Module) else (0, len(raw), (1, len(lines) - 1))
            more: dict = {"text": raw[where[0] : where[1]].decode("utf-8", "replace")}
            kind = PYTHON_KINDS.get(native, "Unknown")
            if isinstance(n, ast.BoolOp):
                more["operator"] = "and" if isinstance(n.op, ast.And) else "or"
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                more["name"] = n.name
            if isinstance(n, ast.ClassDef):
                bases = " ".join(ast.unparse(b) for b in [*n.bases, *n.keywords])
                abstract = any(x in bases for x in ("ABC", "Protocol")) or any("abstractmethod" in ast.unparse(d) for m in n.body for d in getattr(m, "decorator_list", []))
                more["type_kind"] = "abstractClass" if abstract else "class"
            if isinstance(n, ast.Match):
                more["n_arms"] = len(n.cases)
            if isinstance(n, (ast.Try, ast.TryStar)):
                more["n_handlers"] = len(n.handlers)
            if isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                more["n_clauses"] = sum(1 + len(g.ifs) for x in ast.walk(n) if hasattr(x, "generators") for g in x.generators)
            if isinstance(n, ast.match_case):
                native = "case_clause"
            out.push(kind, native, where[0], where[1], where[2], **more)
            for field, value in ast.iter_fields(n):
                if field in ("body", "orelse", "finalbody") and isinstance(value, list) and not isinstance(n, ast.Module):
                    if value:
                        name = {"body": "block", "orelse": "else_clause", "finalbody": "block"}[field]
                        if field == "finalbody":
                            a, b = span(value[0]), span(value[-1])
                            parts.append(("final", a[0], b[1], (a[2][0], b[2][1]), value))
                        else:
                            block(name, value, parts)
                elif isinstance(value, ast.AST):
                    parts.append(("node", value))
                elif isinstance(value, list):
                    parts.extend(("node", v) for v in value if isinstance(v, ast.AST))
        todo.append(("pop",))
        for p in reversed(parts):
            if p[0] == "final":
                _, a, b, ln, body = p
                todo.append(("pop",))
                inner: list = []
                block("block", body, inner)
                todo.extend(inner)
                todo.append(("open", a, b, ln))
            else:
                todo.append(p)
    return out.rows


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = _Rows("html")
        self.out.push("File", "document", 0, 0, (1, 1))
        self.names = ["document"]

    def handle_starttag(self, tag, attrs):
        line, _ = self.getpos()
        self.out.push("Element", tag, 0, 0, (line, line), name=dict(attrs).get("id"))
        self.names.append(tag)
        if tag in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.names[1:]:
            while True:
                self.out.pop()
                if self.names.pop() == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            line, _ = self.getpos()
            self.out.push("Text", "text", 0, 0, (line, line), text=data)
            self.out.pop()


def parse_html(source: str) -> list[dict]:
    """Elements and texts of a page; what is left open at the end is closed there."""
    p = _Html()
    p.feed(source)
    p.close()
    while p.out.open:
        p.out.pop()
    return p.out.rows


PARSERS: dict[str, Callable[[str], list[dict]]] = {"python": parse_python, "html": parse_html}


def register_parser(language: str, parser: Callable[[str], list[dict]]) -> None:
    """A further language: a function from source text to rows of NODE_SCHEMA."""
    PARSERS[language] = parser


def parse(files: DataFrame) -> DataFrame:
    """Node table of files (file_id, language, source); files in a language without a parser give no rows. Null sources are empty."""
    parsers = dict(PARSERS)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file_id, language, source in b.itertuples(index=False):
                if language in parsers:
                    rows = pd.DataFrame(parsers[language](source or ""))
                    rows.insert(0, "file_id", file_id)
                    yield rows

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "language", "source").mapInPandas(work, f"file_id {kind}, {NODE_SCHEMA}")
