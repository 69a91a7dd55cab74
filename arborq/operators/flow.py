"""Control-flow graphs: building them from statement trees, and their metrics.

Building is a sequential walk, so Python gets the rows of each file in turn, in batches of many files (``by_file``); the graphs of all
files are two tables (blocks and edges), whose counts are plain aggregates.
"""

from __future__ import annotations

import sys
from collections import defaultdict, deque
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .module_graph import sorted_join

STATEMENTS = frozenset("IfStmt ForStmt WhileStmt MatchStmt TryStmt CatchClause FinallyClause ReturnStmt BreakStmt ContinueStmt ThrowStmt ExprStmt AssignExpr CallExpr VarDecl".split())
DECISIONS = frozenset("IfStmt ForStmt WhileStmt MatchStmt TryStmt CatchClause FinallyClause ReturnStmt BreakStmt ContinueStmt ThrowStmt".split())
#: Grammar nodes that only group statements, and those that are arms of a match.
CONTAINERS = frozenset("block suite compound_statement statement_block function_body do_statement else_clause elif_clause statement_list expression_case type_case default_case communication_case".split())
ARMS = frozenset("match_arm case_clause expression_case type_case default_case communication_case switch_case switch_default case_statement".split())
CALLABLES = frozenset(("FunctionDecl", "MethodDecl"))


#: Rows that Python holds at most before it sends them on.
SENT = 10_000


def by_file(rows: DataFrame, work, columns: dict[str, pa.DataType], *order: str, parts: int | None = None) -> DataFrame:
    """(file_id, columns...): what ``work`` gives for the rows of each file, as tuples with file_id first, sorted by ``order``.

    A file's rows lie together in one partition and pass as a stream, so a task holds one file and a batch, and no file costs a call or a frame of its own. The sort
    before holds a partition: ``parts`` fixes their number, else the session's settings do.
    """
    kind = rows.schema["file_id"].dataType.simpleString()
    names = ["file_id", *columns]

    def run(batches):
        types = {}

        def read():
            for b in batches:
                types.setdefault("file_id", b.schema.field(0).type)
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def sent(out):
            cells = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cells, [types["file_id"], *columns.values()], strict=True)], names)

        out = []
        for file, own in groupby(read(), itemgetter(0)):
            out += [(file, *x) for x in work(list(own))]
            if len(out) >= SENT:
                yield sent(out)
                out = []
        if out:
            yield sent(out)

    own = rows.select("file_id", *[c for c in rows.columns if c != "file_id"]).repartition(*([parts] if parts else []), "file_id").sortWithinPartitions("file_id", *order)
    return own.mapInArrow(run, ", ".join([f"file_id {kind}", *[f"{c} {_DDL[t]}" for c, t in columns.items()]]))


_DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}


class Tree:
    """One file's nodes by identifier, children in order; of a frame, or of its columns that are sorted by ``pre`` already."""

    def __init__(self, rows: pd.DataFrame | dict[str, list]):
        if isinstance(rows, pd.DataFrame):
            rows = rows.sort_values("pre")
        self.kind = dict(zip(rows["node_id"], rows["kind"], strict=True))
        self.native = dict(zip(rows["node_id"], rows["native_kind"] if "native_kind" in rows else [""] * len(rows["node_id"]), strict=True))
        self.children: dict[str, list[str]] = defaultdict(list)
        self.root = None
        for node, parent in zip(rows["node_id"], rows["parent_id"], strict=True):
            if parent is None or parent not in self.kind:
                self.root = self.root or node
            else:
                self.children[parent].append(node)

    def container(self, n: str) -> bool:
        return self.kind[n] == "Unknown" and self.native[n] in CONTAINERS

    def arm(self, n: str) -> bool:
        return self.kind[n] == "Unknown" and self.native[n] in ARMS

    def statements(self, nodes: list[str]) -> list[str]:
        """Statement nodes among these, and in their containers."""
        out: list[str] = []
        todo = list(reversed(nodes))
        while todo:
            n = todo.pop()
            if self.kind[n] in STATEMENTS:
                out.append(n)
            elif self.container(n):
                todo.extend(reversed(self.children[n]))
        return out

    def first_container(self, n: str) -> list[str]:
        return next((self.statements([c]) for c in self.children[n] if self.container(c)), [])

    def arms(self, n: str) -> list[str]:
        own = [c for c in self.children[n] if self.arm(c)]
        if own:
            return own
        return next((a for c in self.children[n] if self.kind[c] == "Unknown" and (a := [x for x in self.children[c] if self.arm(x)])), [])

    def decisions_below(self, n: str) -> list[str]:
        out: list[str] = []
        todo = list(reversed(self.children[n]))
        while todo:
            c = todo.pop()
            if self.kind[c] in DECISIONS:
                out.append(c)
            else:
                todo.extend(reversed(self.children[c]))
        return out

    def callables(self) -> list[tuple[str, list[str]]]:
        """(label, body) of callables not inside another, then of the module's own statements."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            n = todo.pop()
            if self.kind[n] in CALLABLES:
                out.append((self.kind[n], self.statements(self.children[n])))
            else:
                todo.extend(reversed(self.children[n]))
        if self.root and self.kind[self.root] == "File":
            own = self.statements([c for c in self.children[self.root] if self.kind[c] not in (*CALLABLES, "TypeDecl")])
            if own:
                out.append(("FunctionDecl", own))
        return out


class Graph:
    """The blocks and edges of one file."""

    def __init__(self, tree: Tree):
        self.tree, self.labels, self.stmts, self.edges = tree, [], [], []
        self.loops: list[tuple[int | None, int]] = []  # where continue and break go
        self.finals: list[dict] = []  # enclosing finally clauses: block, and what was routed into it
        # the walk calls itself once or twice a level, in Python frames only
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(tree.kind) + 1000))
        entry, self.exit = self.block("entry"), self.block("exit")
        found = tree.callables()
        if not found:
            self.edge(entry, self.exit, "unconditional")
        for label, body in found:
            start = self.block(f"call_{label}")
            self.edge(entry, start, "unconditional")
            tail = self.sequence(body, start)
            if tail is not None:
                self.edge(tail, self.exit, "unconditional")

    def block(self, label: str) -> int:
        self.labels.append(label)
        self.stmts.append([])
        return len(self.labels) - 1

    def edge(self, src: int, dst: int, kind: str) -> None:
        self.edges.append((src, dst, kind))

    def sequence(self, nodes: list[str], cur: int) -> int | None:
        for n in nodes:
            nxt = self.statement(n, cur)
            if nxt is None:
                return None
            cur = nxt
        return cur

    def statement(self, n: str, cur: int) -> int | None:
        kind = self.tree.kind[n]
        build = {"IfStmt": self.branch, "ForStmt": self.loop, "WhileStmt": self.loop, "MatchStmt": self.match, "TryStmt": self.attempt}.get(kind)
        if build:
            return build(n, cur)
        if kind in ("ReturnStmt", "ThrowStmt"):
            self.stmts[cur].append(n)
            way = "return" if kind == "ReturnStmt" else "exception"
            if self.finals:
                self.finals[-1]["routed"].add(way)
                self.edge(cur, self.finals[-1]["block"], "unconditional")
            else:
                self.edge(cur, self.exit, way)
            return None
        if kind in ("BreakStmt", "ContinueStmt"):
            if kind == "BreakStmt":
                to = self.loops[-1][1] if self.loops else None
            else:
                to = next((c for c, _ in reversed(self.loops) if c is not None), None)
            if to is not None:
                self.edge(cur, to, "break" if kind == "BreakStmt" else "continue")
            return None
        below = self.tree.decisions_below(n)
        if below:
            inner = self.block("nested")
            self.edge(cur, inner, "unconditional")
            tail = self.sequence(below, inner)
            return cur if tail is None else tail
        if kind in STATEMENTS:
            self.stmts[cur].append(n)
        return cur

    def branch(self, n: str, cur: int) -> int:
        self.stmts[cur].append(n)
        kids = self.tree.children[n]
        at = next((i for i, c in enumerate(kids) if self.tree.container(c)), None)
        then = [] if at is None else self.tree.statements([kids[at]])
        other = [] if at is None else self.tree.statements(kids[at + 1 :])
        join, first = self.block("if_join"), self.block("if_then")
        self.edge(cur, first, "true")
        tail = self.sequence(then, first)
        if tail is not None:
            self.edge(tail, join, "unconditional")
        if other:
            second = self.block("if_else")
            self.edge(cur, second, "false")
            tail = self.sequence(other, second)
            if tail is not None:
                self.edge(tail, join, "unconditional")
        else:
            self.edge(cur, join, "false")
        return join

    def loop(self, n: str, cur: int) -> int:
        header = self.block("loop_header")
        self.edge(cur, header, "unconditional")
        self.stmts[header].append(n)
        body, after = self.block("loop_body"), self.block("loop_after")
        self.edge(header, body, "true")
        self.edge(header, after, "false")
        self.loops.append((header, after))
        tail = self.sequence(self.tree.first_container(n), body)
        self.loops.pop()
        if tail is not None:
            self.edge(tail, header, "loop_back")
        return after

    def match(self, n: str, cur: int) -> int:
        self.stmts[cur].append(n)
        join = self.block("match_join")
        self.loops.append((None, join))
        arms = self.tree.arms(n)
        for a in arms:
            arm = self.block("match_arm")
            self.edge(cur, arm, "switch_case")
            tail = self.sequence([a], arm)
            if tail is not None:
                self.edge(tail, join, "unconditional")
        self.loops.pop()
        if not arms:
            self.edge(cur, join, "unconditional")
        return join

    def attempt(self, n: str, cur: int) -> int | None:
        kids = self.tree.children[n]
        handlers = [c for c in kids if self.tree.kind[c] == "CatchClause"]
        final = next((c for c in reversed(kids) if self.tree.kind[c] == "FinallyClause"), None)
        self.stmts[cur].append(n)
        join, body = self.block("try_join"), self.block("try_body")
        state = {"block": self.block("try_finally"), "routed": set()} if final else None
        self.edge(cur, body, "unconditional")
        if state:
            self.finals.append(state)
        normal = False
        after = state["block"] if state else join
        tail = self.sequence(self.tree.first_container(n), body)
        if tail is not None:
            normal = True
            self.edge(tail, after, "unconditional")
        if not handlers:
            self.edge(body, join, "exception")
        for h in handlers:
            handler = self.block("catch_handler")
            self.edge(body, handler, "exception")
            tail = self.sequence(self.tree.first_container(h), handler)
            if tail is not None:
                normal = True
                self.edge(tail, after, "unconditional")
        if state:
            self.finals.pop()
            tail = self.sequence(self.tree.first_container(final), state["block"])
            if tail is None:
                return None
            for way in sorted(state["routed"], reverse=True):
                if self.finals:
                    self.finals[-1]["routed"].add(way)
                    self.edge(tail, self.finals[-1]["block"], "unconditional")
                else:
                    self.edge(tail, self.exit, way)
            if normal:
                self.edge(tail, join, "unconditional")
        return join if normal else None


def build(nodes: DataFrame) -> DataFrame:
    """Flow graphs of all files: rows (file_id, src, dst, kind, label, stmts). A block has dst null; an edge has label null."""
    cols = ["file_id", "node_id", "parent_id", "pre", "kind"] + (["native_kind"] if "native_kind" in nodes.columns else [])

    def one(rows: list[tuple]):
        g = Graph(Tree(dict(zip(cols, zip(*rows, strict=True), strict=True))))
        yield from ((i, None, None, label, s) for i, (label, s) in enumerate(zip(g.labels, g.stmts, strict=True)))
        yield from ((a, b, k, None, None) for a, b, k in g.edges)

    return by_file(nodes.select(*cols), one, {"src": pa.int64(), "dst": pa.int64(), "kind": pa.string(), "label": pa.string(), "stmts": pa.list_(pa.string())}, "pre")


def build_and_measure(nodes: DataFrame) -> DataFrame:
    """The rows of ``build``, of ``procedures`` (proc, ord, stmt) and of ``metrics`` (METRICS) in one pass over the trees; the other columns of a row are null."""
    cols = ["file_id", "node_id", "parent_id", "pre", "kind"] + (["native_kind"] if "native_kind" in nodes.columns else [])
    graph = {"src": pa.int64(), "dst": pa.int64(), "kind": pa.string(), "label": pa.string(), "stmts": pa.list_(pa.string())}
    more = {"proc": pa.int64(), "ord": pa.int64(), "stmt": pa.string()} | dict.fromkeys(METRICS, pa.int64())
    none = (None,) * len(graph)
    no_more, no_metrics = (None,) * len(more), (None,) * len(METRICS)

    def one(rows: list[tuple]):
        g = Graph(Tree(dict(zip(cols, zip(*rows, strict=True), strict=True))))
        blocks = [(i, None, None, label, s) for i, (label, s) in enumerate(zip(g.labels, g.stmts, strict=True))]
        edges = [(a, b, k, None, None) for a, b, k in g.edges]
        for row in (*blocks, *edges):
            yield *row, *no_more
        own = [(None, *row) for row in (*blocks, *sorted(edges, key=itemgetter(0)))]
        for row in _procedures([(f, a, b, label, s) for f, a, b, _, label, s in own]):
            yield *none, *row, *no_metrics
        for row in _metrics([(f, a, b, k) for f, a, b, k, _, _ in own]):
            yield *none, None, None, None, *row

    return by_file(nodes.select(*cols), one, graph | more, "pre")


def procedures_of(measured: DataFrame) -> DataFrame:
    return measured.filter("proc IS NOT NULL").select("file_id", "proc", "ord", "stmt")


def metrics_of(measured: DataFrame) -> DataFrame:
    return measured.filter("cyclomatic IS NOT NULL").select("file_id", *METRICS)


def blocks_of(graph: DataFrame) -> DataFrame:
    return graph.filter("src IS NOT NULL AND dst IS NULL").select("file_id", F.col("src").alias("block_id"), "label", "stmts")


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.filter("dst IS NOT NULL").select("file_id", "src", "dst", "kind")


def _procedures(rows: list[tuple]):
    """(proc, ord, stmt) of one file's rows (file_id, src, dst, label, stmts)."""
    held, ends, succ = {}, {}, defaultdict(list)
    for _, a, b, label, stmts in rows:
        if b is not None:
            succ[a].append(b)
            continue
        held[a] = stmts or []
        if label in ("entry", "exit"):
            ends[label] = a
    entry, exit_ = ends.get("entry", 0), ends.get("exit", 1)
    starts = list(dict.fromkeys(b for b in succ[entry] if b != exit_))
    others = set(starts)
    for p in starts:
        seen, todo = set(), [p]
        while todo:
            x = todo.pop()
            if x not in seen and x != exit_:
                seen.add(x)
                todo += [y for y in succ[x] if y not in others or y == p]
        yield from ((p, i, s) for i, s in enumerate(s for b in sorted(seen) for s in held.get(b, [])))
    if not starts:
        yield from ((-1, i, s) for i, s in enumerate(s for b in sorted(held) for s in held[b]))


def procedures(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, proc, ord, stmt): the statements of each procedure, in the order of their blocks.

    A procedure is a block that the entry leads to; its statements are those of the blocks that it reaches without passing the exit or another
    procedure's first block. Without procedures all of a file's statements are one, of proc -1.
    """
    rows = blocks.select("file_id", F.col("block_id").alias("src"), F.lit(None).cast("long").alias("dst"), "label", "stmts").unionByName(edges.select("file_id", "src", "dst", F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("stmts")))

    return by_file(rows, _procedures, {"proc": pa.int64(), "ord": pa.int64(), "stmt": pa.string()}, "src")


def successors(edges: DataFrame, block: int) -> DataFrame:
    return edges.filter(F.col("src") == block)


def predecessors(edges: DataFrame, block: int) -> DataFrame:
    return edges.filter(F.col("dst") == block)


def essential(edges: DataFrame) -> DataFrame:
    """(file_id, essential): 1 and the edges that jump."""
    return edges.groupBy("file_id").agg((1 + F.count_if(F.col("kind").isin("break", "continue", "return"))).alias("essential"))


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _reach(start: int, near: dict[int, list[int]]) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for x in near[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def immediate_postdominators(succ: dict[int, list[int]], exit_: int) -> dict[int, int]:
    """For each node with a way to the exit the nearest node that all its ways pass; the exit's is itself."""
    pred = defaultdict(list)
    for a, bs in list(succ.items()):
        for b in bs:
            pred[b].append(a)
    order, seen, todo = [], {exit_}, [(exit_, iter(pred[exit_]))]
    while todo:  # post-order over the reversed edges
        node, rest = todo[-1]
        nxt = next((x for x in rest if x not in seen), None)
        if nxt is None:
            order.append(node)
            todo.pop()
        else:
            seen.add(nxt)
            todo.append((nxt, iter(pred[nxt])))
    number = {n: i for i, n in enumerate(order)}
    above = {exit_: exit_}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            best = None
            for m in succ[n]:
                if m in above:
                    if best is None:
                        best = m
                    while best != m:  # the nearest common one
                        if number[best] < number[m]:
                            best = above[best]
                        else:
                            m = above[m]
            if best is not None and above.get(n) != best:
                above[n], changed = best, True
    return above


def graph_metrics(ids: list[int], edges: list[tuple[int, int, str]], entry: int = 0, exit_: int = 1) -> tuple[int, int, int, int]:
    """(components, nesting depth, longest path, independent cycles) of one graph."""
    succ, both = defaultdict(list), defaultdict(list)
    for a, b, _ in edges:
        succ[a].append(b)
        both[a].append(b)
        both[b].append(a)
    left, components = set(ids), 0
    while left:
        left -= _reach(next(iter(left)), both)
        components += 1
    # nesting: a branching head counts for what its branches reach, up to what every way to the exit passes
    above = immediate_postdominators(succ, exit_)
    onward = defaultdict(list)
    for a, b, k in edges:
        if k not in ("loop_back", "continue"):
            onward[a].append(b)
    heads = defaultdict(list)
    for a, b, k in edges:
        if k in ("true", "switch_case"):
            heads[a].append(b)
    depth: dict[int, int] = defaultdict(int)
    for head, todo in heads.items():
        # a head that never gets to the exit leaves its region open; no way leads to a later postdominator but past the nearest
        seen = {head, above[head]} if head in above else set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                depth[x] += 1
                todo.extend(onward[x])
    forward = [(a, b) for a, b, k in edges if k not in ("loop_back", "continue")]
    out, degree = defaultdict(list), defaultdict(int)
    for a, b in forward:
        out[a].append(b)
        degree[b] += 1
    order, ready, far = [], deque(i for i in ids if not degree[i]), {entry: 0}
    while ready:
        x = ready.popleft()
        order.append(x)
        for y in out[x]:
            if x in far:
                far[y] = max(far.get(y, 0), far[x] + 1)
            degree[y] -= 1
            if not degree[y]:
                ready.append(y)
    longest = far.get(exit_, 0) if len(order) == len(ids) else 0
    proper = sum(a != b for a, b, _ in edges)
    return components, max(depth.values(), default=0), longest, proper - len(ids) + components


METRICS = ("cyclomatic", "essential", "nesting_depth", "longest_path", "cycles")


def _metrics(rows: list[tuple]):
    """METRICS of one file's rows (file_id, src, dst, kind)."""
    ids = [a for _, a, b, _ in rows if b is None]
    es = [(a, b, k) for _, a, b, k in rows if b is not None]
    parts, nesting, longest, cycles = graph_metrics(ids, es)
    jumps = sum(k in ("break", "continue", "return") for _, _, k in es)
    yield max(1, len(es) - len(ids) + 2 * parts), 1 + jumps, nesting, longest, cycles


def metrics(blocks: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(file_id, cyclomatic, essential, nesting_depth, longest_path, cycles) of each file's graph."""
    rows = blocks.select("file_id", F.col("block_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("kind")).unionByName(edges.select("file_id", "src", "dst", "kind"))

    return by_file(rows, _metrics, dict.fromkeys(METRICS, pa.int64()), "src", parts=parts)


def cycle_basis(ids: list[int], edges: list[tuple[int, int]]) -> list[list[int]]:
    """Blocks of each independent cycle: a breadth-first forest over the undirected graph, closed by each other edge. Self-loops are skipped."""
    near = defaultdict(list)
    for i, (a, b) in enumerate(edges):
        if a != b:
            near[a].append((b, i))
            near[b].append((a, i))
    up: dict[int, tuple[int, int]] = {}
    depth: dict[int, int] = {}
    used: set[int] = set()
    for root in ids:
        if root in depth:
            continue
        depth[root], todo = 0, deque([root])
        while todo:
            x = todo.popleft()
            for y, i in near[x]:
                if y not in depth:
                    depth[y], up[y] = depth[x] + 1, (x, i)
                    used.add(i)
                    todo.append(y)
    out = []
    for i, (a, b) in enumerate(edges):
        if a == b or i in used:
            continue
        left, right = [a], [b]
        while left[-1] != right[-1]:
            side = left if depth[left[-1]] >= depth[right[-1]] else right
            side.append(up[side[-1]][0])
        out.append(left + right[-2::-1])
    return out


def cycles(blocks: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(file_id, cycle, blocks): a cycle basis of each file's graph; ``parts`` as in ``by_file``."""
    rows = blocks.select("file_id", F.col("block_id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(edges.select("file_id", "src", "dst"))

    def one(rows: list[tuple]):
        yield from enumerate(cycle_basis([a for _, a, b in rows if b is None], [(a, b) for _, a, b in rows if b is not None]))

    return by_file(rows, one, {"cycle": pa.int64(), "blocks": pa.list_(pa.int64())}, "src", "dst", parts=parts)


def cycle_spans(cycles_: DataFrame, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_id, cycle, start_line, end_line) of the statements in each cycle's blocks."""
    inside = cycles_.select("file_id", "cycle", F.explode(F.array_distinct("blocks")).alias("block_id"))
    stmts = blocks.select("file_id", "block_id", F.explode("stmts").alias("node_id"))
    j = sorted_join(sorted_join(inside, stmts, ["file_id", "block_id"]), nodes.select("file_id", "node_id", "start_line", "end_line"), ["file_id", "node_id"])
    return j.groupBy("file_id", "cycle").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
