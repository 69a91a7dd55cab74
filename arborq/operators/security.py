"""Dangerous calls and taint flows: registries, callee extraction, suffix matching, containment, reachability."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import BITS, TOP
from .flow import by_file
from .module_graph import cut
from .tree import ancestors

#: Calls taken for dangerous, by language.
DANGER = {
    "python": "eval exec compile pickle.loads yaml.load marshal.loads subprocess.call subprocess.Popen subprocess.run os.system os.popen __import__".split(),
    "javascript": "eval Function setTimeout setInterval innerHTML document.write child_process.exec".split(),
    "typescript": "eval Function innerHTML document.write child_process.exec".split(),
    "rust": "unsafe transmute from_raw".split(),
    "cpp": "gets strcpy strcat sprintf scanf system".split(),
    "go": "exec.Command exec.CommandContext os.StartProcess syscall.Exec syscall.ForkExec".split(),
}
#: Expressions whose values come from outside, by language.
SOURCES = {
    "python": "input sys.argv request.args request.form request.json os.environ".split(),
    "javascript": "process.argv process.env req.body req.query document.location window.location".split(),
    "typescript": "process.argv process.env req.body req.query".split(),
    "rust": "std::env::args std::env::var".split(),
    "cpp": "argv getenv scanf".split(),
    "go": "os.Getenv os.Args r.FormValue r.URL flag.String".split(),
}


def table_of(spark: SparkSession, values: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(lang, key) for lang, keys in values.items() for key in keys], "language string, key string")


def callee(text: Column) -> Column:
    """The dotted name before the first parenthesis, empty without one. A path with :: has none."""
    return F.regexp_extract(F.trim(text), "^([A-Za-z_][A-Za-z0-9_.]*)\\s*\\(", 1)


def _suffixes(name: Column) -> Column:
    """All endings of a name, itself included: what a key must equal to match, so that matching is a join by equality."""
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.length(name)))).otherwise(F.array().cast("array<string>"))


def _fits(name: Column, key: Column) -> Column:
    """Of a key that ends the name: equal, or dotted, or longer than three characters (at any place, not only behind a dot)."""
    return (name == key) | (F.length(key) > 3) | F.contains(key, F.lit("."))


def matches(name: Column, key: Column) -> Column:
    return F.endswith(name, key) & _fits(name, key)


def effective_registry(registry: DataFrame, allowed: DataFrame) -> DataFrame:
    """Registry entries that no allowed pattern matches."""
    hit = allowed.select("pattern").distinct().withColumn("key", F.explode(_suffixes(F.col("pattern")))).filter(_fits(F.col("pattern"), F.col("key")))
    return registry.join(hit.select("key").distinct(), "key", "left_anti")


def match_registry(calls: DataFrame, registry: DataFrame, on_language: bool = False) -> DataFrame:
    """calls (with callee) that match, each with its key: the exact one, else the longest.

    Distinct callees meet the registry once, by the equality of an ending and a key; the calls then join by equality.
    """
    keys = ["callee", "language"] if on_language else ["callee"]
    names = calls.filter("callee <> ''").select(*keys).distinct().withColumn("key", F.explode(_suffixes(F.col("callee"))))
    names = names.filter(_fits(F.col("callee"), F.col("key")))
    on = ["key", "language"] if on_language else ["key"]
    best = names.join(registry.select(*on).distinct(), on).groupBy(*keys).agg(F.max_by("key", F.struct(F.col("callee") == F.col("key"), F.length("key"), "key")).alias("key"))
    return calls.join(best, keys)


def dangerous_calls(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """(file_id, n): matching calls of each file; files without one have no row."""
    return match_registry(calls, registry).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def source_nodes(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Identifier and member nodes whose whole text is a source."""
    own = nodes.filter(F.col("kind").isin("Identifier", "MemberExpr"))
    return own.withColumn("_t", F.trim("text")).join(sources.select(F.col("key").alias("_t")).distinct(), "_t", "left_semi").drop("_t")


def bridge(nodes: DataFrame, statements: DataFrame, parts: int | None = None) -> DataFrame:
    """(file_id, node_id, stmt): the smallest statement whose span holds the node.

    ``nodes`` and ``statements`` are nodes of one tree a file, with (file_id, node_id, pre, last): the innermost is the one opened last, so one
    pass over both in order finds it. ``parts`` fixes the number of its partitions, as in ``by_file``.
    """
    part = lambda df, name: df.select("file_id", "node_id", "pre", "last", F.lit(name).alias("_as"))
    both = part(nodes, "node").unionByName(part(statements, "stmt"))
    both = both.repartition(parts, "file_id") if parts else both
    found = ancestors(both, F.col("_as") == "stmt", F.col("_as") == "node", ("node_id",), strict=False, nearest=True)
    return found.select("file_id", "node_id", F.col("anc.node_id").alias("stmt"))


def reach_bits(near: dict, bit: dict) -> dict:
    """Of each node of a graph (node -> successors) the ORed bits of all nodes that it reaches, itself included.

    Strongly connected nodes share one word. Components are closed successors first, so one pass over the edges is enough, whatever the number of bits; the walk
    keeps its own stack.
    """
    number: dict = {}
    low: dict = {}
    open_: list = []
    is_open: set = set()
    bits: dict = {}
    for root in [*near, *bit]:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        open_.append(root)
        is_open.add(root)
        todo = [(root, iter(near.get(root, ())))]
        while todo:
            x, rest = todo[-1]
            y = next((y for y in rest if y not in number or y in is_open), None)
            if y is not None and y not in number:
                number[y] = low[y] = len(number)
                open_.append(y)
                is_open.add(y)
                todo.append((y, iter(near.get(y, ()))))
            elif y is not None:
                low[x] = min(low[x], number[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == number[x]:
                    at = len(open_) - 1
                    while open_[at] != x:
                        at -= 1
                    part, word = open_[at:], 0
                    del open_[at:]
                    is_open.difference_update(part)
                    inside = set(part)
                    for m in part:
                        word |= bit.get(m, 0)
                        for y in near.get(m, ()):
                            if y not in inside:
                                word |= bits[y]
                    for m in part:
                        bits[m] = word
    return bits


def reached(starts: DataFrame, ends: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(file_id, start, at): the ends (file_id, at) that each start (file_id, start) reaches along edges (file_id, src, dst), itself included.

    A file's graph passes at once; all its starts are answered by one pass that carries a bit for each end. ``parts`` as in ``by_file``.
    """
    node = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64()}[edges.schema["src"].dataType.typeName()]
    row = lambda df, a, b, as_: df.select("file_id", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(as_).alias("what")).distinct()
    rows = row(edges, "src", "dst", 0).unionByName(row(starts, "start", "start", 1)).unionByName(row(ends, "at", "at", 2))

    def one(rows: list[tuple]):
        near, wanted = defaultdict(list), [a for _, a, _, what in rows if what == 2]
        for _, a, b, what in rows:
            if what == 0:
                near[a].append(b)
        bits = reach_bits(near, {x: 1 << i for i, x in enumerate(wanted)}) if wanted else {}
        for _, s, _, what in rows:
            word = bits.get(s, 0) if what == 1 else 0
            while word:
                i = (word & -word).bit_length() - 1
                yield s, wanted[i]
                word &= word - 1

    return by_file(rows, one, {"start": node, "at": node}, parts=parts)


def taint_flows(sources: DataFrame, sinks: DataFrame, statements: DataFrame, edges: DataFrame, bridged: bool = True, parts: int | None = None) -> DataFrame:
    """(file_id, source, sink): pairs whose statements are connected. Without ``bridged`` the nodes' own identifiers are looked up."""
    own = lambda x: cut(bridge(x, statements, parts)) if bridged else x.select("file_id", "node_id", F.col("node_id").alias("stmt"))
    a = own(sources).select("file_id", F.col("node_id").alias("source"), F.col("stmt").alias("start"))
    b = own(sinks).select("file_id", F.col("node_id").alias("sink"), F.col("stmt").alias("at"))
    met = reached(a, b, edges, parts)
    return a.join(met, ["file_id", "start"]).join(b, ["file_id", "at"]).select("file_id", "source", "sink").distinct()


def taint_findings(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flows (file_id, source, sink) as findings (file_id, source_id, sink_id, kind, line, snippet, callee, source, sink), by the sink's place."""
    at = lambda c: nodes.select("file_id", F.col("node_id").alias(c), F.col("text").alias(c + "_text"), F.col("start_line").alias(c + "_line"))
    j = flows.join(at("source"), ["file_id", "source"]).join(at("sink"), ["file_id", "sink"])
    return j.select("file_id", F.col("source").alias("source_id"), F.col("sink").alias("sink_id"), F.lit("taint_flow").alias("kind"), F.col("sink_line").alias("line"), F.col("sink_text").alias("snippet"), callee(F.col("sink_text")).alias("callee"), F.trim("source_text").alias("source"), F.trim("sink_text").alias("sink"))


def findings(calls: DataFrame, registry: DataFrame, max_findings: int | None = None) -> DataFrame:
    """Dangerous calls as findings (file_id, kind, line, start_byte, snippet, callee); the first few of a file, by line and byte, where asked."""
    from pyspark.sql import Window as W

    out = match_registry(calls, registry).select("file_id", F.lit("dangerous_call").alias("kind"), "line", "start_byte", F.col("text").alias("snippet"), "callee")
    if max_findings is not None:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("file_id").orderBy("line", "start_byte"))).filter(F.col("_n") <= max_findings).drop("_n")
    return out


def glob_regex(glob: Column) -> Column:
    """A pattern for globs of * and ?."""
    escaped = F.regexp_replace(glob, "([.+^$(){}\\[\\]|\\\\])", "\\\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, "\\*", ".*"), "\\?", "."), F.lit("$"))


def apply_allowlist(found: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Findings with acknowledged and its reason: an allow row matches when its scope glob fits the path and its pattern the callee."""
    a = allowlist.select(F.col("pattern").alias("_key"), "reason", F.coalesce("scope", F.lit("*")).alias("scope"))
    names = found.select("path", "callee").distinct().withColumn("_key", F.explode(_suffixes(F.col("callee")))).filter(_fits(F.col("callee"), F.col("_key")))
    hit = names.join(a, "_key").withColumn("_rx", glob_regex(F.col("scope"))).filter(F.expr("path RLIKE _rx"))
    hit = hit.groupBy("path", "callee").agg(F.min("reason").alias("reason"))
    return found.join(hit, ["path", "callee"], "left").withColumn("acknowledged", F.col("reason").isNotNull())


def adjusted_mask(mask: Column, acknowledged: Column) -> Column:
    """A perfect verdict that rests on acknowledged risks does not hold for the secure pillar."""
    return F.when((mask == TOP) & acknowledged, mask.bitwiseAND(F.lit(TOP - BITS["secure"]))).otherwise(mask)


#: Operations by kind of call.
DYNAMIC, SHELL, DESERIALISE, DOM, BOUNDED, UNSAFE = (
    ("replace_dynamic_execution", "use_static_dispatch"), ("remove_shell_execution", "pass_argument_array"), ("use_safe_deserializer", "validate_input"),
    ("sanitize_html", "build_dom_nodes"), ("use_bounded_copy",), ("encapsulate_unsafe",),
)
TAINT_OPERATIONS, DEFAULT_OPERATIONS = ("validate_input", "sanitize_before_sink"), ("replace_dangerous_api", "validate_input")
#: Call, advice, operations.
ADVICE = (
    ("eval", "Replace `eval` with `ast.literal_eval` or explicit parsing.", DYNAMIC),
    ("exec", "Remove `exec`; call the code path directly or dispatch via a map.", DYNAMIC),
    ("compile", "Avoid dynamic `compile`; use a static, reviewed code path.", DYNAMIC),
    ("__import__", "Import statically; avoid `__import__` on dynamic names.", DYNAMIC),
    ("function", "Avoid the `Function` constructor; call a known function directly.", DYNAMIC),
    ("settimeout", "Pass a function reference to `setTimeout`, never a string.", DYNAMIC),
    ("setinterval", "Pass a function reference to `setInterval`, never a string.", DYNAMIC),
    ("pickle.loads", "Use `json` or a schema-validated deserializer instead of `pickle`.", DESERIALISE),
    ("marshal.loads", "Avoid `marshal`; deserialize with `json` or a safe format.", DESERIALISE),
    ("yaml.load", "Use `yaml.safe_load` instead of `yaml.load`.", DESERIALISE),
    ("os.system", "Replace `os.system` with `subprocess.run([...])` (no shell).", SHELL),
    ("os.popen", "Replace `os.popen` with `subprocess.run([...], capture_output=True)`.", SHELL),
    ("subprocess.call", "Pass an argument list and avoid `shell=True`.", SHELL),
    ("subprocess.run", "Pass an argument list and avoid `shell=True`.", SHELL),
    ("subprocess.popen", "Pass an argument list and avoid `shell=True`.", SHELL),
    ("child_process.exec", "Use `execFile`/`spawn` with an argument array (no shell).", SHELL),
    ("system", "Replace `system()` with an `exec*`-family call (no shell).", SHELL),
    ("exec.command", "Pass a fixed argument list to `exec.Command`; never build the command or its args from untrusted input.", SHELL),
    ("exec.commandcontext", "Pass a fixed argument list to `exec.CommandContext`; never build the command or its args from untrusted input.", SHELL),
    ("os.startprocess", "Avoid `os.StartProcess` with untrusted paths or args; validate and pass an explicit argument list.", SHELL),
    ("syscall.exec", "Avoid `syscall.Exec`; validate the program path and argument list before replacing the process image.", SHELL),
    ("syscall.forkexec", "Avoid `syscall.ForkExec`; validate the program path and argument list, or prefer `os/exec` with explicit arguments.", SHELL),
    ("innerhtml", "Set text via `textContent`, or sanitize before assigning HTML.", DOM),
    ("document.write", "Build DOM nodes instead of `document.write`.", DOM),
    ("strcpy", "Use a bounded copy (`strncpy`/`snprintf`).", BOUNDED),
    ("strcat", "Use a bounded concat (`strncat`/`snprintf`).", BOUNDED),
    ("sprintf", "Use `snprintf` with an explicit buffer size.", BOUNDED),
    ("scanf", "Use bounded input (`fgets` + parsing, or width-limited `scanf`).", BOUNDED),
    ("gets", "Replace `gets` with `fgets` and an explicit length.", BOUNDED),
    ("transmute", "Avoid `mem::transmute`; use a safe conversion or `bytemuck`.", UNSAFE),
    ("unsafe", "Confine or remove the `unsafe` block; document the invariant it upholds.", UNSAFE),
    ("from_raw", "Encapsulate `from_raw` behind a safe wrapper; document pointer ownership.", UNSAFE),
)


def advice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, list(o)) for k, a, o in ADVICE], "key string, advice string, operations array<string>")


def remediation(found: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Findings (kind, line, callee; source and sink of flows) with advice and operations: a flow's own line, else the entry that the lower-cased
    callee matches, else a general one."""
    table = (advice if advice is not None else advice_table(found.sparkSession)).select(F.lower("key").alias("_key"), "advice", *(["operations"] if advice is None or "operations" in advice.columns else []))
    calls = found.withColumn("_callee", F.lower(F.coalesce("callee", F.lit(""))))
    best = match_registry(calls.select(F.col("_callee").alias("callee")).distinct(), table.select(F.col("_key").alias("key"))).select(F.col("callee").alias("_callee"), F.col("key").alias("_key"))
    out = calls.join(best, "_callee", "left").join(table, "_key", "left").drop("_key", "_callee")
    listed = lambda names: F.array(*map(F.lit, names))
    column = lambda c: F.col(c).cast("string") if c in found.columns else F.lit(None).cast("string")
    flow = F.coalesce(column("kind") == "taint_flow", F.lit(False))
    line = F.coalesce(column("line"), F.lit("0"))
    callee_ = F.when(column("callee") != "", column("callee"))
    through = F.concat(F.lit("Validate/sanitize `"), F.coalesce(column("source"), F.lit("untrusted input")), F.lit("` before it reaches `"), F.coalesce(callee_, column("sink"), F.lit("the dangerous call")), F.lit("` (line "), line, F.lit(")."))
    general = F.concat(F.lit("Remove or sandbox the dangerous call `"), F.coalesce(column("callee"), F.lit("")), F.lit("` (line "), line, F.lit(")."))
    own = F.col("operations") if "operations" in out.columns else F.lit(None).cast("array<string>")
    return out.withColumn("operations", F.when(flow, listed(TAINT_OPERATIONS)).otherwise(F.coalesce(own, listed(DEFAULT_OPERATIONS)))).withColumn("advice", F.when(flow, through).otherwise(F.coalesce("advice", general)))
