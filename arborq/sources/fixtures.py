"""Code-shaped tables derived from the relational test tables: the same SQL text runs in Spark and in other engines.

A module graph (folders, files, classes, calls), statement trees in interval encoding, process steps and flow graphs stand in for
exported source repositories, which the test tables do not hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

MODULE_CTE = """
pairs AS (
  SELECT DISTINCT o_custkey AS c, l_suppkey AS s, l_discount >= 0.09 AS strong
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.08),
mdg_nodes AS (
  SELECT concat('R', r_regionkey) AS id, 'Folder' AS label, r_name AS file_path FROM region
  UNION ALL SELECT concat('N', n_nationkey), 'File', concat(r_name, '/', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('S', s_suppkey), 'Class', NULL FROM supplier
  UNION ALL SELECT concat('C', c_custkey), 'Class', NULL FROM customer
  UNION ALL SELECT concat('M', c_custkey), 'Method', NULL FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT concat('P', c_custkey), 'Property', NULL FROM customer WHERE c_custkey % 6 = 0),
mdg_edges AS (
  SELECT concat('R', n_regionkey) AS src, concat('N', n_nationkey) AS dst, 'CONTAINS' AS rel_type FROM nation
  UNION ALL SELECT concat('N', s_nationkey), concat('S', s_suppkey), 'DEFINES' FROM supplier
  UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), 'DEFINES' FROM customer
  UNION ALL SELECT concat('C', c_custkey), concat('M', c_custkey), 'HAS_METHOD' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT concat('M', c_custkey), concat('P', c_custkey), 'HAS_PROPERTY' FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT DISTINCT concat(CASE WHEN c % 3 = 0 THEN 'M' ELSE 'C' END, c), concat('S', s), 'CALLS' FROM pairs
  UNION ALL SELECT concat('C', c_custkey), concat('X', c_custkey % 7), 'CALLS' FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT concat('X', s_suppkey % 3), concat('S', s_suppkey), 'CALLS' FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT concat('N', a.n_nationkey), concat('N', b.n_nationkey), 'IMPORTS' FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey % 5 <> 4
  UNION ALL SELECT DISTINCT concat('C', c), concat('S', s), 'IMPORTS' FROM pairs WHERE strong)"""

TREE_CTE = """
lines AS (
  SELECT o_custkey AS file_id, l_orderkey AS fn, l_suppkey AS var, l_returnflag AS rf, l_linestatus AS ls, l_discount AS disc,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
runs AS (SELECT *, sum(CASE WHEN k = 1 OR disc <= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY k) AS run FROM lines),
sized AS (SELECT *, row_number() OVER (PARTITION BY fn, run ORDER BY k) AS pos, count(*) OVER (PARTITION BY fn, run) AS run_size FROM runs),
flat AS (
  SELECT c_custkey AS file_id, CAST(-1 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS run_size, CAST(NULL AS BIGINT) AS var, 'File' AS kind FROM customer
  UNION ALL SELECT o_custkey, o_orderkey, 0, 0, 0, CAST(NULL AS BIGINT), 'FunctionDecl' FROM orders
  UNION ALL SELECT file_id, fn, k, pos, run_size, var, CASE concat(rf, ls) WHEN 'AF' THEN 'IfStmt' WHEN 'AO' THEN 'ForStmt' WHEN 'RF' THEN 'TryStmt' WHEN 'RO' THEN 'WhileStmt' WHEN 'NF' THEN 'AssignExpr' ELSE 'CallExpr' END FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY fn, k) - 1 AS pre, count(*) OVER (PARTITION BY file_id) AS file_size, count(*) OVER (PARTITION BY file_id, fn) AS fn_size FROM flat),
uast_nodes AS (
  SELECT file_id,
    CASE WHEN fn < 0 THEN concat('F', file_id) WHEN k = 0 THEN concat('O', fn) ELSE concat('L', fn, '.', k) END AS node_id,
    CASE WHEN fn < 0 THEN NULL WHEN k = 0 THEN concat('F', file_id) WHEN pos = 1 THEN concat('O', fn) ELSE concat('L', fn, '.', k - 1) END AS parent_id,
    CAST(pre AS BIGINT) AS pre,
    CAST(CASE WHEN fn < 0 THEN file_size - 1 WHEN k = 0 THEN pre + fn_size - 1 ELSE pre + run_size - pos END AS BIGINT) AS last,
    CAST(CASE WHEN fn < 0 THEN 0 WHEN k = 0 THEN 1 ELSE 1 + pos END AS BIGINT) AS depth, kind, var, fn, k
  FROM placed)"""

RICH_CTE = (
    TREE_CTE
    + """,
mixed AS (
  SELECT file_id, node_id, parent_id, pre, last, depth, k,
    CASE WHEN kind = 'AssignExpr' AND k % 4 = 0 THEN 'FunctionDecl' WHEN kind = 'AssignExpr' AND k % 4 = 2 THEN 'TypeDecl' WHEN kind = 'CallExpr' AND k % 3 = 0 THEN 'WithStmt'
      WHEN kind = 'CallExpr' AND k % 3 = 1 THEN 'Identifier' WHEN kind = 'CallExpr' AND k % 6 = 2 THEN 'Unknown' ELSE kind END AS kind
  FROM uast_nodes),
rich_nodes AS (
  SELECT file_id, node_id, parent_id, pre, last, depth, k, kind, CASE WHEN kind = 'Unknown' THEN 'block' ELSE '' END AS native_kind,
    CASE WHEN kind IN ('FunctionDecl', 'MethodDecl', 'TypeDecl') AND pre % 7 <> 0 THEN concat('n', pre) WHEN kind = 'Identifier' THEN concat('v', pre % 5) END AS name,
    CASE WHEN kind = 'TypeDecl' THEN CASE pre % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'class' WHEN 2 THEN 'struct' END END AS type_kind,
    concat(CASE WHEN pre % 5 = 0 THEN 'async def ' ELSE 'def ' END, 'n', pre, '(async)') AS text, CAST(pre + 1 AS INT) AS start_line, CAST(last + 1 AS INT) AS end_line
  FROM mixed)"""
)

#: Small syntax trees by language, as grammars export them: (native kind, depth, field, named, text) in pre-order; each order of a file is one.
TEMPLATES = {
    "python": (
        (("if_statement", 0, None, True, ""), ("comparison_operator", 1, "condition", True, ""), ("identifier", 2, None, True, "__name__"), ("==", 2, "operators", False, "=="), ("string", 2, None, True, '"__main__"'), ("block", 1, "consequence", True, ""), ("call", 2, None, True, "main()")),
        (("if_statement", 0, None, True, ""), ("comparison_operator", 1, "condition", True, ""), ("string", 2, None, True, '"__main__"'), ("==", 2, "operators", False, "=="), ("identifier", 2, None, True, "__name__"), ("block", 1, "consequence", True, ""), ("else_clause", 1, "alternative", True, "")),
        (("class_definition", 0, None, True, ""), ("identifier", 1, "name", True, "A"), ("argument_list", 1, "superclasses", True, "(ABC)"), ("block", 1, "body", True, ""), ("function_definition", 2, None, True, "def f(self)")),
        (("class_definition", 0, None, True, ""), ("identifier", 1, "name", True, "B"), ("block", 1, "body", True, ""), ("decorated_definition", 2, None, True, ""), ("decorator", 3, None, True, "@abstractmethod"), ("boolean_operator", 2, None, True, "a and b"), ("identifier", 3, "left", True, "a"), ("and", 3, "operator", False, "and"), ("identifier", 3, "right", True, "b")),
        (("class_definition", 0, None, True, ""), ("identifier", 1, "name", True, "C"), ("while_statement", 0, None, True, ""), ("list_comprehension", 1, None, True, "[]"), ("integer", 2, None, True, "3")),
    ),
    "rust": (
        (("attribute_item", 0, None, True, "#[cfg(test)]"),),
        (("attribute_item", 0, None, True, "#[derive(Debug)]"), ("struct_item", 0, None, True, "struct S;"), ("type_identifier", 1, "name", True, "S")),
        (("function_item", 0, None, True, "fn f() {}"), ("block", 1, "body", True, ""), ("let_declaration", 2, None, True, ""), ("integer_literal", 3, None, True, "1"), ("attribute_item", 2, None, True, "#[cfg(test)]"), ("if_expression", 2, None, True, ""), ("return_expression", 2, None, True, "")),
        (("trait_item", 0, None, True, ""), ("impl_item", 0, None, True, ""), ("binary_expression", 1, None, True, "a && b"), ("identifier", 2, "left", True, "a"), ("&&", 2, "operator", False, "&&"), ("identifier", 2, "right", True, "b")),
        (("match_expression", 0, None, True, ""), ("binary_expression", 1, None, True, "a + b"), ("+", 2, "operator", False, "+")),
    ),
    "javascript": (
        (("function_declaration", 0, None, True, ""), ("statement_block", 1, None, True, ""), ("throw_statement", 2, None, True, ""), ("string", 3, None, True, "x")),
        (("class_declaration", 0, None, True, ""), ("method_definition", 1, None, True, ""), ("ternary_expression", 2, None, True, ""), ("binary_expression", 3, None, True, ""), ("??", 4, "operator", False, "??"), ("||", 4, None, False, " || ")),
        (("lexical_declaration", 0, None, True, ""), ("arrow_function", 1, None, True, ""), ("try_statement", 2, None, True, ""), ("catch_clause", 3, None, True, ""), ("finally_clause", 3, None, True, "")),
    ),
    "typescript": (
        (("interface_declaration", 0, None, True, ""), ("property_signature", 1, None, True, "")),
        (("abstract_class_declaration", 0, None, True, ""), ("public_field_definition", 1, None, True, ""), ("internal_module", 1, None, True, "")),
        (("ambient_declaration", 0, None, True, ""), ("class_declaration", 0, None, True, ""), ("enum_declaration", 0, None, True, ""), ("type_alias_declaration", 0, None, True, ""), ("switch_statement", 1, None, True, "")),
    ),
    "cpp": (
        (("declaration", 0, None, True, "void f(int);"), ("function_declarator", 1, None, True, ""), ("identifier", 2, None, True, "f")),
        (("declaration", 0, None, True, "void (*h)(int);"), ("function_declarator", 1, None, True, ""), ("parenthesized_declarator", 2, None, True, ""), ("pointer_declarator", 3, None, True, ""), ("identifier", 4, None, True, "h")),
        (("class_specifier", 0, None, True, ""), ("field_declaration_list", 1, None, True, ""), ("field_declaration", 2, None, True, ""), ("function_declarator", 3, None, True, ""), ("field_identifier", 4, None, True, "area"), ("number_literal", 3, None, True, "0")),
        (("struct_specifier", 0, None, True, ""), ("field_declaration_list", 1, None, True, ""), ("field_declaration", 2, None, True, "int x = 0;"), ("field_identifier", 3, None, True, "x"), ("number_literal", 3, None, True, "0")),
        (("union_specifier", 0, None, True, ""), ("enum_specifier", 0, None, True, ""), ("subscript_expression", 1, None, True, "")),
    ),
    "go": (
        (("type_declaration", 0, None, True, ""), ("type_spec", 1, None, True, ""), ("type_identifier", 2, None, True, "T"), ("interface_type", 2, None, True, "")),
        (("type_declaration", 0, None, True, ""), ("type_spec", 1, None, True, ""), ("type_identifier", 2, None, True, "T"), ("type_spec", 1, None, True, ""), ("struct_type", 2, None, True, ""), ("type_spec", 1, None, True, ""), ("interface_type", 2, None, True, "")),
        (("go_statement", 0, None, True, ""), ("call_expression", 1, None, True, "f()"), ("string_literal", 2, None, True, "x"), ("nil", 2, None, True, "nil")),
        (("short_var_declaration", 0, None, True, ""), ("binary_expression", 1, None, True, "a || b"), ("||", 2, "operator", False, "||")),
    ),
}


def _template_rows() -> str:
    quote = lambda x: "CAST(NULL AS VARCHAR(9))" if x is None else "'" + x + "'"
    rows = []
    for lang, own in TEMPLATES.items():
        for t, nodes in enumerate(own):
            for i, (native, depth, field, named, text) in enumerate(nodes):
                up = max((k for k in range(i) if nodes[k][1] == depth - 1), default=-1)
                size = next((k for k in range(i + 1, len(nodes)) if nodes[k][1] <= depth), len(nodes)) - i - 1
                rows.append(f"SELECT '{lang}' AS lang, {t} AS t, {len(own)} AS ts, {i} AS i, {up} AS up, {size} AS size, {quote(native)} AS native, {quote(field)} AS field, {named} AS named, {quote(text)} AS txt")
    return " UNION ALL ".join(rows)


CONCRETE_CTE = f"""
tmpl AS ({_template_rows()}),
langs AS (SELECT c_custkey AS file_id, CASE c_custkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'cpp' ELSE 'go' END AS language FROM customer),
sown AS (SELECT l.file_id, l.language, o_orderkey AS o, m.i, m.up, m.size, m.native, m.field, m.named, m.txt FROM orders JOIN langs l ON l.file_id = o_custkey JOIN tmpl m ON m.lang = l.language AND m.t = o_orderkey % m.ts),
sizes AS (SELECT file_id, count(*) AS n FROM sown GROUP BY file_id),
concrete AS (
  SELECT langs.file_id, language, concat('R', langs.file_id) AS node_id, CAST(NULL AS VARCHAR(9)) AS parent_id, CAST(0 AS BIGINT) AS pre, CAST(coalesce(n, 0) AS BIGINT) AS last,
    CASE language WHEN 'python' THEN 'module' WHEN 'cpp' THEN 'translation_unit' WHEN 'rust' THEN 'source_file' WHEN 'go' THEN 'source_file' ELSE 'program' END AS native_kind, CAST(NULL AS VARCHAR(9)) AS field, true AS named, '' AS text FROM langs LEFT JOIN sizes ON langs.file_id = sizes.file_id
  UNION ALL SELECT file_id, language, concat('T', o, '.', i), CASE WHEN up < 0 THEN concat('R', file_id) ELSE concat('T', o, '.', up) END,
    CAST(row_number() OVER (PARTITION BY file_id ORDER BY o, i) AS BIGINT), CAST(row_number() OVER (PARTITION BY file_id ORDER BY o, i) + size AS BIGINT), native, field, named, txt FROM sown)"""

STEPS_CTE = """
order_steps AS (
  SELECT l_orderkey AS process_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS step, concat('S', l_suppkey) AS node_id FROM lineitem)"""

PROCESS_CTE = """
process_steps AS (
  SELECT user_id AS process_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type AS node_id FROM events)"""

FLOW_STATEMENTS = """
stmts AS (SELECT file_id, kind, row_number() OVER (PARTITION BY file_id ORDER BY pre) + 1 AS b, count(*) OVER (PARTITION BY file_id) + 1 AS final FROM uast_nodes WHERE k > 0)"""
FLOW_PARTS = """
cfg_blocks AS (
  SELECT c_custkey AS file_id, CAST(0 AS BIGINT) AS block_id, 'entry' AS label FROM customer UNION ALL SELECT c_custkey, 1, 'exit' FROM customer
  UNION ALL SELECT file_id, b, kind FROM stmts),
cfg_edges AS (
  SELECT file_id, CAST(0 AS BIGINT) AS src, CAST(2 AS BIGINT) AS dst, 'unconditional' AS kind FROM stmts WHERE b = 2
  UNION ALL SELECT file_id, b, b + 1, 'unconditional' FROM stmts WHERE b < final
  UNION ALL SELECT file_id, b, CASE WHEN b < final THEN b + 1 ELSE 1 END, 'true' FROM stmts WHERE kind = 'IfStmt'
  UNION ALL SELECT file_id, b, CASE WHEN b + 1 < final THEN b + 2 ELSE 1 END, 'false' FROM stmts WHERE kind = 'IfStmt'
  UNION ALL SELECT file_id, b, CASE WHEN b > 2 THEN b - 1 ELSE 2 END, 'loop_back' FROM stmts WHERE kind IN ('ForStmt', 'WhileStmt')
  UNION ALL SELECT file_id, b, CAST(1 AS BIGINT), 'return' FROM stmts WHERE b = final)"""
FLOW_CTE = TREE_CTE + "," + FLOW_STATEMENTS + "," + FLOW_PARTS


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the test tables; a query binds to them when it is analysed."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, cte: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(f"WITH {cte} SELECT * FROM {name}")


def module_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, MODULE_CTE, "mdg_nodes"), table(spark, sf_dir, MODULE_CTE, "mdg_edges")


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Statements of all trees, from the table's footers."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def statement_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, TREE_CTE, "uast_nodes")


def exported_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement trees with nested callables and types, names, lines and texts, as an export of parsed files has them."""
    return table(spark, sf_dir, RICH_CTE, "rich_nodes")


def concrete_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammar nodes of six languages, anonymous ones too, as an export has them."""
    return table(spark, sf_dir, CONCRETE_CTE, "concrete")


def process_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PROCESS_CTE, "process_steps")


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a process whose steps are classes of the module graph."""
    return table(spark, sf_dir, STEPS_CTE, "order_steps")


def flow_graphs(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None, written=None) -> tuple[DataFrame, DataFrame]:
    """Blocks and edges; of statement trees that are a table already, where given.

    Their numbered statements are then given to ``written``, which returns them as a table: blocks and edges read it seven times, without a shuffle.
    """
    if nodes is None:
        return table(spark, sf_dir, FLOW_CTE, "cfg_blocks"), table(spark, sf_dir, FLOW_CTE, "cfg_edges")
    register(spark, sf_dir)
    nodes.createOrReplaceTempView("uast_nodes")
    written(spark.sql(f"WITH {FLOW_STATEMENTS} SELECT * FROM stmts")).createOrReplaceTempView("stmts")
    return spark.sql(f"WITH {FLOW_PARTS} SELECT * FROM cfg_blocks"), spark.sql(f"WITH {FLOW_PARTS} SELECT * FROM cfg_edges")
