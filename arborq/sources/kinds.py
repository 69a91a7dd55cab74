"""Common kinds of exported syntax trees: six languages' grammar nodes to the node table that all operators read.

An export has one row a grammar node, anonymous tokens included: (file_id, language, node_id, parent_id, pre, last, native_kind, field, named,
text). ``map_kinds`` returns the named nodes with their common kind, type kind and logical operator, without test scaffolding, renumbered.

A kind is looked up by language and grammar node in a table of fixed size. What depends on neighbours is found by short chains of semi-joins on
the few nodes that a rule is about (a C++ prototype, an abstract class, a main guard), by one window over siblings (an attribute that marks the
next item as a test), and by one ordered pass a file that drops marked subtrees: no range join and no recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Grammar nodes that are the same in Python, Rust, JavaScript and TypeScript.
SHARED = {
    "module": "File", "program": "File", "translation_unit": "File", "source_file": "File", "expression_statement": "ExprStmt", "assignment": "AssignExpr",
    "augmented_assignment": "AssignExpr", "binary_expression": "BinaryExpr", "boolean_operator": "BinaryExpr", "unary_expression": "UnaryExpr",
    "call_expression": "CallExpr", "member_expression": "MemberExpr", "field_expression": "MemberExpr", "subscript": "MemberExpr", "identifier": "Identifier",
}
#: Statements that have the same name in Python, JavaScript, C++ and Go.
STATEMENTS = {
    "if_statement": "IfStmt", "for_statement": "ForStmt", "return_statement": "ReturnStmt", "break_statement": "BreakStmt", "continue_statement": "ContinueStmt",
}
#: What is a language's own.
PYTHON = {
    "function_definition": "FunctionDecl", "class_definition": "TypeDecl", "lexical_declaration": "VarDecl", "variable_declaration": "VarDecl", "while_statement": "WhileStmt",
    "match_statement": "MatchStmt", "try_statement": "TryStmt", "except_clause": "CatchClause", "finally_clause": "FinallyClause", "with_statement": "WithStmt",
    "assert_statement": "AssertStmt", "conditional_expression": "ConditionalExpr", "list_comprehension": "Comprehension", "set_comprehension": "Comprehension",
    "dictionary_comprehension": "Comprehension", "generator_expression": "Comprehension", "call": "CallExpr",
}
RUST = {
    "struct_item": "TypeDecl", "enum_item": "TypeDecl", "impl_item": "TypeDecl", "trait_item": "TypeDecl", "function_item": "FunctionDecl", "let_declaration": "VarDecl",
    "if_expression": "IfStmt", "for_expression": "ForStmt", "while_expression": "WhileStmt", "loop_expression": "WhileStmt", "match_expression": "MatchStmt",
    "return_expression": "ReturnStmt", "break_expression": "BreakStmt", "continue_expression": "ContinueStmt",
}
JAVASCRIPT = {
    "function_definition": "FunctionDecl", "function_declaration": "FunctionDecl", "function": "FunctionDecl", "function_expression": "FunctionDecl", "arrow_function": "FunctionDecl",
    "class_definition": "TypeDecl", "class_declaration": "TypeDecl", "method_definition": "MethodDecl", "lexical_declaration": "VarDecl", "variable_declaration": "VarDecl",
    "while_statement": "WhileStmt", "switch_statement": "MatchStmt", "throw_statement": "ThrowStmt", "try_statement": "TryStmt", "catch_clause": "CatchClause",
    "finally_clause": "FinallyClause", "ternary_expression": "ConditionalExpr",
}
TYPESCRIPT = {
    "interface_declaration": "TypeDecl", "type_alias_declaration": "TypeDecl", "enum_declaration": "TypeDecl", "abstract_class_declaration": "TypeDecl",
    "property_signature": "VarDecl", "public_field_definition": "VarDecl", "internal_module": "File", "ambient_declaration": "VarDecl",
}
CPP = {
    "translation_unit": "File", "function_definition": "FunctionDecl", "class_specifier": "TypeDecl", "struct_specifier": "TypeDecl", "enum_specifier": "TypeDecl", "union_specifier": "TypeDecl",
    "declaration": "VarDecl", "field_declaration": "VarDecl", "while_statement": "WhileStmt", "switch_statement": "MatchStmt", "throw_statement": "ThrowStmt",
    "try_statement": "TryStmt", "catch_clause": "CatchClause", "expression_statement": "ExprStmt", "assignment_expression": "AssignExpr", "binary_expression": "BinaryExpr",
    "conditional_expression": "ConditionalExpr", "unary_expression": "UnaryExpr", "call_expression": "CallExpr", "field_expression": "MemberExpr",
    "subscript_expression": "MemberExpr", "identifier": "Identifier",
}
GO = {
    "source_file": "File", "function_declaration": "FunctionDecl", "method_declaration": "MethodDecl", "type_declaration": "TypeDecl", "const_declaration": "VarDecl",
    "var_declaration": "VarDecl", "short_var_declaration": "VarDecl", "expression_switch_statement": "MatchStmt", "type_switch_statement": "MatchStmt",
    "select_statement": "MatchStmt", "expression_statement": "ExprStmt", "go_statement": "ExprStmt", "defer_statement": "ExprStmt", "assignment_statement": "AssignExpr",
    "inc_statement": "AssignExpr", "binary_expression": "BinaryExpr", "unary_expression": "UnaryExpr", "call_expression": "CallExpr", "selector_expression": "MemberExpr",
    "index_expression": "MemberExpr", "identifier": "Identifier", "field_identifier": "Identifier", "type_identifier": "Identifier", "package_identifier": "Identifier",
    "int_literal": "Literal", "float_literal": "Literal", "imaginary_literal": "Literal", "rune_literal": "Literal", "interpreted_string_literal": "Literal",
    "raw_string_literal": "Literal", "true": "Literal", "false": "Literal", "nil": "Literal",
}
KINDS = {
    "python": SHARED | STATEMENTS | PYTHON,
    "rust": SHARED | RUST,
    "javascript": SHARED | STATEMENTS | JAVASCRIPT,
    "typescript": SHARED | STATEMENTS | JAVASCRIPT | TYPESCRIPT,
    "cpp": STATEMENTS | CPP,
    "go": STATEMENTS | GO,
}
#: Type kinds that the grammar node alone tells.
TYPE_KINDS = {
    "rust": {"trait_item": "trait", "struct_item": "struct", "enum_item": "enum"},
    "typescript": {"interface_declaration": "interface", "abstract_class_declaration": "abstractClass", "class_declaration": "class", "enum_declaration": "enum", "type_alias_declaration": "typeAlias"},
    "cpp": {"class_specifier": "class", "struct_specifier": "struct", "enum_specifier": "enum", "union_specifier": "union"},
    "python": {"class_definition": "class"},
}
#: Fixed values of the rules.
LITERALS = ("string", "integer", "float")
LOGICAL = ("and", "or", "&&", "||")
ABSTRACT_BASES, ABSTRACT_METHOD = ("ABC", "Protocol", "ABCMeta"), "abstractmethod"
TEST_ATTRIBUTE, TEST_MARKER = "attribute_item", "cfg(test)"
GUARD_NAMES = ("__main__", "__name__")


def _rows(nodes: DataFrame, language: str, *kinds: str) -> DataFrame:
    return nodes.filter((F.col("language") == language) & F.col("native_kind").isin(*kinds))


def parents_of(children: DataFrame, nodes: DataFrame, language: str, *kinds: str) -> DataFrame:
    """The nodes of the kinds that have one of the children."""
    up = children.select("file_id", F.col("parent_id").alias("node_id")).distinct()
    return _rows(nodes, language, *kinds).join(up, ["file_id", "node_id"], "left_semi")


def prototypes(nodes: DataFrame) -> DataFrame:
    """C++ declarations of functions and methods: their declarator has the name right below it, as that of a function pointer has not."""
    declarators = parents_of(_rows(nodes, "cpp", "identifier", "field_identifier"), nodes, "cpp", "function_declarator")
    return parents_of(declarators, nodes, "cpp", "declaration", "field_declaration")


def abstract_cpp(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """C++ classes and structures with a pure virtual method."""
    zero = _rows(nodes, "cpp", "number_literal").filter("named AND text = '0'")
    pure = parents_of(zero, declared, "cpp", "field_declaration")
    return parents_of(parents_of(pure, nodes, "cpp", "field_declaration_list"), nodes, "cpp", "class_specifier", "struct_specifier")


def abstract_python(nodes: DataFrame) -> DataFrame:
    """Python classes with an abstract base by name, or with an abstract method."""
    own = nodes.filter("language = 'python'")
    bases = own.filter((F.col("field") == "superclasses") & reduce(lambda a, b: a | b, [F.contains("text", F.lit(m)) for m in ABSTRACT_BASES]))
    marks = _rows(nodes, "python", "decorator").filter(F.col("named") & F.contains("text", F.lit(ABSTRACT_METHOD)))
    methods = parents_of(marks, nodes, "python", "decorated_definition").filter("named")
    bodies = own.filter("field = 'body'").join(methods.select("file_id", F.col("parent_id").alias("node_id")).distinct(), ["file_id", "node_id"], "left_semi")
    return parents_of(bases.select("file_id", "parent_id").unionByName(bodies.select("file_id", "parent_id")), nodes, "python", "class_definition")


def go_types(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, type_kind) of Go type declarations: what the first type below one of their specifications is."""
    kind = F.when(F.col("native_kind") == "interface_type", "interface").otherwise("struct")
    types = _rows(nodes, "go", "interface_type", "struct_type").filter("named").select("file_id", F.col("parent_id").alias("node_id"), F.struct("pre", kind.alias("k")).alias("t"))
    specs = _rows(nodes, "go", "type_spec").select("file_id", "node_id", "parent_id").join(types, ["file_id", "node_id"])
    first = specs.groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.min("t").getField("k").alias("type_kind"))
    return _rows(nodes, "go", "type_declaration").select("file_id", "node_id").join(first, ["file_id", "node_id"])


def operators(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, operator) of binary nodes that are joined by a logical operator."""
    binary = nodes.filter(F.col("native_kind").isin("binary_expression", "boolean_operator")).select("file_id", "node_id", (F.col("native_kind") == "binary_expression").alias("plain"))
    word = F.when(F.col("native_kind").isin("and", "or"), F.col("native_kind")).when(F.trim("text").isin(*LOGICAL), F.trim("text"))
    child = nodes.select("file_id", F.col("parent_id").alias("node_id"), "pre", "field", "named", "native_kind", word.alias("operator")).filter("operator IS NOT NULL")
    first = F.when(F.col("plain"), F.col("field") == "operator").otherwise(F.col("named") & F.col("native_kind").isin("and", "or"))
    return child.join(binary, ["file_id", "node_id"]).groupBy("file_id", "node_id").agg(F.min_by("operator", F.struct(~F.coalesce(first, F.lit(False)), "pre")).alias("operator"))


def main_guards(nodes: DataFrame) -> DataFrame:
    """Python's guards of a module that is run, without another branch: such a branch is code like any other."""
    stripped = F.coalesce(*[F.when((F.length("text") >= 2) & F.startswith("text", F.lit(q)) & F.endswith("text", F.lit(q)), F.expr("substring(text, 2, length(text) - 2)")) for q in ("'", '"')], F.col("text"))
    conditions = _rows(nodes, "python", "comparison_operator").filter("field = 'condition'").select("file_id", "node_id", F.col("parent_id").alias("guard"))
    is_op = F.coalesce(F.col("field") == "operators", F.lit(False))
    child = nodes.filter("language = 'python'").select("file_id", F.col("parent_id").alias("node_id"), is_op.alias("is_op"), "native_kind", stripped.alias("word"))
    met = conditions.join(child, ["file_id", "node_id"]).groupBy("file_id", "node_id", "guard").agg(
        F.collect_list(F.when(F.col("is_op"), F.col("native_kind"))).alias("ops"), F.count_if(~F.col("is_op")).alias("n"), F.array_sort(F.collect_set(F.when(~F.col("is_op"), F.col("word")))).alias("words")
    )
    met = met.filter((F.col("ops") == F.array(F.lit("=="))) & (F.col("n") == 2) & (F.col("words") == F.array(*map(F.lit, GUARD_NAMES))))
    other = nodes.filter("language = 'python' AND field = 'alternative'").select("file_id", F.col("parent_id").alias("node_id"))
    return _rows(nodes, "python", "if_statement").join(met.select("file_id", F.col("guard").alias("node_id")), ["file_id", "node_id"], "left_semi").join(other, ["file_id", "node_id"], "left_anti")


def test_items(nodes: DataFrame) -> DataFrame:
    """Rust's test attributes and the item behind each, other attributes in between."""
    own = nodes.filter("language = 'rust' AND named").select("file_id", "node_id", "parent_id", "pre", (F.col("native_kind") == TEST_ATTRIBUTE).alias("attribute"), F.contains("text", F.lit(TEST_MARKER)).alias("test"))
    before = W.partitionBy("file_id", "parent_id").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    items = own.withColumn("run", F.coalesce(F.sum((~F.col("attribute")).cast("long")).over(before), F.lit(0)))  # attributes are in one run with the item behind them
    marked = F.max(F.col("attribute") & F.col("test")).over(W.partitionBy("file_id", "parent_id", "run"))
    return items.withColumn("marked", marked).filter("marked AND (test OR NOT attribute)")


def kind_of(native: Column, looked_up: Column, language: Column) -> Column:
    literal = (language != "go") & (F.endswith(native, F.lit("literal")) | native.isin(*LITERALS))
    return F.coalesce(looked_up, F.when(literal, "Literal"), F.lit("Unknown"))


def map_kinds(nodes: DataFrame) -> DataFrame:
    """The named nodes of an export with kind, type_kind and operator, without main guards and test items, numbered anew.

    ``nodes`` is read several times, so it should be a table. A language without a table of kinds keeps its nodes as Unknown.
    """
    spark = nodes.sparkSession
    table = spark.createDataFrame([(lang, k, v, TYPE_KINDS.get(lang, {}).get(k)) for lang, own in KINDS.items() for k, v in own.items()], "language string, native_kind string, _kind string, _type string")
    declared = prototypes(nodes).select("file_id", "node_id", "parent_id", "language", "native_kind")
    none = F.lit(None).cast("string")
    mark = lambda df, kind=none, type_kind=none, operator=none, gone=F.lit(False): df.select("file_id", "node_id", kind.alias("kind"), type_kind.alias("type_kind"), operator.alias("operator"), gone.alias("gone"))
    marks = [
        mark(declared, kind=F.lit("FunctionDecl")),
        mark(abstract_cpp(nodes, declared).unionByName(abstract_python(nodes)), type_kind=F.lit("abstractClass")),
        mark(go_types(nodes), type_kind=F.col("type_kind")),
        mark(operators(nodes), operator=F.col("operator")),
        mark(main_guards(nodes), gone=F.lit(True)),
        mark(test_items(nodes), gone=F.lit(True)),
    ]
    marks = reduce(DataFrame.unionByName, marks).groupBy("file_id", "node_id").agg(*[F.max(c).alias(f"_m_{c}") for c in ("kind", "type_kind", "operator", "gone")])
    j = nodes.join(F.broadcast(table), ["language", "native_kind"], "left").join(marks, ["file_id", "node_id"], "left")  # the table has a fixed size
    j = j.withColumn("kind", F.coalesce("_m_kind", kind_of(F.col("native_kind"), F.col("_kind"), F.col("language"))))
    j = j.withColumn("type_kind", F.coalesce("_m_type_kind", "_type")).withColumn("operator", F.col("_m_operator")).withColumn("_gone", F.coalesce("_m_gone", F.lit(False)))
    return without_subtrees(j, F.col("_gone"), F.col("named")).drop("_kind", "_type", "_gone", "named", "field", *[f"_m_{c}" for c in ("kind", "type_kind", "operator", "gone")])


def without_subtrees(nodes: DataFrame, gone: Column, keep: Column) -> DataFrame:
    """nodes without the subtrees of those that are ``gone`` and without those that aren't to ``keep``, with pre and last counted anew.

    Subtrees nest, so a node lies in one that goes if the furthest end of those opened before it, or its own, is not behind it: one ordered pass.
    """
    w = W.partitionBy("file_id").orderBy("pre").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(gone, F.col("last"))).over(w)
    n = nodes.withColumn("_in", keep & F.coalesce(reach < F.col("pre"), F.lit(True))).withColumn("_n", F.sum(F.col("_in").cast("long")).over(w))
    ends = n.select("file_id", F.col("pre").alias("last"), F.col("_n").alias("_to"))
    out = n.filter("_in").join(ends, ["file_id", "last"])
    return out.withColumn("pre", F.col("_n") - 1).withColumn("last", F.col("_to") - 1).drop("_in", "_n", "_to")
