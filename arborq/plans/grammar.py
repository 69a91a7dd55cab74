"""Queries over grammar trees of six languages: common kinds, type kinds, logical operators, and what is left without test scaffolding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import module_graph as M
from ..operators import tree as N
from ..sources import fixtures as D
from ..sources import kinds as Z
from .catalog import query, r6

KIND_ROWS = ", ".join(f"('{lang}', '{k}', '{v}', {'NULL' if Z.TYPE_KINDS.get(lang, {}).get(k) is None else repr(Z.TYPE_KINDS[lang][k])})" for lang, own in Z.KINDS.items() for k, v in own.items())
MAPPED = f"""+ kinds(language, native_kind, mapped, plain_type) AS (VALUES {KIND_ROWS}),
guard AS (SELECT g.file_id, g.pre, g.last FROM concrete g JOIN concrete c ON c.file_id = g.file_id AND c.parent_id = g.node_id AND c.field = 'condition' AND c.native_kind = 'comparison_operator'
  WHERE g.language = 'python' AND g.native_kind = 'if_statement' AND NOT EXISTS (SELECT 1 FROM concrete a WHERE a.file_id = g.file_id AND a.parent_id = g.node_id AND a.field = 'alternative')
    AND (SELECT string_agg(x.native_kind, ',') FROM concrete x WHERE x.file_id = c.file_id AND x.parent_id = c.node_id AND x.field = 'operators') = '=='
    AND (SELECT string_agg(replace(x.text, chr(34), ''), ',' ORDER BY replace(x.text, chr(34), '')) FROM concrete x WHERE x.file_id = c.file_id AND x.parent_id = c.node_id AND x.field IS NULL) = '__main__,__name__'),
prior AS (SELECT s.*, (SELECT max(p.pre) FROM concrete p WHERE p.file_id = s.file_id AND p.parent_id = s.parent_id AND p.named AND p.pre < s.pre AND p.native_kind <> 'attribute_item') AS item FROM concrete s WHERE s.language = 'rust' AND s.named),
tests AS (SELECT p.file_id, p.pre, p.last FROM prior p WHERE CASE WHEN native_kind = 'attribute_item' THEN contains(text, 'cfg(test)')
  ELSE EXISTS (SELECT 1 FROM concrete a WHERE a.file_id = p.file_id AND a.parent_id = p.parent_id AND a.native_kind = 'attribute_item' AND contains(a.text, 'cfg(test)') AND a.pre < p.pre AND a.pre > coalesce(p.item, -1)) END),
gone AS (SELECT * FROM guard UNION ALL SELECT * FROM tests),
kept AS (SELECT * FROM concrete c WHERE named AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = c.file_id AND g.pre <= c.pre AND c.pre <= g.last)),
proto AS (SELECT DISTINCT p.file_id, p.node_id, p.parent_id, p.native_kind FROM concrete p JOIN concrete d ON d.file_id = p.file_id AND d.parent_id = p.node_id AND d.native_kind = 'function_declarator'
  JOIN concrete n ON n.file_id = d.file_id AND n.parent_id = d.node_id AND n.native_kind IN ('identifier', 'field_identifier') WHERE p.language = 'cpp' AND p.native_kind IN ('declaration', 'field_declaration')),
virt AS (SELECT DISTINCT c.file_id, c.node_id FROM concrete c JOIN concrete l ON l.file_id = c.file_id AND l.parent_id = c.node_id AND l.native_kind = 'field_declaration_list'
  JOIN proto p ON p.file_id = l.file_id AND p.parent_id = l.node_id AND p.native_kind = 'field_declaration' JOIN concrete z ON z.file_id = p.file_id AND z.parent_id = p.node_id AND z.native_kind = 'number_literal' AND z.text = '0' AND z.named
  WHERE c.language = 'cpp' AND c.native_kind IN ('class_specifier', 'struct_specifier')),
abst AS (SELECT DISTINCT c.file_id, c.node_id FROM concrete c JOIN concrete b ON b.file_id = c.file_id AND b.parent_id = c.node_id LEFT JOIN concrete m ON m.file_id = b.file_id AND m.parent_id = b.node_id AND m.native_kind = 'decorated_definition' AND b.field = 'body'
  LEFT JOIN concrete r ON r.file_id = m.file_id AND r.parent_id = m.node_id AND r.native_kind = 'decorator' AND contains(r.text, 'abstractmethod')
  WHERE c.language = 'python' AND c.native_kind = 'class_definition' AND (r.node_id IS NOT NULL OR b.field = 'superclasses' AND (contains(b.text, 'ABC') OR contains(b.text, 'Protocol')))),
gotype AS (SELECT t.file_id, t.node_id, arg_min(CASE x.native_kind WHEN 'interface_type' THEN 'interface' ELSE 'struct' END, x.pre) AS k FROM concrete t JOIN concrete s ON s.file_id = t.file_id AND s.parent_id = t.node_id AND s.native_kind = 'type_spec'
  JOIN concrete x ON x.file_id = s.file_id AND x.parent_id = s.node_id AND x.native_kind IN ('interface_type', 'struct_type') WHERE t.language = 'go' AND t.native_kind = 'type_declaration' GROUP BY ALL),
ops AS (SELECT b.file_id, b.node_id, arg_min(trim(x.text), x.pre) AS op FROM concrete b JOIN concrete x ON x.file_id = b.file_id AND x.parent_id = b.node_id AND trim(x.text) IN ('and', 'or', '&&', '||') WHERE b.native_kind IN ('binary_expression', 'boolean_operator') GROUP BY ALL),
renumbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pre) - 1 AS new_pre FROM kept),
mapped AS (SELECT r.file_id, r.language, r.node_id, r.parent_id, r.new_pre AS pre, r.new_pre + (SELECT count(*) FROM kept k WHERE k.file_id = r.file_id AND k.pre > r.pre AND k.pre <= r.last) AS last, r.native_kind,
  CASE WHEN p.node_id IS NOT NULL THEN 'FunctionDecl' WHEN kinds.mapped IS NOT NULL THEN kinds.mapped WHEN r.language <> 'go' AND (ends_with(r.native_kind, 'literal') OR r.native_kind IN ('string', 'integer', 'float')) THEN 'Literal' ELSE 'Unknown' END AS kind,
  CASE WHEN v.node_id IS NOT NULL OR a.node_id IS NOT NULL THEN 'abstractClass' WHEN g.k IS NOT NULL THEN g.k ELSE plain_type END AS type_kind, op AS operator
  FROM renumbered r LEFT JOIN kinds ON kinds.language = r.language AND kinds.native_kind = r.native_kind LEFT JOIN proto p ON p.file_id = r.file_id AND p.node_id = r.node_id LEFT JOIN virt v ON v.file_id = r.file_id AND v.node_id = r.node_id
    LEFT JOIN abst a ON a.file_id = r.file_id AND a.node_id = r.node_id LEFT JOIN gotype g ON g.file_id = r.file_id AND g.node_id = r.node_id LEFT JOIN ops ON ops.file_id = r.file_id AND ops.node_id = r.node_id)"""
COLUMNS = ("file_id", "node_id", "parent_id", "pre", "last", "kind", "type_kind", "operator")


def _language_query(language: str) -> None:
    @query(f"mapped_{language}", MAPPED + f" SELECT {', '.join(COLUMNS)} FROM mapped WHERE language = '{language}'", D.CONCRETE_CTE)
    def _(spark, d) -> DataFrame:
        return Z.map_kinds(M.cut(D.concrete_trees(spark, d).filter(F.col("language") == language))).select(*COLUMNS)


for _name in Z.KINDS:
    _language_query(_name)


@query("mapped_abstractness", MAPPED + """ SELECT file_id, round(coalesce(count(*) FILTER (type_kind IN ('trait', 'interface', 'abstractClass')) / CAST(nullif(count(*) FILTER (type_kind IN ('trait', 'interface', 'abstractClass', 'class', 'struct', 'enum', 'union', 'typeAlias')), 0) AS DOUBLE), 0), 6) AS abstractness
FROM mapped WHERE language <> 'javascript' GROUP BY file_id""", D.CONCRETE_CTE)
def _(spark, d):
    return N.abstractness(Z.map_kinds(M.cut(D.concrete_trees(spark, d)))).select("file_id", r6("abstractness"))
