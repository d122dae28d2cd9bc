"""What kind a statement is, from Spark's own parsed plan: no text matching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

ANALYTICAL = {"Aggregate", "UnresolvedHaving", "Join", "Window", "WithWindowDefinition", "Sort", "Union", "Intersect", "Except", "Distinct", "Pivot", "GlobalLimit", "LocalLimit"}

AGGREGATES = frozenset("over count sum avg mean min max stddev stddev_pop stddev_samp variance var_pop var_samp percentile percentile_approx median corr approx_count_distinct collect_list collect_set".split())


@dataclass(frozen=True)
class Statement:
    """kind: select, insert, update, delete, create, alter, drop or other."""

    kind: str
    analytical: bool
    tables: tuple[str, ...]

    @property
    def writes(self) -> bool:
        return self.kind != "select"

    @property
    def label(self) -> str:
        """Advisory: ``olap`` for scans that aggregate, join, sort or combine, else ``oltp``."""
        return "olap" if self.kind == "select" and self.analytical else "oltp"


def _items(seq) -> list:
    found, out = seq.iterator(), []
    while found.hasNext():
        out.append(found.next())
    return out


def _functions(plan) -> set[str]:
    """Names of the functions that a node calls, and ``over`` for a window."""
    out, stack = set(), _items(plan.expressions())
    while stack:
        e = stack.pop()
        kind = e.getClass().getSimpleName()
        if kind in ("WindowExpression", "UnresolvedWindowExpression"):
            out.add("over")
        elif kind == "UnresolvedFunction":
            out.add(e.nameParts().last().lower())
        stack += _items(e.children())
    return out


def classify(spark: SparkSession, sql: str) -> Statement:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names, tables, functions, stack = [], set(), set(), [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName().lstrip("'")
        names.append(name)
        functions |= _functions(node)
        if name == "UnresolvedRelation":
            tables.add(node.tableName())
        if name == "InsertIntoStatement":
            stack.append(node.table())
        if name == "UnresolvedWith":
            stack += [r._2() for r in _items(node.cteRelations())]
        stack += _items(node.children())
    top = names[0]
    kinds = {"Insert": "insert", "Update": "update", "Delete": "delete", "Merge": "update", "Create": "create", "ReplaceTable": "create", "Alter": "alter", "AddColumns": "alter", "RenameTable": "alter", "RenameColumn": "alter", "DropColumns": "alter", "Drop": "drop"}
    kind = next((k for start, k in kinds.items() if top.startswith(start)), None)
    if kind is None:
        text = sql.lstrip(" \n\t(").split(None, 1)[0].lower() if sql.strip() else ""
        kind = "select" if text in ("select", "with", "values", "from", "table") else "other"
    ctes = {n.lower() for n in _cte_names(plan)}
    return Statement(kind, bool(set(names) & ANALYTICAL or functions & AGGREGATES), tuple(sorted(t for t in tables if t.lower() not in ctes)))


def _cte_names(plan) -> list[str]:
    return [r._1() for r in _items(plan.cteRelations())] if plan.nodeName().lstrip("'") == "UnresolvedWith" else []
