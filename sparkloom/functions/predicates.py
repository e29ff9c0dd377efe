"""Row filters from SQL text, from tuples in disjunctive normal form, or from Columns.

SQL text is parsed by Spark. In strict mode only columns, literals, comparisons, IN,
IS [NOT] NULL, IS TRUE/FALSE, AND, OR, NOT pass. For floating columns, IS NULL holds for
NaN too, and ordered comparisons with NaN do not hold.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = {"GreaterThan": "__gt__", "GreaterThanOrEqual": "__ge__", "LessThan": "__lt__", "LessThanOrEqual": "__le__"}
DNF = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _floating(schema: T.StructType, name: str | None) -> bool:
    return name is not None and isinstance(schema[name].dataType, T.FloatType | T.DoubleType)


class _Translator:
    def __init__(self, schema: T.StructType, nulls: str, strict: bool):
        self.schema, self.nulls, self.strict = schema, nulls, strict

    def name_of(self, node: Any) -> str | None:
        return node.name().replace("`", "") if node.getClass().getSimpleName() == "UnresolvedAttribute" else None

    def known(self, a: Any, b: Any) -> Column:
        """That neither side is NaN."""
        sides = [~F.isnan(F.col(n)) for n in map(self.name_of, (a, b)) if _floating(self.schema, n)]
        return reduce(Column.__and__, sides) if sides else F.lit(True)

    def typed(self, node: Any, other: Any) -> Column:
        """A literal beside a column of text, or a text beside another column, takes its type."""
        own, name = self.column(node), self.name_of(other)
        if node.getClass().getSimpleName() != "Literal" or name is None or node.dataType().typeName() in ("void", "null"):
            return own
        goal = self.schema[name].dataType
        is_text = node.dataType().typeName() == "string"
        return own.cast(goal) if is_text != isinstance(goal, T.StringType) and not isinstance(goal, T.ArrayType | T.StructType | T.MapType) else own

    def pair(self, a: Any, b: Any) -> tuple[Column, Column]:
        return self.typed(a, b), self.typed(b, a)

    def column(self, node: Any) -> Column:
        kind, seq = node.getClass().getSimpleName(), node.children()
        kids = [seq.apply(i) for i in range(seq.size())]
        if kind == "UnresolvedAttribute":
            name = self.name_of(node)
            if name not in self.schema.names:
                raise ValueError(f"Unknown field: {name}")
            return F.col(f"`{name}`")
        if kind == "Literal" or kind == "UnaryMinus" and kids[0].getClass().getSimpleName() == "Literal":
            return F.expr(node.sql())
        if kind == "EqualTo":
            left, right = self.pair(*kids)
            return left == right
        if kind == "EqualNullSafe":
            left, right = self.pair(*kids)
            return left.eqNullSafe(right)
        if kind in ORDERED:
            left, right = self.pair(*kids)
            return getattr(left, ORDERED[kind])(right) & self.known(*kids)
        if kind == "In":
            return self.column(kids[0]).isin([self.typed(k, kids[0]) for k in kids[1:]])
        if kind in ("IsNull", "IsNotNull"):
            own, name = self.column(kids[0]), self.name_of(kids[0])
            missing = own.isNull() | F.isnan(own) if _floating(self.schema, name) else own.isNull()
            return missing if kind == "IsNull" else ~missing
        if kind in ("And", "Or"):
            a, b = map(self.column, kids)
            return a & b if kind == "And" else a | b
        if kind == "Not":
            inner = kids[0]
            if self.nulls == "keep" and inner.getClass().getSimpleName() == "In":  # NOT IN holds for nulls
                return F.coalesce(~self.column(inner), F.lit(True))
            return ~self.column(inner)
        if self.strict:
            raise ValueError(f"Unsupported expression type: {kind}")
        return F.expr(node.sql())


def from_sql(where: str, schema: T.StructType, nulls: str = "sql", strict: bool = True) -> Column:
    spark = SparkSession.active()
    node = spark._jsparkSession.sessionState().sqlParser().parseExpression(where)
    return _Translator(schema, nulls, strict).column(node)


def from_tuples(filters: list, schema: T.StructType) -> Column:
    """[(column, op, value), ...] all hold; a list of such lists: any holds."""
    if not filters:
        return F.lit(True)
    if isinstance(filters[0], tuple):
        filters = [filters]

    def one(name: str, op: str, value: Any) -> Column:
        if name not in schema.names:
            raise ValueError(f"Unknown field: {name}")
        col = F.col(f"`{name}`")
        if op.lower() in ("in", "not in"):
            return col.isin(list(value)) if op.lower() == "in" else ~col.isin(list(value))
        if op not in DNF:
            raise ValueError(f"Unsupported operator: {op}")
        held = getattr(col, DNF[op])(value)
        return held & ~F.isnan(col) if op in ("<", "<=", ">", ">=") and _floating(schema, name) else held

    return reduce(Column.__or__, [reduce(Column.__and__, [one(*t) for t in group]) for group in filters])


def predicate(filters: str | list | Column | None, schema: T.StructType, nulls: str = "sql", strict: bool = True) -> Column:
    if filters is None:
        return F.lit(True)
    if isinstance(filters, str):
        return from_sql(filters, schema, nulls, strict)
    if isinstance(filters, list):
        return from_tuples(filters, schema)
    if isinstance(filters, Column):
        return filters
    raise TypeError(f"filters are SQL text, tuples or a Column, not {type(filters).__name__}")


def table_names(query: str) -> list[str]:
    """Names of the tables that a query refers to, those of its own WITH clauses left out."""
    plan = SparkSession.active()._jsparkSession.sessionState().sqlParser().parsePlan(query)
    import re

    text = plan.toString()
    own = set(re.findall(r"CTE \[([^\]]*)\]", text))
    own = {x.strip() for group in own for x in group.split(",")}
    return sorted({m.replace(", ", ".") for m in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", text)} - own)
