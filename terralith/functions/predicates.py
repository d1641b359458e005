"""Small predicate forms that callers pass as data, turned into columns. Values only ever become literals."""

from __future__ import annotations

import ast
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAFE_WHERE = re.compile(r"\s*([A-Za-z_]\w*)\s*(LIKE\b|>=|<=|!=|>|<|=)\s*(.+?)\s*", re.IGNORECASE | re.DOTALL)


class PredicateError(ValueError):
    pass


def _literal(raw: str) -> Any:
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "'\"":
        return raw[1:-1].replace(raw[0] * 2, raw[0])
    low = raw.lower()
    if low in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[low]
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    if not re.fullmatch(r"[\w.:\-]+", raw):
        raise PredicateError(f"not one literal: {raw}")
    return raw


def safe_where(text: str, columns: list[str]) -> Column:
    """One `column op literal`; conjunctions and anything else are refused."""
    m = _SAFE_WHERE.fullmatch(text)
    if not m or m[1] not in columns:
        raise PredicateError(f"expected `column op literal`: {text}")
    c, op, value = F.col(m[1]), m[2].upper(), _literal(m[3])
    if value is None:
        if op not in ("=", "!="):
            raise PredicateError("null can only be compared by = and !=")
        return c.isNull() if op == "=" else c.isNotNull()
    if op == "LIKE":
        return c.cast("string").like(str(value))
    return {"=": c == value, "!=": c != value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]


_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def attribute_filter(text: str, columns: list[str]) -> Column:
    """`a > 1 and b in ["x", "y"]` and the like: and, or, not, comparisons (chained too), in, not in."""
    try:
        tree = ast.parse(text.replace("`", "").strip(), mode="eval").body
    except SyntaxError as e:
        raise PredicateError(str(e)) from e

    def operand(node: ast.expr) -> Any:
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise PredicateError(f"no column {node.id}")
            return F.col(node.id)
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -operand(node.operand)
        raise PredicateError(f"not allowed here: {ast.unparse(node)}")

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [build(x) for x in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(node.op, ast.And) else (out | p)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~build(node.operand)
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, ast.In | ast.NotIn):
                    if not isinstance(right, ast.List | ast.Tuple):
                        raise PredicateError("in takes a list")
                    one = operand(left).isin(*[operand(x) for x in right.elts])
                    one = ~one if isinstance(op, ast.NotIn) else one
                elif type(op) in _COMPARE:
                    one = getattr(operand(left), _COMPARE[type(op)])(operand(right))
                else:
                    raise PredicateError("comparison not allowed")
                out, left = one if out is None else out & one, right
            return out
        raise PredicateError(f"not allowed: {ast.unparse(node)}")

    return build(tree)


def layer_filter(expression: list) -> Column:
    """A map style filter, e.g. ["all", [">", ["get", "value"], 50], ["in", ["get", "kind"], ["literal", ["a"]]]]."""
    op, *args = expression
    if op in ("all", "any", "none"):
        parts = [layer_filter(x) for x in args]
        out = F.lit(op != "any")
        for p in parts:
            p = ~p if op == "none" else p
            out = (out | p) if op == "any" else (out & p)
        return out
    if op == "!":
        return ~layer_filter(args[0])
    if op == "has":
        return F.col(args[0]).isNotNull()

    def value(x: Any) -> Any:
        if isinstance(x, list):
            if x[0] == "get":
                return F.col(x[1])
            if x[0] == "literal":
                return x[1]
            raise PredicateError(f"unknown expression {x[0]}")
        return x

    left = value(args[0])
    left = left if isinstance(left, Column) else F.lit(left)
    if op in ("in", "!in"):
        options = value(args[1]) if len(args) == 2 and isinstance(args[1], list) else args[1:]
        found = left.isin(*options)
        return ~found if op == "!in" else found
    ops = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    if op not in ops:
        raise PredicateError(f"unknown operator {op}")
    return getattr(left, ops[op])(value(args[1]))


def contains_ci(column: Column, needle: str) -> Column:
    """Case-insensitive substring; % and _ have no special meaning."""
    return F.contains(F.lower(F.coalesce(column.cast("string"), F.lit(""))), F.lit(needle.lower()))
