"""Formulas of named numbers, compiled to Spark columns.

Only numbers, names, + - * /, unary signs and brackets are allowed; anything else is
a ValueError. Text never reaches the SQL parser. Division by zero gives 0.
"""

from __future__ import annotations

import ast
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismtab.functions.columns import safe_divide

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: safe_divide}


def names(formula: str) -> set[str]:
    return {n.id for n in ast.walk(_parse(formula)) if isinstance(n, ast.Name)}


def _parse(formula: str) -> ast.expr:
    try:
        return ast.parse(formula, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"no formula: {formula!r}") from e


def compile_formula(formula: str, known: Collection[str]) -> Column:
    """The formula as a double column over columns named in known."""

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = build(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in known:
                raise ValueError(f"unknown name {node.id!r} in {formula!r}")
            return F.col(f"`{node.id}`").cast("double")
        raise ValueError(f"{type(node).__name__} is not allowed in {formula!r}")

    return build(_parse(formula))
