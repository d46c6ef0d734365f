"""Arithmetic formulas over columns, turned into Column expressions.

A formula may hold numbers, column names, ``+ - * /``, a leading sign and
parentheses.  Nothing of it is ever evaluated as code or passed on as SQL text.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref, safe_ratio
from tabloom.functions.roles import column_roles

_CHARACTERS = re.compile(r"[\w\s.+\-*/()]*")
_MAX_DEPTH = 200


class FormulaError(ValueError):
    """The formula is not plain arithmetic over known columns."""


def _signed(operand: Column, op: ast.unaryop) -> Column:
    if isinstance(op, ast.USub):
        return -operand
    if isinstance(op, ast.UAdd):
        return operand
    raise FormulaError(f"operator {type(op).__name__} is not allowed")


def _combined(left: Column, op: ast.operator, right: Column, on_zero: str) -> Column:
    match op:
        case ast.Add():
            return left + right
        case ast.Sub():
            return left - right
        case ast.Mult():
            return left * right
        case ast.Div():
            return safe_ratio(left, right, on_zero)
    raise FormulaError(f"operator {type(op).__name__} is not allowed")


def _column_of(node: ast.AST, names: set[str], on_zero: str, depth: int = 0) -> Column:
    if depth > _MAX_DEPTH:
        raise FormulaError("formula is nested too deeply")
    match node:
        case ast.Constant(value=bool()):
            raise FormulaError("only numbers are allowed as constants")
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name(id=name) if name in names:
            return ref(name).cast("double")
        case ast.Name(id=name):
            raise FormulaError(f"unknown column {name!r}; known are {sorted(names)}")
        case ast.UnaryOp(op=op, operand=operand):
            return _signed(_column_of(operand, names, on_zero, depth + 1), op)
        case ast.BinOp(left=left, op=op, right=right):
            return _combined(
                _column_of(left, names, on_zero, depth + 1),
                op,
                _column_of(right, names, on_zero, depth + 1),
                on_zero,
            )
    raise FormulaError(f"{type(node).__name__} is not allowed in a formula")


def compile_formula(formula: str, columns: list[str], on_zero: str = "null") -> Column:
    """The Column a formula stands for; raises :class:`FormulaError` on anything else."""
    if not isinstance(formula, str) or not formula.strip():
        raise FormulaError("formula is empty")
    if not _CHARACTERS.fullmatch(formula):
        raise FormulaError("only names, numbers, + - * / and parentheses are allowed")
    try:
        body = ast.parse(formula.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
        raise FormulaError(f"not an arithmetic expression: {exc}") from exc
    return _column_of(body, set(columns), on_zero)


def validate_formula(formula: str, columns: list[str]) -> None:
    """Raise :class:`FormulaError` unless the formula is allowed over these columns."""
    compile_formula(formula, columns)


def formula_over(df: DataFrame, formula: str, on_zero: str = "null") -> Column:
    """The formula's Column for this table; raises TypeError if it uses a column that is no number."""
    compiled = compile_formula(formula, df.columns, on_zero)
    numeric, _ = column_roles(df)
    try:
        validate_formula(formula, numeric)
    except FormulaError as exc:
        raise TypeError(f"formula uses a column that is not numeric: {exc}") from exc
    return compiled


def derive(df: DataFrame, name: str, formula: str, on_zero: str = "null") -> DataFrame:
    """Add the formula's value as a double column; a constant formula fills every row."""
    return df.withColumn(name, formula_over(df, formula, on_zero))
