"""Scalar functions: NULL in gives NULL out; division by zero and overflow are errors (ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import SyntaxFault


def arithmetic(op: str, left: Column, right: Column, whole: bool) -> Column:
    """left op right; whole: both are integers, so that division cuts off towards zero."""
    if op == "+":
        return left + right
    if op == "-":
        return left - right
    if op == "*":
        return left * right
    if op != "/":
        raise SyntaxFault(f"unknown operator {op}")
    return F.call_function("div", left, right) if whole else left / right


def modulo(left: Column, right: Column) -> Column:
    return left % right


def square_root(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("square root of a negative number"))).otherwise(F.sqrt(x))


def smaller(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), F.least(left, right))


def larger(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def same(left: Column, right: Column) -> Column:
    """Equality in which NULL equals NULL."""
    return left.eqNullSafe(right)


def cast_as(x: Column, kind: str) -> Column:
    """A cast that fails where the value doesn't fit."""
    return x.cast(kind)


def hash_value(*columns: Column) -> Column:
    return F.xxhash64(*columns)
