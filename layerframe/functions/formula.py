"""Formula text to a Column: arithmetic on x0, x1, x2 only."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALLOWED = re.compile(r"[\sx0-9eE.+\-*/^(),pow]*")


def formula_column(text: str, names: dict[str, str], lo: float | None = None, hi: float | None = None) -> Column:
    """Column for ``text``; ``names`` maps formula variables to columns, ``^`` and ``pow`` are powers.

    Division by zero gives null. The result is clipped to [lo, hi] when given.
    """
    if not text or not _ALLOWED.fullmatch(text):
        raise ValueError(f"not a plain formula: {text!r}")

    def build(n: ast.AST) -> Column:
        match n:
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=i) if i in names:
                return F.col(names[i]).cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -build(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return build(a)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return build(a) + build(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return build(a) - build(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return build(a) * build(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(build(a), build(b))
            case ast.BinOp(left=a, op=ast.Pow(), right=b) | ast.Call(func=ast.Name(id="pow"), args=[a, b]):
                return F.pow(build(a), build(b))
        raise ValueError(f"not a plain formula: {text!r}")

    out = build(ast.parse(text.replace("^", "**"), mode="eval").body)
    if lo is not None and hi is not None:
        out = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), out))
    return out
