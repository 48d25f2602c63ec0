"""The small expression language of specs, checked statically and compiled to Columns.

Filters know comparisons (also chained), membership in literal lists, and,
or, not.  Derived values add arithmetic and the conditional.  Python's
meaning holds: null is false where a truth value is needed, and membership
and equality never give null.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOGIC = (ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.Compare, ast.Name, ast.Load, ast.Constant, ast.Tuple, ast.List)
_COMPARE = (ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn)
FILTER_NODES = (*_LOGIC, *_COMPARE)
DERIVED_NODES = (*FILTER_NODES, ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.USub, ast.IfExp)


def parse(text: str, nodes: tuple[type, ...]) -> ast.Expression:
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"cannot parse {text!r}: {e.msg}") from None
    odd = next((n for n in ast.walk(tree) if not isinstance(n, nodes)), None)
    if odd is not None:
        raise ValueError(f"{type(odd).__name__} has no place in {text!r}")
    return tree


def names_in(text: str, nodes: tuple[type, ...]) -> set[str]:
    return {n.id for n in ast.walk(parse(text, nodes)) if isinstance(n, ast.Name)}


def literals_compared(text: str, name: str) -> set:
    """Literals that ``name`` is compared with or looked up in."""
    out: set = set()
    for node in ast.walk(parse(text, FILTER_NODES)):
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            if any(isinstance(s, ast.Name) and s.id == name for s in sides):
                for s in sides:
                    out |= {e.value for e in (s.elts if isinstance(s, (ast.Tuple, ast.List)) else [s]) if isinstance(e, ast.Constant)}
    return out


class Compiler:
    """Expressions over named columns; ``types`` tells which names are strings or booleans."""

    def __init__(self, columns: Mapping[str, Column], types: Mapping[str, str] | None = None) -> None:
        self.columns, self.types = columns, dict(types or {})

    def predicate(self, text: str) -> Column:
        """True or false, never null."""
        return self._truth(parse(text, FILTER_NODES).body)

    def value(self, text: str) -> Column:
        """The value, null as soon as any name it reads is null."""
        tree = parse(text, DERIVED_NODES)
        missing = [self._name(n).isNull() for n in sorted({x.id for x in ast.walk(tree) if isinstance(x, ast.Name)})]
        result = self._value(tree.body)
        return F.when(~reduce(Column.__or__, missing), result) if missing else result

    def _name(self, name: str) -> Column:
        if name not in self.columns:
            raise ValueError(f"unknown name {name!r}; there are {sorted(self.columns)}")
        return self.columns[name]

    def _truth(self, node: ast.AST) -> Column:
        match node:
            case ast.BoolOp(op=ast.And()):
                return reduce(Column.__and__, map(self._truth, node.values))
            case ast.BoolOp():
                return reduce(Column.__or__, map(self._truth, node.values))
            case ast.UnaryOp(op=ast.Not()):
                return ~self._truth(node.operand)
            case ast.Compare():
                sides = [node.left, *node.comparators]
                return reduce(Column.__and__, [self._pair(a, op, b) for a, op, b in zip(sides, node.ops, sides[1:], strict=False)])
            case ast.Constant():
                return F.lit(bool(node.value))
            case ast.Name() if self.types.get(node.id) == "boolean":
                truth = self._name(node.id)
            case ast.Name() if self.types.get(node.id) == "string":
                truth = self._name(node.id) != ""
            case _:
                truth = self._value(node) != 0
        return F.coalesce(truth, F.lit(False))

    def _pair(self, left: ast.AST, op: ast.AST, right: ast.AST) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.Tuple, ast.List)):
                raise ValueError("in needs a list")
            a = self._value(left)
            found = reduce(Column.__or__, [a.eqNullSafe(self._value(e)) for e in right.elts], F.lit(False))
            return ~found if isinstance(op, ast.NotIn) else found
        a, b = self._value(left), self._value(right)
        match op:
            case ast.Eq():
                return a.eqNullSafe(b)
            case ast.NotEq():
                return ~a.eqNullSafe(b)
            case ast.Lt():
                found = a < b
            case ast.LtE():
                found = a <= b
            case ast.Gt():
                found = a > b
            case _:
                found = a >= b
        return F.coalesce(found, F.lit(False))

    def _value(self, node: ast.AST) -> Column:
        match node:
            case ast.Constant():
                return F.lit(node.value)
            case ast.Name():
                return self._name(node.id)
            case ast.BinOp():
                a, b = self._value(node.left), self._value(node.right)
                match node.op:
                    case ast.Add():
                        return a + b
                    case ast.Sub():
                        return a - b
                    case ast.Mult():
                        return a * b
                    case _:
                        return a.cast("double") / b
            case ast.UnaryOp(op=ast.USub()):
                return -self._value(node.operand)
            case ast.IfExp():
                return F.when(self._truth(node.test), self._value(node.body)).otherwise(self._value(node.orelse))
            case _:
                return self._truth(node)
