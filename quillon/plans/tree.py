"""What the parser yields: expressions without types, and the statement."""

from __future__ import annotations

from dataclasses import dataclass

from quillon.plans.types import LType


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Literal:
    """A Python int, float, str, bool or None."""

    value: int | float | str | bool | None


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Cast:
    operand: Expr
    to: LType


@dataclass(frozen=True)
class NullTest:
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class Nested:
    """An expression in parentheses: only its name in the output differs from the inner one's."""

    inner: Expr


Expr = Name | Literal | Unary | Binary | Cast | NullTest | Nested


@dataclass(frozen=True)
class Star:
    """All columns of the input."""


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Key:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Star | Item, ...]
    table: str
    table_alias: str | None = None
    where: Expr | None = None
    order_by: tuple[Key, ...] = ()
    limit: int | None = None
