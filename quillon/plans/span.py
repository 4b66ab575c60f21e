"""Places in a query text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Generic, NamedTuple, TypeVar

T = TypeVar("T")
U = TypeVar("U")


class Span(NamedTuple):
    """A half-open range of bytes of a query text."""

    start: int
    end: int

    @classmethod
    def empty(cls, at: int) -> Span:
        """The range of no bytes at a place."""
        return cls(at, at)

    def merge(self, other: Span) -> Span:
        """The least range that covers both."""
        return Span(min(self.start, other.start), max(self.end, other.end))

    def __str__(self) -> str:
        return f"{self.start}..{self.end}"


@dataclass(frozen=True)
class Spanned(Generic[T]):
    """A value and where in the text it stands."""

    value: T
    span: Span

    def map(self, f: Callable[[T], U]) -> Spanned[U]:
        """Another value at the same place."""
        return Spanned(f(self.value), self.span)
