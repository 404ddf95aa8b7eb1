"""What the parser makes of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    """A term as it is stored: ``<iri>``, ``"literal"``, a number or a bare word."""

    text: str

    def __str__(self) -> str:
        return self.text


Term = Var | Const


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term

    @property
    def terms(self) -> tuple[Term, Term, Term]:
        return self.s, self.p, self.o

    @property
    def variables(self) -> tuple[str, ...]:
        """Each once, in order."""
        return tuple(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))

    @property
    def shape(self) -> str:
        """Which positions are variables, as ``?s p ?o``; a variable that repeats makes it a self-join shape."""
        names = [f"?{n}" if isinstance(t, Var) else n for n, t in zip("spo", self.terms)]
        found = [t.name for t in self.terms if isinstance(t, Var)]
        return " ".join(names) + (" repeated" if len(set(found)) < len(found) else "")

    def __str__(self) -> str:
        return f"{self.s} {self.p} {self.o}"


@dataclass(frozen=True)
class Filter:
    """``op`` is a comparison or a function's name; ``args`` are terms or Python numbers."""

    var: str
    op: str
    args: tuple[str | float, ...]


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)

    @property
    def variables(self) -> tuple[str, ...]:
        names = [v for p in self.patterns for v in p.variables] + [v for g in self.optionals for v in g.variables]
        return tuple(dict.fromkeys(names))


@dataclass
class Query:
    where: Group
    select: list[str] | None
    modifier: str | None = None
    limit: int | None = None
    prefixes: dict[str, str] = field(default_factory=dict)

    @property
    def distinct(self) -> bool:
        return self.modifier == "distinct"

    @property
    def columns(self) -> list[str]:
        """Projected names in order; for ``*`` all, sorted."""
        return sorted(self.where.variables) if self.select is None else self.select
