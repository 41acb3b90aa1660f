"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Column:
    """A column, or an aggregate of one; name is * in COUNT(*)."""

    name: str
    table: str | None = None
    aggregate: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Condition:
    """left op right; right is a Literal, a Column, a tuple of Literals or a Select. op: = <> < > <= >= IN."""

    left: Column
    op: str
    right: object


@dataclass(frozen=True)
class Order:
    column: Column
    descending: bool = False


@dataclass(frozen=True)
class Select:
    columns: tuple[Column, ...] | None  # None: *
    tables: tuple[str, ...]
    where: tuple[Condition, ...] = ()
    group: tuple[Column, ...] = ()
    having: tuple[Condition, ...] = ()
    order: Order | None = None
    unique: bool = False


@dataclass(frozen=True)
class Arithmetic:
    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class Assignment:
    column: str
    value: object  # Literal or Arithmetic


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[Assignment, ...]
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class ColumnDefinition:
    name: str
    kind: str  # INT, FLOAT, CHAR, VARCHAR, DATETIME
    length: int | None = None
    not_null: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDefinition, ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class DropIndex:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Load:
    path: str
    table: str


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class ShowIndex:
    table: str


@dataclass(frozen=True)
class SetKnob:
    knob: str
    on: bool


@dataclass(frozen=True)
class Command:
    """BEGIN, COMMIT, ROLLBACK, ABORT, HELP, EXIT, STATIC_CHECKPOINT."""

    name: str


@dataclass
class Script:
    statements: list = field(default_factory=list)
