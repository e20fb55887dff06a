"""Row-level security: policies of a table, as filters and as checks of new rows; and published changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Policy:
    """Who may see (using) and write (check; `using` if not given) which rows by which command ('all' by default)."""

    name: str
    using: Column | None = None
    check: Column | None = None
    command: str = "all"
    roles: tuple[str, ...] = ("public",)
    permissive: bool = True


@dataclass
class Policies:
    """A table's policies: a row passes one permissive policy at least, and every restrictive one. Without any, none passes."""

    owner: str | None = None
    policies: list[Policy] = field(default_factory=list)

    def add(self, policy: Policy) -> Policies:
        if any(p.name == policy.name for p in self.policies):
            raise ValueError(f"policy {policy.name!r} already exists")
        self.policies.append(policy)
        return self

    def _passes(self, role: str, command: str, new: bool) -> Column:
        if role == self.owner:
            return F.lit(True)
        own = [p for p in self.policies if p.command in ("all", command) and {"public", role} & set(p.roles)]
        terms = [(p.permissive, F.coalesce((p.check if p.check is not None else p.using) if new else p.using, F.lit(False))) for p in own if (p.check is not None or p.using is not None if new else p.using is not None)]
        allowed = reduce(lambda a, b: a | b, [t for permissive, t in terms if permissive], F.lit(False))
        return reduce(lambda a, b: a & b, [t for permissive, t in terms if not permissive], allowed)

    def visible(self, df: DataFrame, role: str, command: str = "select") -> DataFrame:
        """The rows that the role may see by a command."""
        return df.filter(self._passes(role, command, False))

    def violations(self, rows: DataFrame, role: str, command: str = "insert") -> DataFrame:
        """New rows that the role may not write."""
        return rows.filter(~self._passes(role, command, True))


def published(changes: DataFrame, operations: Sequence[str] = ("insert", "update", "delete", "truncate"), columns: Sequence[str] | None = None, where: Column | None = None, op: str = "op") -> DataFrame:
    """What a publication sends of change rows: some operations, columns and rows; a subscriber applies them with apply_changes()."""
    kept = changes.filter(F.col(op).isin(*operations))
    kept = kept if where is None else kept.filter((F.col(op) == "truncate") | F.coalesce(where, F.lit(False)))
    return kept if columns is None else kept.select(*columns)
