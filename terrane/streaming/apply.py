"""Declared conditions on streams: policies, checks and triggers are stateless and hold row by row; keyed upserts run per batch.

Beyond what the declarations need, nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..operators import changes
from ..operators.security import Protected, combined
from ..sources.catalog import Store, Table


def filtered(stream: DataFrame, protected: Protected, command: str, role: str, **values: object) -> DataFrame:
    """A stream's rows that the role's policies let through. Policies with subqueries would need a join, and are refused."""
    condition = combined([p for p in protected.policies if p.applies(command, role)], "using")
    require(all(e.op != "exists" for e in X.walk(condition)), "stateful-policy", "a stream's policy has no subquery")
    return stream.where(X.compile_(condition, X.Scope(bare=True, locals=tuple(values.items()))))


def checked(stream: DataFrame, table: Table) -> DataFrame:
    """The stream with broken: the names of the checks that a row fails, and of required columns it lacks."""
    parts = [F.when(~F.coalesce(X.compile_(c.condition, X.Scope(bare=True)), F.lit(True)), F.lit(c.name)) for c in table.checks]
    parts += [F.when(F.col(n).isNull(), F.lit(f"{n} not null")) for n, c in table.columns if not c.nullable]
    return stream.withColumn("broken", F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"))


def upsert_into(table: Table, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], set_: dict, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: merges each batch into the table that read() gives and write() replaces. A repeated batch gives the same state."""

    def merge(batch: DataFrame, epoch: int) -> None:
        store = Store(batch.sparkSession).bind(table, read)
        write(changes.insert_or_update(table, batch, keys, set_, order, store).state, epoch)

    return merge
