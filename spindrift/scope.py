"""Visibility scopes: who may read which rows of which table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content: public rows for everybody, private ones for their owner alone.
CONTENT = frozenset({"event", "cluster", "entity_edge"})
#: Rows of a subscriber, and the column that names it; all of them for an administrator.
OWNED = {"connection": "owner", "subscriber": "subscriber", "digest": "subscriber", "story": "subscriber", "thread": "subscriber", "feedback": "subscriber", "subscription": "subscriber"}
OPEN = frozenset({"digest_config", "build_watermark"})


@dataclass(frozen=True)
class Context:
    """Nobody in particular (neither), a subscriber, or an administrator."""

    subscriber: int | None = None
    admin: bool = False


def visible_to(subscriber: int | Column | None, kind: str = "scope_kind", owner: str = "owner") -> Column:
    """Public rows, and the subscriber's own private ones."""
    public = F.col(kind) == "public"
    if subscriber is None:
        return public
    return public | ((F.col(kind) == "private") & F.col(owner).eqNullSafe(F.lit(subscriber) if isinstance(subscriber, int) else subscriber))


def scoped(table: str, df: DataFrame, ctx: Context) -> DataFrame:
    """The rows of a table that ctx may read. Raises PermissionError where none may be."""
    if table in OPEN:
        return df
    if table in CONTENT:
        return df.filter(visible_to(None if ctx.admin else ctx.subscriber))
    if table not in OWNED:
        raise KeyError(table)
    if ctx.admin:
        return df
    if ctx.subscriber is None:
        raise PermissionError(f"{table} needs a subscriber or an administrator")
    return df.filter(F.col(OWNED[table]) == ctx.subscriber)


def scoped_items(items: DataFrame, digests: DataFrame, ctx: Context) -> DataFrame:
    """Digest items whose digest ctx may read."""
    if ctx.admin:
        return items
    return items.join(scoped("digest", digests, ctx).select("digest_id"), "digest_id", "left_semi")


def finalize_scope(df: DataFrame, is_private: Column, owner: Column) -> DataFrame:
    """Scope columns from a flag and an owner. A private row without an owner is an error, never public."""
    bad = F.raise_error(F.lit("a private event needs an owner"))
    kind = F.when(~is_private, F.lit("public")).when(owner.isNull(), bad).otherwise(F.lit("private"))
    return df.withColumns({"scope_kind": kind, "owner": F.when(is_private, owner)})
