"""Column roles and name resolution.  Schema only, no data pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tabloom.functions.columns import is_fractional, is_integral

# Column names taken for a target when none is given.
TARGET_NAMES = (
    "target", "label", "class", "y", "output", "response",
    "outcome", "result", "prediction", "survived", "churn", "default",
)


def column_roles(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names in table order.

    Strings, booleans and date or time columns are categorical.  Nested columns
    have no role.
    """
    skip = set(exclude)
    numeric, categorical = [], []
    for field in df.schema.fields:
        if field.name in skip:
            continue
        if is_integral(field.dataType) or is_fractional(field.dataType):
            numeric.append(field.name)
        elif field.dataType.typeName() not in ("array", "map", "struct", "binary", "udt"):
            categorical.append(field.name)
    return numeric, categorical


def resolve_column(columns: DataFrame | list[str], name: str | None) -> str | None:
    """The column a loosely written name means: exact, else ignoring case, else by substring."""
    names = columns.columns if isinstance(columns, DataFrame) else list(columns)
    wanted = "" if name is None else str(name).strip()
    if not wanted:
        return None
    if wanted in names:
        return wanted
    folded = wanted.lower()
    tests = (
        lambda known: known == folded,
        lambda known: folded in known or known in folded,
    )
    for test in tests:
        found = next((n for n in names if test(n.lower())), None)
        if found is not None:
            return found
    return None


def pick_target(df: DataFrame, explicit: str | None = None, clustering: bool = False) -> str | None:
    """Target column: explicit name if in the table, else a well-known name, else the last column."""
    if clustering or not df.columns:
        return None
    if explicit in df.columns:
        return explicit
    known = [c for c in df.columns if c.lower() in TARGET_NAMES]
    return known[0] if known else df.columns[-1]
