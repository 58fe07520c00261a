"""Filters F1-F13: conditions as data, turned into one Column each."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.numbers import is_time, number
from tabulon.functions.text import strip

OPS = ("==", "!=", ">", ">=", "<", "<=", "in", "contains")
BITS_PER_JOB = 12


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any = None


def known_columns(df: DataFrame, conditions: list[Condition]) -> list[Condition]:
    """without the conditions on columns the table lacks."""
    return [c for c in conditions if c.column in df.columns]


def _moment(value: Any) -> datetime | None:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None


def _as_float(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


class _Side:
    """The column side of a condition, with values brought to its type."""

    def __init__(self, df: DataFrame, name: str, trim: bool):
        field = df.schema[name]
        self.df, self.name, self.trim = df, name, trim
        self.text = isinstance(field.dataType, T.StringType)
        self.time = is_time(field)
        self.kind = field.dataType
        self.raw = F.col(f"`{name}`")
        self.c = strip(self.raw) if self.text and trim else self.raw

    def literal(self, value: Any, listed: bool = False) -> Column | None:
        """The value as a literal of the column's type; None if it can never be equal."""
        if self.text:
            if isinstance(value, str):
                return F.lit(value.strip() if self.trim else value)
            return F.lit(str(value)) if listed and self.trim else None
        if self.time:
            moment = _moment(value)
            return None if moment is None else F.lit(moment.isoformat(sep=" ")).cast(self.kind)
        if isinstance(value, str):
            return None
        if isinstance(self.kind, T.BooleanType):
            return F.lit(bool(value)) if value in (0, 1, True, False) else None
        return F.lit(value)

    def among(self, values: list[Any]) -> Column:
        found = [v for v in (self.literal(x, listed=True) for x in values if x is not None) if v is not None]
        return self.c.isin(*found) if found else F.lit(False)

    def printed(self) -> Column:
        """The text a value prints as; large doubles without exponent."""
        if isinstance(self.kind, (T.DoubleType, T.FloatType)):
            plain = F.regexp_replace(self.raw.try_cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
            large = (F.abs(self.raw) >= 1e7) & (F.abs(self.raw) < 1e16)
            return F.when(large, plain).otherwise(self.raw.cast("string"))
        return self.raw.cast("string")


def condition_column(df: DataFrame, cond: Condition, trim: bool = True, ignore_case: bool = True) -> Column | None:
    """The condition as a boolean Column (null counts as false); None if it is not usable.

    With ``trim=False, ignore_case=False`` this is the plain dialect of F10.
    """
    if cond.column not in df.columns or cond.op not in OPS:
        return None
    side = _Side(df, cond.column, trim)
    value = cond.value
    if isinstance(value, (list, tuple)) and trim:
        value = None if not value else (value[0] if len(value) == 1 else list(value))
    listed = isinstance(value, (list, tuple))

    if cond.op == "==":
        if listed:
            return side.among(value)
        if value is None:
            return side.raw.isNull() if trim else F.lit(False)
        lit = side.literal(value)
        return F.lit(False) if lit is None else side.c == lit
    if cond.op == "!=":
        if listed:
            return ~F.coalesce(side.among(value), F.lit(False))
        if value is None:
            return side.raw.isNotNull() if trim else F.lit(True)
        lit = side.literal(value)
        if lit is None:
            return F.lit(True)
        return side.c != lit if side.text and trim else ~side.c.eqNullSafe(lit)
    if cond.op == "in":
        if value is None:
            return F.lit(False)
        if not listed and not trim:
            return None
        return side.among(value if listed else [value])
    if cond.op == "contains":
        tokens = [str(v) for v in (value if listed else [value]) if v is not None]
        if not tokens:
            return F.lit(False)
        flags = "(?iu)" if ignore_case else ""
        return reduce(Column.__or__, [side.printed().rlike(flags + t) for t in tokens])
    if listed or value is None:
        return F.lit(False)
    if side.time:
        moment = _moment(value)
        if moment is None:
            return F.lit(False)
        left, right = side.raw, F.lit(moment.isoformat(sep=" ")).cast(side.kind)
    else:
        bound = _as_float(value)
        if bound is None:
            return F.lit(False)
        left, right = number(df, cond.column), F.lit(bound)
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[cond.op]


def where_all(df: DataFrame, conditions: list[Condition], trim: bool = True) -> DataFrame:
    """Every usable condition, without the empty-result guard."""
    columns = [condition_column(df, c, trim=trim) for c in conditions]
    usable = [c for c in columns if c is not None]
    return df.filter(reduce(Column.__and__, usable)) if usable else df


def where_plain(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """the second dialect, exact text and case, unusable conditions ignored."""
    for cond in known_columns(df, conditions):
        c = condition_column(df, cond, trim=False, ignore_case=False)
        if c is not None:
            df = df.filter(c)
    return df


def keep_baseline(df: DataFrame, conditions: list[Condition]) -> tuple[list[Condition], list[str]]:
    """thresholds are refused unless they bound a real time column."""
    kept, refused = [], []
    for cond in conditions:
        if cond.column not in df.columns:
            refused.append(f"unknown column: {cond.column}")
        elif cond.op not in OPS:
            refused.append(f"unsupported operator: {cond.column} {cond.op}")
        elif cond.op in (">", ">=", "<", "<=") and not is_time(df.schema[cond.column]):
            refused.append(f"threshold refused: {cond.column} {cond.op} {cond.value!r}")
        else:
            kept.append(cond)
    return kept, refused


def where_guarded(df: DataFrame, conditions: list[Condition], preserve_baseline: bool = False) -> tuple[DataFrame, list[Condition], list[str]]:
    """F8: conditions in order, each skipped if it would leave no row.

    One pass marks which conditions hold together: every row gives a bit mask and only the distinct
    masks come back (at most 2^12, whatever the table size). The guard is then decided on the masks.
    """
    notes: list[str] = []
    if preserve_baseline:
        conditions, notes = keep_baseline(df, conditions)
    usable: list[tuple[Condition, Column]] = []
    for cond in conditions:
        c = condition_column(df, cond)
        if c is None:
            notes.append(f"unknown column or operator: {cond.column} {cond.op}")
        else:
            usable.append((cond, c))
    kept: list[Condition] = []
    out = df
    for start in range(0, len(usable), BITS_PER_JOB):
        part = usable[start:start + BITS_PER_JOB]
        mask = reduce(Column.__add__, [
            F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, c) in enumerate(part)
        ])
        masks = [r[0] for r in out.select(mask.alias("mask")).distinct().collect()]
        need = 0
        accepted: list[Column] = []
        for i, (cond, c) in enumerate(part):
            trial = need | (1 << i)
            if any(m & trial == trial for m in masks):
                need = trial
                kept.append(cond)
                accepted.append(c)
            else:
                notes.append(f"no rows left: {cond.column} {cond.op} {cond.value!r}")
        if accepted:
            out = out.filter(reduce(Column.__and__, accepted))
    return out, kept, notes


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows where all named columns hold a finite value."""
    for name in columns:
        c = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            df = df.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        else:
            df = df.filter(c.isNotNull())
    return df
