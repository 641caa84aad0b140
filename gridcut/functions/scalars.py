"""Column expressions shared by the operators. All run inside whole-stage codegen."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcut.schemas import BLANK_CHARS, PREDICTABLE_CAUSES

INFINITY = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """NULL in, NULL out; false for NaN and both infinities."""
    return ~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(INFINITY))


def clean_label(c: str | Column) -> Column:
    """Label without surrounding blanks (tabs and line breaks included), in upper case."""
    return F.upper(F.btrim(col(c), F.lit(BLANK_CHARS)))


def label_or_null(c: str | Column) -> Column:
    """Published tables write a missing label as '', snapshots as NULL: treat both alike."""
    return F.nullif(clean_label(c), F.lit(""))


def is_blank(c: str | Column) -> Column:
    return F.coalesce(F.btrim(col(c), F.lit(BLANK_CHARS)) == "", F.lit(True))


def outside(c: str | Column, domain: Sequence) -> Column:
    """Known value that is not in the domain (NULL is not a violation)."""
    return F.coalesce(~col(c).isin(*domain), F.lit(False))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def is_true(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(False))


def half_hour_slot(ts: str | Column) -> Column:
    """0..47 slot of the civil day."""
    return (F.hour(col(ts)) * 2 + F.floor(F.minute(col(ts)) / 30)).cast("int")


def unix_micros(ts: str | Column) -> Column:
    """Microseconds of a naive timestamp, read as if it were UTC (session zone is not used)."""
    t = col(ts).cast("timestamp_ntz")
    days = F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000
    clock = F.hour(t) * 3600 + F.minute(t) * 60
    micros = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return days + clock.cast("bigint") * 1_000_000 + micros


def off_grid(ts: str | Column) -> Column:
    return unix_micros(ts) % 1_800_000_000 != 0


def plus_minutes(ts: str | Column, minutes: int | Column) -> Column:
    n = F.lit(minutes) if isinstance(minutes, int) else minutes
    return col(ts) + F.make_dt_interval(mins=n)


def at_midnight(day: str | Column) -> Column:
    return col(day).cast("timestamp_ntz")


def month_label(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def hours_in_month(ts: str | Column) -> Column:
    return F.day(F.last_day(col(ts))) * 24


def week_start(day: str | Column) -> Column:
    """Monday of the week."""
    return F.date_sub(col(day), F.weekday(col(day)))


def clip01(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """NULL when the denominator is zero or NULL."""
    return F.try_divide(col(a), col(b))


def count_if(condition: Column) -> Column:
    return F.count_if(is_true(condition))


def sum_if(value: str | Column, condition: Column) -> Column:
    """SUM that stays NULL when nothing known qualifies."""
    return F.sum(F.when(condition, col(value)))


def mean_if(value: str | Column, condition: Column) -> Column:
    return F.avg(F.when(condition, col(value)))


def changed(a: str | Column, b: str | Column) -> Column:
    """IS DISTINCT FROM."""
    return ~col(a).eqNullSafe(col(b))


def top_label(columns: Sequence[str], labels: Sequence[str] = PREDICTABLE_CAUSES) -> Column:
    """Label of the largest share; NULL shares lose, the first wins a tie, all NULL gives NULL."""
    best = F.greatest(*[F.coalesce(F.col(c), F.lit(-1.0)) for c in columns])
    choice = F.lit(None).cast("string")
    for name, label in reversed(list(zip(columns, labels, strict=True))):
        choice = F.when(F.col(name) == best, F.lit(label)).otherwise(choice)
    return choice


def mapped(c: str | Column, table: dict, default=None) -> Column:
    """Value lookup; values that are not in the table get the default."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(col(c) == F.lit(key), F.lit(value)).otherwise(out)
    return out


def mapped_strict(c: str | Column, table: dict) -> Column:
    """Value lookup that fails the job on a value outside the table."""
    out = F.raise_error(F.concat(F.lit("no entry for value "), F.coalesce(col(c), F.lit("NULL"))))
    for key, value in reversed(list(table.items())):
        out = F.when(col(c) == F.lit(key), F.lit(value)).otherwise(out)
    return out
