"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a stored slot list
# (space, tab, newline, carriage return, NUL, vertical tab) plus ':'.
TRIM_CHARS = ": \t\n\r\x00\x0b"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch.  For TIMESTAMP_NTZ this does not depend
    on the session time zone; for TIMESTAMP it is the instant."""
    return F.unix_timestamp(_c(ts))


def tick_of(ts, width_s: int) -> Column:
    """Tumbling tick number: floor(epoch / width)."""
    return F.floor(epoch_seconds(ts) / F.lit(width_s)).cast("bigint")


def in_ticks(df, ts: str, width_s: int, first: int, last: int):
    """Rows whose ``ts`` lies in ticks ``first`` .. ``last``: a range of
    literals of the column's own type, which reaches the file scan."""
    kind = df.schema[ts].dataType.simpleString()

    def at(tick: int) -> Column:
        # TIMESTAMP_NTZ counts as UTC, as in tick_of
        return F.lit(datetime.fromtimestamp(tick * width_s, UTC).strftime("%Y-%m-%d %H:%M:%S")).cast(kind) \
            if kind == "timestamp_ntz" else F.timestamp_seconds(F.lit(tick * width_s))
    return df.where((F.col(ts) >= at(first)) & (F.col(ts) < at(last + 1)))


def hash_u32(*parts) -> Column:
    """Reproducible uniform draw in [0, 2^32): first 8 hex digits of md5.

    Same integer as DuckDB ``concat('0x', substr(md5(s),1,8))::bigint``.
    """
    s = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def draw_index(u: Column, n) -> Column:
    """1-based index of a uniform pick among ``n`` items from draw ``u``
    (``n`` < 1 is treated as 1, so no division by zero under ANSI mode)."""
    n = _c(n) if not isinstance(n, int) else F.lit(n)
    return (F.pmod(u, F.greatest(n, F.lit(1))) + 1).cast("int")


def pick(arr, u: Column) -> Column:
    """Uniform pick from an array with draw ``u``; null for a null or empty
    array (``get`` never raises on a bad index)."""
    a = _c(arr)
    return F.get(a, draw_index(u, F.size(a)) - 1)


def is_empty(c) -> Column:
    """The 'empty' test of the serving path: null, '' or '0'."""
    c = _c(c)
    return c.isNull() | c.isin("", "0")


def strip_chars(c, chars: str = TRIM_CHARS) -> Column:
    """Strip any of ``chars`` from both ends (btrim with a char set)."""
    return F.btrim(_c(c), F.lit(chars))


def round4(c) -> Column:
    """Round half-up to 4 places through DECIMAL(38,12).

    Rounding a double directly differs between engines at exact halves
    (Spark rounds its shortest decimal string, others the binary value);
    going through a 12-place decimal first makes every engine round the
    same decimal number."""
    return F.round(_c(c).cast("decimal(38,12)"), 4).cast("double")


def scaled_units(c, digits: int) -> Column:
    """A non-negative decimal amount with at most ``digits`` decimals as an
    exact integer count of 10^-digits units."""
    return F.round(_c(c) * (10 ** digits)).cast("bigint")


def exact_mean4(units_sum: str, n: str, digits: int) -> Column:
    """Mean of non-negative amounts rounded half-up to 4 places, exactly.

    ``units_sum`` is the column name of the integer sum of
    ``scaled_units(x, digits)``; integer arithmetic makes the result
    independent of the summation order of doubles (many such means sit
    exactly on a .5 at the fifth place).  Null when ``n`` is 0.
    """
    m = 10 ** (4 - digits)
    q = F.expr(f"({units_sum} * {2 * m} + {n}) div (2 * {n})")
    return F.when(F.col(n) > 0, q / F.lit(10000.0))
