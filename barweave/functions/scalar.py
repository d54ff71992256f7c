"""Row-level expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barweave import params


def lit_or_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Bound ``x``; a non-finite number becomes 0, NULL stays NULL."""
    # NaN compares above infinity, so one comparison finds every finite number
    finite = F.abs(x) < F.lit(float("inf"))
    return F.when(finite, F.greatest(F.lit(lo), F.least(F.lit(hi), x))).when(x.isNotNull(), 0.0)


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero or NULL."""
    return F.try_divide(lit_or_col(a).cast("double"), lit_or_col(b).cast("double"))


def truthy(x: Column) -> Column:
    """Numbers that are present and not zero."""
    return F.coalesce(x, F.lit(0.0)) != 0


def json_safe(x: Column) -> Column:
    """Non-finite doubles have no JSON form and become NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 7.1.26 erf polynomial (error <= 1.5e-7)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def epoch_to_ts(x: Column) -> Column:
    """Epoch seconds or milliseconds; values above 1e12 are milliseconds."""
    seconds = F.when(x > F.lit(1e12), x / 1000.0).otherwise(x.cast("double"))
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def ist(ts: Column) -> Column:
    """Wall-clock time in India as TIMESTAMP_NTZ, independent of the session zone."""
    return F.convert_timezone(None, F.lit(params.IST), ts)


def ist_minute(ts: Column) -> Column:
    local = ist(ts)
    return F.hour(local) * 60 + F.minute(local)


def is_high_vol_session(ts: Column) -> Column:
    """09:30-10:30 or 14:30-15:30 IST at minute precision, both ends included."""
    m = ist_minute(ts)
    return m.between(570, 630) | m.between(870, 930)


def session_vol_factor(ts: Column) -> Column:
    lunch = F.hour(ist(ts)).between(12, 13)
    return F.lit(params.VOLATILITY_MULTIPLIER) * (
        F.when(is_high_vol_session(ts), 1.2).when(lunch, 0.8).otherwise(1.0)
    )


def clean_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def order_key(ts: Column, seq: Column) -> Column:
    """(ts, seq) as one decimal, ordered like the pair.

    ``min_by`` / ``max_by`` over a struct cannot be hash-aggregated because the
    buffer is not updatable in place; a decimal can. |seq| is below 1e19, so the
    factor 2e19 keeps the two parts apart and the result fits 38 digits.
    """
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit("20000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + seq.cast(
        "decimal(20,0)"
    )


def joined(reasons: list[Column], sep: str = "; ") -> Column:
    return F.array_join(F.array_compact(F.array(*reasons)), sep)


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)
