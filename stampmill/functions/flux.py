"""Magnitudes, surface brightness and the softened log-flux map as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from stampmill.cuts import AB_ZEROPOINT

# Regime limits of the map and the faint-quartile spread of a unit Gaussian.
LINEAR_BELOW = -20.0
EXPM1_ABOVE = 30.0
QUARTILE_SPREAD = 0.9703648
SKY_SLOPE = 0.5 / math.log(2.0)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def finite(value: Column) -> Column:
    """False for null, NaN and both infinities (Spark orders NaN above everything)."""
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def flux_to_mag(flux: Column) -> Column:
    """AB magnitude of a flux in nJy; a flux that is not positive has none (NaN)."""
    usable = (flux > 0) & ~F.isnan(flux)
    return F.when(usable, F.lit(AB_ZEROPOINT) - 2.5 * F.log10(F.when(usable, flux))).otherwise(
        F.lit(float("nan"))
    )


def mag_to_flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), (F.lit(AB_ZEROPOINT) - mag) / 2.5)


def softplus(u: Column) -> Column:
    return F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))


def log_softplus(u: Column) -> Column:
    return F.when(u < LINEAR_BELOW, u).otherwise(F.log(softplus(F.greatest(u, F.lit(LINEAR_BELOW)))))


def soften(flux: Column, softening, floor=0.0) -> Column:
    s, c = as_column(softening), as_column(floor)
    return c + s * softplus((flux - c) / s)


def log_flux(flux: Column, softening, floor=0.0) -> Column:
    """log(soften(flux)); its linear limit where the softened flux underflows."""
    s, c = as_column(softening), as_column(floor)
    u = (flux - c) / s
    value = soften(flux, s, c)
    direct = (value > 0) & ~((c == 0) & (u < LINEAR_BELOW))
    return F.when(direct, F.log(F.when(direct, value).otherwise(F.lit(1.0)))).otherwise(u + F.log(s))


def exact_flux(x: Column, softening, floor=0.0) -> Column:
    """Undo `log_flux`: the measured flux, negative values included."""
    s, c = as_column(softening), as_column(floor)
    no_floor = c == 0
    # log v and v, where v = softplus((flux - floor) / s). Without a floor log v is closed.
    v = F.when(no_floor, F.exp(x - F.log(s))).otherwise((F.exp(x) - c) / s)
    log_v = F.when(no_floor, x - F.log(s)).otherwise(F.log(F.greatest(v, F.lit(1e-300))))
    middle = (v <= EXPM1_ABOVE) & (log_v >= LINEAR_BELOW)
    u = (
        F.when(v > EXPM1_ABOVE, v)
        .when(log_v < LINEAR_BELOW, log_v)
        .otherwise(F.log(F.expm1(F.when(middle, v).otherwise(F.lit(1.0)))))
    )
    return c + s * u


def sky_level(softening, floor=0.0) -> Column:
    """Where zero flux sits in x."""
    return F.log(soften(F.lit(0.0), softening, floor))
