"""The engine's own helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coalesce_label(*pairs: tuple[Column | str, str], first: bool = False) -> Column:
    """The label of the last pair whose column is not null (of the first one, with first=True)."""
    out = F.lit(None).cast("string")
    for col, label in reversed(pairs) if first else pairs:
        if label is None:
            raise ValueError("coalesce_label: a label must be a non-null string")
        c = F.col(col) if isinstance(col, str) else col
        out = F.when(c.isNotNull(), F.lit(label)).otherwise(out)
    return out


def cast_int8_as_char(x: Column) -> Column:
    return F.call_function("chr", F.pmod(x.cast("int"), F.lit(256)).cast("bigint"))


_KGUM, _UPOX, _UMLL = "SDN:P06::KGUM", "SDN:P06::UPOX", "SDN:P06::UMLL"
_DENSITY, _OXYGEN = 1.025, 44.66080
#: Factor for each pair of oxygen units: micromole a kilogram, micromole a litre, millilitre a litre.
UNITS = {
    (_KGUM, _UPOX): _DENSITY,
    (_UPOX, _KGUM): 1 / _DENSITY,
    (_UMLL, _UPOX): _OXYGEN,
    (_UPOX, _UMLL): 1 / _OXYGEN,
    (_KGUM, _UMLL): _DENSITY / _OXYGEN,
    (_UMLL, _KGUM): _OXYGEN / _DENSITY,
}


def map_units(source: Column, target: Column, value: Column) -> Column:
    """The value in the target unit; null for any pair that is not in UNITS, equal units included."""
    out = F.lit(None).cast("double")
    for (a, b), factor in UNITS.items():
        out = F.when((source == a) & (target == b), value * F.lit(factor)).otherwise(out)
    return out


# The coefficients h001 to h007 of the published 75-term polynomial for specific volume (Roquet et al. 2015),
# integrated over pressure, as the TEOS-10 toolbox gives them for its height from pressure.
#: Specific enthalpy at standard ocean salinity and 0 C in powers of pressure / 10^4 dbar.
_ENTHALPY = (
    9.726613854843870e-4, -2.252956605630465e-5, 2.376909655387404e-6, -1.664294869986011e-7, -5.988108894465758e-9,
    -2.1078768810e-9, 2.8019291329e-10,
)


def pressure_to_depth(p: Column, lat: Column) -> Column:
    """Depth in metres from sea pressure in dbar and latitude: minus TEOS-10's height from pressure."""
    sin2 = F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    z = p * F.lit(1e-4)
    poly = F.lit(_ENTHALPY[-1])
    for c in _ENTHALPY[-2::-1]:
        poly = F.lit(c) + z * poly
    enthalpy = z * poly * F.lit(1e8)
    b = F.lit(9.780327) * (F.lit(1.0) + (F.lit(5.2792e-3) + F.lit(2.32e-5) * sin2) * sin2)
    a = F.lit(-0.5 * 2.26e-7) * b
    return F.lit(2.0) * enthalpy / (b + F.sqrt(b * b - F.lit(4.0) * a * enthalpy))
