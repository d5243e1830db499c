"""Units of measure: factors to canonical units."""

from __future__ import annotations

#: Unit to (canonical unit, factor).
UNITS: dict[str, tuple[str, float]] = {
    # mass
    "kg": ("g", 1000.0), "g": ("g", 1.0), "mg": ("g", 0.001), "ug": ("g", 0.000001), "ng": ("g", 0.000000001), "pg": ("g", 0.000000000001),
    "lb": ("g", 453.59237), "oz": ("g", 28.349523125), "[lb_av]": ("g", 453.59237), "[oz_av]": ("g", 28.349523125),
    # length
    "km": ("m", 1000.0), "m": ("m", 1.0), "dm": ("m", 0.1), "cm": ("m", 0.01), "mm": ("m", 0.001), "um": ("m", 0.000001), "nm": ("m", 0.000000001),
    "[in_i]": ("m", 0.0254), "[ft_i]": ("m", 0.3048), "[yd_i]": ("m", 0.9144), "[mi_i]": ("m", 1609.344), "in": ("m", 0.0254), "ft": ("m", 0.3048),
    # volume
    "L": ("L", 1.0), "l": ("L", 1.0), "dL": ("L", 0.1), "dl": ("L", 0.1), "cL": ("L", 0.01), "cl": ("L", 0.01), "mL": ("L", 0.001), "ml": ("L", 0.001),
    "uL": ("L", 0.000001), "ul": ("L", 0.000001), "[gal_us]": ("L", 3.785411784), "[qt_us]": ("L", 0.946352946), "[pt_us]": ("L", 0.473176473), "[foz_us]": ("L", 0.0295735295625),
    # time
    "a": ("s", 31557600.0), "mo": ("s", 2629800.0), "wk": ("s", 604800.0), "d": ("s", 86400.0), "h": ("s", 3600.0), "min": ("s", 60.0), "s": ("s", 1.0),
    "ms": ("s", 0.001), "us": ("s", 0.000001), "ns": ("s", 0.000000001),
    # temperature
    "K": ("K", 1.0), "Cel": ("Cel", 1.0), "[degF]": ("Cel", 1.0),
    # mass concentration
    "g/L": ("g/L", 1.0), "mg/L": ("g/L", 0.001), "ug/L": ("g/L", 0.000001), "ng/L": ("g/L", 0.000000001), "g/dL": ("g/L", 10.0), "mg/dL": ("g/L", 0.01),
    "ug/dL": ("g/L", 0.00001), "g/mL": ("g/L", 1000.0), "mg/mL": ("g/L", 1.0), "ug/mL": ("g/L", 0.001),
    # molar concentration
    "mol/L": ("mol/L", 1.0), "mmol/L": ("mol/L", 0.001), "umol/L": ("mol/L", 0.000001), "nmol/L": ("mol/L", 0.000000001), "pmol/L": ("mol/L", 0.000000000001),
    # pressure
    "Pa": ("Pa", 1.0), "kPa": ("Pa", 1000.0), "mm[Hg]": ("Pa", 133.322387415), "[psi]": ("Pa", 6894.757293168),
    # counts
    "10*9/L": ("10*9/L", 1.0), "10*12/L": ("10*9/L", 1000.0), "10*6/L": ("10*9/L", 0.001), "10*3/uL": ("10*9/L", 1.0), "/uL": ("10*9/L", 0.000001),
    # per cent, rates
    "%": ("%", 1.0), "/min": ("/min", 1.0), "/h": ("/min", 1.0 / 60.0),
    # international units
    "[IU]": ("[IU]", 1.0), "[IU]/L": ("[IU]/L", 1.0), "[IU]/mL": ("[IU]/L", 1000.0), "m[IU]/L": ("[IU]/L", 0.001), "m[IU]/mL": ("[IU]/L", 1.0), "u[IU]/mL": ("[IU]/L", 0.001),
    # energy
    "J": ("J", 1.0), "kJ": ("J", 1000.0), "cal": ("J", 4.184), "kcal": ("J", 4184.0), "[Cal]": ("J", 4184.0),
}
_BY_LOWER: dict[str, tuple[str, float]] = {}
for _unit, _row in UNITS.items():
    _BY_LOWER.setdefault(_unit.lower(), _row)


def known(unit: str) -> bool:
    return unit in UNITS or unit.lower() in _BY_LOWER


def canonical(unit: str) -> str:
    return (UNITS.get(unit) or _BY_LOWER.get(unit.lower()) or (unit, 1.0))[0]


def factor(unit: str) -> float:
    return (UNITS.get(unit) or _BY_LOWER.get(unit.lower()) or (unit, 1.0))[1]


def normalize(value: float, unit: str, system: str = "") -> tuple[float, str]:
    """(value, unit) in the canonical unit; unchanged for unknown units and for systems other than UCUM's."""
    if system not in ("", "http://unitsofmeasure.org"):
        return value, unit
    return value * factor(unit), canonical(unit)
