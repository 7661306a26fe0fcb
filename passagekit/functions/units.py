"""Unit conversion: internal knots, metres and nautical miles to and from preferred units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to SI, factors back, and symbols without preferences.
TO_SI = {"speed": 0.514444, "depth": 1.0, "distance": 1852.001}
KNOTS_FROM_SI = 1.94384
SYMBOL = {"speed": "kn", "depth": "m", "distance": "nmi"}


@dataclass(frozen=True)
class Preference:
    formula: str
    inverse: str
    symbol: str
    display: str = ""


def apply_formula(formula: Column, value: Column) -> Column:
    """``value OP number``; any other text leaves the value as it is."""
    rest = F.ltrim(F.substring(formula, 6, 1000))
    op, digits = F.substring(rest, 1, 1), F.ltrim(F.substring(rest, 2, 1000))
    number = F.when(F.startswith(formula, F.lit("value")) & (F.translate(digits, "0123456789.", "") == ""), digits.try_cast("double"))
    return (
        F.when(number.isNull(), value)
        .when(op == "*", value * number)
        .when(op == "/", value / number)
        .when(op == "+", value + number)
        .when(op == "-", value - number)
        .otherwise(value)
    )


def to_si(value: Column, category: str) -> Column:
    return value * TO_SI[category]


def from_si(value: Column, category: str) -> Column:
    return value * KNOTS_FROM_SI if category == "speed" else value / TO_SI[category]


def to_display(value: Column, category: str, preference: Preference | None = None, metres_a_second: bool = False) -> Column:
    if metres_a_second:
        return to_si(value, category)
    return apply_formula(F.lit(preference.formula), to_si(value, category)) if preference else value


def formatted(value: Column, category: str, preference: Preference | None = None, metres_a_second: bool = False) -> Column:
    """Text with its symbol: two places for m/s, one without preferences, else as the display format has."""
    if metres_a_second:
        places, symbol = 2, "m/s"
    elif preference is None:
        places, symbol = 1, SYMBOL[category]
    else:
        places, symbol = len(preference.display.partition(".")[2]), preference.symbol
    shown = to_display(value, category, preference, metres_a_second)
    return F.concat(F.format_string(f"%.{places}f", shown), F.lit(" " + symbol))


def from_display(value: Column, category: str, preference: Preference | None = None, metres_a_second: bool = False) -> Column:
    if metres_a_second:
        return value * KNOTS_FROM_SI
    return from_si(apply_formula(F.lit(preference.inverse), value), category) if preference else value
