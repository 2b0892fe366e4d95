"""Scalar functions over numbers, times and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a unit of length.
METRES = {"km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "um": 1e-6, "nm": 1e-9}


def convert_length(value: Column, unit: str, to: str) -> Column:
    """An unknown unit raises ValueError."""
    if unit not in METRES or to not in METRES:
        raise ValueError(f"no conversion from {unit!r} to {to!r}")
    return value * METRES[unit] / METRES[to]


#: How many of the second unit one of the first is.
FACTORS = {("mile", "km"): 1.609344, ("inch", "cm"): 2.54, ("foot", "m"): 0.3048, ("yard", "m"): 0.9144, ("pound", "kg"): 0.45359237, ("ounce", "g"): 28.349523125, ("gallon", "litre"): 3.785411784}


def convert(value: Column, unit: str, to: str) -> Column:
    """Lengths, imperial units and temperatures; an unknown pair raises ValueError."""
    if (unit, to) in FACTORS:
        return value * FACTORS[unit, to]
    if (to, unit) in FACTORS:
        return value / FACTORS[to, unit]
    if (unit, to) == ("celsius", "fahrenheit"):
        return value * 9.0 / 5 + 32
    if (unit, to) == ("fahrenheit", "celsius"):
        return (value - 32) * 5.0 / 9
    return convert_length(value, unit, to)


def success_rate(success: Column, usage: Column) -> Column:
    """0 where a memory was never used."""
    return F.coalesce(F.try_divide(success.cast("double"), usage), F.lit(0.0))


def importance(sorting: Column, keywords: Column, recorded: Column, w: tuple[float, float, float]) -> Column:
    """w0 sorting + w1 min(keywords w1, 5) + w2 min(recorded w2, 2): the weights of the last two count twice."""
    return w[0] * sorting + w[1] * F.least(keywords * w[1], F.lit(5.0)) + w[2] * F.least(recorded * w[2], F.lit(2.0))


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def ordered_subsequence(a: Column, b: Column) -> Column:
    """Whether all of ``a`` occurs in ``b`` in order, with anything between."""
    at = F.aggregate(b, F.lit(0), lambda i, x: F.when((i < F.size(a)) & (F.get(a, i) == x), i + 1).otherwise(i))
    return at == F.size(a)


#: How much of a currency one US dollar is.
RATES = {"RMB": 7.0, "EUR": 0.8, "JPY": 110.0, "GBP": 0.7, "CAD": 1.3, "AUD": 1.4, "INR": 70.0, "RUB": 60.0, "BRL": 3.8, "MXN": 20.0}


def exchanged(value: Column, base: Column, target: Column) -> Column:
    """From dollars as it is, into dollars rounded to cents; null for any other pair."""
    rate = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(base == "USD", value * F.try_element_at(rate, target)).when(target == "USD", F.round(value / F.try_element_at(rate, base), 2))


#: Pieces of the marks for the shape of a tree: up to which value (included, or not, where so noted), slope, what is added, the least.
SHAPE = {
    "density": [(0.2, False, 25.0, 0.0, 0.0), (0.6, True, 0.0, 10.0, 0.0), (None, True, -20.0, 22.0, 5.0)],
    "leaf_ratio": [(0.3, False, 20.0, 0.0, 0.0), (0.7, True, 0.0, 10.0, 0.0), (None, True, -20.0, 24.0, 3.0)],
    "depth": [(3, False, 3.0, 0.0, 0.0), (8, True, 0.0, 15.0, 0.0), (None, True, -1.5, 27.0, 5.0)],
    "chain": [(2, True, 0.0, 10.0, 0.0), (5, True, -1.0, 10.0, 0.0), (None, True, -0.5, 5.5, 0.0)],
}


def in_pieces(x: Column, pieces: list[tuple]) -> Column:
    """The piecewise linear function of such a table."""
    out = None
    for upto, included, slope, added, least in reversed(pieces):
        y = F.greatest(F.lit(least), slope * x + added)
        out = y if upto is None else F.when(x <= upto if included else x < upto, y).otherwise(out)
    return out


def tree_quality(depth: Column, leaves: Column, nodes: Column, branches: Column, chain: Column, widest: Column) -> Column:
    """Marks for the shape of a tree: 0.35 for branches, 0.25 for leaves, 0.25 for depth and width, 0.15 for no long chain; less where it is almost one chain or hardly branches."""
    density, thin = branches / nodes, depth / F.greatest(widest, F.lit(1))
    balance = in_pieces(depth, SHAPE["depth"]) + F.least(widest * 1.5, F.lit(15.0)) - F.when(thin > 3, 2 * (thin - 3)).otherwise(0.0)
    total = (
        0.35 * (F.least(branches * 3, F.lit(15)) + in_pieces(density, SHAPE["density"])) + 0.25 * (F.least(leaves * 2, F.lit(20)) + in_pieces(leaves / nodes, SHAPE["leaf_ratio"]))
        + 0.25 * F.greatest(F.lit(0.0), balance) + 0.15 * in_pieces(chain, SHAPE["chain"])
    )
    factor = F.when(chain > 0.8 * nodes, 0.3).when((density < 0.1) & (nodes > 5), 0.5).otherwise(1.0)
    return F.when(nodes <= 1, F.lit(0.1)).otherwise(total * factor)
