"""Scalar helpers as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def smoothstep(x: Column) -> Column:
    return clip(x) * clip(x) * (3 - 2 * clip(x))


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def huber(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, x * x / 2).otherwise(F.abs(x) - 0.5)


def linear_kernel(distance: Column, radius: float) -> Column:
    """1 at no distance, 0 from ``radius`` on."""
    return clip(1 - F.abs(distance) / radius)


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def letters(n: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for 1, 2, ...; up to four letters, null outside."""
    digits, out, rest = [], F.lit(""), n.cast("long")
    for _ in range(4):
        digits.append(F.when(rest > 0, F.char(65 + F.pmod(rest - 1, F.lit(26)).cast("int"))).otherwise(""))
        rest = F.floor((rest - 1) / 26)
    out = F.concat(*reversed(digits))
    return F.when((n > 0) & (n <= 26 + 26**2 + 26**3 + 26**4), out)


def note_name(pitch: Column) -> Column:
    """Name and octave of a pitch number, 60 being C4."""
    names = F.array(*[F.lit(x) for x in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")])
    return F.concat(F.element_at(names, (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, rounded from its exact binary value as C and SQL print it.

    ``format_string`` rounds the shortest decimal that reads back as the double, half up.
    """

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return text(x.cast("double"))
