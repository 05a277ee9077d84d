"""Numbers: reading them, rounding them, adding them and their squares up exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums are kept in whole units of this many decimals.
PLACES = 8
# Bits of the low part of a whole number that is summed in two parts.
LOW_BITS = 20
# Parts of a summed number.
PARTS = ("high", "low", "fraction")


def finite(value: Column) -> Column:
    """A double with NaN and the infinities turned into NULL."""
    x = value.cast("double")
    # NaN compares as greater than every number.
    return F.when(F.abs(x) < float("inf"), x)


def number_from_text(text: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is NULL."""
    # The cast also takes Java literals such as 12d, 12f and 0x1p3.
    plain = ~text.rlike("[dDfFxX]")
    return F.when(plain, finite(text.try_cast("double")))


def half_even(value: Column, places: int) -> Column:
    """Round by scaling, rounding half to even, and scaling back."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def exact_parts(column: str, places: int, name: str) -> list[str]:
    """SQL of a double as three whole numbers: two of its whole part, one of its fraction.

    Whole numbers add up to the same sum in any order, and long additions stay
    in generated code, which decimal ones do not. The whole part is taken before
    anything is multiplied, so every double below 2^63 has its parts; each part
    has room for 10^10 rows and more, and beyond that the sum is an error, not a
    wrong value. A value that has more than ``places`` decimals, beyond what its
    own precision as a double explains, is an error as well: it is never cut.
    """
    if not 0 <= places <= PLACES:
        raise ValueError(f"Sums carry 0 to {PLACES} decimals, not {places}")
    x = f"`{column}`"
    whole = f"double(floor({x}))"
    scaled = f"(({x} - {whole}) * {10**places}D)"
    high = f"floor({x} / {1 << LOW_BITS}D)"
    off = f"abs({scaled} - rint({scaled})) > 0.01D + abs({x}) * {10**places * 2.0**-50!r}D"
    message = f"concat('{column} has more than {places} decimals: ', {x})"
    return [
        f"{high} AS {name}_high",
        f"bigint({whole} - {high} * {1 << LOW_BITS}D) AS {name}_low",
        f"IF({off}, bigint(raise_error({message})), bigint(rint({scaled})) * {10 ** (PLACES - places)}L) "
        f"AS {name}_fraction",
    ]


def exact_sum(name: str) -> Column:
    """Sum of a number kept in parts, as a decimal; NULL over no values."""
    high, low, fraction = (f"sum({name}_{part})" for part in PARTS)
    return F.expr(
        f"({high} * {1 << LOW_BITS}BD + {low}) + {fraction} * {10**-PLACES:.{PLACES}f}BD"
    )


def exact_total(name: str) -> Column:
    """The same as a double; 0 over no values."""
    return F.coalesce(exact_sum(name).cast("double"), F.lit(0.0))


def exact_mean(name: str, n: str) -> Column:
    """The sum divided by a summed count, as a double; NULL over no values."""
    return F.try_divide(exact_sum(name).cast("double"), F.sum(n).cast("double"))


# --- mean and deviation ------------------------------------------------------

# Bits of the parts in which numbers and products are summed, and of half a number.
LIMB, HALF = 21, 31


def _limbs(number: str, name: str) -> list[str]:
    """SQL of a long as three whole numbers; the first has its sign."""
    mask = (1 << LIMB) - 1
    return [
        f"shiftright({number}, {2 * LIMB}) AS {name}_2",
        f"shiftright({number}, {LIMB}) & {mask}L AS {name}_1",
        f"{number} & {mask}L AS {name}_0",
    ]


def moment_parts(column: str, places: int, name: str) -> list[list[str]]:
    """SQL of what the exact sums of a double and of its square are added up from.

    Two lists, to be selected one after the other. The value is taken in whole
    units of ``places`` decimals; more decimals are rounded away. Half products
    fit a long, and so do their sums: parts of 21 bits leave room for 2^42 rows.
    Values of 2^62 units or more are an error.
    """
    scaled = f"rint(double(`{column}`) * {10**places}D)"
    message = f"concat('{column} is too large for {places} decimals: ', `{column}`)"
    units = f"IF(abs({scaled}) >= {2.0**62!r}D, bigint(raise_error({message})), bigint({scaled}))"
    high, low = f"shiftright(abs({name}_x), {HALF})", f"(abs({name}_x) & {(1 << HALF) - 1}L)"
    parts = _limbs(f"{name}_x", f"{name}_s")
    for kind, product in (("hh", f"({high} * {high})"), ("hl", f"({high} * {low})"), ("ll", f"({low} * {low})")):
        parts += _limbs(product, f"{name}_{kind}")
    return [[f"{units} AS {name}_x"], [f"{name}_x", *parts]]


def moment_sums(name: str) -> list[Column]:
    """The aggregates of these parts."""
    kinds = [f"{name}_{kind}_{n}" for kind in ("s", "hh", "hl", "ll") for n in (2, 1, 0)]
    return [F.count(f"{name}_x").alias(f"{name}_n"), *[F.sum(kind).alias(kind) for kind in kinds]]


def mean_and_deviation(name: str, places: int) -> tuple[str, str, list[str]]:
    """SQL of the mean and of the sample standard deviation from summed parts.

    The last list is to be selected before them, each over what went before: the
    sums as whole numbers, then the sums of differences from a whole number next
    to the mean. All is exact up to the last divisions, so the order of rows and
    their partitioning change no digit, and values far from zero lose none.
    """
    def whole(kind: str) -> str:
        return " + ".join(
            f"CAST({name}_{kind}_{n} AS DECIMAL(20, 0)) * CAST('{1 << (LIMB * n)}' AS DECIMAL(38, 0))" for n in (2, 1, 0)
        )

    def power(bits: int) -> str:
        return f"CAST('{1 << bits}' AS DECIMAL(38, 0))"

    def sure(value: str, what: str) -> str:
        # Without ANSI mode, too many digits are NULL.
        error = f"CAST(raise_error('{what} has more than 38 digits') AS DECIMAL(38, 0))"
        return f"IF({name}_n > 0 AND ({value}) IS NULL, {error}, {value})"

    squares = f"({whole('hh')}) * {power(2 * HALF)} + ({whole('hl')}) * {power(HALF + 1)} + ({whole('ll')})"
    near = f"CAST({name}_near AS DECIMAL(20, 0))"
    steps = [
        f"{sure(whole('s'), 'A sum')} AS {name}_sum", f"{sure(squares, 'A sum of squares')} AS {name}_squares",
        f"IF({name}_n > 0, {name}_sum div {name}_n, 0L) AS {name}_near",
        f"{name}_sum - CAST({name}_n AS DECIMAL(20, 0)) * {near} AS {name}_off",
        sure(
            f"{name}_squares - 2 * {near} * {name}_sum + CAST({name}_n AS DECIMAL(20, 0)) * {near} * {near}", "A sum of squares"
        ) + f" AS {name}_spread",
    ]
    n, off, spread = f"double({name}_n)", f"double({name}_off)", f"double({name}_spread)"
    unit = f"{10.0**places!r}D"
    mean = f"IF({name}_n > 0, (double({name}_near) + {off} / {n}) / {unit}, NULL)"
    deviation = f"IF({name}_n > 1, sqrt(greatest({spread} - {off} * {off} / {n}, 0D) / ({n} - 1)) / {unit}, NULL)"
    return mean, deviation, steps
