"""Tail probabilities for the drift tests, as expressions over per-feature result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond so many degrees the Wilson-Hilferty approximation is used; its error is below 1e-6 there.
MOST_DEGREES = 4_000_000


def kolmogorov_tail(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value of a Kolmogorov-Smirnov distance."""
    n, m = n.cast("double"), m.cast("double")
    lam2 = statistic * statistic * n * m / (n + m)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam2),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    # The alternating series does not converge near zero, where the probability is 1 to all digits.
    return F.when(lam2 < F.lit(0.01), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series sixteen places further, and the recurrence back."""
    far = z + 16.0
    series = (far - 0.5) * F.ln(far) - far + F.lit(0.9189385332046727) + 1.0 / (12.0 * far)
    series = series - 1.0 / (360.0 * far * far * far) + 1.0 / (1260.0 * F.pow(far, F.lit(5.0)))
    series = series - 1.0 / (1680.0 * F.pow(far, F.lit(7.0)))
    back = sum((F.ln(z + float(i)) for i in range(1, 16)), F.ln(z))
    return series - back


def _lower_series(a: Column, x: Column, steps: Column) -> Column:
    """Sum of x^i / ((a + 1) ... (a + i)), which falls fast for x < a + 1."""
    seed = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * x / (a + i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), steps), seed, step)["total"]


def _upper_fraction(a: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the upper incomplete gamma function over x^a e^-x, for x >= a + 1, from the inside out."""

    def step(below: Column, i: Column) -> Column:
        k = (steps + 1 - i).cast("double")
        return x + 2.0 * k - 1.0 - a - k * (k - a) / below

    inner = F.aggregate(F.sequence(F.lit(1), steps), x + 2.0 * steps.cast("double") + 1.0 - a, step)
    return 1.0 / inner


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """Upper tail of the chi-square distribution, in [0, 1]; NULL without degrees of freedom.

    Computed in logarithms, with a number of steps that grows with the root of the degrees, so neither large statistics
    nor large degrees lose the result.
    """
    a, x = degrees.cast("double") / 2.0, statistic.cast("double") / 2.0
    steps = (F.lit(80) + F.ceil(F.lit(10.0) * F.sqrt(F.least(a, F.lit(MOST_DEGREES / 2))))).cast("int")
    scale = a * F.ln(x) - x
    lower = F.exp(scale - _log_gamma(a + 1.0)) * _lower_series(a, x, steps)
    upper = F.exp(scale - _log_gamma(a)) * _upper_fraction(a, x, steps)
    share = 2.0 / (9.0 * degrees.cast("double"))
    deviate = (F.pow(statistic / degrees, F.lit(1.0 / 3.0)) - (1.0 - share)) / F.sqrt(share)
    half, small = F.lit(0.5), F.lit(80)
    normal_x = deviate * deviate / 2.0
    normal = F.when(
        normal_x < 1.5, 1.0 - F.exp(half * F.ln(normal_x) - normal_x - _log_gamma(F.lit(1.5))) * _lower_series(half, normal_x, small)
    ).otherwise(F.exp(half * F.ln(normal_x) - normal_x - _log_gamma(half)) * _upper_fraction(half, normal_x, small))
    normal = F.when(deviate == 0, F.lit(0.5)).when(deviate > 0, normal / 2.0).otherwise(1.0 - normal / 2.0)
    tail = (
        F.when(x <= 0, F.lit(1.0))
        .when(degrees > MOST_DEGREES, normal)
        .when(x < a + 1.0, 1.0 - lower)
        .otherwise(upper)
    )
    return F.when(degrees >= 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail: the square of z is chi-square with one degree of freedom."""
    return chi_square_tail(z * z, F.lit(1))
