"""Row transforms on arrays of doubles, all as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x / norm(a)).otherwise(x))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def safelog(a: Column, least: float = 1e-10) -> Column:
    return F.transform(a, lambda x: F.log(F.greatest(x, F.lit(least))))


def dct(a: Column, n: int) -> Column:
    """DCT of the first kind of n values, over n - 1."""
    rows = [[(1.0 if i == 0 else (-1.0) ** j if i == n - 1 else 2 * math.cos(math.pi * i * j / (n - 1))) / (n - 1) for i in range(n)] for j in range(n)]
    return F.array(*[dot(a, F.array(*map(F.lit, r))) for r in rows])


def lna8(a: Column) -> Column:
    """8-bit log probabilities."""
    return F.transform(a, lambda x: F.least(F.greatest(F.floor(-24 * F.log(x + 1e-37)), F.lit(0)), F.lit(255)))


def lna8_back(a: Column) -> Column:
    return F.transform(a, lambda x: F.exp(-(x + 0.5) / 24))


def one_hot(label: Column, n: int, low: float = 0.0, high: float = 1.0) -> Column:
    """1 at the label's place among n; a label that isn't one of them is an error, null stays null."""
    coded = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, high).otherwise(low))
    wrong = F.raise_error(F.concat(F.lit("label out of range: "), label.cast("string"))).cast("array<double>")
    return F.when(label.isNull(), F.lit(None).cast("array<double>")).when(label.between(0, n - 1), coded).otherwise(wrong)


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(p: Column) -> Column:
    """In bits; zero probabilities add nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def margin(p: Column) -> Column:
    """Largest value minus the second."""
    s = F.sort_array(p, asc=False)
    return F.get(s, 0) - F.get(s, 1)


def kl(p: Column, q: Column, least: float = 1e-10) -> Column:
    """Relative entropy in bits, with values floored."""
    floor = lambda x: F.greatest(x, F.lit(least))
    return total(F.zip_with(p, q, lambda x, y: floor(x) * F.log2(floor(x) / floor(y))))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


# Vector algebra on arrays of equal length.


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, x / F.when(y != 0, y)))


def multiply_add(s: Column, a: Column, b: Column) -> Column:
    return add(s, multiply(a, b))


def negative(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def square(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def root(a: Column) -> Column:
    """Null below 0."""
    return F.transform(a, lambda x: F.when(x >= 0, F.sqrt(F.abs(x))))


def reciprocal(a: Column) -> Column:
    """Null for 0."""
    return F.transform(a, lambda x: F.when(x != 0, 1 / F.when(x != 0, x)))


def larger(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def smaller(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def affine(a: Column, bias: list[float], scale: list[float]) -> Column:
    """(a + bias) * scale."""
    return F.zip_with(F.zip_with(a, F.array(*map(F.lit, bias)), lambda x, b: x + b), F.array(*map(F.lit, scale)), lambda x, k: x * k)


def transposed(rows: Column, width: int) -> Column:
    """An array of rows as an array of columns."""
    column = lambda j: F.transform(rows, lambda r: F.get(r, j))
    return F.array(*map(column, range(width)))


def matrix_times(matrix: list[list[float]], a: Column) -> Column:
    return F.array(*[dot(a, F.array(*map(F.lit, r))) for r in matrix])


# Signals.


def decibel(a: Column, least: float = 1e-10) -> Column:
    return F.transform(a, lambda x: 20 * F.log10(F.greatest(F.abs(x), F.lit(least))))


def difference(a: Column) -> Column:
    """Each value less the one before; the first as it is."""
    return F.transform(a, lambda x, i: x - F.coalesce(F.get(a, i - 1), F.lit(0.0)))


def hanning(a: Column) -> Column:
    """Weighted by a raised cosine over the array's length."""
    return F.transform(a, lambda x, i: x * (0.5 - 0.5 * F.cos(2 * math.pi * i / (F.size(a) - 1))))


def compressed(a: Column, j: float) -> Column:
    """ln(1 + j x): nearly linear for small values, logarithmic for large ones."""
    return F.transform(a, lambda x: F.log(1 + j * x))


def expanded(a: Column, j: float) -> Column:
    """The inverse of `compressed`."""
    return F.transform(a, lambda x: (F.exp(x) - 1) / j)


def loudness(bands: Column, hertz: list[float]) -> Column:
    """Equal-loudness weights of bands by their centre frequency, then the cube root; edge bands repeat their neighbours."""
    def weight(f: float) -> float:
        s = f * f
        return (s / (s + 1.6e5)) ** 2 * (s + 1.44e6) / (s + 9.61e6)

    heard = F.zip_with(bands, F.array(*[F.lit(weight(f)) for f in hertz]), lambda x, w: F.pow(x * w, F.lit(0.33)))
    n = len(hertz)
    return F.transform(heard, lambda x, i: F.when(i == 0, F.get(heard, 1)).when(i == n - 1, F.get(heard, n - 2)).otherwise(x))


# Distances.


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def symmetric_kl(p: Column, q: Column, least: float = 1e-10) -> Column:
    """Half of both relative entropies, in bits, with values floored."""
    return (kl(p, q, least) + kl(q, p, least)) / 2


def log_product(p: Column, q: Column, least: float = 1e-10) -> Column:
    """-ln of the dot product, floored."""
    return -F.log(F.greatest(dot(p, q), F.lit(least)))


def inverse_entropy(p: Column) -> Column:
    """Null for a certain distribution."""
    return 1 / F.when(entropy(p) != 0, entropy(p))


def sigmoid_slope(y: Column) -> Column:
    """Derivative of the logistic function by its own values y."""
    return F.transform(y, lambda v: v * (1 - v))


def tanh_slope(y: Column) -> Column:
    """Derivative of the hyperbolic tangent by its own values y."""
    return F.transform(y, lambda v: 1 - v * v)


def softmax_slope(p: Column, d: Column) -> Column:
    """What a softmax p hands back of the slopes d of its outputs: p * (d - sum of p * d)."""
    once = F.array(F.struct(p.alias("p"), dot(p, d).alias("whole")))
    return F.get(F.transform(once, lambda z: F.zip_with(z["p"], d, lambda v, e: v * (e - z["whole"]))), F.lit(0))
