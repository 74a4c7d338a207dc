"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns with built-in higher-order functions.

Everything here returns a Column and stays inside the JVM; no Python per row.
These are the right tool for vector widths up to a few hundred; wider
matrix work goes through the Arrow-batched helpers in ``operators.stats``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fdiv(a: ColumnOrName | float, b: ColumnOrName | float) -> Column:
    """Floating division with IEEE results for a zero divisor (x/0 = +-inf, 0/0 = NaN), as numpy
    and torch give, instead of an ANSI-mode error."""
    a = _c(a) if isinstance(a, (str, Column)) else F.lit(float(a))
    b = _c(b) if isinstance(b, (str, Column)) else F.lit(float(b))
    a, b = a.cast("double"), b.cast("double")
    return (F.when(b != 0, a / b)
            .when(F.isnan(a) | (a == 0), F.lit(float("nan")))
            .when(a > 0, F.lit(float("inf")))
            .otherwise(F.lit(float("-inf"))))


def to_double(v: ColumnOrName) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def vsum(v: ColumnOrName) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a: ColumnOrName, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def midpoint(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: (x + y) / 2.0)


def sq_norm(a: ColumnOrName) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(sq_norm(a))


def sq_dist(a: ColumnOrName, b: ColumnOrName) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def quad_form(rows: ColumnOrName, v: ColumnOrName) -> Column:
    """vᵀ M v for a matrix stored as an array of row arrays."""
    vv = _c(v)
    return vsum(F.zip_with(_c(rows), vv, lambda r, x: x * dot(r, vv)))


def mat_vec(rows: ColumnOrName, v: ColumnOrName) -> Column:
    vv = _c(v)
    return F.transform(_c(rows), lambda r: dot(r, vv))


def softmax(logits: ColumnOrName) -> Column:
    """Numerically stable softmax of an array column."""
    z = _c(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - m))
    total = vsum(e)
    return F.transform(e, lambda x: x / total)


def argmax(v: ColumnOrName) -> Column:
    """0-based index of the first maximum (ties: first wins)."""
    z = _c(v)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def odd_sum(v: ColumnOrName) -> Column:
    """Sum of entries at odd 0-based positions."""
    return vsum(F.filter(_c(v), lambda x, i: i % 2 == 1))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    return fdiv(dot(a, b), norm(a) * norm(b))


def round_array(v: ColumnOrName, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x, digits))


def explode_indexed(df, keys: list[str], vec: str, index: str = "i", value: str = "value"):
    """Long form (keys..., i, value) of an array column: for result checks and SQL parity."""
    return df.select(*keys, F.posexplode(vec).alias(index, value)).withColumn(index, F.col(index).cast("int"))
