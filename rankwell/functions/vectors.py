"""Vector expressions on array columns; all evaluate inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.functions.core import let


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of different length fail the job."""
    product = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    mismatch = F.raise_error(
        F.concat(F.lit("vector dimension mismatch: "), F.size(a).cast("string"), F.lit(" vs "), F.size(b).cast("string"))
    ).cast("double")
    return F.when(F.size(a) != F.size(b), mismatch).otherwise(product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of ``v`` in double precision; a zero vector stays as it is."""
    doubles = v.cast("array<double>")
    return let(
        F.struct(doubles.alias("v"), norm(v).alias("n")),
        lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])).otherwise(p["v"]),
    )
