"""Scalar functions of the dialect as Spark SQL text builders, shared by the SQL rewriter and the DataFrame API.

SCALARS maps an upper-case name to a callable from the arguments' SQL texts to SQL text. `fn` applies one to
Columns: fn("TRIM", "name").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import conditional, datetimes, hashing, jsons, maths, strings, vectors

SCALARS: dict = {}
for _family in (strings, maths, datetimes, conditional, jsons, hashing, vectors):
    SCALARS |= _family.FUNCTIONS


def fn(name: str, *args: str) -> Column:
    """A function of the dialect over SQL expressions: fn("SUBSTRING", "c_name", "0", "3")."""
    return F.expr(SCALARS[name.upper()](*args))
