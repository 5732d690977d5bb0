"""Arrow functions over columns that leave all other columns in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType


def scan(f, schema: str, *args):
    """``f(*args, arrays)`` over batches of a column, evaluated once per row."""
    return F.arrow_udf(functools.partial(f, *args), schema, ArrowUDFType.SCALAR_ITER).asNondeterministic()


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
