"""Delimited text to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidestream.fields import Schema

REJECT = "_rejected"


def parse_csv(lines: DataFrame, schema: Schema, value: str = "value", delimiter: str = ",") -> DataFrame:
    """One column for each field, by position, and ``_rejected``: the line where a field is missing, extra or no number, else null.

    Other columns of ``lines`` stay. Signs, exponents and white space around numbers are accepted.
    """
    line = F.col(value)
    cells = F.split(line, f"\\Q{delimiter}\\E", -1)
    split = lines.withColumn("_cells", cells)
    typed = [F.get("_cells", F.lit(k)) if f.type == "string" else F.trim(F.get("_cells", F.lit(k))).try_cast(f.spark_type) for k, f in enumerate(schema)]
    bad = F.size("_cells") != len(schema)
    for c in typed:
        bad = bad | c.isNull()
    kept = [c for c in lines.columns if c != value]
    return split.select(*kept, *[c.alias(f.column) for c, f in zip(typed, schema)], F.when(F.coalesce(bad, F.lit(True)), F.coalesce(line, F.lit(""))).alias(REJECT))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REJECT).isNull()).drop(REJECT)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REJECT).isNotNull()).select(REJECT)
