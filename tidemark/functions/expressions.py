"""SQL expressions compared as Catalyst reads them, not as text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .casts import plain_type


def canonical(spark: SparkSession, columns: Mapping[str, str], texts: Iterable[str]) -> dict[str, str]:
    """A form of each text over ``columns`` (name to type): equal forms are the same expression.

    Spaces, case, parentheses, quoting and the order of commutative terms don't count. Forms of one call can be compared, those of
    different calls can't. Nothing is run. A text that can't be analysed keeps its words.
    """
    wanted = sorted(set(texts))
    # only columns with a plain type name can be declared; a text that uses others keeps its words too
    fields = []
    for name, kind in columns.items():
        try:
            fields.append(StructField(name, _parse_datatype_string(plain_type(kind))))
        except Exception:
            continue
    base = spark.createDataFrame([], StructType(fields))
    relation = base._jdf.queryExecution().analyzed()
    names = {str(relation.output().apply(i).exprId().id()): relation.output().apply(i).name().lower() for i in range(relation.output().size())}
    out = {}
    for text in wanted:
        try:
            plan = base.select(F.expr(text).alias("x"))._jdf.queryExecution().analyzed()
            tree = plan.projectList().apply(0).child().canonicalized().toString()
            out[text] = re.sub(r"none#(\d+)L?", lambda m: names.get(m[1], m[0]), tree)
        except Exception:
            out[text] = " ".join(re.findall(r"\w+|\S", text.lower()))
    return out
