"""A registry of queries over inputs that both engines derive from the tables by one statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derive import table


def _input(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf, t) for t in set(re.findall(r"{(\w+)}", text))})


def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """(queries, oracles, decorator). ``@query(sql, name=statement)``: ``{table}`` in a statement is a table; in ``sql`` inputs are tables of their names."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, **inputs: str):
        def add(f):
            def run(spark: SparkSession, sf: str) -> DataFrame:
                return f(**{name: _input(spark, sf, text) for name, text in inputs.items()})

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = run
            if sql:
                recursive = " recursive" if "recursive " in sql else ""
                parts = [f"{name} as ({re.sub(r'{(\w+)}', r'\1', text).replace(chr(96), chr(34))})" for name, text in inputs.items()]
                oracles[f.__name__] = f"with{recursive} " + ", ".join(parts) + " " + sql.replace("recursive ", "")
            return f

        return add

    return queries, oracles, query
