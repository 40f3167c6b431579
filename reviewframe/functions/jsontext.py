"""JSON text that must be complete: one value and nothing after it.

Spark's reader stops after the first value of a text. Inside a wrapper object anything left over
breaks the syntax, so a wrapped parse accepts exactly the texts a strict reader accepts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt"}


def _wrapped(text: Column, schema: str) -> Column:
    return F.from_json(F.concat(F.lit('{"v":['), text, F.lit("]}")), schema, _OPTIONS)


def parse_record(text: Column, fields: str) -> Column:
    """STRUCT<v ARRAY<STRUCT<fields>>, _corrupt>; see ``record_of`` and ``is_broken``."""
    return _wrapped(text, f"v ARRAY<STRUCT<{fields}>>, _corrupt STRING")


def record_of(parsed: Column) -> Column:
    return F.get(parsed["v"], F.lit(0))


def is_broken(parsed: Column) -> Column:
    return (parsed.isNull() | parsed["_corrupt"].isNotNull()
            | (F.coalesce(F.size(parsed["v"]), F.lit(0)) != 1) | record_of(parsed).isNull())


def whole_value(text: Column) -> Column:
    """The text of one complete JSON list or object, else null."""
    values = _wrapped(text, "v ARRAY<STRING>")["v"]
    return F.when((text.startswith("[") | text.startswith("{")) & (F.size(values) == 1),
                  F.get(values, F.lit(0)))


def parse_list(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, _OPTIONS)
