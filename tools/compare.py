"""Spark vs DuckDB result comparison shared by tools/oracle_check.py and the
pytest parity test: column names, type families, row counts, values."""

from __future__ import annotations

import math

_SPARK_FAMILY = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "FloatType": "FLOAT",
                 "StringType": "VARCHAR", "BooleanType": "BOOLEAN", "ShortType": "SMALLINT", "ByteType": "TINYINT",
                 "TimestampNTZType": "TIMESTAMP", "TimestampType": "TIMESTAMP WITH TIME ZONE", "DateType": "DATE"}


def spark_family(dt) -> str:
    name = type(dt).__name__
    if name == "DecimalType":
        return f"DECIMAL({dt.precision},{dt.scale})"
    if name == "ArrayType":
        return f"LIST<{spark_family(dt.elementType)}>"
    return _SPARK_FAMILY.get(name, name)


def duck_family(t) -> str:
    t = str(t).upper().replace(" ", "")
    if t.endswith("[]"):
        return f"LIST<{duck_family(t[:-2])}>"
    return t.replace("TIMESTAMPWITHTIMEZONE", "TIMESTAMP WITH TIME ZONE")


def type_differences(spark_schema, duck_description) -> dict:
    s = {f.name: spark_family(f.dataType) for f in spark_schema.fields}
    d = {x[0]: duck_family(x[1]) for x in duck_description}
    return {c: (s[c], d.get(c)) for c in s if s[c] != d.get(c)}


def _key(v):
    """Sort key: floats rounded so both sides order rows alike."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_key(x) for x in v])
    return repr(v)


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        fa, fb = float(a), float(b)
        if math.isnan(fa) or math.isnan(fb):
            return math.isnan(fa) and math.isnan(fb)
        return math.isclose(fa, fb, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    return a == b and type(a) is type(b) or (a is None and b is None)


def _ordered(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(r[i].tolist() if hasattr(r[i], "tolist") else r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: [_key(v) for v in r])


def compare_rows(spark_cols, spark_rows, duck_cols, duck_rows) -> str | None:
    """None when equal; otherwise a short description of the first difference."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns spark={sorted(spark_cols)} duck={sorted(duck_cols)}"
    a, b = _ordered(spark_cols, spark_rows), _ordered(duck_cols, duck_rows)
    if len(a) != len(b):
        return f"rows spark={len(a)} duck={len(b)}"
    diffs = [(x, y) for x, y in zip(a, b) if not all(_same(u, v) for u, v in zip(x, y))]
    if diffs:
        return f"values differ ({len(diffs)} rows), e.g. {diffs[:2]}"
    return None
