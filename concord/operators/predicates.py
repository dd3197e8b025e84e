"""Structured filters as one Column, and keyset ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)), "like": lambda c, v: c.like(v), "not like": lambda c, v: ~c.like(v),
    "between": lambda c, v: c.between(*v), "is": lambda c, v: c.isNull() if v in (None, "not set") else c.isNotNull(),
}


def condition(name: str, op: str, value) -> Column:
    if (k := op.strip().lower()) not in OPS:
        raise ValueError(f"no operator: {op}")
    return OPS[k](F.col(name), value)


def as_triples(filters) -> list[tuple]:
    """{f: v}, {f: [op, v]} or [[f, op, v], ...] as triples."""
    if isinstance(filters, dict):
        return [(f, *v) if isinstance(v, (list, tuple)) and len(v) == 2 and str(v[0]).lower() in OPS else (f, "=", v) for f, v in filters.items()]
    return [tuple(t) for t in filters or ()]


def predicate(filters=None, any_of=None) -> Column:
    """All of filters, and at least one of any_of if there are any."""
    every = reduce(lambda a, b: a & b, [condition(*t) for t in as_triples(filters)], F.lit(True))
    some = [condition(*t) for t in as_triples(any_of)]
    return every & reduce(lambda a, b: a | b, some) if some else every


def after(keys: list[str], cursor: list) -> Column:
    """Rows after a cursor in the order of keys."""
    out = F.lit(False)
    for k in range(len(keys)):
        out = out | (reduce(lambda a, b: a & b, [F.col(n) == v for n, v in zip(keys[:k], cursor)], F.lit(True)) & (F.col(keys[k]) > cursor[k]))
    return out


def keyset_page(df: DataFrame, keys: list[str], size: int, cursor: list | None = None) -> DataFrame:
    """The next size rows by keys, and one more that tells whether another page follows."""
    return (df.where(after(keys, cursor)) if cursor else df).orderBy(*keys).limit(size + 1)


def keyset_faults(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that cannot be paged by: null ones and repeated ones, with their number of rows."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | null)
