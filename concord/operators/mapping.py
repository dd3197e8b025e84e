"""Projections between the two sides: names, values, zones, nested paths and computed columns."""

from __future__ import annotations

from decimal import Context, Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import WHOLE, norm_key, norm_number, shift_zone, trimmed, trimmed_key
from ..plans.spec import Definition, Fallback


def read_path(df: DataFrame, path: str) -> Column:
    """A column, or table.N.field of a list of rows (N from 1; null if it is short)."""
    parts = path.split(".")
    return F.try_element_at(F.col(parts[0]), F.lit(int(parts[1])))[parts[2]] if len(parts) == 3 else F.col(path)


def number_text(value: str) -> str | None:
    """norm_number of a literal."""
    try:
        n = Decimal(value.strip())
    except InvalidOperation:
        return None
    return format(n.normalize(Context(prec=200)), "f") if n.is_finite() else None


def map_value(v: Column, pairs: list[tuple[str | None, str | None]], fallback: Fallback | None = None) -> Column:
    """The value that pairs map v to: an exact hit, else one of equal number; null can be mapped either way.

    A hit may map to null, so whether there is one is asked apart from what it gives.
    """
    text = v.cast("string")
    literal = lambda x: F.lit(x).cast("string")
    rest = {"keep": text, "constant": literal(fallback.value if fallback else None), "null": literal(None)}[fallback.action if fallback else "keep"]
    exact = {a: b for a, b in pairs if a is not None}
    numbers = {n: b for a, b in reversed(pairs) if a is not None and (n := number_text(a)) is not None}
    for key, known in ((norm_number(v), numbers), (text, exact)):
        if known:
            table = F.create_map(*[literal(x) for kv in known.items() for x in kv])
            rest = F.when(F.coalesce(key.isin(*known), F.lit(False)), F.try_element_at(table, key)).otherwise(rest)
    null = [b for a, b in pairs if a is None]
    return F.when(v.isNull(), literal(null[0])).otherwise(rest) if null else rest


def reverse_pairs(pairs) -> list[tuple[str | None, str | None]]:
    """Remote to local; of several local values for one remote value the last wins."""
    return list({b: (b, a) for a, b in pairs}.values())


def project(df: DataFrame, d: Definition, way: str, keep: list[str | Column] = ()) -> DataFrame:
    """push: local rows as remote columns; pull: remote rows as local columns. Columns in keep come along."""
    cols = []
    for m in d.mapped(way):
        source, target = (m.local, m.remote) if way == "push" else (m.remote, m.local)
        v = read_path(df, source)
        pairs, fallback = d.value_map.get(m.local), d.fallbacks.get(m.local)
        if pairs or fallback:
            v = map_value(v, list(pairs or ()) if way == "push" else reverse_pairs(pairs or ()), fallback)
        if m.local in d.datetime_fields:
            v = shift_zone(v, *((d.local_zone, d.remote_zone) if way == "push" else (d.remote_zone, d.local_zone)))
        cols.append(v.alias(target))
    return df.select(*keep, *cols)


def write_paths(df: DataFrame, table: str) -> DataFrame:
    """Columns called table.N.field folded into one list of rows, built up to the largest N."""
    paths = [(c, *c.split(".")[1:]) for c in df.columns if c.startswith(f"{table}.") and c.count(".") == 2]
    fields = list(dict.fromkeys(p[2] for p in paths))
    have = {(int(n), f): F.col(f"`{c}`") for c, n, f in paths}
    rows = [F.struct(*[have.get((n, f), F.lit(None).cast("string")).cast("string").alias(f) for f in fields]) for n in range(1, max(int(p[1]) for p in paths) + 1)]
    return df.withColumn(table, F.array(*rows)).drop(*[p[0] for p in paths])


def computed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """SQL expressions added one after the other; later ones may use earlier ones, and an unknown column is an error."""
    for name, sql in columns:
        df = df.withColumn(name, F.expr(sql))
    return df


def stamp_remote(df: DataFrame, d: Definition, modified: Column, creation: Column, is_create: Column) -> DataFrame:
    """modified always, creation only where the row is new; both in the remote zone."""
    out = {d.remote_modified: shift_zone(modified, d.local_zone, d.remote_zone)}
    if d.remote_creation:
        out[d.remote_creation] = F.when(is_create, shift_zone(creation, d.local_zone, d.remote_zone))
    return df.withColumns(out)


def stamp_local(df: DataFrame, d: Definition, modified: Column) -> DataFrame:
    out = df.withColumn(d.local_modified, shift_zone(modified, d.remote_zone, d.local_zone))
    return out.drop(d.local_creation) if d.local_creation else out


def key_parts(df: DataFrame, names: list[str]) -> Column:
    kinds = dict(df.dtypes)
    if all(kinds.get(n) in WHOLE for n in names):
        return F.array(*[norm_key(F.col(n), kinds[n]) for n in names])
    # one expression for all parts; each is trimmed once
    texts = F.array(*[trimmed(F.col(n).cast("int") if kinds.get(n) == "boolean" else F.col(n)) for n in names])
    return F.transform(texts, lambda t: trimmed_key(t))
