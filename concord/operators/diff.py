"""Field-level differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_diff

CHANGES = "array<struct<field: string, old: string, new: string>>"


def field_changes(new: dict[str, Column], old: dict[str, Column], kinds: dict[str, str] | None = None, exclude: tuple[str, ...] = (), rename: dict[str, str] | None = None) -> Column:
    """[(field, old, new)] of the fields of new that differ from old in normal form; values as text, names as rename has them.

    Normal forms are made only where the plain texts differ, which most fields of most records do not.
    """
    kinds, rename = kinds or {}, rename or {}
    fields = [f for f in new if f not in exclude]
    if not fields:
        return F.array().cast(CHANGES)

    def text(v: Column, kind: str) -> Column:
        """A value as what norm_diff makes of it depends on."""
        if kind.startswith(("array", "struct", "map")):
            return F.concat(F.lit("j:"), F.to_json(v))
        return (v.cast("int") if kind == "boolean" else v).cast("string")

    def row(f: str) -> Column:
        kind = kinds.get(f, "string")
        return F.struct(F.lit(rename.get(f, f)).alias("field"), old[f].cast("string").alias("old"), new[f].cast("string").alias("new"), text(old[f], kind).alias("a"), text(new[f], kind).alias("b"))

    def changed(c: Column) -> Column:
        forms = F.transform(F.array(c["a"], c["b"]), lambda v: norm_diff(v))
        return F.when(c["a"].eqNullSafe(c["b"]), F.lit(False)).otherwise(~F.get(forms, F.lit(0)).eqNullSafe(F.get(forms, F.lit(1))))

    # one expression for all fields: the plan does not grow with what norm_diff has to try
    return F.transform(F.filter(F.array(*[row(f) for f in fields]), changed), lambda c: F.struct(c["field"], c["old"], c["new"])).cast(CHANGES)


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are costly and asked often, made once for each row: they pass a generator, beyond which no filter on them and no later column is folded into them."""
    made = df.withColumns({f"_{name}": c for name, c in columns.items()})
    return made.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(F.struct(*[F.col(f"_{name}").alias(name) for name in columns]))))
