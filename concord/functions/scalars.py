"""Normal forms that decide when keys and values are equal, and other scalar functions. All are Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
EXPONENT = r"^[+-]?(\d+(\.\d*)?|\.\d+)[eE][+-]?\d+$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
AWARE = r"(Z|[+-]\d{2}:?\d{2})$"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def trimmed(v: Column) -> Column:
    """The text of v without white space at the ends."""
    return F.regexp_replace(v.cast("string"), r"^\s+|\s+$", "")


def clean_string(v: Column) -> Column:
    """Without white space at the ends; blank is null."""
    return F.nullif(trimmed(v), F.lit(""))


def first_non_blank(*vs: Column) -> Column:
    return F.coalesce(*map(clean_string, vs))


def as_bool(v: Column) -> Column:
    return F.coalesce(F.lower(clean_string(v)).isin("1", "true", "yes", "on"), F.lit(False))


def positive_int(v: Column, default: int) -> Column:
    n = clean_string(v).try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


#: Digits before and after the point that are written out; beyond, the digits and a power of ten stand for the number.
WRITTEN_OUT = 10_000
#: Digits that fit into a long.
DIGITS = r"^\d{1,18}\z"
#: A numeral that is its own canonical text.
CANONICAL = r"^(0|-?[1-9]\d*|-?(0|[1-9]\d*)\.\d*[1-9])$"


def _written_out(t: Column) -> Column:
    """An exponent form as a plain numeral: the point is moved in the text, so that no digit is lost. Which numbers are too long for it is told by their value alone."""
    part = lambda n: F.regexp_extract(t, r"^([+-]?)(\d*)\.?(\d*)[eE]([+-]?\d+)$", n)
    parts = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("digits"), F.length(part(2)).alias("whole"), part(4).try_cast("long").alias("by"))

    def moved(x: Column) -> Column:
        digits, point = x["digits"], x["whole"] + x["by"]
        zeros = lambda n: F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(n, F.lit(2 * WRITTEN_OUT))).cast("int"))
        near = F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= F.length(digits), F.concat(digits, zeros(point - F.length(digits)))).otherwise(F.concat(F.substring(digits, F.lit(1), point.cast("int")), F.lit("."), F.substring(digits, point.cast("int") + 1, F.length(digits))))
        bare = F.trim(digits, F.lit("0"))
        first = point - (F.length(digits) - F.length(F.ltrim(digits, F.lit("0"))))  # digits before the point, and the power of the last digit that is no zero
        last = first - F.length(bare)
        far = F.when(bare == "", F.lit("0")).otherwise(F.concat(bare, F.lit("e"), last.cast("string")))
        return F.concat(x["sign"], F.when((bare == "") | (first > WRITTEN_OUT) | (last < -WRITTEN_OUT), far).otherwise(near))

    return F.get(F.transform(F.array(parts), moved), F.lit(0))


def norm_number(v: Column) -> Column:
    """Canonical decimal text of a number's exact value, null if v is no finite number.

    Digits are never rounded. Of a number that has more than WRITTEN_OUT digits before or after the point the text is its digits, e and the power of ten,
    however it was written; an exponent of more than 18 digits makes no number.
    """
    return _number(trimmed(v))


def _number(t: Column) -> Column:
    """norm_number of a trimmed text."""
    short = F.length(t) <= WRITTEN_OUT
    plain = t.rlike(PLAIN)
    out = F.when(short & plain, t).when(plain | t.rlike(EXPONENT), _written_out(F.when(plain, F.concat(t, F.lit("e0"))).otherwise(t)))
    # sign +, leading zeros, a bare point in front, trailing zeros, a bare point at the end, minus zero
    for pattern, to in ((r"^\+", ""), (r"^(-?)0+(?=\d)", "$1"), (r"^(-?)\.", "$10."), (r"(\.\d*?)0+$", "$1"), (r"\.$", ""), (r"^-0$", "0")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(short & t.rlike(CANONICAL), t).otherwise(out)


#: Types whose text is a canonical number.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def number_of(v: Column, dtype: str) -> Column:
    """norm_number for a column of a Spark type: booleans are 1 and 0."""
    return norm_number(v.cast("int") if dtype == "boolean" else v)


def norm_comparable(v: Column) -> Column:
    return F.coalesce(F.concat(F.lit("n:"), norm_number(v)), F.concat(F.lit("s:"), v.cast("string")))


def norm_datetime_key(v: Column) -> Column:
    """ISO text in microseconds, of aware ones in UTC with their offset; null if v is no calendar datetime."""
    return _datetime(trimmed(v))


def _datetime(t: Column) -> Column:
    """norm_datetime_key of a trimmed text."""
    aware = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.try_cast("timestamp").cast("timestamp_ntz")), MICROS)
    naive = F.date_format(t.try_cast("timestamp_ntz"), MICROS)
    return F.when(t.rlike(DATETIME), F.when(t.rlike(AWARE), F.concat(aware, F.lit("+00:00"))).otherwise(naive))


def norm_key(v: Column, dtype: str = "string") -> Column:
    """One comparable text for a key's part: null stays null, blank is '', and 1, 1.0, '001' and true are equal."""
    if dtype in ("boolean", *WHOLE):
        return F.concat(F.lit("number:"), (v.cast("int") if dtype == "boolean" else v).cast("string"))
    return trimmed_key(trimmed(v))


def trimmed_key(t: Column) -> Column:
    """norm_key of a trimmed text; t stands in it many times, so that inside a lambda it should be a variable. Short runs of digits, as most keys are, need no patterns."""
    tagged = F.coalesce(F.concat(F.lit("datetime:"), _datetime(t)), F.concat(F.lit("number:"), _number(t)), F.concat(F.lit("text:"), t))
    return F.when(t.rlike(DIGITS), F.concat(F.lit("number:"), t.try_cast("long").cast("string"))).when(t == "", t).otherwise(tagged)


def valid_key(parts: Column) -> Column:
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.isNotNull() & (p != ""))


def parse_datetime(v: Column, assumed: str | None = None, target: str | None = None) -> Column:
    """timestamp_ntz of a datetime or its text; with zones, shifted from the assumed to the target one. Unparseable is null."""
    t = trimmed(v)
    zone = target or "UTC"
    aware = F.convert_timezone(F.current_timezone(), F.lit(zone), t.try_cast("timestamp").cast("timestamp_ntz"))
    naive = t.try_cast("timestamp_ntz")
    if assumed and target:
        naive = F.convert_timezone(F.lit(assumed), F.lit(target), naive)
    return F.when(t.rlike(DATETIME) | t.rlike(DATE), F.when(t.rlike(DATETIME) & t.rlike(AWARE), aware).otherwise(naive))


def shift_zone(v: Column, source: str | None, target: str | None) -> Column:
    """v in the target zone; where it cannot be parsed it stays as it is."""
    if not source or not target:
        return v
    return F.coalesce(parse_datetime(v, source, target).cast("string"), v.cast("string"))


def norm_diff(v: Column, dtype: str = "string", source: str | None = None, target: str | None = None) -> Column:
    """The text by which values are compared for changes; null and '' differ."""
    if dtype.startswith(("array", "struct", "map")):
        return F.concat(F.lit("j:"), F.to_json(v))
    if dtype == "boolean":
        v = v.cast("int")
    number = F.concat(F.lit("n:"), norm_number(v))
    when = F.concat(F.lit("d:"), F.date_format(parse_datetime(v, source, target), MICROS))
    return F.coalesce(number, when, F.concat(F.lit("s:"), v.cast("string")))


def blank(v: Column) -> Column:
    return v.isNull() | (v.cast("string") == "")


def effective_modified(modified: Column, creation: Column, assumed: str | None = None, target: str | None = None) -> Column:
    """modified, or creation where that is blank; a modified that cannot be parsed is null."""
    return F.when(blank(modified), parse_datetime(creation, assumed, target)).otherwise(parse_datetime(modified, assumed, target))


def changed_since(effective: Column, watermark: Column | None) -> Column:
    """Inclusive; with no watermark all has changed, with no stamp nothing."""
    return F.lit(True) if watermark is None else F.coalesce(effective >= watermark, F.lit(False))


def compare_modified(local: Column, remote: Column, buffer_ms: int) -> Column:
    """local, remote or tie; the later one wins beyond the buffer. A missing stamp loses to one that is there."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    apart = micros(local) - micros(remote)
    return F.when(local.isNull() & remote.isNull(), "tie").when(remote.isNull(), "local").when(local.isNull(), "remote").when(F.abs(apart) <= buffer_ms * 1000, "tie").when(apart > 0, "local").otherwise("remote")


def canonical_json(columns: dict[str, Column], dtypes: dict[str, str]) -> Column:
    """Compact JSON with sorted names and nulls kept; dates as text, decimals as text, bytes as hex."""

    def plain(name: str) -> Column:
        v, kind = columns[name], dtypes.get(name, "string")
        if kind == "binary":
            v = F.lower(F.hex(v))
        elif kind.startswith(("decimal", "date", "timestamp")):
            v = v.cast("string")
        return v.alias(name)

    return F.to_json(F.struct(*[plain(n) for n in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def record_key(parts: Column) -> Column:
    """Canonical text of a normalised key; null if it is incomplete."""
    return F.when(valid_key(parts), F.to_json(parts))


def state_name(definition: Column, key: Column) -> Column:
    return F.sha2(F.to_json(F.array(definition, key)), 256)


def idempotency_key(definition: Column, key: Column, revision: Column, name: Column, prefix: str = "recon:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(definition, key, revision.cast("string"), name)), 256))


def display_key(local: dict[str, Column], remote: dict[str, Column], pk: Column) -> Column:
    """'f=v | f=v'; a blank local value gives way to the remote one, no value at all to the local id."""
    parts = [F.when(first_non_blank(v, remote.get(f, F.lit(None))).isNotNull(), F.concat(F.lit(f"{f}="), first_non_blank(v, remote.get(f, F.lit(None))))) for f, v in local.items()]
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), pk)


def source_and_target(direction: Column, local_id: Column, remote_id: Column) -> tuple[Column, Column]:
    return F.when(direction == "pull", remote_id).otherwise(local_id), F.when(direction == "pull", local_id).otherwise(remote_id)


def fit(v: Column, width: int = 140) -> Column:
    return F.when(F.length(v) > width, F.concat(F.left(v, F.lit(width - 3)), F.lit("..."))).otherwise(v)


def changed_fields(changes: Column) -> Column:
    return F.array_join(F.transform(changes, lambda c: c["field"]), ", ")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
