"""Column helpers for loosely typed JSON and for number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixeltide.functions.columns import col, finite

# A bare NaN or Infinity between JSON delimiters. Many writers emit it; strict parsers refuse it.
_NONFINITE = r"(?<=[\[,:\s])(-?Infinity|NaN)(?=\s*[\],}])"


def quote_nonfinite(text: Column | str, as_null: bool = False) -> Column:
    """Bare NaN/Infinity to a quoted string (or to null), so that the document stays parseable."""
    return F.regexp_replace(col(text), _NONFINITE, "null" if as_null else '"$1"')


def parse(text: Column | str, as_null: bool = True) -> Column:
    """Variant of a JSON text; null where it is malformed."""
    return F.try_parse_json(quote_nonfinite(text, as_null))


def field(v: Column, key: str) -> Column:
    """Member as a variant; null where it is absent (a JSON null is a value)."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """The schema text of a value goes through all of it; reading it as an object of which no member is asked for does not."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    """The schema text of a long array is costly; reading it as a list of variants is not."""
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(type_of(v) == "STRING", F.lit(False))


def is_bool(v: Column) -> Column:
    return F.coalesce(type_of(v) == "BOOLEAN", F.lit(False))


def is_int(v: Column) -> Column:
    """Written without fraction or exponent. Booleans do not count."""
    return F.coalesce(type_of(v) == "BIGINT", F.lit(False))


def is_number(v: Column, booleans: bool = False) -> Column:
    t = type_of(v)
    ok = (t == "BIGINT") | (t == "DOUBLE") | (t == "FLOAT") | t.startswith("DECIMAL")
    if booleans:
        ok = ok | (t == "BOOLEAN")
    return F.coalesce(ok, F.lit(False))


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def is_finite_number(v: Column) -> Column:
    """A finite number; booleans pass, as they are integers to the checks."""
    return F.coalesce(is_bool(v) | (is_number(v) & finite(number(v))), F.lit(False))


def integral_number(v: Column) -> Column:
    """A number without fraction, finite, not a boolean."""
    n = number(v)
    return F.coalesce(is_number(v) & finite(n) & (n == F.floor(n).cast("double")), F.lit(False))


def items(v: Column) -> Column:
    """Elements as variants; null where the value is not an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column) -> Column:
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def finite_array(a: Column | str, n: int) -> Column:
    """array<double> of length n with finite elements only."""
    a = col(a)
    return F.coalesce((F.size(a) == n) & F.forall(a, lambda x: x.isNotNull() & finite(x)), F.lit(False))


def _plain(token: Column) -> Column:
    return F.regexp_replace(token, r"(?<=\d)_(?=\d)", "")


def parse_int(token: Column) -> Column:
    """Integer text or null; a fraction or exponent is not an integer. Only odd texts take the regex path."""
    t = _plain(token)
    return F.when(F.contains(token, F.lit("_")), F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))).otherwise(token.try_cast("bigint"))


def parse_float(token: Column) -> Column:
    """Decimal, exponent, nan and inf texts; null otherwise. Type suffixes and hex forms are refused.

    A cast alone would take suffixes; tokens with any letter that could be one take the regex path.
    """
    t = _plain(token)
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    inf = t.rlike(r"(?i)^[+-]?inf(inity)?$")
    nan = t.rlike(r"(?i)^[+-]?nan$")
    inf_value = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    careful = F.when(plain, t.try_cast("double")).when(inf, inf_value).when(nan, F.lit(float("nan")))
    return F.when(token.rlike("[_a-df-zA-DF-Z]"), careful).otherwise(token.try_cast("double"))


def scalar_range(v: Column) -> Column:
    """Number or {min, max} to struct(min, max), swapped if reversed; null where it is neither."""
    lo, hi = field(v, "min"), field(v, "max")
    pair = is_object(v) & is_number(lo) & is_number(hi)
    one = number(v)
    a, b = number(lo), number(hi)
    return F.when(is_number(v), F.struct(one.alias("min"), one.alias("max"))).when(
        pair, F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max"))
    )


def vec3(v: Column) -> Column:
    """[x, y, z] of numbers to array<double>; null otherwise."""
    xs = items(v)
    ok = (F.size(xs) == 3) & F.forall(xs, lambda x: is_number(x))
    return F.when(ok, F.transform(xs, lambda x: number(x)))


def vec3_range(v: Column) -> Column:
    """[x, y, z] or {min, max} of such to struct(min, max), swapped per axis."""
    one, lo, hi = vec3(v), vec3(field(v, "min")), vec3(field(v, "max"))
    low = F.zip_with(lo, hi, lambda a, b: F.least(a, b))
    high = F.zip_with(lo, hi, lambda a, b: F.greatest(a, b))
    return F.when(one.isNotNull(), F.struct(one.alias("min"), one.alias("max"))).when(
        is_object(v) & lo.isNotNull() & hi.isNotNull(), F.struct(low.alias("min"), high.alias("max"))
    )


def range_json(r: Column) -> Column:
    """A range as JSON text: a plain value where both ends agree."""
    lo, hi = r["min"], r["max"]
    return F.when(lo == hi, lo.cast("string")).otherwise(F.to_json(F.struct(hi.alias("max"), lo.alias("min"))))
