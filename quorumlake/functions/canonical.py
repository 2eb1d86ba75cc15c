"""Canonical JSON with sorted keys, made from a column's type, and the stable keys that are hashes of it.

The text is the one that Python's ``json.dumps(..., sort_keys=True)`` gives: non-ASCII characters as UTF-16 escapes, numbers
in their shortest form, keys of structs and maps in the order of their characters, nulls spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How JSON spells these characters.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    out = text
    for char, spelled in SHORT.items():
        out = F.replace(out, F.lit(char), F.lit(spelled))
    units = F.lower(F.hex(F.encode(out, "UTF-16BE")))
    plain = lambda u: F.char(F.conv(u, 16, 10).cast("int"))
    unit = lambda i: F.substring(units, i * 4 + 1, F.lit(4))
    each = F.transform(F.sequence(F.lit(0), F.length(out) - 1 + F.length(F.regexp_replace(out, "[^\\x{10000}-\\x{10FFFF}]", ""))), lambda i: F.when((unit(i) >= "0020") & (unit(i) <= "007e"), plain(unit(i))).otherwise(F.concat(F.lit("\\u"), unit(i))))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[^\x20-\x7e]"), F.array_join(each, "")).otherwise(out), F.lit('"'))


def json_double(value: Column) -> Column:
    """The shortest digits that give the number; a power of ten from 1e16 on and below 1e-4."""
    value = value.cast("double")
    spelled = [F.format_string(f"%.{p}e", value) for p in (14, 15)]  # as few digits as give the number again
    text = F.coalesce(*[F.when(t.try_cast("double") == value, t) for t in spelled], F.format_string("%.16e", value))
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).try_cast("int")
    sign, digits = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.regexp_replace(F.regexp_replace(text, r"e.*$|[.-]", ""), r"(?<=.)0+$", "")
    n = F.length(digits)
    whole = F.concat(F.substring(F.rpad(digits, 400, "0"), F.lit(1), power + 1), F.lit("."), F.when(n > power + 1, F.substring(digits, power + 2, n)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(power.isNull(), value.cast("string")).when((power >= 16) | (power < -4), F.concat(sign, far)).when(power >= 0, F.concat(sign, whole)).otherwise(F.concat(sign, small))


def canonical_json(value: Column, kind: T.DataType, between: tuple[str, str] = (",", ":")) -> Column:
    """The JSON text of a column of this type; ``between`` separates items, and keys from values. Types that JSON doesn't have are written as their strings."""
    item, colon = between

    def of(v: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            parts = [F.concat(json_string(F.lit(f.name)), F.lit(colon), of(v[f.name], f.dataType)) for f in sorted(t.fields, key=lambda f: f.name)]
            made = F.concat(F.lit("{"), F.concat_ws(item, *parts), F.lit("}"))
        elif isinstance(t, T.ArrayType):
            made = F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: of(x, t.elementType)), item), F.lit("]"))
        elif isinstance(t, T.MapType):
            pairs = F.array_sort(F.transform(F.map_entries(v), lambda e: F.struct(e["key"].cast("string").alias("k"), of(e["value"], t.valueType).alias("v"))))
            made = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(json_string(e["k"]), F.lit(colon), e["v"])), item), F.lit("}"))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            made = json_double(v)
        elif isinstance(t, (T.BooleanType, T.IntegralType)):
            made = v.cast("string")
        else:
            made = json_string(v.cast("string"))
        return F.when(v.isNull(), F.lit("null")).otherwise(made)

    return of(value, kind)


def source_key(pinned: Column, provider: Column, source: Column, kind: T.MapType, left_out: tuple[str, ...]) -> Column:
    """A source's stable key: the pinned one, else a hash of its provider and its configuration without the selectors of single feeds."""
    own = F.map_filter(source, lambda k, v: ~k.isin(*left_out)) if left_out else source
    hashed = F.left(F.sha1(F.concat(provider, F.lit("|"), canonical_json(own, kind, (", ", ": ")))), F.lit(12))
    return F.coalesce(F.nullif(pinned, F.lit("")), hashed)


def family_key(entity: Column, provider: Column, own_key: Column) -> Column:
    """The key of all feeds of one entity; without one, the source's own."""
    return F.when(F.coalesce(entity, F.lit("")) != "", F.left(F.sha1(F.concat(provider, F.lit("|entity:"), entity)), F.lit(12))).otherwise(own_key)


def digest(value: Column, kind: T.DataType) -> Column:
    return F.left(F.sha1(canonical_json(value, kind)), F.lit(12))


def chapter_id(index: Column, start: Column, title: Column) -> Column:
    """A chapter's id from its place, start and title in the source."""
    payload = F.struct(index.cast("long").alias("index"), start.cast("double").alias("start"), F.trim(F.coalesce(title, F.lit(""))).alias("title"))
    return F.concat(F.lit("ch-"), digest(payload, T.StructType().add("index", "long").add("start", "double").add("title", "string")))
