"""Scalar functions on identifiers, names, values and units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hyphens and spaces that drawings and answers use for '-' and ' '.
TYPOGRAPHY = ("‐‑‒–  ", "----  ")
#: What a word of a property name is, and words of it that don't change which property is meant.
NAME_WORDS = "[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"
GENERIC_WORDS = ("representation", "numerical", "value", "standard", "number", "code", "id", "name")
#: Units of length and pressure as drawings name them, and how values show them.
UNITS = {"Bar": "bar", "DegreeCelsius": "°C", "Kilowatt": "kW", "MetreSquared": "m2", "Millimetre": "mm", "Metre": "m", "MetreCubed": "m3"}


def normalize_identifier(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def camel_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0)), F.lower)


def identifier_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9_.\-/]*"), F.lit(0))


def singular(c: Column) -> Column:
    """Without a last s, in words of more than three letters that don't end in ss."""
    return F.when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.regexp_replace(c, "s$", "")).otherwise(c)


def fold_typography(c: Column) -> Column:
    return F.translate(c, *TYPOGRAPHY)


def fold_units(c: Column) -> Column:
    return F.translate(c, "³²", "32")


def key(c: Column) -> Column:
    """Comparison form of a name: hyphens and spaces folded, no white space, lower case, no outer punctuation."""
    return F.regexp_replace(F.lower(F.regexp_replace(fold_typography(c), r"\s+", "")), r"^[.,;:'\"`*]+|[.,;:'\"`*]+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def name_tokens(c: Column) -> Column:
    """Words of a name, whether written nominalDiameter, nominal_diameter or Nominal diameter; a run of capitals is one word."""
    return F.transform(F.regexp_extract_all(c, F.lit(NAME_WORDS), F.lit(0)), F.lower)


def names_match(wanted: Column, have: Column) -> Column:
    """The same property, where have may hold words more that don't change which one is meant."""
    a, b = name_tokens(wanted), name_tokens(have)
    more = F.array_except(b, a)
    return F.coalesce((F.size(a) > 0) & ((a == b) | ((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(more, F.array(*map(F.lit, GENERIC_WORDS)))) == 0))), F.lit(False))


def plain_term(c: Column) -> Column:
    """A term for comparison inside texts: no white space, lower case, no punctuation at its ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), "^[.,;:]+|[.,;:]+$", "")


def identifier_pieces(c: Column) -> Column:
    """The whole, its parts between white space, and theirs between '/' and '-'."""
    words = F.split(F.trim(c), r"\s+")
    return F.array_distinct(F.filter(F.concat(F.array(c), words, F.flatten(F.transform(words, lambda w: F.split(w, "[/-]")))), lambda x: x != ""))


def number_and_unit(c: Column) -> Column:
    """(number, unit) of texts that begin with a number; else null."""
    digits = F.regexp_extract(F.trim(c), r"^[0-9.+-]+", 0)
    number = digits.try_cast("double")
    return F.when(number.isNotNull(), F.struct(number.alias("number"), F.trim(F.regexp_replace(F.trim(c), r"^[0-9.+-]+", "")).alias("unit")))


def same_value(have: Column, want: Column) -> Column:
    """Equal numbers with equal units, or without a wanted unit; else equal text but for case and white space."""
    a, b = number_and_unit(have), number_and_unit(want)
    text = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    numeric = (a["number"] == b["number"]) & ((b["unit"] == "") | (text(a["unit"]) == text(b["unit"])))
    return F.when(a.isNotNull() & b.isNotNull(), numeric).otherwise(text(have) == text(want))


def parse_value(c: Column) -> Column:
    """(kind, number, unit): dn for 'DN 80', quantity for '80 mm', number for '80', else text. Kinds are never converted."""
    dn = F.regexp_extract(F.trim(c), r"(?i)^dn\s*([0-9]+(?:[.][0-9]+)?)$", 1)
    parts = number_and_unit(F.regexp_replace(c, ",", "."))
    kind = F.when(dn != "", "dn").when(parts.isNotNull() & (parts["unit"] != ""), "quantity").when(parts.isNotNull(), "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(dn != "", dn.try_cast("double")).otherwise(parts["number"]).alias("number"), F.when(dn != "", F.lit("")).otherwise(F.lower(fold_units(parts["unit"]))).alias("unit"))


def values_match(a: Column, b: Column) -> Column:
    x, y = parse_value(a), parse_value(b)
    same = (x["kind"] == y["kind"]) & F.when(x["kind"] == "text", key(a) == key(b)).otherwise((x["number"] == y["number"]) & (x["unit"].eqNullSafe(y["unit"])))
    return F.coalesce(same, F.lit(False))


def fact_key(predicate: Column, subject: Column, obj: Column, value: Column, qualifiers: Column) -> Column:
    """A canonical fact as JSON: empty parts dropped, qualifiers sorted by name."""
    q = F.map_from_entries(F.array_sort(F.filter(F.map_entries(qualifiers), lambda e: e["value"].isNotNull() & (e["value"] != ""))))
    blank = lambda c: F.when(c != "", c)
    return F.to_json(F.struct(predicate.alias("p"), subject.alias("s"), blank(obj).alias("o"), blank(value).alias("v"), F.when(F.size(q) > 0, q).alias("q")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", "-"), "^-+|-+$", "")
