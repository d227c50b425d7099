"""Text functions as Column expressions: normalisers, overlaps, relation labels, number and JSON parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label segments that say nothing about a relation, and the names by which types are also known.
GENERIC_SEGMENTS = [
    "measurement unit", "dated integer", "dated percentage", "dated money", "dated money value", "dated string",
    "dated enum", "dated date", "dated datetime",
]
TYPE_ALIASES: dict[str, list[str]] = {
    "movie": ["film", "motion picture", "feature film"],
    "film": ["movie", "motion picture", "feature film"],
    "actor": ["performer", "cast", "person", "film actor"],
    "actress": ["performer", "cast", "person", "film actor"],
    "person": ["people", "human"],
    "city": ["town", "location", "citytown"],
    "country": ["nation", "sovereign state"],
    "language": ["spoken language"],
    "religion": ["faith", "belief system"],
    "airport": ["airfield", "aviation facility"],
    "school": ["university", "college", "educational institution"],
    "date": ["year", "datetime", "time"],
    "year": ["date", "datetime", "time"],
    "museum": ["architecture.museum", "museum"],
}


def _squeeze(c: Column, chars: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), chars, " "))


def norm_ws(c: Column) -> Column:
    return _squeeze(c, r"\s+")


def norm_catalog(c: Column) -> Column:
    """Names and ids alike; null counts as empty."""
    return _squeeze(F.coalesce(c, F.lit("")), r"[\s._/\-()|]+")


def norm_beam(c: Column) -> Column:
    return _squeeze(F.coalesce(c, F.lit("")), r"[\s._/\-()|,:]+")


def norm_relation(c: Column) -> Column:
    """As ``norm_catalog``, but null reads "none"."""
    return _squeeze(F.coalesce(c, F.lit("none")), r"[\s._/\-()|]+")


def norm_prompt(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def tokens(normalized: Column) -> Column:
    """Distinct words of normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def _share(a: Column, b: Column, base: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(base > 0, both / base).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays."""
    return _share(a, b, F.size(F.array_union(a, b)))


def jaccard_beam(a: Column, b: Column) -> Column:
    return jaccard(tokens(norm_beam(a)), tokens(norm_beam(b)))


def jaccard80(a: Column, b: Column) -> Column:
    """80 times the Jaccard similarity of already normalised texts."""
    return 80.0 * jaccard(tokens(a), tokens(b))


def overlap_max(a: Column, b: Column) -> Column:
    x, y = tokens(norm_ws(a)), tokens(norm_ws(b))
    return _share(x, y, F.greatest(F.size(x), F.size(y)))


def overlap_left(a: Column, b: Column) -> Column:
    x, y = tokens(norm_relation(a)), tokens(norm_relation(b))
    return _share(x, y, F.size(x))


def verbalize_relation(c: Column) -> Column:
    """A short label for a relation id: its telling segments, the last two joined by an arrow."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    every = F.filter(F.transform(F.split(raw, r"\."), norm_catalog), lambda s: s != "")
    telling = F.filter(every, lambda s: ~s.isin(GENERIC_SEGMENTS))
    telling = F.when(F.size(telling) > 0, telling).otherwise(every)
    tail = F.slice(telling, 3, 1_000_000)
    fresh = F.filter(tail, lambda s: ~F.array_contains(F.slice(telling, 1, 2), s))
    core = F.when(F.size(telling) > 2, F.when(F.size(fresh) > 0, fresh).otherwise(tail)).otherwise(telling)
    once = F.filter(core, lambda s, i: (i == 0) | (s != F.get(core, i - 1)))
    last = F.when(F.size(once) > 2, F.slice(once, -2, 2)).otherwise(once)
    return F.when(F.size(every) == 0, raw).otherwise(F.array_join(last, " -> "))


def is_id(c: Column) -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    return c.startswith("m.") | c.startswith("g.")


def number_or_year(c: Column) -> Column:
    """The text as a number without its commas, else the first number in it."""
    t = F.regexp_replace(F.trim(c), ",", "")
    whole = F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t)
    first = F.regexp_extract(t, r"[-+]?\d+(?:\.\d+)?", 0)
    return F.coalesce(whole.try_cast("double"), F.nullif(first, F.lit("")).try_cast("double"))


def tolerant_json(c: Column, schema: str) -> Column:
    """Parsed JSON: the whole text, else a fenced block, else from the first brace or bracket to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    tries = [F.from_json(F.when(_looks_json(x) & (F.trim(x) != ""), x), schema) for x in (c, fenced, braces, brackets)]
    return F.coalesce(*tries)


def _looks_json(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


def crc_bucket(parts: list[Column], n: int) -> Column:
    return F.pmod(F.crc32(F.concat_ws("\u001f", *parts).cast("binary")), F.lit(n))


def type_names(expected: str | None) -> list[str]:
    """The normalised names of a type: itself and its aliases, sorted."""
    t = " ".join((expected or "").lower().replace(".", " ").replace("_", " ").split())
    return sorted({t, *TYPE_ALIASES.get(t, [])}) if t else []


def type_names_of(expected: Column) -> Column:
    """``type_names`` of a column: an array, empty where no type is expected."""
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(expected, F.lit("")), "[._]", " ")), r"\s+", " "))
    table = F.create_map(*[x for k, v in TYPE_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    none = F.array().cast("array<string>")
    return F.when(t == "", none).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none)))))


def type_match(expected: str | None, name: Column, types: Column) -> Column:
    """1 if an alias of the expected type occurs in name and types, else the best token overlap; 0.5 if none is expected."""
    names = type_names(expected)
    if not names:
        return F.lit(0.5)
    hay = norm_catalog(F.concat_ws(" ", name, types))
    each = [F.when(F.contains(hay, F.lit(a)), F.lit(1.0)).otherwise(jaccard_beam(F.lit(a), hay)) for a in names]
    return F.when(hay == "", F.lit(0.0)).otherwise(reduce(F.greatest, each) if len(each) > 1 else each[0])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks similarity of two strings; the one text measure without a built-in, hence a vectorised UDF."""
    import pandas as pd

    def ratio(x, y):
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    ratio.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, "double")(a, b)


def ordered_distinct(c: Column) -> Column:
    """Trimmed, non-empty elements, each where it first occurs."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))
