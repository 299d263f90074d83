"""Scalar normalisation as column expressions: text, ages, skin tones, digests, identifiers, JSON."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as no information, and the bands and codes of ages.
UNINFORMATIVE = ("", "unknown", "unk", "other_or_unspecified", "not_reported")
NULLISH = ("", "nan", "none", "<na>")
AGE_BANDS = ((18, "under_18"), (30, "18_to_29"), (40, "30_to_39"), (50, "40_to_49"), (60, "50_to_59"), (70, "60_to_69"))
AGE_TOP = "70_and_over"
AGE_CODES = {
    "AGE_18_TO_29": "18_to_29",
    "AGE_30_TO_39": "30_to_39",
    "AGE_40_TO_49": "40_to_49",
    "AGE_50_TO_59": "50_to_59",
    "AGE_60_TO_69": "60_to_69",
    "AGE_70_TO_79": "70_and_over",
    "AGE_80_OR_ABOVE": "70_and_over",
    "AGE_UNKNOWN": "unknown",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def optional_text(c: Column | str) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def metadata_text(c: Column | str) -> Column:
    """Trimmed text; empty where it stands for null."""
    text = F.coalesce(F.trim(col(c).cast("string")), F.lit(""))
    return F.when(F.lower(text).isin(*NULLISH), F.lit("")).otherwise(text)


def informative(c: Column | str) -> Column:
    return F.coalesce(~F.lower(F.trim(col(c).cast("string"))).isin(*UNINFORMATIVE), F.lit(False))


def reported(c: Column | str) -> Column:
    return F.when(informative(c), col(c).cast("string")).otherwise(F.lit("missing_or_unknown"))


def combined(system: Column | str, value: Column | str) -> Column:
    """system:value where both tell something."""
    return F.when(informative(system) & informative(value), F.concat_ws(":", col(system), col(value)))


def plain_label(c: Column | str) -> Column:
    """A label of ASCII letters: lower case, & as and, separators as spaces, all else dropped, spaces squeezed."""
    text = F.regexp_replace(F.lower(col(c)), "&", " and ")
    text = F.regexp_replace(F.regexp_replace(text, r"[_/\\-]+", " "), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(text, " +", " "))


@F.pandas_udf(T.StringType())
def decomposed(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, case folded; what plain_label needs for letters beyond ASCII."""

    def one(value: str | None) -> str | None:
        return None if value is None else "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()

    return values.map(one)


def label(c: Column | str) -> Column:
    """plain_label of any text. Only texts with other than ASCII characters go through Python; for the rest it is sent nulls."""
    ascii = col(c).rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii, plain_label(c)).otherwise(plain_label(decomposed(F.when(~ascii, col(c)))))


def letters_and_digits(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def age_group(years: Column | str, source: Column | str | None = None) -> Column:
    """A source's code where there is one, else the band of the years; negative years are null."""
    years = col(years)
    bands = F.when(years < 0, F.lit(None).cast("string"))
    for under, name in AGE_BANDS:
        bands = bands.when(years < under, F.lit(name))
    bands = bands.when(years.isNotNull(), F.lit(AGE_TOP))
    if source is None:
        return bands
    text = optional_text(source)
    return F.when(text.isNotNull(), F.coalesce(lookup(AGE_CODES, F.upper(text)), F.lit("unknown"))).otherwise(bands)


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """A small fixed mapping as an expression; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def whole_number(c: Column | str) -> Column:
    """Truncated number of a text or number, null for others and for negative ones."""
    number = col(c).try_cast("double")
    return F.when(number >= 0, number.cast("int"))


def scale_value(c: Column | str, low: int, high: int) -> Column:
    """A number between low and high as whole text, another number null, other text as it is."""
    text, number = optional_text(c), col(c).try_cast("double")
    return F.when(number.isNull(), text).when(number.between(low, high), number.cast("int").cast("string"))


def without_marker(c: Column | str, markers: Sequence[str]) -> Column:
    """Optional text; null where it is one of the markers, in any case."""
    text = optional_text(c)
    return F.when(~F.lower(text).isin(*[m.lower() for m in markers]), text)


def tone_group(tone: Column | str, system: Column | str) -> Column:
    """system:TONE, the system taken from the tone's prefix where it isn't told; unknown without a tone."""
    tone, system = metadata_text(tone), metadata_text(system)
    low = F.lower(tone)
    system = F.when(system != "", system).when(low.startswith("fst_"), "fitzpatrick").when(low.startswith("mst_"), "monk").otherwise("unspecified")
    return F.when(tone == "", F.lit("unknown")).otherwise(F.concat(F.lower(system), F.lit(":"), F.upper(tone)))


def tone_band(group: Column | str) -> Column:
    """The band of a tone within its scale; other groups as they are."""
    group = col(group)
    tone = F.regexp_extract(group, "^[^:]*:(.*)$", 1)
    one = F.regexp_extract(tone, "^FST_([1-6])$", 1).try_cast("int")
    pair = F.regexp_extract(tone, "^FST_(12|34|56)$", 1)
    monk = F.regexp_extract(tone, "^MST_(10|[1-9])$", 1).try_cast("int")
    return (
        F.when(one.isNotNull(), F.concat(F.lit("fitzpatrick:FST_"), F.when(one <= 2, "1-2").when(one <= 4, "3-4").otherwise("5-6")))
        .when((pair != "") & group.startswith("fitzpatrick"), F.concat(F.lit("fitzpatrick:FST_"), F.substring(pair, 1, 1), F.lit("-"), F.substring(pair, 2, 1)))
        .when(monk.isNotNull(), F.concat(F.lit("monk:MST_"), F.when(monk <= 3, "1-3").when(monk <= 6, "4-6").otherwise("7-10")))
        .otherwise(group)
    )


def digest(seed: object, *parts: Column | str, sep: str = ":") -> Column:
    """Hex digest of seed and parts: a reproducible random order."""
    return F.sha2(F.concat_ws(sep, F.lit(str(seed)), *[col(p).cast("string") for p in parts]), 256)


def score(*parts: Column | str) -> Column:
    """Hex digest of parts with a NUL between them."""
    return F.sha2(F.concat_ws("\u0000", *[col(p).cast("string") if not isinstance(p, str) else F.col(p).cast("string") for p in parts]), 256)


def task_seed(run_seed: object, task: Column | str) -> Column:
    """The first eight bytes of a digest as a number modulo 2 ** 31."""
    return F.conv(F.substring(digest(run_seed, task), 9, 8), 16, 10).cast("long") % F.lit(2**31)


def stable_id(prefix: str, c: Column | str, n: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(col(c).cast("string"), 256), 1, n))


def members_id(prefix: str, members: Column, n: int = 20) -> Column:
    """An id of a set of members, whatever their order."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\n"), 256), 1, n))


def without_fragment(url: Column | str) -> Column:
    return F.regexp_replace(col(url), "#.*$", "")


def first_of(*columns: Column | str) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[optional_text(c) for c in columns])


def any_contains(columns: Sequence[Column | str], word: str) -> Column:
    """Whether one of several texts has the word, in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.upper(col(c)).contains(word.upper()), F.lit(False)) for c in columns])


def sorted_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object with its keys in order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def selected(flags: Mapping[str, Column]) -> Column:
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))


def file_name(c: Column | str, n: int = 180) -> Column:
    return F.substring(F.regexp_replace(col(c), "[^A-Za-z0-9._-]+", "_"), 1, n)


def rules(*cases: tuple[str, Column]) -> Column:
    """The names of the cases that hold, as an array in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cases]))


def choice(cases: Sequence[tuple[str, Column]], otherwise: str | None) -> Column:
    """The name of the first case that holds."""
    out = F.lit(otherwise)
    for name, c in reversed(cases):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def weighted_list(c: Column | str) -> Column:
    """An array of (label, weight, rank) of a text such as {'a': 0.2, 'b': 0.8}: by falling weight, equal ones as they were written. Null for other texts."""
    entries = F.map_entries(F.from_json(F.regexp_replace(col(c), "'", '"'), "map<string,double>"))
    placed = F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("w"), i.alias("i"), e["key"].alias("label")))
    return F.transform(F.array_sort(placed), lambda e, i: F.struct(e["label"].alias("label"), (-e["w"]).alias("weight"), (i + 1).alias("rank")))


def id_set(c: Column | str, fallback: Column | None = None) -> Column:
    """Distinct ids in a text of a list, however it was printed; the fallback where there is none."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z0-9_.-]*[A-Za-z0-9_]"), F.lit(0))))
    return ids if fallback is None else F.when(F.size(ids) > 0, ids).otherwise(fallback)


def rendered(template: str, fields: Mapping[str, Column]) -> Column:
    """template with {{ name }} and {{name}} replaced."""
    out = F.lit(template)
    for name, value in fields.items():
        for mark in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}"):
            out = F.replace(out, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return out


def bullets(items: Column) -> Column:
    """An array of texts as lines with a dash."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def first_contained(c: Column | str, names: Sequence[str], otherwise: str | None = None) -> Column:
    """The first of names that a text has; longer names that have shorter ones in them come first."""
    return choice([(n, F.coalesce(F.lower(col(c)).contains(n.lower()), F.lit(False))) for n in names], otherwise)


def leading_letter(c: Column | str, allowed: Column) -> Column:
    letter = F.upper(F.regexp_extract(col(c), r"^\s*([A-Za-z])(?![A-Za-z])", 1))
    return F.when(F.array_contains(allowed, letter), letter)
