"""Format-preserving pseudonyms for personal data, in DataFrame functions.

Each value found and validated is a sequence of small numbers (digits, letters, octets, a day of the calendar) that a keyed Feistel network permutes
within its own format; equal values get equal pseudonyms in all documents. Check digits are computed anew, so what was valid stays valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.frames import unclashed

#: Characters that are exchanged for one another; all others stay where they are.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:1[89]|2[01])[0-9]{2}"
_HEX = "[0-9A-Fa-f]{1,4}"
_WORD = r"(?<![\p{L}\p{N}])"
#: kind: what it looks like. In one pattern the first that fits at a place is taken.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?i:(?<![a-z])(?:token|secret|password|passwd|pwd|api_?key|access_?key))[\"']? ?[=:] ?(?:[\"'][A-Za-z0-9_+/-]{12,}+[\"']|(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{8,}+)"
    rf"|{_WORD}(?i:bearer) [A-Za-z0-9._~+/-]{{16,}}+=*|{_WORD}(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![\p{{L}}\p{{N}}])|{_WORD}(?:gh[pousr]_|sk-|xox[abprs]-)[A-Za-z0-9_-]{{20,}}+|{_WORD}eyJ[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]{{8,}}+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "date": rf"(?<![\p{{L}}\p{{N}}./-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}(?:/{_MONTH}/|\.{_MONTH}\.|-{_MONTH}-){_YEAR}|{_MONTH}/{_DAY}/{_YEAR})(?![\p{{L}}\p{{N}}/-]|\.[0-9])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?<!(?i:version|release|ver\.?|v\.?) )(?<!(?i:version|release|ver))(?:{_OCTET})(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?:{_HEX}::?){{2,6}}{_HEX}(?![\p{{L}}\p{{N}}:]))(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|\+[0-9]{7,15}|[0-9]{3}(?<pa>[ .-])[0-9]{3}\k<pa>[0-9]{4})(?![\p{L}\p{N}]|[.-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?<ca>[ -])[0-9]{4}\k<ca>[0-9]{4}\k<ca>[0-9]{1,7}|[0-9]{4}(?<cb>[ -])[0-9]{6}\k<cb>[0-9]{5})(?![\p{L}\p{N}])",
}
KINDS = tuple(PATTERNS)
_NAMED = {k: f"(?<{k}>{p})" for k, p in PATTERNS.items()}
#: All of them. None begins within a word, and of those that differ by their first character only one group is tried.
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:{_NAMED['email']}|(?=[A-Za-z])(?:{_NAMED['secret']}|{_NAMED['iban']})|(?=[0-9+(])(?:{'|'.join(_NAMED[k] for k in ('date', 'ip', 'phone', 'ssn', 'card'))})|{_NAMED['ipv6']})"
#: Unicode's noncharacters, which stand around what is found and between its kinds while a text is taken apart.
FOUND, NEXT = "﷐", "﷑"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def noise(key: str, tweak: Column, n: Column) -> Column:
    """n keyed numbers from 0 to 65,535 that depend on tweak: 32 from each digest."""
    digests = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), b.cast("string"), tweak), 512)), "")
    return let(digests, lambda h: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))


def feistel(values: Column, radices: Column, key: str, tweak: Column) -> Column:
    """values, each from 0 to its radix - 1, permuted. Rounds take turns: keyed noise that depends on one half is added to the other, each number modulo its radix. A single value is only shifted by the tweak's noise."""

    def added(half: Column, radix: Column, other: Column, r: Column) -> Column:
        seed = F.concat_ws("|", tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ","))
        return let(noise(key, seed, F.size(half)), lambda h: F.transform(half, lambda x, i: F.pmod(x + F.get(h, i), F.get(radix, i)).cast("int")))

    def rounds(v: Column) -> Column:
        values, radix, cut = v["v"], v["m"], F.ceil(F.size(v["v"]) / 2).cast("int")
        left, right = F.slice(radix, 1, cut), F.slice(radix, cut + 1, F.size(values))
        start = F.struct(F.slice(values, 1, cut).alias("l"), F.slice(values, cut + 1, F.size(values)).alias("r"))
        end = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            lambda a, r: F.when(r % 2 == 0, F.struct(added(a["l"], left, a["r"], r).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), added(a["r"], right, a["l"], r).alias("r"))),
        )
        return let(end, lambda a: F.concat(a["l"], a["r"]))

    return let(F.struct(values.cast("array<int>").alias("v"), radices.cast("array<int>").alias("m")), rounds)


def characters(text: Column, key: str, kind: str) -> Column:
    """text with each character of an alphabet exchanged within it; what text looks like is part of the tweak."""

    def places(c: Column) -> Column:
        alphabet = F.lit(0)
        for i, a in reversed(list(enumerate(ALPHABETS, 1))):
            alphabet = F.when(F.instr(F.lit(a), c) > 0, F.lit(i)).otherwise(alphabet)
        return alphabet

    def body(chars: Column) -> Column:
        kinds = F.transform(chars, places)
        alphabets, sizes = F.array(*map(F.lit, ALPHABETS)), F.array(*(F.lit(len(a)) for a in ALPHABETS))
        return let(
            F.arrays_zip(chars.alias("c"), kinds.alias("k")),
            lambda z: let(
                F.filter(z, lambda x: x["k"] > 0),
                lambda own: let(
                    feistel(
                        F.transform(own, lambda x: F.instr(F.get(alphabets, x["k"] - 1), x["c"]) - 1),
                        F.transform(own, lambda x: F.get(sizes, x["k"] - 1)),
                        key,
                        F.concat(F.lit(kind + "|"), F.array_join(F.transform(z, lambda x: F.when(x["k"] > 0, x["k"].cast("string")).otherwise(x["c"])), "")),
                    ),
                    lambda new: F.aggregate(
                        z,
                        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
                        lambda a, x: F.when(x["k"] == 0, F.struct(F.concat(a["s"], x["c"]).alias("s"), a["n"].alias("n"))).otherwise(
                            F.struct(F.concat(a["s"], F.substring(F.get(alphabets, x["k"] - 1), F.get(new, a["n"]) + 1, F.lit(1))).alias("s"), (a["n"] + 1).alias("n"))
                        ),
                        lambda a: a["s"],
                    ),
                ),
            ),
        )

    return F.when(F.length(text) > 0, let(F.split(text, ""), lambda chars: body(F.filter(chars, lambda c: c != "")))).otherwise(text)


def digit_sum(digits: Column, double_last: bool) -> Column:
    """Luhn's sum, modulo 10, with every second digit doubled from the last one or the one before it."""
    own = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    parity = 0 if double_last else 1
    return F.aggregate(F.transform(own, lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == parity, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))), F.lit(0), lambda a, x: a + x) % 10


def remainder(text: Column) -> Column:
    """text, letters as 10 to 35, modulo 97."""
    own = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(own, F.lit(0), lambda a, c: let(F.conv(c, 36, 10).cast("int"), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def relaid(layout: Column, text: Column) -> Column:
    """text's characters put where layout has letters and digits."""
    return F.aggregate(
        F.filter(F.split(layout, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("n")),
        lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["s"], F.substring(text, a["n"], F.lit(1))).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))),
        lambda a: a["s"],
    )


def email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(characters(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def secret(m: Column, key: str) -> Column:
    """What says that it is one, and of which make, stays."""
    head = F.regexp_extract(m, r"^((?i:[a-z_]+)[\"']? ?[=:] ?[\"']?|(?i:bearer) (?:eyJ)?|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|)", 1)
    return let(head, lambda h: F.concat(h, characters(F.substring(m, F.length(h) + 1, F.length(m)), key, "secret")))


def iban(m: Column, key: str) -> Column:
    """The account is permuted, the country stays, the check digits are computed anew; only for right check digits."""

    def body(x: Column) -> Column:
        country, account = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        new = let(characters(account, key, "iban"), lambda a: F.concat(country, F.lpad((98 - remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(remainder(F.concat(account, F.substring(x, 1, 4))) == 1, relaid(m, new))

    return let(F.translate(m, " ", ""), body)


def date(m: Column, key: str) -> Column:
    """Another day of the 146,097 from 1800 to 2199, the calendar's own cycle, as 27 times 5,411; only for days that exist. 12/25/1990 has its month first, as it can't be last."""
    first = F.lit("1800-01-01").cast("date")
    iso = F.substring(m, 5, 1) == "-"
    month_first = F.substring(m, 4, 2).cast("int") > 12

    def body(day: Column) -> Column:
        n = F.datediff(day, first)
        new = feistel(F.array(n % 27, F.floor(n / 27).cast("int")), F.array(F.lit(27), F.lit(5411)), key, F.lit("date"))

        def shown(d: Column) -> Column:
            dd, mm, yyyy, s = F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yyyy"), F.substring(m, 3, 1)
            return F.when(iso, F.concat_ws("-", yyyy, mm, dd)).when(month_first, F.concat(mm, s, dd, s, yyyy)).otherwise(F.concat(dd, s, mm, s, yyyy))

        return F.when(day.isNotNull(), let(let(new, lambda v: F.date_add(first, F.get(v, 0) + F.get(v, 1) * 27)), shown))

    a, b = F.substring(m, 1, 2), F.substring(m, 4, 2)
    given = F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a)))
    return let(F.try_to_timestamp(given, F.lit("yyyy-MM-dd")).cast("date"), body)


def ip(m: Column, key: str) -> Column:
    return F.array_join(feistel(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), F.array(*[F.lit(256)] * 4), key, F.lit("ip")).cast("array<string>"), ".")


def ipv6(m: Column, key: str) -> Column:
    """Its groups, as numbers under 65,536, in lower case without leading zeros; where zeros are left out stays. How a value is written doesn't matter, but for that place."""

    def body(groups: Column) -> Column:
        full = F.filter(groups, lambda g: g != "")
        at = F.array_position(groups, "")
        new = feistel(F.transform(full, lambda g: F.conv(g, 16, 10).cast("int")), F.transform(full, lambda g: F.lit(65536)), key, F.concat(F.lit("ipv6|"), at.cast("string")))
        shown = let(new, lambda v: F.transform(v, lambda x: F.lower(F.hex(x))))
        return let(shown, lambda v: F.array_join(F.when(at > 0, F.concat(F.slice(v, 1, (at - 1).cast("int")), F.array(F.lit("")), F.slice(v, at.cast("int"), F.size(v)))).otherwise(v), ":"))

    return let(F.split(m, ":"), body)


def phone(m: Column, key: str) -> Column:
    """After + the country code stays; only for 7 to 15 digits in all."""
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|)", 1)
    right = F.length(F.regexp_replace(m, "[^0-9]", "")).between(7, 15)
    return F.when(right, let(head, lambda h: F.concat(h, characters(F.substring(m, F.length(h) + 1, F.length(m)), key, "phone"))))


def ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def body(v: Column) -> Column:
        area = F.get(v, 0)
        return F.concat_ws("-", F.lpad((area + 1 + F.when(area >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.get(v, 1) + 1).cast("string"), 2, "0"), F.lpad((F.get(v, 2) + 1).cast("string"), 4, "0"))

    area = F.substring(m, 1, 3).cast("int")
    values = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1)
    return let(feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn")), body)


def card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, the last makes Luhn's sum right again; only for numbers whose sum is right."""

    def body(digits: Column) -> Column:
        rest = let(characters(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), lambda r: F.concat(r, ((10 - digit_sum(r, True)) % 10).cast("string")))
        return F.when(digit_sum(digits, False) == 0, relaid(m, rest))

    return let(F.regexp_replace(m, "[^0-9]", ""), body)


#: kind: the pseudonym of a value, or null where it isn't a valid one.
PSEUDONYMS = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "ipv6": ipv6, "phone": phone, "ssn": ssn, "card": card}


def replaced(groups: Column, key: str) -> Column:
    """Struct of text and kind for what one place fits, each kind's match in its turn and all but one empty; kind is null where the value isn't valid and stays."""

    def of(kind: str, m: Column) -> Column:
        return let(PSEUDONYMS[kind](m, key), lambda new: F.struct(F.coalesce(new, m).alias("text"), F.when(new.isNotNull(), F.lit(kind)).alias("kind")))

    out = F.struct(F.array_join(groups, "").alias("text"), F.lit(None).cast("string").alias("kind"))
    for i, kind in reversed(list(enumerate(KINDS))):
        out = F.when(F.get(groups, F.lit(i)) != "", of(kind, F.get(groups, F.lit(i)))).otherwise(out)
    return out


def rewritten(text: Column, key: str) -> Column:
    """Array of structs of text and kind that make up a text without FOUND and NEXT. The pattern goes over it once and says what fits and as what."""
    marked = F.regexp_replace(text, F.lit(ANY), F.lit(FOUND + NEXT.join(f"${{{k}}}" for k in KINDS) + FOUND))
    plain = lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("kind"))
    return F.transform(F.split(marked, FOUND, -1), lambda x, i: F.when(i % 2 == 0, plain(x)).otherwise(let(F.split(x, NEXT, -1), lambda groups: replaced(groups, key))))


def pseudonymize(docs: DataFrame, key: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, then text with pseudonyms (null stays null), n_pii and pii_kinds (the kinds found, joined by commas, in alphabetic order).

    Texts are searched whole. There is no shuffle, and no state between rows: a value's pseudonym depends on key, its kind and itself; as in any permutation, a
    value can be its own, which counts as found. Whoever has key can undo all; it is part of the query's plan. Repeated rows give repeated results, an empty
    table an empty one. A column of keep with the name of an added one is an error.
    """
    unclashed(keep, text.lower(), "n_pii", "pii_kinds", "_text", "_parts")
    if not key:
        raise ValueError("pseudonyms need a key")
    own = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    # between the marks that a text may have of its own, which nothing that is sought contains
    between, marks = F.split("_text", f"[{FOUND}{NEXT}]", -1), F.regexp_extract_all("_text", F.lit(f"[{FOUND}{NEXT}]"), F.lit(0))
    mark = lambda m: F.array(F.struct(F.coalesce(m, F.lit("")).alias("text"), F.lit(None).cast("string").alias("kind")))
    own = own.withColumn("_parts", F.flatten(F.zip_with(F.transform(between, lambda x: rewritten(x, key)), marks, lambda x, m: F.concat(x, mark(m)))))
    kinds = F.coalesce(F.filter(F.transform("_parts", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    new = F.when(F.col("_text").isNotNull(), F.array_join(F.transform("_parts", lambda x: x["text"]), ""))
    return own.select(*keep, new.alias(text), F.size(kinds).cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("pii_kinds"))
