"""Scalar text functions as Catalyst expressions (no UDF)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The code points that count as white space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.trim(c, F.lit(WHITE_SPACE))


def non_blank_lines(text: Column) -> Column:
    """Stripped lines of a text, blank ones dropped, in order."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")


def token_count(text: Column) -> Column:
    """Runs of letters, digits and underscores of any alphabet."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")).cast("long")


def is_upper(c: Column) -> Column:
    """At least one cased letter, and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def numbered_heading(c: Column) -> Column:
    return c.rlike(r"^\d+\.?\s")


def without_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d+\.?\s*", "")


def is_chapter(c: Column) -> Column:
    return c.rlike(r"^\d+\.")


def truncated(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean_font_name(c: Column) -> Column:
    """Without a subset tag in front and a style suffix behind."""
    return F.regexp_replace(F.regexp_replace(c, r"^[A-Z]{6}\+", ""), r"-(Regular|Bold|Italic|BoldItalic)$", "")


def shown(c: Column, kind: T.DataType) -> Column:
    """A value as messages print it: None for null, 1.0 for a whole double, capitalised booleans."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number_text(c)
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "True").otherwise("False")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "None").otherwise(text)


def _once(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _decimal(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _power_of_two(n: Column) -> Column:
    """2**n as a decimal, for n from 0 to 124."""
    half = (n / 2).cast("int")
    two = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).cast("decimal(19,0)")
    return _decimal(two(half) * two((n - half).cast("int")))


def _binary(size: Column) -> Column:
    """(m, e) of a double from 2**-60 to 2**63: whole numbers with size = m * 2**-e exactly, m below 2**55.

    The logarithm may be off by one next to a power of two; m then has a bit more or less, and is exact all the same.
    """
    e = (F.lit(60) - F.floor(F.log2(size))).cast("int")
    return F.struct(F.shiftright((size * F.pow(F.lit(2.0), e)).cast("long"), 7).alias("m"), (e - 7).alias("e"))


def _nearest(numerator: Column, denominator: Column) -> Column:
    """The whole number nearest to a fraction of decimals, half to even, as a long."""
    whole = lambda a, b: F.call_function("div", a, b)

    def rounded(x: Column) -> Column:
        q = whole(x["n"], x["d"])
        twice = _decimal((x["n"] - _decimal(_decimal(q) * x["d"])) * F.lit(2))
        return q + F.when((twice > x["d"]) | ((twice == x["d"]) & (q % 2 == 1)), 1).otherwise(0)

    return _once(F.struct(numerator.alias("n"), denominator.alias("d")), rounded)


def half_even(c: Column, places: int) -> Column:
    """A double rounded to 0 to 3 decimal places, half to even, by its exact binary value: 2.675 is below its half and gives 2.67.

    The double is taken apart into a whole number and a power of two, and rounded as a fraction of decimals; nothing is
    rounded twice. Doubles of 2**53 or more have no places to round; null, infinities and what is no number stay as they are.
    """
    if not 0 <= places <= 3:
        raise ValueError("places must be 0 to 3")
    ten = 10**places

    def rounded(x: Column) -> Column:
        parts = _binary(x)
        up = F.greatest(-parts["e"], F.lit(0))  # of numbers from 2**53 on, which are not asked for
        q = _nearest(_decimal(_decimal(parts["m"]) * F.lit(ten) * _power_of_two(up)), _power_of_two(F.greatest(parts["e"], F.lit(0))))
        return F.when(q < (1 << 53), q.cast("double") / F.lit(float(ten))).otherwise(F.concat(q.cast("string"), F.lit(f"E-{places}")).cast("double"))

    size = F.abs(c.cast("double"))
    small, large = size < 2.0**-60, F.isnan(size) | (size >= 2.0**53)
    safe = F.when(small | large | size.isNull(), F.lit(1.0)).otherwise(size)
    # away from a half the product with a power of ten, which is off by its last place at most, cannot be on the wrong side of it
    scaled = size * ten
    plain = (scaled < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.001)
    found = F.when(plain, F.floor(scaled + 0.5).cast("double") / F.lit(float(ten))).when(small, F.lit(0.0)).otherwise(_once(safe, rounded))
    return F.when(large | size.isNull(), c.cast("double")).otherwise(F.when(c < 0, -found).otherwise(found))


def number_text(c: Column) -> Column:
    """A double in the fewest digits that give it back, as Python prints it: 1.0, 0.1, 1e-05, 1e+16, inf, nan.

    15, 16 or 17 digits are made exactly, and the first that read back as the double are taken. Doubles below 1e-5 and from 2**62 on
    take the engine's digits, rounded to 15 or 16 where these read back as the double.
    """

    def digits(x: Column, n: int) -> Column:
        """The number of n digits nearest to x as (q, t): q * 10**t. Where the logarithm is off by one, q has a digit more or less."""
        t = (F.floor(F.log10(x)) - (n - 1)).cast("int")
        ten = lambda k: _decimal(F.pow(F.lit(10.0), F.least(F.greatest(k, F.lit(0)), F.lit(21))))  # noqa: E731  exact up to 10**22
        parts = _binary(x)
        up, down = F.greatest(-parts["e"], F.lit(0)), F.greatest(parts["e"], F.lit(0))
        q = _nearest(_decimal(_decimal(parts["m"]) * ten(-t) * _power_of_two(up)), _decimal(_power_of_two(down) * ten(t)))
        return F.concat(q.cast("string"), F.lit("E"), t.cast("string"))

    def shortest(x: Column) -> Column:
        tries = [_once(digits(x, n), lambda s: F.when(s.cast("double") == x, s)) for n in (15, 16, 17)]
        return F.coalesce(*tries, x.cast("string"))

    def fewer(x: Column, java: Column) -> Column:
        """The engine's digits, in 15 or 16 places if that is enough."""
        mantissa, power = F.split(java, "E")[0], F.coalesce(F.try_element_at(F.split(java, "E"), F.lit(2)).cast("int"), F.lit(0))
        bare = F.replace(mantissa, F.lit("."), F.lit(""))
        places = F.char_length(F.regexp_extract(mantissa, r"\.(\d+)$", 1))
        tries = []
        for n in (15, 16):
            off = F.greatest(F.char_length(bare) - n, F.lit(0))
            ten = F.pow(F.lit(10.0), off).cast("long")
            q = F.call_function("div", bare.try_cast("long") + F.call_function("div", ten, F.lit(2).cast("long")), ten)
            s = F.concat(q.cast("string"), F.lit("E"), (power - places + off).cast("string"))
            tries.append(_once(s, lambda s: F.when(s.cast("double") == x, s)))
        return F.coalesce(*tries, java)

    def written(s: Column) -> Column:
        """Digits and exponent of any form (123E-2, 1.23E0) in Python's form."""
        mantissa, power = F.split(s, "E")[0], F.coalesce(F.try_element_at(F.split(s, "E"), F.lit(2)).cast("int"), F.lit(0))
        fraction = F.char_length(F.regexp_extract(mantissa, r"\.(\d+)$", 1))
        all_digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
        bare = F.regexp_replace(all_digits, "0+$", "")
        place = F.char_length(all_digits) + power - fraction  # of the point, from the first digit

        def form(p: Column) -> Column:
            d, n, at = p["d"], F.char_length(p["d"]), p["at"]
            pad = lambda k: F.repeat(F.lit("0"), k)
            exponent = at - 1
            scientific = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(F.lit("")), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(exponent).cast("string"))), F.lit("0")))
            plain = F.when(at <= 0, F.concat(F.lit("0."), pad(-at), d)).when(n <= at, F.concat(d, pad(at - n), F.lit(".0"))).otherwise(F.concat(F.substr(d, F.lit(1), at), F.lit("."), F.substr(d, at + 1)))
            return F.when(n == 0, "0.0").when((exponent < -4) | (exponent >= 16), scientific).otherwise(plain)

        return _once(F.struct(bare.alias("d"), place.cast("int").alias("at")), form)

    size = F.abs(c.cast("double"))
    usual = (size >= 1e-5) & (size < 2.0**62)
    # whole numbers and what the engine writes with a few digits are the shortest as they are
    java = F.when(F.contains(size.cast("string"), F.lit("E")), size.cast("string")).otherwise(F.concat(size.cast("string"), F.lit("E0")))
    long = F.char_length(java) > 16
    exact = F.when(long & usual, _once(F.when(usual, size).otherwise(F.lit(1.0)), shortest)).when(long, fewer(size, java)).otherwise(java)
    text = F.when(~long & ~F.contains(size.cast("string"), F.lit("E")), size.cast("string")).otherwise(_once(exact, written))
    sign = F.when((c < 0) | (F.substring(c.cast("string"), 1, 1) == "-"), "-").otherwise("")
    return F.when(F.isnan(c), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.regexp_extract(F.lower(path), r"\.[^./]+$", 0)


def unique_name(name: Column) -> Column:
    """epoch_8hex_name: two uploads of one name never meet."""
    return F.concat_ws("_", F.unix_timestamp().cast("string"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8), name)


def display_name(name: Column, default: str) -> Column:
    """A stored name without the prefix of unique_name."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^\d+_[a-f0-9]+_", ""), F.lit("")), F.lit(default))


def full_name(first: Column, last: Column, email: Column) -> Column:
    joined = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))
    return F.coalesce(F.nullif(joined, F.lit("")), email)


def initials(first: Column, last: Column) -> Column:
    return F.upper(F.concat(F.substring(F.coalesce(first, F.lit("")), 1, 1), F.substring(F.coalesce(last, F.lit("")), 1, 1)))


def percent(part: Column, total: Column) -> Column:
    """Share in per cent to two places, half to even; 0 of nothing."""
    return F.when(total > 0, half_even(part / total * 100, 2)).otherwise(0.0)


def score(part: Column, total: Column) -> Column:
    """Whole score from 0 to 100, half to even; 0 of nothing."""
    return F.when(total > 0, half_even(part / total * 100, 0)).otherwise(0.0).cast("int")


def half_up(c: Column, places: int) -> Column:
    """A double rounded half away from zero after its product with a power of ten, as SQL engines on doubles do: 29.849999999999998 has the
    product 298.5 and gives 29.9, where the engine's own round looks at the printed digits. What the product overflows stays as it is."""
    ten = F.lit(10.0**places)
    scaled = c.cast("double") * ten
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / ten).otherwise(c.cast("double"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def tiered(c: Column, tiers: list[tuple[float, str]], rest: str) -> Column:
    """Text of the first tier whose bound c reaches."""
    out = F.lit(rest)
    for bound, text in reversed(tiers):
        out = F.when(c >= bound, text).otherwise(out)
    return out


def looked_up(c: Column, table: dict, default) -> Column:
    """A constant map with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def signature(fields: Column) -> Column:
    """The key=value lines of a map by key, without empty values: what a sign-in is signed over."""
    used = F.map_filter(fields, lambda k, v: F.coalesce(v, F.lit("")) != "")
    return F.array_join(F.transform(F.sort_array(F.map_entries(used)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest in hex, from two plain ones over the padded key (at most 64 bytes)."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ mask for x in padded)) for mask in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def joined_errors(errors: Column) -> Column:
    """An array of (loc, msg) as lines `a → b: message`, without a path where there is none."""
    line = lambda e: F.when(F.size(e["loc"]) > 0, F.concat(F.array_join(e["loc"], " → "), F.lit(": "), e["msg"])).otherwise(e["msg"])
    return F.array_join(F.transform(errors, line), "\n")


def default_id(at: Column) -> Column:
    """The id of a document that has none, by the time it is checked."""
    return F.concat(F.lit("doc_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def iso_time(at: Column) -> Column:
    """A time in ISO form; the fraction is left out where it is zero."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0{6}$", "")


def emu_to_mm(c: Column) -> Column:
    return c / 36000


def points_to_mm(c: Column) -> Column:
    return c * 0.3528


def points_to_cm(c: Column) -> Column:
    return c / 28.346


def jwt_payload(token: Column, schema: str) -> Column:
    """Claims of a JSON web token (not verified)."""
    body = F.translate(F.split(token, r"\.")[1], "-_", "+/")
    return F.from_json(F.unbase64(body).cast("string"), schema)
