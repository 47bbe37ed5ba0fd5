"""Text functions that follow the semantics of the file format's usual readers, which are those of JavaScript strings."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[\\x{300}-\\x{36f}]"
WORD = "A-Za-z0-9_"
QUALIFIERS = "ABT|EST|CAL|BET|BEF|AFT|FROM|TO"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Without white space of any kind, and byte order marks, at both ends."""
    return F.regexp_replace(col(x), "(?U)^[\\s\\x{feff}]+|[\\s\\x{feff}]+$", "")


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


#: The parts of Hangul syllables, from the first of each kind, and how many there are of each.
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def _bare(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not 0x300 <= ord(c) <= 0x36F)


@cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters whose decomposition is one letter and marks, and those letters; then the others but Hangul, with their parts."""
    codes = [c for c in range(0xC0, 0x110000) if not (0xD800 <= c < 0xE000 or HANGUL <= c < HANGUL + 11_172 or 0x300 <= c <= 0x36F)]
    pairs = [(chr(c), rest) for c in codes if (rest := _bare(chr(c))) != chr(c)]
    single = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single), tuple((a, b) for a, b in pairs if len(b) != 1)


def _syllables(x: Column) -> Column:
    """Hangul syllables as their parts, which follow from their number."""
    lead, vowel, tail = ("".join(chr(first + i) for i in range(n)) for first, n in (LEADS, VOWELS, TAILS))

    def parts(c: Column) -> Column:
        n = F.ascii(c) - HANGUL
        at = lambda letters, i: F.substr(F.lit(letters), i + 1, F.lit(1))
        last = F.when(n % 28 > 0, at(tail, n % 28)).otherwise("")
        made = F.concat(at(lead, F.floor(n / 588).cast("int")), at(vowel, F.floor(n % 588 / 28).cast("int")), last)
        return F.when(n.between(0, 11_171), made).otherwise(c)

    return F.array_join(F.transform(F.split(x, ""), parts), "")


def strip_accents(x: Column | str) -> Column:
    """Canonical decomposition without combining marks of U+0300 to U+036F. Letters of several parts, and Hangul, are only
    looked for in texts that have some; marks of other kinds keep their order."""
    one, folded, several = _folding()
    x = F.translate(col(x), one, folded)
    parts = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in several)), F.lit(","), F.lit(":"))
    more = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(parts, c), c)), "")
    x = F.when(x.rlike("[" + "".join(f"\\x{{{ord(a):x}}}" for a, _ in several) + "]"), more).otherwise(x)
    x = F.when(x.rlike(f"[\\x{{{HANGUL:x}}}-\\x{{{HANGUL + 11_171:x}}}]"), _syllables(x)).otherwise(x)
    return F.regexp_replace(x, MARKS, "")


def norm_place(x: Column | str) -> Column:
    """For lookups of places: no accents, trimmed, lower case."""
    return F.lower(trim(strip_accents(x)))


def norm_country(x: Column | str) -> Column:
    """For lookups of countries: lower case, no accents or punctuation, single spaces."""
    kept = F.regexp_replace(strip_accents(F.lower(col(x))), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def norm_border(x: Column | str) -> Column:
    """For names of borders: letters and spaces only; inner spaces stay as they are."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(x)), "[^a-z ]", ""))


def tokens(x: Column | str) -> Column:
    """The parts between commas, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(col(x), ","), trim), lambda t: t != "")


def country_token(x: Column | str) -> Column:
    """The last part that isn't blank, else null."""
    return F.try_element_at(tokens(x), F.lit(-1))


def parse_year(x: Column | str) -> Column:
    """The first run of three or four digits that stands alone."""
    found = F.regexp_extract(col(x), f"(?<![{WORD}])([0-9]{{3,4}})(?![{WORD}])", 1)
    return found.try_cast("int")


def is_approximate(x: Column | str) -> Column:
    return col(x).rlike(f"(?i)(?<![{WORD}])({QUALIFIERS})(?![{WORD}])")


def parse_date(x: Column | str) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.struct(x.alias("raw"), parse_year(x).alias("year"), is_approximate(x).alias("approximate")))


def parse_coord(x: Column | str) -> Column:
    """A signed decimal, or one after N, S, E or W, which settle the sign; else null."""
    pattern = r"^([NSEWnsew])?(?U:\s)*(-?[0-9]+(?:\.[0-9]+)?)$"
    value = trim(x)
    number = F.regexp_extract(value, pattern, 2).try_cast("double")
    side = F.upper(F.regexp_extract(value, pattern, 1))
    return F.when(side.isin("S", "W"), -F.abs(number)).when(side.isin("N", "E"), F.abs(number)).otherwise(number)


def valid_coord(lat: Column | str, lng: Column | str) -> Column:
    return (F.abs(col(lat)) <= 90) & (F.abs(col(lng)) <= 180)


def parse_name(x: Column | str) -> Column:
    """`given /surname/`; without slashes all is the given name. Blank parts are null."""
    x, pattern = col(x), "^(.*?)/(.*?)/"
    slashed = x.rlike(pattern)
    given = F.when(slashed, F.regexp_extract(x, pattern, 1)).otherwise(x)
    surname = F.when(slashed, F.regexp_extract(x, pattern, 2))
    return F.struct(blank_to_null(trim(given)).alias("given"), blank_to_null(trim(surname)).alias("surname"))


def display_name(given: Column | str, surname: Column | str, id_: Column | str) -> Column:
    joined = F.concat_ws(" ", blank_to_null(given), blank_to_null(surname))
    return F.coalesce(blank_to_null(joined), col(id_))


def number_text(x: Column | str) -> Column:
    """A number without a fraction of zero: `39`, `44.64`."""
    return F.regexp_replace(col(x).cast("string"), r"\.0$", "")
