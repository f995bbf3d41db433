"""Column functions: cleaning, parsing, arithmetic.  All run inside the JVM but for the two Arrow UDFs at the end."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prematch import schema


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- strings ----------------------------------------------------------------------


#: A string that cleaning would change: white space other than one space between words.
_UNCLEAN = r"(?U)^\s|\s$|\s\s|[^\S ]"


def clean_string(c: Column | str) -> Column:
    """Trimmed, white space (of any script) collapsed; empty becomes null."""
    text = _col(c).cast("string")
    # most strings have no white space to deal with
    return F.nullif(F.when(text.rlike(_UNCLEAN), F.trim(F.regexp_replace(text, r"(?U)\s+", " "))).otherwise(text), F.lit(""))


def known_spelling(c: Column | str, spellings: dict[str, str], missing: str = "Unknown") -> Column:
    """Of a cleaned string: known spellings replaced, others passed through, null made ``missing``."""
    text = _col(c)
    made = F.when(text.isNull(), F.lit(missing))
    for old, new in spellings.items():
        if old != new:
            made = made.when(text == old, F.lit(new))
    return made.otherwise(text)


def allowed_title(c: Column | str, allowed: list[str], missing: str = "Unknown") -> Column:
    """Of a cleaned string: title-cased if that is an allowed value, else ``missing``."""
    text = F.lower(_col(c))
    made = F.when(text.isNull(), F.lit(missing))
    for value in allowed:
        made = made.when(text == value.lower(), F.lit(value))
    return made.otherwise(F.lit(missing))


def recode(c: Column | str, spellings: dict[str, str], missing: str = "Unknown") -> Column:
    """``known_spelling`` of a string that isn't cleaned yet."""
    return known_spelling(clean_string(c), spellings, missing)


def one_of(c: Column | str, allowed: list[str], missing: str = "Unknown") -> Column:
    """``allowed_title`` of a string that isn't cleaned yet."""
    return allowed_title(clean_string(c), allowed, missing)


def series(c: Column | str) -> Column:
    return recode(c, schema.SERIES)


def round_name(c: Column | str) -> Column:
    return recode(c, schema.ROUNDS)


def court(c: Column | str) -> Column:
    return one_of(c, schema.COURTS)


def surface(c: Column | str) -> Column:
    return one_of(c, schema.SURFACES)


def completed(comment: Column | str) -> Column:
    """The comment, cleaned, says "completed" in any case."""
    return F.lower(clean_string(comment)) == "completed"


def full_name(first: Column | str, last: Column | str) -> Column:
    return F.trim(F.concat(F.coalesce(_col(first), F.lit("")), F.lit(" "), F.coalesce(_col(last), F.lit(""))))


def hand(c: Column | str) -> Column:
    """"U" (unknown) becomes null."""
    return F.nullif(_col(c), F.lit("U"))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """The same key for both orders of two names; a missing name reads "nan"."""
    x, y = (F.coalesce(_col(c).cast("string"), F.lit("nan")) for c in (a, b))
    return F.concat_ws("||", F.least(x, y), F.greatest(x, y))


def first_in_pair(a: Column | str, b: Column | str) -> Column:
    """1 if a comes first (or equal) in the pair's order."""
    x, y = (F.coalesce(_col(c).cast("string"), F.lit("nan")) for c in (a, b))
    return (x <= y).cast("int")


def year_in(c: Column | str) -> Column:
    """The first year 20xx in a string such as a file name."""
    return F.try_to_number(F.nullif(F.regexp_extract(_col(c), r"(20\d{2})", 1), F.lit("")), F.lit("9999")).cast("int")


# --- names in two conventions ------------------------------------------------------


def ascii_words(c: Column | str) -> Column:
    """Names of ASCII letters as compared: lower case; hyphen, underscore and full stop are spaces, apostrophes go, all else is a space."""
    spaced = F.translate(F.lower(_col(c)), "-_.'", "   ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9\s]", " "), r"\s+", " "))


def surname_first(normal: Column | str) -> tuple[Column, Column]:
    """(surname, initial) of a normalised "nadal r": the last word's first letter is the initial."""
    words = F.split(_col(normal), " ")
    n = F.size(words)
    several = n > 1
    name = F.when(several, F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ")).otherwise(_col(normal))
    return name, F.when(several, F.substring(F.element_at(words, -1), 1, 1)).otherwise("")


def surname_last(normal: Column | str) -> tuple[Column, Column]:
    """(surname, initial) of a normalised "rafael nadal": the first word's first letter is the initial."""
    words = F.split(_col(normal), " ")
    n = F.size(words)
    name = F.when(n > 1, F.array_join(F.slice(words, 2, F.greatest(n - 1, F.lit(1))), " ")).otherwise(_col(normal))
    return name, F.substring(F.element_at(words, 1), 1, 1)


# --- dates --------------------------------------------------------------------------


def to_date(c: Column | str, pattern: str | None = None) -> Column:
    """A date, or null where it can't be read (ANSI mode would raise)."""
    c = _col(c)
    return (F.try_to_timestamp(c.cast("string"), F.lit(pattern)) if pattern else F.try_to_timestamp(c.cast("string"))).cast("date")


def age_years(day: Column | str, birth: Column | str) -> Column:
    return F.datediff(_col(day), _col(birth)) / F.lit(365.25)


def iso(day: Column | str) -> Column:
    return F.date_format(_col(day), "yyyy-MM-dd")


# --- numbers -------------------------------------------------------------------------


def number(c: Column | str) -> Column:
    """A double, or null where it can't be read or is NaN."""
    return F.nanvl(_col(c).cast("string").try_cast("double"), F.lit(None).cast("double"))


def whole(c: Column | str) -> Column:
    """Rounded half to even, as a long."""
    return F.bround(_col(c)).cast("long")


def positive(c: Column | str) -> Column:
    """Null unless above 0 (ranks)."""
    return F.when(_col(c) > 0, _col(c))


def not_negative(c: Column | str) -> Column:
    """Null if below 0 (points)."""
    return F.when(_col(c) >= 0, _col(c))


def odds(c: Column | str) -> Column:
    """Decimal odds; null unless above 1."""
    return F.when(_col(c) > 1.0, _col(c))


def implied(c: Column | str) -> Column:
    """Reciprocal of decimal odds, the book's margin left in."""
    return F.try_divide(F.lit(1.0), _col(c))


def rate(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom, null over 0."""
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def flipped(c: Column | str) -> Column:
    """The negative, without a negative zero."""
    return F.lit(0.0) - _col(c)


def missing(c: Column | str) -> Column:
    return _col(c).isNull().cast("int")


def any_present(columns: list[str]) -> Column:
    return F.coalesce(*columns).isNotNull().cast("int")


def coin(key: Column | str, seed: int = 42) -> Column:
    """A fair coin that depends on the key and seed alone: 1 or 0."""
    return F.pmod(F.xxhash64(_col(key), F.lit(seed)), F.lit(2)).cast("int")


# --- rendering ------------------------------------------------------------------------


def format_cell(value: object, width: int = 48) -> str:
    """A cell of the viewer: a mark for what is missing, short numbers, long text cut with an ellipsis."""
    text = "" if value is None else str(value).strip()
    if text == "" or text.lower() in ("nan", "none", "nat"):
        return "∅"
    read = parse_number(text)
    if read is not None:
        return str(int(read)) if read == int(read) and abs(read) < 1e15 else f"{read:.6g}"
    return text if len(text) <= width else text[: width - 1] + "…"


def parse_number(text: str) -> float | None:
    """A finite number, or None."""
    try:
        read = float(text)
    except (TypeError, ValueError):
        return None
    return read if read == read and abs(read) != float("inf") else None


# --- Arrow UDFs, for distinct names only -----------------------------------------------


def normal_name(text: str | None) -> str:
    """Accents dropped, then as ``ascii_words``."""
    if text is None:
        return ""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", plain.translate({ord("'"): None, **dict.fromkeys(map(ord, "-_."), " ")})).split())


def indel_ratio(a: str, b: str) -> float:
    """Similarity of 0 to 100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    # one bit per character of a; a cleared bit is a step of the subsequence
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    state = full
    for ch in b:
        hit = state & at.get(ch, 0)
        state = (state + hit | state - hit) & full
    common = len(a) - state.bit_count()
    return 100.0 * 2 * common / (len(a) + len(b))


@F.pandas_udf(T.StringType())
def normal_name_udf(names: pd.Series) -> pd.Series:
    return names.map(normal_name)


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
