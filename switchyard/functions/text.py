"""Text expressions: whitespace, tokens, scripts, labels, cell keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from switchyard import schema as S

# Characters that separate words (Unicode white space plus the four information
# separators U+001C-U+001F).
_WS = r"\s\x1c-\x1f"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Unicode blocks of the two native scripts.
SINHALA = (0x0D80, 0x0DFF)
TAMIL = (0x0B80, 0x0BFF)
SCRIPTS = {"sinhala": SINHALA, "tamil": TAMIL}


def words(text: Column) -> Column:
    """Whitespace-separated tokens as an array."""
    return F.filter(F.split(text, rf"(?U)[{_WS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind (plain ``trim`` only knows the blank).

    Touches the two ends only, where an anchored pattern would scan the whole text.
    """
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for '' and all-white-space text; null stays null."""
    return ~text.rlike(rf"(?U)[^{_WS}]")


def cell_id(language: Column, industry: Column, scenario: Column) -> Column:
    return F.concat_ws("__", language, industry, scenario)


def _char_class(ranges) -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def has_script(text: Column, scripts: dict[str, tuple[int, int]] | None = None) -> Column:
    """True when any one character lies in one of the script blocks; null and '' give false."""
    pattern = _char_class((scripts or SCRIPTS).values())
    return F.coalesce(text.rlike(pattern), F.lit(False))


def script_language(text: Column, scripts: dict[str, tuple[int, int]] | None = None) -> Column:
    """Name of the one script present, ``mixed_script`` for more than one, null for none."""
    found = {n: has_script(text, {n: r}) for n, r in (scripts or SCRIPTS).items()}
    hits = reduce(lambda a, b: a + b, (c.cast("int") for c in found.values()))
    named = F.when(hits > 1, F.lit("mixed_script"))
    for name, present in found.items():
        named = named.when(present, F.lit(name))
    return named


def resolve_label(
    language: Column,
    scenario: Column,
    plain_language: str = S.PLAIN_LANGUAGE,
    cheap_scenarios: tuple[str, ...] = (S.SIMPLE,),
) -> Column:
    """0 only for the plain language in a cheap scenario, otherwise 1."""
    cheap = (language == plain_language) & scenario.isin(*cheap_scenarios)
    return F.when(cheap, F.lit(0)).otherwise(F.lit(1))


def label_caption(label: Column) -> Column:
    """Label as shown in a plan: cells that always need the strong model say so."""
    return F.when(label == 1, F.lit("1 (always)")).otherwise(F.lit("0"))


def strip_label_prefixes(text: Column, prefixes: tuple[str, ...] = S.LABEL_PREFIXES) -> Column:
    """Drop each prefix at most once, in the given order and in any case, trimming after each drop.

    One anchored pattern: an optional group per prefix, each followed by its trim.
    """
    chain = "".join(rf"(?:(?i:\Q{p}\E)[{_WS}]*+)?" for p in prefixes)
    return F.regexp_replace(strip(text), rf"(?U)^{chain}", "")


def grams(tokens: Column, low: int, high: int) -> Column:
    """Word n-grams of ``low`` to ``high`` tokens, joined by one blank.

    Longer grams are shorter ones zipped with the tokens that follow.  ``tokens`` is used several
    times, so pass a plain column, not an expression.
    """
    sizes = {1: tokens}
    for n in range(2, high + 1):
        left = F.size(tokens) - (n - 1)
        joined = F.zip_with(
            F.slice(sizes[n - 1], F.lit(1), left),
            F.slice(tokens, F.lit(n), left),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        sizes[n] = F.when(left >= 1, joined).otherwise(F.array().cast("array<string>"))
    return F.concat(*[sizes[n] for n in range(low, high + 1)])


def model_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def padded(words_: Column) -> Column:
    """Every word with a blank on both sides."""
    return F.transform(words_, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def char_grams(word: Column, low: int, high: int) -> Column:
    """All substrings of ``low`` to ``high`` characters of one padded word; a shorter word counts whole."""

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))
        short = F.array(word) if n == low else F.array().cast("array<string>")
        return F.when(F.length(word) >= n, cut).otherwise(short)

    return F.concat(*[of_size(n) for n in range(low, high + 1)])
