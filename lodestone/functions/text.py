"""Text expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that part tokens.  White space as Unicode has it, full-width
# punctuation, the ASCII apostrophe, and CJK ideographs; other ASCII punctuation stays in tokens.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN_BREAKS = f"[{_SPACES}，。、！？；：'【】《》（）一-鿿]+"


# Those of ASCII, and the others: a class of many parts costs Java five times the time of one of few.
_ASCII_BREAKS = r"[\t-\r\x1c-\x20']+"
_WIDE_BREAKS = TOKEN_BREAKS.replace(r"\s\x0b\x1c-\x1f", "").replace("'", "")


def tokens(text: Column) -> Column:
    """Tokens in small letters, in order, with repeats."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.split(low, _ASCII_BREAKS, -1)
    finer = F.flatten(F.transform(parts, lambda t: F.when((F.octet_length(t) > F.char_length(t)) & F.rlike(t, F.lit(_WIDE_BREAKS)), F.split(t, _WIDE_BREAKS, -1)).otherwise(F.array(t))))
    return F.filter(F.when(F.octet_length(low) > F.char_length(low), finer).otherwise(parts), lambda t: t != "")


def shortened(text: Column, size: int = 200) -> Column:
    """The first characters, with dots if any are left out."""
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def preview(text: Column, size: int = 120) -> Column:
    """One line of the first characters."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("..."))).otherwise(flat)


def shown_score(score: Column) -> Column:
    """Four places, rounded from the double's exact value, halves to even; N/A for null.

    score * 10,000 is worked out as a double and what that double lacks, so that halves of the
    shortest decimal, which the double itself may miss on either side, are told from true ones.  Beyond
    2^53 the digits are those of the shortest decimal.
    """
    size = F.abs(score)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # the upper half of the digits
    low = size - high
    product = high * 10000.0 + low * 10000.0
    lacking = (high * 10000.0 - product) + low * 10000.0
    whole = F.floor(product)
    over = (product - whole - 0.5) + lacking
    units = F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole).cast("long")
    sign = F.when((score < 0) | (score.cast("string") == "-0.0"), "-").otherwise("")
    shown = F.concat(sign, F.floor(units / 10000).cast("string"), F.lit("."), F.lpad((units % 10000).cast("string"), 4, "0"))
    odd = F.when(F.isnan(score), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.format_string("%.4f", score))
    return F.when(score.isNull(), "N/A").when(size < 1e9, shown).otherwise(odd)  # from there on a double has no half at the fifth place


def source_label(metadata: Column, unknown: str = "未知文档") -> Column:
    """The source, else the name that the metadata has for the file, else a fixed text; null metadata has neither."""
    return F.coalesce(metadata["source"], metadata["doc_name"], F.lit(unknown))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places; what is put in is never read as a template again."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)
