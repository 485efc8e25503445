"""Text expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import AREA_WORDS, STOP_WORDS



def _fixed_map(values: dict[str, str]) -> Column:
    """A map that is made once, while the plan is; from_json() of a text would read it again for each lookup. Lookups go from its start."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


@cache
def _fold() -> tuple[str, str, dict[str, str]]:
    """By compatibility decomposition: characters that leave one ASCII character, these, and those that leave several."""
    import sys
    import unicodedata

    left = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(c))}
    one = {c: p for c, p in left.items() if len(p) == 1}
    return "".join(one), "".join(one.values()), {c: p for c, p in left.items() if len(p) > 1}


def ascii_fold(c: Column) -> Column:
    """Characters as what compatibility decomposition leaves of them in ASCII: letters without their marks; all others beyond ASCII go."""
    marked, plain, several = _fold()
    without = F.translate(c, "".join(several), "")  # a look at each character; a class of so many signs would try them one by one
    spelt = _fixed_map(several)
    wide = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(spelt[x], x)), "")
    return F.regexp_replace(F.translate(F.when(without != c, wide).otherwise(c), marked, plain), r"[^\x00-\x7F]", "")


@cache
def _bases() -> tuple[str, str]:
    """By canonical decomposition: letters with marks and then all marks, and these letters without them."""
    import sys
    import unicodedata

    left = {chr(c): "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn") for c in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(c))}
    one = {c: p for c, p in left.items() if len(p) == 1 and p != c}
    marks = (chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn")
    return "".join([*one, *(c for c in marks if c not in one)]), "".join(one.values())


def word_tokens(c: Column) -> Column:
    """Words of a text in lower case and without marks, in order: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.translate(c, *_bases())), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def title_tokens(c: Column) -> Column:
    """Words of a title in lower case, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(ascii_fold(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def normalized_title(c: Column) -> Column:
    return F.array_join(title_tokens(c), " ")


def normalized_area(c: Column) -> Column:
    return F.array_join(F.filter(title_tokens(c), lambda w: ~w.isin(*AREA_WORDS)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def single_line(c: Column, fallback: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")), F.lit(fallback))


_ENTITY = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;)"


def unescaped(c: Column) -> Column:
    """Entities as characters, in one pass: numbers, and all names with their semicolon; unknown ones stay."""
    from html.entities import html5

    simple = c
    for coded, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        simple = F.replace(simple, F.lit(coded), F.lit(plain))
    frequent = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;")
    names = _fixed_map({f"&{k}": html5[k] for k in (*frequent, *html5) if k.endswith(";")})

    def decoded(e: Column) -> Column:
        digits = F.regexp_extract(e, "^&#[xX]?([0-9a-fA-F]+);?$", 1)
        number = F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        good = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        said = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(e.startswith("&#"), F.when(good, said).otherwise(F.lit("\ufffd"))).otherwise(F.coalesce(names[e], e))

    found = F.regexp_extract_all(c, F.lit(f"({_ENTITY})"), F.lit(1))
    between = F.split(c, _ENTITY, -1)
    # Both arrays are a lambda's arguments: what stands inside one is worked out anew for each entity.
    whole = F.array_join(F.zip_with(between, found, lambda text, e: F.concat(text, F.coalesce(decoded(e), F.lit("")))), "")
    other = c.rlike("&(?!(?:lt|gt|quot|amp|#39);)(?:#|[A-Za-z])")
    return F.when(other, whole).otherwise(simple)


def clean_markup(c: Column, most: int = 4000) -> Column:
    """Entities back to characters first, then tags to blanks, white space squeezed, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(unescaped(c), "<[^>]*>", " "), r"\s+", " ")), 1, most)


def safe_url(c: Column) -> Column:
    """An http(s) address without credentials, else null."""
    return F.when(c.rlike(r"^(?i)https?://[^/@\s]+(/[^\s]*)?([?#][^\s]*)?$"), c)


def redacted_url(c: Column) -> Column:
    """safe_url with the values of secret parameters struck out."""
    return F.regexp_replace(safe_url(c), r"(?i)([?&#](?:api_key|token|secret|password|appid)=)[^&#]*", "$1REDACTED")


def host_label(c: Column) -> Column:
    return F.split_part(F.regexp_replace(F.regexp_extract(c, "//([^/]+)", 1), r"^www\.", ""), F.lit("."), F.lit(1))


def csv_cell(c: Column, numeric: bool = False) -> Column:
    """A quoted cell; a sign that a spreadsheet would run gets a tab before it, unless the cell is a number."""
    line = single_line(c.cast("string"))
    guarded = F.when(line.rlike("^[=+\\-@＝＋－＠]"), F.concat(F.lit("\t"), line)).otherwise(line)
    if numeric:
        guarded = F.when(c.try_cast("double").isNotNull(), F.regexp_replace(c.cast("string"), r"\.0$", "")).otherwise(guarded)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
