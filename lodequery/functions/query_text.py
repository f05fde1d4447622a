"""Column functions on query texts and titles. Null texts count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

_BLANK = r"[\s\u001c-\u001f\u0085   -     　]"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def normalize(c: Column) -> Column:
    """Lower case, everything but Latin and Russian letters and digits one space, trimmed."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), "[^a-zа-яё0-9]+", " ")), F.lit(""))


def lemmatize(c: Column, enabled: bool = False) -> Column:
    """The normal form by word forms; as no morphology is at hand, the identity, and an error where it is asked for."""
    if enabled:
        raise NotImplementedError("no morphological dictionary is available")
    return c


def variant_form(c: Column) -> Column:
    """Lower case with other characters deleted, not replaced by a space; trimmed."""
    return stripped(F.regexp_replace(F.lower(c), r"[^a-zа-яё0-9\s]", ""))


def default_process(c: Column) -> Column:
    """Every character that is no letter, digit or underscore a space; trimmed; lower case."""
    return F.lower(stripped(F.regexp_replace(c, r"(?U)\W", " ")))


def tokens(c: Column) -> Column:
    """The parts between spaces of a normal form, without empty ones."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def is_latin(c: Column) -> Column:
    """Whether there is an ASCII letter and no Cyrillic character; false for null."""
    return F.coalesce(c.rlike("[A-Za-z]") & ~c.rlike(r"[Ѐ-ӿ]"), F.lit(False))


def transliterate(c: Column) -> Column:
    """Latin letters as Cyrillic ones, groups before single letters; lower case, stripped."""
    out = F.lower(stripped(c))
    for latin, cyrillic in L.LATIN_GROUPS:
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    return F.translate(out, L.LATIN_LETTERS, L.CYRILLIC_LETTERS)


def in_cyrillic(c: Column) -> Column:
    """Wholly Latin texts transliterated, all others as they are."""
    return F.when(is_latin(c), transliterate(c)).otherwise(c)


def clean_title(c: Column) -> Column:
    """A title without remarks in parentheses, a year at the end and a leading word for its type; stripped."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\(.*?\)", "")
    out = F.regexp_replace(out, r"\s+\d{4}$", "")
    return stripped(F.regexp_replace(out, r"(?iu)^(?:фильм|сериал|мультфильм|аниме)\s+", ""))


def title_variants(title: Column, year: Column) -> Column:
    """Sorted distinct aliases: the title and its normal form, each without ё and, where the year is digits, with it."""
    norm, year = normalize(title), F.coalesce(year, F.lit(""))
    dated = year.rlike("^[0-9]+$")
    plain = [title, norm, F.replace(title, F.lit("ё"), F.lit("е")), F.replace(norm, F.lit("ё"), F.lit("е"))]
    every = F.array(*plain, *[F.when(dated, F.concat(t, F.lit(" "), year)) for t in (title, norm)])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != "")))


def chosen_title(current: Column, incoming: Column) -> Column:
    """The better written of two titles with one normal form; the current one where the forms differ."""
    same = normalize(current) == normalize(incoming)
    plain, new_plain = current == normalize(current), incoming == normalize(incoming)
    compact = F.replace(incoming, F.lit(" ")) != F.replace(current, F.lit(" "))
    better = (plain & ~new_plain) | ((F.length(incoming) > F.length(current)) & compact)
    return F.when(same & better, incoming).otherwise(current)


def is_year(token: Column) -> Column:
    """Four digits from 1950 to 2035."""
    return token.rlike("^[0-9]{4}$") & F.try_to_number(token, F.lit("9999")).between(1950, 2035)


def has_phrase(query: Column, title: Column) -> Column:
    """Whether the normal form of the title stands in that of the query, at word bounds."""
    q, t = normalize(query), normalize(title)
    return (t != "") & (q != "") & F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))


def vetoed(query: Column, title: Column) -> Column:
    """Whether a title of one or two characters, not all digits, is to be ignored as the query does not hold it."""
    compact = F.replace(normalize(title), F.lit(" "))
    return (compact != "") & ~compact.rlike("^[0-9]+$") & (F.length(compact) <= 2) & ~has_phrase(query, title)


def content_type(c: Column) -> Column:
    """One of the labels; anything else, null included, is the last of them."""
    label = F.lower(stripped(c))
    return F.when(label.isin(*L.LABELS), label).otherwise(F.lit(L.OTHER))


def known_label(c: Column) -> Column:
    """One of the labels, or empty."""
    label = F.lower(stripped(c))
    return F.when(label.isin(*L.LABELS), label).otherwise(F.lit(""))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_position(same, False).cast("int") - 1, F.lit(0)) + F.when(F.array_contains(same, False), 0).otherwise(n + 1))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))
