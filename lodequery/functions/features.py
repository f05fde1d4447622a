"""Features of queries as columns; all are computed in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .query_text import is_latin, normalize, tokens


def _bound(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a text that is evaluated once, however often it occurs there."""
    return F.transform(F.array(text), use)[0]


def _list(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words))


def markers_in(text: Column, markers: Iterable[str]) -> Column:
    """How many of the markers are substrings of the text; repeated and overlapping ones each count."""
    return _bound(text, lambda t: F.size(F.filter(_list(markers), lambda m: F.contains(t, m))))


def any_of(text: Column, markers: Iterable[str]) -> Column:
    return _bound(text, lambda t: F.exists(_list(markers), lambda m: F.contains(t, m)))


# The patterns of a season and an episode, and the names of the features in their order.
_SEASON = r"([0-9]+)\s*(?:сезон|season|s\b)"
_EPISODE = r"([0-9]+)\s*(?:серия|эпизод|episode|eps\b)"
YEAR = "(?:^| )(19[5-9][0-9]|20[0-2][0-9])(?: |$)"

KEYS = (
    "length", "word_count", "has_digits", "digit_count", "video_marker_count", "has_video_marker", "non_video_marker_count",
    "has_non_video_marker", "has_season", "has_episode", "has_year", "season_number", "episode_number", "is_translit",
    "hint_film", "hint_series", "hint_anime", "hint_cartoon",
)


def _number(norm: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(norm, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def columns(raw: Column, norm: Column | None = None) -> dict[str, Column]:
    """The 18 features by name, in order; flags are 0 or 1. ``norm``: a column that already holds the normal form, which
    some 200 markers are looked up in; without one, each would normalise the text again."""
    text, norm = F.coalesce(raw, F.lit("")), normalize(raw) if norm is None else norm
    video, other = markers_in(norm, L.VIDEO_MARKERS), markers_in(norm, L.OTHER_MARKERS)
    digits = F.regexp_count(text, F.lit(r"\p{Nd}"))
    values = [
        F.length(text), F.size(tokens(norm)), digits > 0, digits, video, video > 0, other, other > 0, norm.rlike(_SEASON), norm.rlike(_EPISODE),
        norm.rlike(YEAR), _number(norm, _SEASON), _number(norm, _EPISODE), is_latin(norm), *(any_of(norm, L.HINTS[k]) for k in KEYS[-4:]),
    ]
    return {k: v.cast("bigint") for k, v in zip(KEYS, values)}


def vector(raw: Column, norm: Column | None = None) -> Column:
    """The features as an array of doubles."""
    return F.array(*[c.cast("double") for c in columns(raw, norm).values()])


def heuristic_type(raw: Column) -> Column:
    """1 where more signals of video intent than of another occur in the lower-case text."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return (markers_in(low, L.VIDEO_SIGNALS) > markers_in(low, L.OTHER_SIGNALS)).cast("int")


def is_generic(raw: Column) -> Column:
    """Whether a query names no work in particular: no word beyond generic ones and numbers, or one or two of them beside
    a word for a whole category."""
    words = F.array_distinct(tokens(normalize(raw)))
    own = F.size(F.filter(F.array_except(words, _list(L.GENERIC_QUERY_WORDS)), lambda w: ~w.rlike("^[0-9]+$")))
    broad = F.arrays_overlap(words, _list(L.BROAD_QUERY_WORDS))
    return (own == 0) | ((own <= 2) & broad)


def has_broad_context(raw: Column) -> Column:
    return F.arrays_overlap(tokens(normalize(raw)), _list(L.BROAD_CONTEXT_WORDS))


def type_hint(raw: Column) -> Column:
    """struct(label, score, dominance): points by substrings, the first label of the fixed order where several lead."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    points = {label: F.lit(0) for label in L.LABELS}
    for label, n, words in L.TYPE_POINTS:
        points[label] = points[label] + F.when(any_of(low, words), n).otherwise(0)
    dated = low.rlike("19[5-9][0-9]|20[0-2][0-9]|2030") & (points["сериал"] == 0) & (points["мультсериал"] == 0)
    points["фильм"] = points["фильм"] + dated.cast("int")
    ranked = F.sort_array(F.array(*[F.struct(points[x].alias("score"), F.lit(-i).alias("place"), F.lit(x).alias("label")) for i, x in enumerate(L.LABELS)]), asc=False)
    top, second = ranked[0], ranked[1]
    return F.struct(F.when(top["score"] > 0, top["label"]).otherwise("").alias("label"), top["score"].alias("score"), (top["score"] - second["score"]).alias("dominance"))


def calibrated_type(raw: Column, title_type: Column, model_type: Column, margin: Column, source: Column) -> Column:
    """The content type from a query's own hint, the title found and a model; null margin counts as a weak model."""
    from .query_text import known_label

    hint, low = type_hint(raw), F.lower(F.coalesce(raw, F.lit("")))
    label, score, lead = hint["label"], hint["score"], hint["dominance"]
    sure = (score >= 5) | (label.isin("мультфильм", "мультсериал", "сериал") & (score >= 3)) | ((label != "") & (lead >= 4)) | any_of(low, L.SURE_TYPE_WORDS)
    strong = (score >= 4) | ((score >= 3) & (lead >= 2))
    title, model = known_label(title_type), known_label(model_type)
    weak = margin.isNull() | (margin < 0.45)
    trusted = source.isin("franchise_exact", "franchise_substring", "franchise_lemma_match_strong")
    return (
        F.when(sure, label)
        .when(strong & (label != ""), label)
        .when((title != "") & (F.coalesce(trusted, F.lit(False)) | (model == "") | weak), title)
        .when(model != "", model)
        .when(title != "", title)
        .when(label != "", label)
        .otherwise(F.lit(L.OTHER))
    )
