"""Freely typed titles and the entries of a reference list that they mean.

Token-level repair: every token is joined to the words of the reference list by edit distance (slips of the hand), by
sound (Latin spellings), by keyboard and by look-alike letters, through an index of the list's words and their one-letter
deletions. The corrected tokens are combined with soft TF-IDF to rank whole entries, and an entry is accepted only when
its words, the words left over and the number of a sequel all agree.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

from . import spelling as sp
from .keyed import key_pieces, key_reading

# Words that join the words of a title, words around a title, words after season and episode numbers,
# words for a part, and ordinals of parts.
JOINING = frozenset("и из на в с о the a an of from and".split())
AROUND = frozenset(
    "фильм сериал мультфильм мультсериал кино аниме передача шоу мультик film movie serial series "
    "смотреть посмотреть онлайн все серии серия полностью бесплатно скачать hd online полный".split()
)
COUNTED = frozenset("сезон сезона сезоны серия серии серий выпуск выпуски эпизод sezon seriya serii season episode ctpjy cthbz".split())
PART = frozenset("часть части part chast".split())
ORDINALS = {w: n for n, w in enumerate("первая вторая третья четвертая пятая шестая седьмая восьмая девятая десятая одиннадцатая двенадцатая".split(), 1)} | {
    w: n for n, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), 1)
}

_ROMAN = re.compile(r"x{0,3}(?:ix|iv|v?i{0,3})$")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10}
#: A bare number after a title in a query is that of a sequel below this one.
COUNTS = 20

_JOINING_SOUNDS = frozenset(map(sp.skeleton, JOINING))
_AROUND_SOUNDS = frozenset(map(sp.skeleton, AROUND))
_LATIN = re.compile("[a-z]")
_YEAR = re.compile(r"(?:19|20)\d\d$")
_SPLIT = re.compile(r"\s+")
_KEYS = re.compile(r"([a-z0-9\[\];',.`{}:\"<>~]+)")


def joins(word: str) -> bool:
    return word in JOINING or bool(_LATIN.match(word)) and sp.skeleton(word) in _JOINING_SOUNDS


def stand_alone(word: str) -> bool:
    return word in AROUND or bool(_LATIN.match(word)) and sp.skeleton(word) in _AROUND_SOUNDS


def is_year(word: str) -> bool:
    return bool(_YEAR.match(word))


def roman(word: str) -> int | None:
    """The number of a Roman numeral to XXXIX; a lone I or X is no numeral but a letter."""
    if word in ("", "i", "x") or not _ROMAN.match(word):
        return None
    values = [_ROMAN_VALUES[c] for c in word]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def numeral(word: str) -> int | None:
    """A number in digits or Roman numerals; years are none."""
    return (None if is_year(word) else int(word)) if word.isdecimal() else roman(word)


def sequel(words: list[str], loose: bool = False) -> tuple[list[int], int | None]:
    """(positions that are no title words, number of the sequel). With ``loose`` the words are a whole query, where a bare
    number counts only if nothing says that it counts seasons; numbers of episodes are no title words either."""
    out: set[int] = set()
    number = None
    for i, w in enumerate(words):
        if w in PART:
            for j in (i + 1, i - 1):
                if 0 <= j < len(words):
                    n = ORDINALS.get(words[j]) or numeral(words[j])
                    if n:
                        number = n
                        out |= {i, j}
                        break
        elif is_year(w):
            out.add(i)
    for i, w in enumerate(words):
        if i in out:
            continue
        n = numeral(w)
        if n is None:
            continue
        if loose and (i + 1 < len(words) and words[i + 1] in COUNTED or i and words[i - 1] in COUNTED and not (i + 1 < len(words) and words[i + 1].isdigit())):
            out.add(i)
        elif not loose and number is None and n > 1 and i > 0:
            number = n
            out.add(i)
    return sorted(out), None if number == 1 else number


def stem(word: str) -> str:
    """A name's sound without the vowels it ends on, which cases change."""
    return sp.skeleton(word).rstrip("aeiouy")


def is_latin(words: Iterable[str]) -> bool:
    return any(map(_LATIN.search, words))


Form = tuple[int, tuple[str, ...], "int | None", bool]


def spelling_words(spelling: str) -> tuple[list[str], int | None]:
    """All words of a spelling but years, the number of a sequel and a leading word for its type."""
    words = [sp.looked(w) for w in sp.word_list(spelling)]
    drop, number = sequel(words)
    kept = [w for i, w in enumerate(words) if i not in drop] or words
    return (kept[1:] if len(kept) > 2 and kept[0] in AROUND else kept), number


def entry_forms(spellings: Iterable[str | None]) -> tuple[list[tuple[tuple[str, ...], int | None]], list[tuple[tuple[str, ...], int | None]], list[tuple[tuple[str, ...], int | None]]]:
    """(Cyrillic, Latin, joined) forms of an entry's spellings, each its words and the number of a sequel. Joining words are
    no part of a form unless there are no others; joined forms are all words of a spelling as one."""
    cyrillic, latin, joined = {}, {}, {}
    for s in spellings:
        words, number = spelling_words(s or "")
        if kept := [w for w in words if w not in JOINING] or words:
            (latin if _LATIN.search(" ".join(kept)) else cyrillic)[tuple(kept), number] = None
        if len(words) > 1:
            joined[("".join(words),), number] = None
    return list(cyrillic), list(latin), list(joined)


def word_pairs(cyrillic: list, latin: list) -> set[tuple[str, str]]:
    """Russian and English words that stand at the same place in two spellings of an entry."""
    return {(a, b) for ru, _ in cyrillic for en, _ in latin if len(ru) == len(en) for a, b in zip(ru, en) if sp.skeleton(a) != sp.skeleton(b)}


def translated_form(words: tuple[str, ...], english: Callable[[str], str | None]) -> tuple[str, ...]:
    """A Russian form in English, words that ``english`` lacks as their sound."""
    return tuple(english(w) or "~" + stem(w) for w in words)


def word_keys(word: str) -> list[str]:
    """Keys by which a word of the reference list is found, see :func:`token_keys`."""
    if word[0] == "~":
        return ["w:" + word]
    sound = sp.skeleton(word)
    return ["w:" + word, "s:" + sound, *("d:" + k for k in sp.deletions(word)), *("e:" + k for k in sp.deletions(sound) if not _LATIN.search(word))]


def token_keys(token: str) -> list[str]:
    """Keys that a token shares with every word that :func:`likeness` finds like it."""
    out = ["w:" + token]
    if token.isdigit():
        return out
    sound = sp.skeleton(token)
    out += ["s:" + sound, *("d:" + k for k in sp.deletions(token))]
    if _LATIN.search(token):
        out += ["w:~" + stem(sound), *("e:" + k for k in sp.deletions(sound))]
        if (a := sp.all_looked(token)) is not None:
            out.append("w:" + a)
    return out


def likeness(token: str, word: str) -> float:
    """How surely a token means a word of the reference list, from 0 to 1."""
    if token == word:
        return 1.0
    if token.isdigit():
        return 0.0
    latin, sound = bool(_LATIN.search(token)), sp.skeleton(token)
    if word[0] == "~":
        return 0.95 if latin and word == "~" + stem(sound) else 0.0
    other = bool(_LATIN.search(word))
    if latin and sp.all_looked(token) == word or latin != other and sound == sp.skeleton(word):
        return 0.97
    if sp.is_slip(token, word):
        return 0.9
    return 0.85 if latin and not other and sp.is_slip(sound, sp.skeleton(word)) else 0.0


def _chunks(text: str) -> Iterator[str]:
    for part in _SPLIT.split(text):
        yield from _KEYS.split(part)


def tokens(text: str, longest: int) -> list[str]:
    """All tokens that :class:`Matcher` may ask for this text, on a reference list whose longest word has ``longest`` letters."""
    text = sp.clean(text)
    out = {sp.looked(w) for w in sp._WORD.findall(text)}
    if any(map(_LATIN.search, out)):
        for chunk in _chunks(text):
            if _LATIN.search(chunk):
                out.update(w for piece in key_pieces(chunk, longest) for w in piece)
    return sorted(out)


class Matcher:
    """Ranks entries for texts. ``repaired`` gives the reference words that a token may mean, with likenesses; ``idf`` their
    rarity, ``unknown`` that of a word no entry has; ``forms`` the forms worth trying for such repairs."""

    def __init__(self, repaired: Callable[[str], Mapping[str, float]], idf: Callable[[str], float], unknown: float, longest: int, forms: Callable[[list[Mapping[str, float]]], Iterable[Form]]):
        self.repaired, self.idf, self.unknown, self.longest, self.forms = repaired, idf, unknown, longest, forms

    def readings(self, text: str) -> list[list[str]]:
        """The readings of a text: as typed, and with every chunk of keys that has Latin letters as on a Russian keyboard."""
        text = sp.clean(text)
        typed = [sp.looked(w) for w in sp._WORD.findall(text)]
        if not any(map(_LATIN.search, typed)):
            return [typed]
        keyed: list[str] = []
        told = lambda w: w in AROUND or w in JOINING or w in COUNTED or w in PART or self.repaired(w)
        for chunk in _chunks(text):
            if not _LATIN.search(chunk):
                keyed += [sp.looked(w) for w in sp._WORD.findall(chunk)]
            else:
                keyed += key_reading(chunk, lambda w: (0 if w.isdigit() else len(w)) - (len(w) if told(w) else 0), self.longest)
        return [typed, keyed]

    def candidates(self, words: list[str]) -> Iterator[tuple[float, Form, dict[int, str]]]:
        """(soft TF-IDF, form, reference words by token position) of the forms all of whose words are among the tokens, each at
        a place of its own."""
        repairs = [self.repaired(w) for w in words]
        norm = math.fsum(max((self.idf(r) for r in m), default=0 if joins(w) or stand_alone(w) else self.unknown) ** 2 for w, m in zip(words, repairs)) or 1.0
        for form in self.forms(repairs):
            got: dict[str, tuple[float, int]] = {}
            for r in dict.fromkeys(form[1]):
                for at, m in enumerate(repairs):
                    if m.get(r, 0.0) > got.get(r, (0.0, 0))[0]:
                        got[r] = (m[r], at)
                if r not in got:
                    break
            else:
                used = {at: r for r, (_, at) in got.items()}
                if len(used) == len(form[1]):
                    score = math.fsum(self.idf(r) ** 2 * sim for r, (sim, _) in got.items()) / math.sqrt(norm * math.fsum(self.idf(r) ** 2 for r in form[1]))
                    yield score, form, used

    def title(self, text: str) -> tuple[int, float] | None:
        """The entry that a whole text names, with a score; None if it names none. Everything in the text must belong to
        the title, but for years and words around titles."""
        best = None
        for words in self.readings(text):
            drop, number = sequel(words)
            left = [w for i, w in enumerate(words) if i not in drop]
            for score, (i, form, n, latin), used in self.candidates(left):
                if n != number or any(not joins(w) and not stand_alone(w) for at, w in enumerate(left) if at not in used):
                    continue
                ordered = [used[at] for at in sorted(used)] == list(form)
                rank = (round(score, 9), ordered, -i)
                if (ordered or not latin) and (best is None or rank > best):
                    best = rank
        return best and (-best[2], best[0])

    def named(self, text: str) -> tuple[int, float] | None:
        """The entry that a query names among other words. A number right after the title, or with a word for a part, is
        that of a sequel unless a word for seasons or episodes claims it. From ``COUNTS`` on a number after the title is
        one of lines or episodes, unless the list has that sequel."""
        best = None
        for words in self.readings(text):
            drop, number = sequel(words, loose=True)
            left = [(at, w) for at, w in enumerate(words) if at not in drop]
            fitting = list(self.candidates([w for _, w in left]))
            listed = {(form, n) for _, (_, form, n, _), _ in fitting}
            for score, (i, form, n, latin), used in fitting:
                ordered = [used[at] for at in sorted(used)] == list(form)
                if latin and not ordered:
                    continue
                wanted, after = number, max(left[at][0] for at in used) + 1
                if wanted is None and after < len(words) and after not in drop:
                    said = numeral(words[after])
                    if said is not None and (1 < said < COUNTS or (form, said) in listed):
                        wanted = said
                bare = [w for at, w in enumerate(words) if at not in drop and w.isdigit()]
                if n != wanted and not (wanted is None and n is not None and str(n) in bare):
                    continue
                rank = (n == wanted, round(math.fsum(self.idf(r) for r in form), 6), ordered, round(score, 9), -i)
                if best is None or rank > best:
                    best = rank
        return best and (-best[4], best[3])


class Reference(Matcher):
    """A matcher on a reference list held in one process: (id, spellings). The list of any size is ``canonical.matched``."""

    def __init__(self, entries: Iterable[tuple[int, list[str]]]):
        parts = [(i, *entry_forms(spellings)) for i, spellings in entries]
        pairs = Counter(p for _, cyrillic, latin, _ in parts for p in word_pairs(cyrillic, latin))
        english: dict[str, str] = {}
        for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            english.setdefault(a, b)
        every: dict[tuple, None] = {}
        for i, cyrillic, latin, joined in parts:
            named = [] if latin else [(translated_form(w, english.get), n) for w, n in cyrillic]
            every |= dict.fromkeys((i, w, n) for w, n in [*cyrillic, *latin, *named, *joined])
        df = Counter(w for _, words, _ in every for w in set(words))
        postings, found = defaultdict(list), defaultdict(list)
        for i, words, n in every:
            postings[min(words, key=lambda w: (df[w], w))].append((i, words, n, is_latin(words)))
        for w in df:
            for k in word_keys(w):
                found[k].append(w)
        idf = {w: math.log(1 + len(every) / n) for w, n in df.items()}

        @lru_cache(None)
        def repaired(token: str) -> dict[str, float]:
            return {w: x for k in token_keys(token) for w in found.get(k, ()) if (x := likeness(token, w)) > 0}

        super().__init__(repaired, idf.__getitem__, math.log(1 + len(every)), max(map(len, df), default=0), lambda repairs: [f for r in {r for m in repairs for r in m} for f in postings.get(r, ())])
