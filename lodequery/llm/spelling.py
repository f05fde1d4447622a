"""Ways in which the same word is keyed in: other keyboard, other alphabet, look-alike letters, a slip of the hand."""

from __future__ import annotations

import re

# The keys of a Latin keyboard and the Russian letters on them, without and with shift.
KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,.~{}:\"<>"
ON_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбюёхъжэбю"
# Latin letters (and one digit) that look like the Cyrillic ones below them.
LOOKS = "aceopxykmhtbiu3"
LOOKED = "асеорхукмнтвіи3"
# Latin spellings of Russian letters; the first is the commonest, the others are found as well.
LATIN = {
    "а": ("a",), "б": ("b",), "в": ("v", "w"), "г": ("g",), "д": ("d",), "е": ("e", "ye", "je"), "ё": ("yo", "e", "jo"),
    "ж": ("zh", "j"), "з": ("z",), "и": ("i",), "й": ("y", "j", "i"), "к": ("k",), "л": ("l",), "м": ("m",), "н": ("n",),
    "о": ("o",), "п": ("p",), "р": ("r",), "с": ("s",), "т": ("t",), "у": ("u",), "ф": ("f",), "х": ("kh", "h", "x"),
    "ц": ("ts", "c", "tz"), "ч": ("ch",), "ш": ("sh",), "щ": ("shch", "sch", "shh"), "ъ": ("",), "ы": ("y",), "ь": ("",),
    "э": ("e",), "ю": ("yu", "ju", "iu"), "я": ("ya", "ja", "ia"),
}

_FROM_KEYS = str.maketrans(KEYS, ON_KEYS)
_LOOKS = str.maketrans(LOOKS, LOOKED)
_LOOKS_BACK = str.maketrans(LOOKED[:12], LOOKS[:12])
_WORD = re.compile(r"[^\W_]+")
_KEYED = re.compile(r"[a-z0-9\[\];',.`{}:\"<>~]+")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[a-z]")
_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


def clean(text: str) -> str:
    return text.translate(_INVISIBLE).lower()


def word_list(text: str) -> list[str]:
    return _WORD.findall(clean(text))


def from_keys(text: str) -> str:
    """What the same keys give on a Russian keyboard."""
    return text.translate(_FROM_KEYS)


def looked(word: str) -> str:
    """A word of mixed alphabets with its look-alike letters in the alphabet that has letters of no look-alike, or in
    Cyrillic where both have or neither; ё as е. Words of one alphabet stay."""
    if _LATIN.search(word) and _CYRILLIC.search(word):
        turned = word.translate(_LOOKS)
        word = word.translate(_LOOKS_BACK) if _LATIN.search(turned) and not _CYRILLIC.search(word.translate(_LOOKS_BACK)) else turned
    return word.replace("ё", "е")


def all_looked(word: str) -> str | None:
    """A purely Latin word as the Cyrillic one it may look like, if all its letters have a look-alike."""
    turned = word.translate(_LOOKS)
    return turned.replace("ё", "е") if not _LATIN.search(turned) and _LATIN.search(word) else None


_TO_LATIN = str.maketrans({k: v[0] for k, v in LATIN.items()} | {"ё": "e"})
# What the spellings of LATIN leave different, in one pass over Latin letters.
_SOUNDS = {"shch": "w", "sch": "w", "shh": "w", "zh": "q", "kh": "h", "ch": "4", "sh": "6", "ts": "c", "tz": "c", "x": "h", "'": ""}
_SOUND = re.compile("|".join(sorted(_SOUNDS, key=len, reverse=True)))
_GLIDE = re.compile("[yji]+(?=[aeou])")


def skeleton(word: str) -> str:
    """The same for a Russian word and all its Latin spellings; distinct words may rarely share it."""
    word = _SOUND.sub(lambda m: _SOUNDS[m.group()], word.translate(_TO_LATIN))
    word = _GLIDE.sub("y", word).replace("yo", "e").replace("ye", "e")
    return re.sub("i+", "i", re.sub("[yj](?![au])", "i", word))


def is_slip(a: str, b: str, least: int = 5) -> bool:
    """Whether one slip of the hand makes one word of the other: a letter left out, doubled, swapped with the next, or
    hit wrong. The first letter is always right, and only a swap reaches the last (another ending is another word form). Words with digits have no slips, nor do words under ``least`` letters (the longer one
    counts), where a slip is mostly another word."""
    if a == b or abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < least or a[0] != b[0] or any(c.isdigit() for c in a + b):
        return False
    if len(a) == len(b):
        off = [i for i in range(len(a)) if a[i] != b[i]]
        if len(off) == 1:
            return 0 < off[0] < len(a) - 1
        return len(off) == 2 and off[1] == off[0] + 1 and off[0] > 0 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]
    short, long = sorted((a, b), key=len)
    i = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    return short[i:] == long[i + 1 :] and i < len(long) - 1


def deletions(word: str, least: int = 5) -> list[str]:
    """Keys by which :func:`is_slip` pairs meet: the word itself and with each inner letter left out."""
    if len(word) < least - 1 or any(c.isdigit() for c in word):
        return []
    return list({word, *(word[:i] + word[i + 1 :] for i in range(1, len(word)))})


def transliterations(text: str) -> list[str]:
    """Whole texts in Latin letters by each of three common systems."""
    out = []
    for k in range(3):
        table = {ord(c): s[min(k, len(s) - 1)] for c, s in LATIN.items()}
        out.append(text.lower().translate(table))
    return out
