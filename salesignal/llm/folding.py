"""Folds text so that look-alike spellings meet: case, accents, homoglyphs and digits written for letters. Combining marks and code points that show nothing go; any other code point stays one."""

from __future__ import annotations

import unicodedata

import numpy as np

# Letters of other scripts that look like Latin ones, by Latin letter.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "ьβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ",
}
# Digits and signs written for letters; signs count only between letters.
DIGITS = dict(zip("01345789", "oieastbg", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i"}
SPACE = ord(" ")


# Unicode's default-ignorable code points (soft hyphen, joiners, zero-width spaces, selectors, tags), first and last.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Stands for code points that go.
GONE = 0xFFFFFFFF
_LIKE = {ord(x): ord(latin) for latin, others in HOMOGLYPHS.items() for x in others}


def _one(c: int) -> int:
    """What a code point is folded to: GONE, SPACE, or a letter or digit."""
    if 0xD800 <= c < 0xE000:
        return SPACE
    if any(a <= c <= b for a, b in IGNORABLE) or unicodedata.category(chr(c))[0] == "M":
        return GONE
    if 0x3400 <= c < 0xD800:  # ideographs and syllables have no case and no look-alikes here
        return c
    base = next((x for x in unicodedata.normalize("NFKD", chr(c)) if x.isalnum()), " ").lower()[0]
    if not base.isalnum():
        return SPACE
    if base in DIGITS:
        return ord(DIGITS[base])
    return _LIKE.get(ord(base), _LIKE.get(c, ord(base)))


_made: list[np.ndarray] = []
#: Code points beyond the table that were met, folded.
_far: dict[int, int] = {}


def fold(text: str) -> np.ndarray:
    """Code points of text, folded, without marks and ignorable ones; whatever else is neither letter nor digit is a space."""
    if not _made:
        _made.append(np.array([_one(c) for c in range(0x10000)], np.uint32))
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _made[0][np.minimum(raw, 0xFFFF)]
    far = np.flatnonzero(raw > 0xFFFF)
    if len(far):
        met, which = np.unique(raw[far], return_inverse=True)
        for c in met.tolist():
            if c not in _far:
                _far[c] = _one(c)
        out[far] = np.array([_far[c] for c in met.tolist()], np.uint32)[which]
    stays = out != GONE
    if not stays.all():
        raw, out = raw[stays], out[stays]
    for sign, letter in SIGNS.items():
        at = np.flatnonzero(raw == ord(sign))
        at = at[(at > 0) & (at < len(raw) - 1)]
        at = at[(out[at - 1] != SPACE) & (out[at + 1] != SPACE)]
        out[at] = ord(letter)
    return out


def folded(text: str) -> str:
    return fold(text).tobytes().decode("utf-32-le")
