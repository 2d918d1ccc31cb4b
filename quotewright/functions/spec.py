"""The three normalisation tiers and edit similarity over plain strings: the meaning that Column versions follow."""

from __future__ import annotations

import unicodedata

TIERS = ("light", "standard", "aggressive")
KASHIDA = "ـ"
# Ranges of marks that the standard tier drops, and letters that it and the aggressive tier fold.
MARKS = [(0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED)]
ALEFS = ("آأإٱ", "اااا")
LOSSY = ("ىة", "يه")
ARABIC = (0x0600, 0x06FF)


class _Folds(dict):
    """A translation table that works out a code point's image when it is first met."""

    def __init__(self, tier: str):
        super().__init__()
        self.level = TIERS.index(tier)

    def __missing__(self, point: int):
        c = chr(point)
        if c == KASHIDA:
            out = None
        elif self.level >= 1 and any(low <= point <= high for low, high in MARKS):
            out = None
        else:
            if self.level >= 1 and c in ALEFS[0]:
                c = ALEFS[1][ALEFS[0].index(c)]
            if self.level >= 2:
                if c in LOSSY[0]:
                    c = LOSSY[1][LOSSY[0].index(c)]
                elif not ARABIC[0] <= point <= ARABIC[1]:
                    c = " "
            out = c
        self[point] = out
        return out


_FOLDS = {tier: _Folds(tier) for tier in TIERS}


def normalize(text: str | None, tier: str) -> str | None:
    """The text at a tier; a null stays null. An unknown tier raises ValueError."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; expected one of {TIERS}")
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFC", text).translate(_FOLDS[tier]).split())


def levenshtein(a: str, b: str) -> int:
    """Edit distance in code points."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def ratio(a: str, b: str) -> float:
    """1 - distance / longer length; 0.0 for two empty strings."""
    longest = max(len(a), len(b))
    return 1 - levenshtein(a, b) / longest if longest else 0.0
