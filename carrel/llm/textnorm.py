"""Text folding shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones, and dashes and quotes by their plain form.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ѵ": "v", "һ": "h",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}


def _fold_char(c: str) -> str:
    """Lower-case plain form of one character: compatibility forms, accents and look-alikes removed."""
    out = []
    for d in unicodedata.normalize("NFKD", c).casefold():
        if not unicodedata.combining(d):
            out.append(LOOKALIKES.get(d, d))
    return "".join(out)


class _FoldTable(dict):
    """str.translate table that is filled as characters come up; at most one entry a code point."""

    def __missing__(self, code: int) -> str:
        self[code] = v = _fold_char(chr(code))
        return v


FOLD = _FoldTable()


class _SqueezeTable(dict):
    """As FOLD, with everything but letters and digits dropped."""

    def __missing__(self, code: int) -> str:
        self[code] = v = "".join(c for c in _fold_char(chr(code)) if c.isalnum())
        return v


SQUEEZE = _SqueezeTable()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.translate(FOLD)


def words(text: str) -> list[str]:
    """Runs of letters or digits, folded."""
    return _WORD.findall(text.translate(FOLD))


def squeeze(text: str) -> str:
    """Only the folded letters and digits."""
    return text.translate(SQUEEZE)


def squeeze_with_offsets(text: str) -> tuple[str, list[int]]:
    """squeeze(text) and, for each of its characters, the offset of its origin in text."""
    out, at = [], []
    for i, c in enumerate(text):
        for d in SQUEEZE[ord(c)]:
            out.append(d)
            at.append(i)
    return "".join(out), at
