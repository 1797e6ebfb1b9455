"""Words of texts that may be TeX: maximal runs of letters and digits, whatever their spelling.

Case, accents (typed or as TeX), ligatures, punctuation, spacing, line breaks, hyphenation, comment signs and command
names do not count. Arguments of commands are words, except those of \\cite..., \\label and \\ref.
"""

from __future__ import annotations

import re
import unicodedata

#: TeX's letter commands, and letters that Unicode does not decompose.
TEX_LETTERS = {"ss": "ss", "SS": "ss", "ae": "ae", "AE": "ae", "oe": "oe", "OE": "oe", "o": "o", "O": "o", "l": "l", "L": "l", "aa": "a", "AA": "a", "i": "i", "j": "j", "dj": "d", "DJ": "d", "dh": "d", "DH": "d", "th": "th", "TH": "th"}
LETTERS = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ȷ": "j"})

_LETTER = r"(?:\\[ij](?![A-Za-z])\s*|[A-Za-z])"
_SIGN = rf"[\"'`^~=.]\s*(?:\{{\s*{_LETTER}\s*\}}|{_LETTER})"
_NAMED = rf"[cvHkrudbt](?:\s*\{{\s*{_LETTER}\s*\}}|\s+{_LETTER})"
_LIG = rf"(?:{'|'.join(sorted(TEX_LETTERS, key=len, reverse=True))})(?![A-Za-z])"
_ARG = r"(?:\s*\[[^\[\]]*\])*\s*\{[^{}]*\}"

#: One scan over the text. Groups: acc, lig give letters; gap gives a break; what has no group joins its neighbours.
MARKUP = re.compile(
    rf"\\(?:(?P<gap>\\|(?:cite[A-Za-z]*\*?|(?:label|ref)(?![A-Za-z])){_ARG})|(?P<acc>{_SIGN}|{_NAMED})|(?P<lig>{_LIG})(?:\s*\{{\}}|[ \t]*\n?)|-|(?P<name>[A-Za-z@]+\*?|[^A-Za-z]))"
    rf"|\{{\\(?:(?P<acc2>{_SIGN}|{_NAMED})|(?P<lig2>{_LIG}))\s*\}}"
    r"|-[ \t]*\r?\n[ \t]*(?:%+[ \t]*)*"
    "|\xad(?:[ \t]*\r?\n[ \t]*(?:%+[ \t]*)*)?"
)
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
_LAST_LETTER = re.compile(r"([A-Za-z])\s*\}?\s*$")


def _meaning(m: re.Match) -> str:
    kind = m.lastgroup
    if kind in ("acc", "acc2"):
        return _LAST_LETTER.search(m.group(kind)).group(1)
    if kind in ("lig", "lig2"):
        return TEX_LETTERS[m.group(kind)]
    return " " if kind else ""


def fold(text: str) -> str:
    """Lower case, ligatures apart, accents off."""
    text = unicodedata.normalize("NFKD", text).casefold().translate(LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for null."""
    if not text:
        return []
    text = MARKUP.sub(_meaning, text)
    return ASCII_WORD.findall(text.lower()) if text.isascii() else WORD.findall(fold(text))


def words_at(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words, each with the [start, end) that it takes up in ``text``. Slower: for the few texts that need it."""
    if not text:
        return [], []
    out: list[str] = []
    at: list[int] = []
    last = 0

    def plain(a: int, b: int) -> None:
        for i in range(a, b):
            c = fold(text[i])
            out.append(c)
            at.extend([i] * len(c))

    for m in MARKUP.finditer(text):
        plain(last, m.start())
        got = _meaning(m).casefold()
        out.append(got)
        at.extend([m.start()] * (len(got) - 1) + [m.end() - 1] * bool(got))
        last = m.end()
    plain(last, len(text))
    flat = "".join(out)
    found = [(m.group(), (at[m.start()], at[m.end() - 1] + 1)) for m in WORD.finditer(flat)]
    return [w for w, _ in found], [s for _, s in found]
