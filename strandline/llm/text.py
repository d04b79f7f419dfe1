"""Text clean-up for workers."""

from __future__ import annotations

import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>|&[a-z]{2,8};|&#\d{1,6};")
_URL = re.compile(r"\bhttps?://\S+|\bwww\.\S+")
#: A lead byte of UTF-8 read as a letter, followed by another byte of it.
_SUSPECT = re.compile("[\u00c2\u00c3\u00d0\u00d1\u00e2][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]|\ufffd")
_MARKS = re.compile("[\u0300-\u036f]+")
_DIGITS = {ord(c): "0" for c in "123456789"}
_SPACE = re.compile(r"[^\S\n]+")
_BREAK = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\s*\n+\s*")


def repair(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, once, where that lowers the count of suspicious pairs."""
    if text.isascii() or not (bad := len(_SUSPECT.findall(text))):
        return text
    for code in ("cp1252", "latin-1"):
        try:
            again = text.encode(code).decode("utf-8")
        except UnicodeError:
            continue
        if len(_SUSPECT.findall(again)) < bad:
            return again
    out = "".join(_byte(c) for c in text)  # a mixture of both, piece by piece
    fixed = re.sub(r"[\x80-\xff]{2,}", lambda m: _utf8(m.group()), out)
    return fixed if len(_SUSPECT.findall(fixed)) < bad else text


def _byte(c: str) -> str:
    try:
        return c if ord(c) < 256 else c.encode("cp1252").decode("latin-1")
    except UnicodeError:
        return c


def _utf8(s: str) -> str:
    try:
        return s.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return s


def masked(text: str) -> str:
    """Markup and addresses as blanks, a character for a character, so positions stay."""
    blank = lambda m: " " * len(m.group())
    return _URL.sub(blank, _TAG.sub(blank, text))


def squeezed(text: str) -> str:
    """Repaired, with single ordinary spaces."""
    return _SPACE.sub(" ", repair(text)).strip()


def plain(text: str) -> str:
    """Without markup and addresses, with ordinary spaces."""
    return squeezed(masked(text))


def folded(text: str) -> str:
    """Lower case, without accents, digits as 0, single spaces."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    return " ".join(low.translate(_DIGITS).split())


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences of a text: cut after closing punctuation and at line breaks, without blanks around."""
    out, at = [], 0
    for start, end in [m.span() for m in _BREAK.finditer(text)] + [(len(text), len(text))]:
        piece = text[at:start]
        if bare := piece.strip():
            first = at + len(piece) - len(piece.lstrip())
            out.append((first, first + len(bare)))
        at = end
    return out


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]
