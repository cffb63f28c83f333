"""Words of a text, however they are set down."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_TIME = re.compile(r"(?m)^[ \t]*(?:\d+[ \t]*\n)?[ \t]*(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3}[ \t]*-->.*$|^[ \t]*WEBVTT.*$|\[?\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\]?")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|wbr|sup|sub|mark|small)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")
#: Letters of other scripts that look like Latin ones, and digits read for letters.
_ALIKE = str.maketrans("авекмнорстухіјѕԁһӏαεικνορτυχ", "abekmhopctyxijsdhlaeiknoptux")
_DIGITS = str.maketrans("013457", "olesat")


def spelled(text: str) -> str:
    """The text without markup, caption times and invisible characters, folded to plain lower-case letters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        if not text.isascii():
            text = _UNSEEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if ":" in text:
        text = _TIME.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    text = text.casefold()
    return text if text.isascii() else text.translate(_ALIKE)


def words(text: str | None) -> list[str]:
    """Words in order; a digit inside a word is read as the letter it looks like."""
    plain = spelled(text or "")
    out = _WORD.findall(plain)
    if not _DIGIT.search(plain):
        return out
    return [w if w.isalpha() or w.isdigit() else w.translate(_DIGITS) for w in out]
