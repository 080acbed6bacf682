"""Texts as sequences of plain words, whatever mark-up, wrapping and odd characters they came with."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_WRAPPED = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n[ \t>|]*(?=\w)")
_QUOTED_LINE = re.compile(r"(?m)^[ \t]*[>|][> |\t]*")
_WORD = re.compile(r"[^\W\d_]+|\d+(?:[:.,]\d+)*")


def plain_words(text: str) -> list[str]:
    """Words and numbers in lower case without accents; a time or number with inner marks is one word of its digits."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _QUOTED_LINE.sub("", _WRAPPED.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", "".join(ch for ch in text if unicodedata.category(ch) != "Cf").casefold())
        text = "".join(ch for ch in text if not unicodedata.combining(ch))
    else:
        text = text.lower()
    return [re.sub(r"\D", "", w) if w[0].isdigit() else w for w in _WORD.findall(text)]
