"""URLs in free text.

The pattern is written without nested quantifiers that the JVM's engine would try in
every division: brackets are unrolled and their insides possessive, and the word border
is ASCII's. A linear-time engine (the oracle's) reads the plain form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADS = [r"https?://", r"www[0-9]{0,3}\.", r"[.\-0-9a-z]+\.[a-z]{2,4}/"]
_CHAR = r"[^()<>\s]"
_LAST = "[^\\s" + "".join("\\" + c for c in "[](){}") + "<>`!?.,;:'\"" + "«»‘’“”]"
_WORD = "[0-9A-Za-z_]"


def _jvm() -> str:
    char = _CHAR.replace(r"\s", r"\t\n\f\r ")
    last = _LAST.replace(r"\s", r"\t\n\f\r ")
    border = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
    group = rf"\({char}*+(?:\({char}++\){char}*+)*+\)"
    body = f"(?:{char}+(?:{group}{char}*)*|(?:{group}{char}*)+)"
    return f"(?i){border}((?:{'|'.join(_HEADS)}){body}(?:{group}|{last}))"


def _linear() -> str:
    group = rf"\((?:{_CHAR}+|\({_CHAR}+\))*\)"
    return rf"(?i)\b((?:{'|'.join(_HEADS)})(?:{_CHAR}+|{group})+(?:{group}|{_LAST}))"


PATTERN = _jvm()
LINEAR_PATTERN = _linear()


def mine_urls(text: Column) -> Column:
    """All URLs in a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))
