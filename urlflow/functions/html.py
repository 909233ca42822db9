"""HTML by tokens: exact link extraction and text terms, as Arrow UDFs over the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mining import PATTERN
from .stem import stem
from .url import BAD_ESCAPE, BAD_HOST, CONTROL, DYNAMIC_SUFFIXES, URI

_LINKED = frozenset({"a", "link", "frame", "form"})
_ATTRIBUTES = frozenset({"href", "src", "action"})
_URI, _ESCAPE, _HOST, _CONTROL = (re.compile(p) for p in (URI, BAD_ESCAPE, BAD_HOST, CONTROL))
_MINE = re.compile(PATTERN, re.ASCII)


def _parts(url: str) -> tuple[str, str, str]:
    m = _URI.match(url)
    return (m[1] or "").lower(), re.sub("^.*@", "", m[2] or ""), m[3] or ""


def _absolute(url: str) -> bool:
    scheme, host, path = _parts(url)
    return bool(scheme and host) and not (_CONTROL.search(url) or _ESCAPE.search(path) or _HOST.search(host))


def resolve(ref: str, current: str) -> str:
    """url.resolve() for one reference."""
    scheme, host, path = _parts(current)
    if "http" not in ref and not ref.startswith("//"):
        if not ref:
            return ""
        if ref.endswith(".js") or ref.startswith("/"):
            return f"{scheme}://{host}{ref}"
        ext = re.search(r"(\.[^./]*)$", path)
        dynamic = not current.endswith("/") and ("?" in current or (ext and ext[1] in DYNAMIC_SUFFIXES))
        joined = (f"{scheme}://{host}" + re.sub("/?[^/]*$", "", path) + "/" if dynamic else current) + ref
        return f"{scheme}://{ref}" if joined.count(".") > 3 or not _absolute(joined) else joined
    if ref.startswith("//"):
        return f"{scheme}:{ref}"
    return ref if ref.startswith(("http://", "https://")) else ""


#: Elements whose content is text up to their end tag, and those of them in which character references count.
_RAW = frozenset({"iframe", "noembed", "noframes", "plaintext", "script", "style", "textarea", "title", "xmp"})
_ESCAPABLE = frozenset({"textarea", "title"})


_LIST = pa.list_(pa.string())


def _by_slices(one: Callable, html: pa.Array, *others: pa.Array, most: int = 1 << 20) -> pa.Array:
    """one() of every row, in slices of about `most` bytes of HTML: of a batch's lists only a slice's are Python objects at a time."""
    total = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, i = [pa.array([], _LIST)], 0
    while i < len(html):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        out.append(pa.array([one(*row) for row in zip(*(c.slice(i, j - i).to_pylist() for c in (html, *others)), strict=True)], _LIST))
        i = j
    return pa.concat_arrays(out)


class _Tokens(HTMLParser):
    """Tags, comments and texts, each text whole: from one tag or comment to the next."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.held: list[str] = []

    def tag(self, name: str, attrs: list) -> None: ...

    def comment(self, data: str) -> None: ...

    def text(self, data: str) -> None: ...

    def _flush(self) -> None:
        if self.held:
            self.text("".join(self.held))
            self.held.clear()

    def _raw(self, tag: str) -> None:
        if tag in _RAW:
            self.set_cdata_mode(tag)
            if tag == "plaintext":
                self.interesting = re.compile(r"(?!)")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        self.tag(tag, attrs)
        self._raw(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """Self-closing tags give nothing."""
        self._flush()
        self._raw(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        self.held.append(unescape(data) if self.cdata_elem in _ESCAPABLE else data)

    def handle_comment(self, data: str) -> None:
        self._flush()
        self.comment(data)

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self.handle_comment("?" + data)

    def unknown_decl(self, data: str) -> None:
        self.handle_comment(f"[{data}]]")

    def close(self) -> None:
        super().close()
        if self.cdata_elem and self.rawdata:  # an element that isn't ended
            self.handle_data(self.rawdata)
        self._flush()


def _serialised(data: str) -> str:
    """Text as it stands in HTML."""
    return escape(data).replace("&quot;", "&#34;").replace("&#x27;", "&#39;")


class _Links(_Tokens):
    """Links of tags come first, the last tag's before the others'; URLs found in scripts' tags, comments (with their signs) and texts follow in order."""

    def __init__(self, current: str):
        super().__init__()
        self.current, self.tags, self.found = current, [], []

    def tag(self, name: str, attrs: list) -> None:
        if name in _LINKED:
            own = [resolve(v or "", self.current) for k, v in attrs if k in _ATTRIBUTES and "javascript" not in (v or "") and v != "#"]
            self.tags = own + self.tags
        elif name == "script":
            self._mine("<script" + "".join(f' {k}="{_serialised(v or "")}"' for k, v in attrs) + ">")

    def comment(self, data: str) -> None:
        self._mine("<!--" + unescape(data).replace("&", "&amp;") + "-->")

    def text(self, data: str) -> None:
        self._mine(_serialised(data))

    def _mine(self, text: str) -> None:
        got = dict.fromkeys(resolve(m, self.current) for m in (x[0] for x in _MINE.finditer(text)))
        self.found += [u for u in got if u]


def page_links(html: str | None, current: str | None) -> list[str] | None:
    """All links of a page; '' for references that resolve to nothing."""
    if html is None or current is None:
        return None
    p = _Links(current)
    p.feed(html)
    p.close()
    return p.tags + p.found


@F.arrow_udf(T.ArrayType(T.StringType()))
def extract_links(html: pa.Array, current: pa.Array) -> pa.Array:
    return _by_slices(page_links, html, current)


@F.pandas_udf(T.StringType())
def resolve_rfc3986(ref: pd.Series, current: pd.Series) -> pd.Series:
    """The standard's resolution; null where it fails."""

    def one(r, c):
        try:
            return None if r is None or c is None else urljoin(c, r)
        except ValueError:
            return None

    return pd.Series([one(r, c) for r, c in zip(ref, current, strict=True)], dtype=object)


class _Texts(_Tokens):
    def __init__(self):
        super().__init__()
        self.texts: list[str] = []

    def text(self, data: str) -> None:
        if word := data.strip():
            self.texts.append(stem(word))


def page_terms(html: str | None) -> list[str] | None:
    """Every text token of a page, trimmed, lower-cased and stemmed as one word."""
    if html is None:
        return None
    p = _Texts()
    p.feed(html)
    p.close()
    return p.texts


@F.arrow_udf(T.ArrayType(T.StringType()))
def vector_terms(html: pa.Array) -> pa.Array:
    return _by_slices(page_terms, html)
