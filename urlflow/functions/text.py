"""Text, encoding and header expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_FOUND = ("not found", "页面不存在", "<title>404")
LOGIN_WORDS = ("用户登录", "忘记密码")
CLICK_BLACKLIST = ("lougout", "登出", "reset")
EXCLUDED_TAGS = ("SCRIPT", "STYLE", "IMG", "LINK", "META", "TITLE", "HEAD", "HTML", "DIV")


def base64_text(x: Column) -> Column:
    """Standard alphabet, no line breaks whatever the session's setting."""
    return F.regexp_replace(F.base64(F.encode(x, "UTF-8")), "[\r\n]", "")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def probe_token(seed: str, url: Column) -> Column:
    """Ten characters for a URL that won't exist; the same for the same seed."""
    return F.substring(F.md5(F.concat(F.lit(seed), url)), 1, 10)


def title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


def is_not_found(html: Column) -> Column:
    """A not-found page by its words."""
    return html.rlike("(?i)" + "|".join(NOT_FOUND))


def is_not_found_titled(html: Column) -> Column:
    return title(html).contains("404") | is_not_found(html)


def is_login_page(url: Column, html: Column) -> Column:
    """By URL, by title, or by words in the page."""
    t = title(html)
    words = html.contains(LOGIN_WORDS[0]) | html.contains(LOGIN_WORDS[1]) | (html.contains("登录") & html.contains("密码"))
    return F.lower(url).contains("/login") | t.contains("登录") | F.lower(t).contains("login") | words


def links(html: Column) -> Column:
    """href of every a tag, as written."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))


def usable_links(refs: Column) -> Column:
    return F.filter(refs, lambda x: ~x.contains("javascript") & (x != "#"))


def text_terms(html: Column) -> Column:
    """Texts between tags, trimmed and lower-cased; each is one term. html.vector_terms() has the exact tokens, stemmed."""
    parts = F.transform(F.split(html, "<[^>]*>"), lambda x: F.lower(F.regexp_replace(x, "^[ \t\r\n]+|[ \t\r\n]+$", "")))
    return F.filter(parts, lambda x: x != "")


def is_blacklisted(node: Column, words: tuple[str, ...] = CLICK_BLACKLIST) -> Column:
    """A node's markup has a word of the list."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(node), w))


def is_excluded_tag(tag: Column) -> Column:
    return F.upper(tag).isin(*EXCLUDED_TAGS)


def canonical_header(name: Column) -> Column:
    """As MIME headers are written: Content-Type."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "-")


def headers_map(pairs: Column) -> Column:
    """Map from canonical name to values, in order, of an array of (name, value)."""
    names = F.array_distinct(F.transform(pairs, lambda p: canonical_header(p["name"])))
    values = F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: canonical_header(p["name"]) == n), lambda p: p["value"]))
    return F.map_from_arrays(names, values)
