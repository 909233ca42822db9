"""URL expressions: decomposition, generalisation, fingerprint, resolution.

All are built-in Column expressions, so they stay in whole-stage code generation and
can be pushed below exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: scheme, authority, path, query, fragment.
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
BAD_ESCAPE = r"%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"
CONTROL = r"[\x00-\x1f\x7f]"
BAD_HOST = r"[ <>\"]|:[^0-9:\]]+$"

_KINDS = {
    "archive": "dll zip rar tar gz gz2 bz2 cab apk exe dmg iso bin dat crt",
    "font": "woff2 woff ttf otf",
    "image": "png jpg jpeg gif bmp webp svg ico tiff tif psp pct mng drw ai eps dxf ps pst qt",
    "sound": "mp3 wav wma ogg aac aiff m4a mid au ra",
    "video": "mp4 mpg mpeg avi wmv mov flv 3gp m4v asf asx rm rmvb swf",
    "office": "pdf doc docx xls xlsx ppt pptx odt odp ods odg wps csv txt xsl",
    "web": "css less map rss exif",
}
#: Suffixes of resources that are neither reported nor opened.
STATIC_SUFFIXES = sorted(f".{x}" for xs in _KINDS.values() for x in xs.split())
DYNAMIC_SUFFIXES = [".action", ".asp", ".php"]


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URI, i)


def decode_path(x: Column) -> Column:
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """With port, without user."""
    return F.regexp_replace(_part(url, 2), "^.*@", "")


def path(url: Column) -> Column:
    """Decoded; null where an escape is malformed."""
    return decode_path(_part(url, 3))


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def parseable(url: Column) -> Column:
    """False for a null URL, control characters, malformed escapes in the path, and blanks or a bad port in the host."""
    bad = url.rlike(CONTROL) | _part(url, 3).rlike(BAD_ESCAPE) | host(url).rlike(BAD_HOST)
    return F.coalesce(~bad, F.lit(False))


def without_fragment(url: Column) -> Column:
    """Cut at the last #."""
    return F.regexp_replace(url, "(?s)#[^#]*$", "")


def suffix(url: Column) -> Column:
    """Of the path, with its dot; what follows an & is ignored."""
    return F.regexp_extract(path(F.substring_index(url, "&", 1)), r"(\.[^./]*)$", 1)


def is_static(url: Column) -> Column:
    """A static resource's suffix, or no URL at all."""
    return ~parseable(F.substring_index(url, "&", 1)) | F.coalesce(suffix(url).isin(STATIC_SUFFIXES), F.lit(True))


def is_static_for_frontier(url: Column) -> Column:
    """Scripts are reported but not opened."""
    return is_static(url) | F.coalesce(suffix(url) == ".js", F.lit(True))


def is_integer(x: Column) -> Column:
    """An optional sign and digits that fit 64 bits."""
    return x.rlike("^[+-]?[0-9]+$") & x.try_cast("bigint").isNotNull()


def general_path(p: Column) -> Column:
    """Runs of digits become the word number; a path that isn't empty ends with /."""
    x = F.regexp_replace(p, "[0-9]+", "number")
    return F.when((x != "") & ~x.endswith("/"), F.concat(x, F.lit("/"))).otherwise(x)


def _decoded(x: Column) -> Column:
    return F.try_url_decode(x)


def params(q: Column) -> Column:
    """Array of (key, pos, value) of a query string in its order; pairs with ; or malformed escapes are dropped."""
    pairs = F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.contains(";") & ~x.rlike(BAD_ESCAPE))
    return F.transform(pairs, lambda x, i: F.struct(_decoded(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("key"), i.alias("pos"), _decoded(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def general_query(q: Column) -> Column:
    """key=@ for integers and key=$ for all else, by key, values of a key in their order, without separators."""
    return F.array_join(F.transform(F.array_sort(params(q)), lambda x: F.concat(x["key"], F.when(is_integer(x["value"]), "=@").otherwise("=$"))), "")


def fingerprint_key(url: Column, method: Column) -> Column:
    """What two requests must share to be the same: see fingerprint()."""
    u = without_fragment(url)
    p = path(u)
    last = F.regexp_extract(p, "([^/]*)$", 1)
    numbered = F.concat(F.lit("|"), scheme(u), F.lit("://"), host(u), F.regexp_replace(p, "/?[^/]*$", ""), F.lit("/@"))
    other = F.concat(method, F.lit("|"), F.lower(host(u)), general_path(p), general_query(query(u)))
    return F.when(parseable(u), F.when(is_integer(last), numbered).otherwise(other))


def fingerprint(url: Column, method: Column) -> Column:
    """MD5 of the generalised request; null for a URL that can't be parsed.

    Pages that differ in a last integer segment are one, whatever their method and query.
    """
    return F.md5(fingerprint_key(url, method))


def absolute_url(x: Column) -> Column:
    """Without fragment; '' for a mere fragment or what can't be parsed."""
    return F.when(x.startswith("#") | ~parseable(x), "").otherwise(F.regexp_replace(x, "(?s)#.*$", ""))


def parent_url(url: Column) -> Column:
    """scheme, host and the directory of the path; no query."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.regexp_replace(path(url), "/?[^/]*$", ""), F.lit("/"))


def base_url(url: Column) -> Column:
    """What a relative reference is appended to."""
    ext = F.regexp_extract(path(url), r"(\.[^./]*)$", 1)
    return F.when(url.endswith("/"), url).when(url.contains("?") | ext.isin(DYNAMIC_SUFFIXES), parent_url(url)).otherwise(url)


def snapshot_base(url: Column) -> Column:
    """Of a page's snapshot: its directory if the path ends with /, else the host's root."""
    p = path(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p.endswith("/"), p).otherwise("/"))


def dot_count(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))


def is_absolute(url: Column) -> Column:
    return parseable(url) & (scheme(url) != "") & (host(url) != "")


def resolve(ref: Column, current: Column) -> Column:
    """ref as seen on the page `current`, by the crawler's rules (RFC 3986: html.resolve_rfc3986).

    A name ending .js is appended to the host as it is; a joined URL of more than three
    dots is taken for a host of its own; an inner http without a leading scheme gives ''.
    """
    top = F.concat(scheme(current), F.lit("://"))
    joined = F.concat(base_url(current), ref)
    relative = F.when((dot_count(joined) > 3) | ~is_absolute(joined), F.concat(top, ref)).otherwise(joined)
    local = F.when(ref == "", "").when(ref.endswith(".js") | ref.startswith("/"), F.concat(top, host(current), ref)).otherwise(relative)
    return (
        F.when(~ref.contains("http") & ~ref.startswith("//"), local)
        .when(ref.startswith("//"), F.concat(scheme(current), F.lit(":"), ref))
        .when(ref.startswith("http://") | ref.startswith("https://"), ref)
        .otherwise("")
    )


def resolve_all(refs: Column, current: Column) -> Column:
    """Resolved references without '', each once, in order."""
    return F.array_distinct(F.filter(F.transform(refs, lambda x: resolve(x, current)), lambda x: x != ""))


def basename(p: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(p, "([^/]*)$", 1), r"\.[^.]*$", "")
