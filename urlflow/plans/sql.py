"""DuckDB expressions for the oracle, written apart from the Spark ones: no constant comes from the code under test."""

from __future__ import annotations

STATIC = (
    "woff2 bz2 gz2 mp3 mp4 m4a wma ra cab rmvb aac doc mid exe pdf aiff tiff woff gif tif exif asf otf ttf swf dxf "
    "odg jpeg mpeg ogg dmg mng png jpg mpg svg ai avi apk dll xsl rm bin ico iso map webp odp 3gp zip bmp psp rar "
    "tar ods xls ps eps wps css less rss dat pct odt ppt qt crt pst txt au m4v wav flv wmv mov csv drw docx asx "
    "xlsx pptx gz"
).split()
DYNAMIC = ("php", "asp", "action")
#: A percent sign that no two hexadecimal digits follow.
_ESCAPE = "%($|[^0-9a-fA-F]|.$|.[^0-9a-fA-F])"
_SCHEME = "^[a-zA-Z][a-zA-Z0-9.+-]*:"
_PLAIN = "[^<>()\\s]"
_BRACKETS = f"[(](?:{_PLAIN}+|[(]{_PLAIN}+[)])*[)]"
_NO_END = "".join("\\" + c for c in "<>{}[]()'`!?;:,.") + '"' + "".join(map(chr, (0xAB, 0xBB, 0x2018, 0x2019, 0x201C, 0x201D)))
_HEADS = ("http://", "https://", "www[0-9]?[0-9]?[0-9]?\\.", "[-.0-9a-z]+\\.[a-z]{2,4}/")
#: URLs in free text, for a linear-time engine.
_MINED = f"(?i)\\b((?:{'|'.join(_HEADS)})(?:{_PLAIN}+|{_BRACKETS})+(?:{_BRACKETS}|[^\\s{_NO_END}]))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _before_query(u: str) -> str:
    return f"regexp_replace({u}, '(?s)[?#].*$', '')"


def scheme(u: str) -> str:
    return f"lower(rtrim(regexp_extract({u}, '{_SCHEME}'), ':'))"


def _no_scheme(u: str) -> str:
    return f"regexp_replace({_before_query(u)}, '{_SCHEME}', '')"


def host(u: str) -> str:
    rest = _no_scheme(u)
    return f"(CASE WHEN starts_with({rest}, '//') THEN regexp_replace(split_part(substr({rest}, 3), '/', 1), '^.*@', '') ELSE '' END)"


def raw_path(u: str) -> str:
    return f"regexp_replace({_no_scheme(u)}, '^//[^/]*', '')"


def path(u: str) -> str:
    return f"CASE WHEN regexp_matches({raw_path(u)}, {lit(_ESCAPE)}, 's') THEN NULL ELSE url_decode({raw_path(u)}) END"


def query(u: str) -> str:
    return f"regexp_extract(split_part({u}, '#', 1), '^[^?]*[?](.*)$', 1, 's')"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '^[^#]*#(.*)$', 1, 's')"


def parseable(u: str) -> str:
    return f"coalesce(NOT (regexp_matches({u}, '[[:cntrl:]]') OR regexp_matches({raw_path(u)}, {lit(_ESCAPE)}, 's') OR regexp_matches({host(u)}, '[ <>\"]') OR regexp_matches({host(u)}, ':[^0-9:\\]]+$')), false)"


def no_fragment(u: str) -> str:
    return f"regexp_replace({u}, '(?s)#[^#]*$', '')"


def suffix(u: str) -> str:
    cut = f"split_part({u}, '&', 1)"
    return f"regexp_extract({path(cut)}, '(\\.[^./]*)$', 1)"


def static(u: str, frontier: bool = False) -> str:
    names = ", ".join(lit(f".{s}") for s in [*STATIC, *(["js"] if frontier else [])])
    cut = f"split_part({u}, '&', 1)"
    return f"(NOT {parseable(cut)} OR coalesce({suffix(u)} IN ({names}), true))"


def integer(x: str) -> str:
    return f"(regexp_matches({x}, '^[+-]?[0-9]+$') AND try_cast({x} AS BIGINT) IS NOT NULL)"


def general_path(p: str) -> str:
    n = f"regexp_replace({p}, '[0-9]+', 'number', 'g')"
    return f"CASE WHEN {n} <> '' AND NOT ends_with({n}, '/') THEN {n} || '/' ELSE {n} END"


def params(table: str, key: str, url: str) -> str:
    """A query: key, pos, k, v of every parameter."""
    pairs = f"SELECT {key}, x.i - 1 AS pos, x.p AS p FROM (SELECT {key}, unnest([{{'i': i, 'p': q[i]}} FOR i IN range(1, len(q) + 1)]) AS x FROM (SELECT {key}, [z FOR z IN string_split({query(url)}, '&') IF z <> '' AND NOT contains(z, ';') AND NOT regexp_matches(z, {lit(_ESCAPE)}, 's')] AS q FROM {table}))"
    decoded = lambda e: f"url_decode(replace({e}, '+', ' '))"
    return f"SELECT {key}, CAST(pos AS INTEGER) AS pos, {decoded("regexp_extract(p, '(?s)^([^=]*)', 1)")} AS k, {decoded("regexp_extract(p, '(?s)^[^=]*=(.*)$', 1)")} AS v FROM ({pairs})"


def general_query(table: str, key: str, url: str) -> str:
    """A query: key and params of every row that has parameters."""
    return f"SELECT {key}, string_agg(k || CASE WHEN {integer('v')} THEN '=@' ELSE '=$' END, '' ORDER BY k, pos) AS params FROM ({params(table, key, url)}) GROUP BY {key}"


def fingerprints(table: str, key: str, url: str, method: str, more: str = "") -> str:
    """A query: key, more, k (the generalised request) and fp."""
    u = no_fragment(url)
    p = f"({path('u')})"
    last = f"regexp_extract({p}, '([^/]*)$', 1)"
    held = f"(SELECT *, {u} AS u, {method} AS m FROM {table})"
    k = f"CASE WHEN NOT {parseable('u')} THEN NULL WHEN {integer(last)} THEN '|' || {scheme('u')} || '://' || {host('u')} || regexp_replace({p}, '/?[^/]*$', '') || '/@' ELSE m || '|' || lower({host('u')}) || {general_path(p)} || coalesce(params, '') END"
    extra = f", {more}" if more else ""
    return f"SELECT {key}{extra}, k, md5(k) AS fp FROM (SELECT h.*, {k} AS k FROM {held} h LEFT JOIN ({general_query(held, key, 'u')}) USING ({key}))"


def parent(u: str) -> str:
    return f"{scheme(u)} || '://' || {host(u)} || regexp_replace({path(u)}, '/?[^/]*$', '') || '/'"


def base(u: str) -> str:
    names = ", ".join(lit(f".{s}") for s in DYNAMIC)
    return f"CASE WHEN ends_with({u}, '/') THEN {u} WHEN contains({u}, '?') OR regexp_extract({path(u)}, '(\\.[^./]*)$', 1) IN ({names}) THEN {parent(u)} ELSE {u} END"


def snapshot(u: str) -> str:
    return f"(CASE WHEN ends_with({path(u)}, '/') THEN {scheme(u)} || '://' || {host(u)} || ({path(u)}) ELSE {scheme(u)} || '://' || {host(u)} || '/' END)"


def dots(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '.', '')))"


def resolved(table: str, ref: str, current: str, keep: str) -> str:
    """A query: keep and resolved."""
    j = "joined"
    absolute = f"({parseable(j)} AND {scheme(j)} <> '' AND {host(j)} <> '')"
    return f"""SELECT {keep}, CASE
        WHEN NOT contains({ref}, 'http') AND NOT starts_with({ref}, '//') THEN CASE
          WHEN {ref} = '' THEN '' WHEN ends_with({ref}, '.js') OR starts_with({ref}, '/') THEN top || hst || {ref}
          WHEN {dots(j)} > 3 OR NOT {absolute} THEN top || {ref} ELSE joined END
        WHEN starts_with({ref}, '//') THEN sch || ':' || {ref}
        WHEN starts_with({ref}, 'http://') OR starts_with({ref}, 'https://') THEN {ref} ELSE '' END AS resolved
      FROM (SELECT *, {scheme(current)} AS sch, {scheme(current)} || '://' AS top, {host(current)} AS hst, ({base(current)}) || {ref} AS joined FROM {table})"""


def links(html: str) -> str:
    return f"regexp_extract_all({html}, '<a [^>]*href=\"([^\"]*)\"', 1)"


def title(html: str) -> str:
    return f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"


def terms(html: str) -> str:
    parts = f"[lower(regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) FOR x IN regexp_split_to_array({html}, '<[^>]*>')]"
    return f"[x FOR x IN {parts} IF x <> '']"


def mined(text: str) -> str:
    return f"regexp_extract_all({text}, {lit(_MINED)}, 1)"


def page_links(pages: str, base: str) -> str:
    """A query: page_id and link of every link of the pages' tags, comments and texts; those of one text once. For pages whose references are all &amp;, whose linked tags have one attribute each and whose scripts' tags have none."""
    raw = "(?is)<(?:script|style|title)[^>]*>(.*?)</(?:script|style|title)>"
    shown = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), chr(39), '&#39;')"
    unshown = lambda x: f"replace({x}, '&amp;', '&')"
    rest = f"regexp_replace(html, {lit(raw)}, '<>', 'g')"
    return f"""
    WITH p AS (SELECT page_id, {base} AS b, html, {rest} AS rest FROM {pages}),
    refs AS (SELECT page_id, b, unnest(regexp_extract_all(rest, '<(?:a|link|frame|form) (?:href|src|action)="([^"]*)"', 1)) AS ref FROM p),
    texts AS (SELECT page_id, b, {shown('t')} AS t FROM (SELECT page_id, b, unnest(regexp_split_to_array(rest, '(?s)<!--.*?-->|<[^>]*>')) AS t FROM p)
      UNION ALL SELECT page_id, b, {shown('t')} FROM (SELECT page_id, b, unnest(regexp_extract_all(html, {lit(raw)}, 1)) AS t FROM p)
      UNION ALL SELECT page_id, b, '<!--' || replace({unshown('t')}, '&', '&amp;') || '-->' FROM (SELECT page_id, b, unnest(regexp_extract_all(rest, '(?s)<!--(.*?)-->', 1)) AS t FROM p)),
    numbered AS (SELECT row_number() OVER () AS i, * FROM texts),
    found AS (SELECT DISTINCT i, page_id, resolved FROM ({resolved(f"(SELECT i, page_id, b, unnest({mined('t')}) AS ref FROM numbered)", 'ref', 'b', 'i, page_id')}) WHERE resolved <> '')
    SELECT page_id, resolved AS link FROM ({resolved(f"(SELECT page_id, b, {unshown('ref')} AS ref FROM refs WHERE NOT contains(ref, 'javascript') AND ref <> '#')", 'ref', 'b', 'page_id')})
    UNION ALL SELECT page_id, resolved FROM found"""
