"""Forms and nodes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import links
from ..functions.url import resolve_all

KEYWORDS = {
    "username": ("name", "user", "用户", "账号"),
    "email": ("email", "mail", "邮箱"),
    "phone": ("电话", "手机", "phone"),
    "password": ("密码", "password", "passwd"),
}
SUBMIT = ("login", "提交", "登录")
_OWN_TYPE = {"email": "email", "phone": "tel"}


def attribute(tag: Column, name: str) -> Column:
    """Null where the tag lacks it."""
    found = F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)
    return F.when(tag.rlike(rf'(?is)\s{name}\s*=\s*"'), found)


def inputs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, type, name and placeholder of every input tag."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<input\b[^>]*>"), F.lit(0))).alias("pos", "tag"))
    return tags.select(key, "pos", *[attribute(F.col("tag"), a).alias(a) for a in ("type", "name", "placeholder")])


def login_inputs(fields: DataFrame) -> DataFrame:
    """A row for each field and keyword that makes it a user name, mail, phone or password field; a field may have several."""
    hint, out = F.lower("placeholder"), None
    for role, words in KEYWORDS.items():
        kind = "password" if role == "password" else "text"
        matched = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(hint, w))
        own = F.when(F.col("type") == _OWN_TYPE[role], F.array(F.lit(""))).when(F.col("type") == kind, matched) if role in _OWN_TYPE else F.when(F.col("type") == kind, matched)
        rows = fields.where("type IS NOT NULL AND placeholder IS NOT NULL").withColumn("keyword", F.explode(own)).withColumn("role", F.lit(role))
        out = rows if out is None else out.unionByName(rows)
    return out


def submit_buttons(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each submit button; others with a type once for each keyword in their markup."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<button\b[^>]*>.*?</button>"), F.lit(0))).alias("pos", "tag"))
    kind = attribute(F.regexp_extract("tag", r"(?is)^<button\b[^>]*>", 0), "type")
    matched = F.filter(F.array(*[F.lit(w) for w in SUBMIT]), lambda w: F.contains(F.lower("tag"), w))
    return tags.withColumn("type", kind).where("type IS NOT NULL").withColumn("keyword", F.explode(F.when(F.col("type") == "submit", F.array(F.lit(""))).otherwise(matched)))


def anchor_route(href: Column) -> Column:
    """emit: the link is followed as it is; click: the node must be clicked."""
    return F.when((href != "") & ~href.contains("javascript") & (href != "#"), "emit").otherwise("click")


def harvest(html: Column, url: Column) -> Column:
    """What a page's anchors lead to: the references that are followed as they are, resolved against the page's own URL, each once. Of a page without HTML the URL itself."""
    followed = F.filter(links(html), lambda x: anchor_route(x) == "emit")
    return F.coalesce(resolve_all(followed, url), F.array(url))
