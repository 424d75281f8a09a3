"""HTML detail pages and robots rules."""

from __future__ import annotations

import math
import os
import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from reelloom.functions.infohash import hash_of_delivery
from reelloom.functions.scalars import page_size_bytes

ANCHOR = StructType([StructField(n, StringType()) for n in ("href", "name", "size")])
PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("anchors", ArrayType(ANCHOR))])
MOST_DELAY = 86_400.0
LEAST_DELAY = 5.0


class _Page(HTMLParser):
    """Title, visible text and anchors of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: list[str] = []
        self.text: list[str] = []
        self.anchors: list[dict] = []
        self._title = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in ("h1", "title"):
            self._title += 1
            self.titles.append("")
        elif tag == "a" and given.get("href") is not None:
            self.anchors.append({"href": given["href"], "name": given.get("data-name"), "size": given.get("data-size")})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h1", "title") and self._title:
            self._title -= 1

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self._title:
            self.titles[-1] += data


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    title = next((t.strip() for t in page.titles if t.strip()), None)
    return {"title": title, "text": " ".join(page.text), "anchors": page.anchors}


@F.pandas_udf(PAGE)
def _read(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=PAGE.fieldNames())


@F.pandas_udf(StringType())
def _display_name(href: pd.Series) -> pd.Series:
    return href.map(lambda h: next(iter(parse_qs(urlsplit(h).query).get("dn", [])), "").strip() or None)


def page_records(pages: DataFrame) -> DataFrame:
    """(path, info_hash, name, size) of the magnet links of pages (path, html).

    The name is the anchor's own, else the link's, else the page's title; the
    size the anchor's own, else the first size in the page's text. Links
    without hash, name or size are left out.
    """
    rows = pages.withColumn("p", _read("html")).select("path", "p.title", "p.text", F.explode("p.anchors").alias("a"))
    rows = rows.where(F.col("a.href").startswith("magnet:"))
    name = F.coalesce(F.nullif(F.trim("a.name"), F.lit("")), _display_name("a.href"), F.col("title"))
    own = F.when(F.col("a.size").rlike("^[0-9]+$"), F.col("a.size").try_cast("bigint"))
    return rows.select(
        "path", hash_of_delivery(F.col("a.href")).alias("info_hash"), name.alias("name"), F.coalesce(own, page_size_bytes(F.col("text"))).alias("size")
    ).where("info_hash is not null and name is not null and size is not null")


def page_errors(pages: DataFrame) -> DataFrame:
    """(path, error) of pages (path, html) without any magnet link."""
    rows = pages.select("path", _read("html").alias("p"))
    return rows.where(~F.exists("p.anchors", lambda a: a["href"].startswith("magnet:"))).select("path", F.lit("no magnet link").alias("error"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of the HTML files under a folder, at any depth and of any
    size. A file reached through a symbolic link is skipped, where the folder
    is of a file system that has them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[hH][tT][mM][lL]").load(folder)
    return files.where(~_through_link("path", F.lit(folder))).select("path", F.decode("content", "UTF-8").alias("html"))


@F.pandas_udf(BooleanType())
def _through_link(path: pd.Series, folder: pd.Series) -> pd.Series:
    local = lambda p: unquote(urlsplit(p).path) if urlsplit(p).scheme in ("", "file") else None

    def linked(p: str, root: str) -> bool:
        place, top = local(p), local(root)
        if place is None or top is None:
            return False
        below = os.path.relpath(place, top)
        return os.path.join(os.path.realpath(top), below) != os.path.realpath(place)

    return pd.Series([linked(p, f) for p, f in zip(path, folder)], dtype=bool)


def folder_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder's pages; of equal hashes the first path's counts."""
    window = Window.partitionBy("info_hash").orderBy("path", "name")
    return page_records(read_folder(spark, folder)).withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def links_of(base: str, html: str | None) -> list[str]:
    """Addresses of detail pages of the same origin that a page links to."""
    origin = lambda u: (u.scheme, u.hostname, u.port or {"http": 80, "https": 443}.get(u.scheme))
    home, out = urlsplit(base), set()
    for anchor in read_page(html)["anchors"]:
        try:
            url = urlsplit(urljoin(base, anchor["href"]))
            same = origin(url) == origin(home)
        except ValueError:
            continue
        if same and url.path.startswith(("/torrent/", "/torrents/")):
            out.add(url.geturl())
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def _links(base: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([links_of(b, h) for b, h in zip(base, html)])


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct detail addresses linked from pages (base, html)."""
    return pages.select(F.explode(_links("base", "html")).alias("url")).distinct()


def robots_rules(text: str, agent: str) -> tuple[list[tuple[bool, str, int]], float]:
    """((allow, pattern, length) of each rule, delay in seconds) for an agent.

    Groups that name the agent count; only without any those for ``*``. A
    ``*`` in a rule stands for any text, ``$`` at its end for the end. The
    longest delay holds; one out of range is a ValueError.
    """
    groups: list[dict] = []
    fresh = True
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        field, colon, value = (part.strip() for part in line.partition(":"))
        field = field.lower()
        if not line:
            fresh = True
            continue
        if not colon:
            continue
        if field == "user-agent":
            if fresh or groups[-1]["ruled"]:
                groups.append({"agents": set(), "rules": [], "delay": None, "ruled": False})
            groups[-1]["agents"].add(value.lower())
            fresh = False
        elif groups and not fresh:
            group = groups[-1]
            if field in ("allow", "disallow"):
                group["ruled"] = True
                if field == "allow" or value:
                    group["rules"].append((field == "allow", value))
            elif field == "crawl-delay":
                delay = float(value)
                if not (math.isfinite(delay) and 0 <= delay <= MOST_DELAY):
                    raise ValueError("crawl delay out of range")
                group["ruled"], group["delay"] = True, delay
    chosen = [g for g in groups if agent.lower() in g["agents"]] or [g for g in groups if "*" in g["agents"]]
    rules = []
    for g in chosen:
        for allow, rule in g["rules"]:
            end = rule.endswith("$")
            body = ".*".join(re.escape(p) for p in rule.removesuffix("$").split("*"))
            rules.append((allow, f"^{body}{'$' if end else ''}", len(rule.removesuffix("$").replace("*", ""))))
    delays = [g["delay"] for g in chosen if g["delay"] is not None]
    return rules, max(delays, default=LEAST_DELAY)


def robots_allowed(urls: DataFrame, rules: list[tuple[bool, str, int]]) -> DataFrame:
    """``urls`` (url) with ``allowed``: the longest matching rule decides, a
    permission among equals; without any the address is allowed."""
    target = F.regexp_replace("url", r"^[a-zA-Z]+://[^/?#]*", "")
    target = F.regexp_replace(F.regexp_replace(target, "#.*$", ""), r"^(?=\?|$)", "/")
    fits = [F.when(target.rlike(p), F.struct(F.lit(n).alias("length"), F.lit(a).alias("allow"))) for a, p, n in rules]
    best = F.array_max(F.array(*fits)) if fits else F.lit(None)
    return urls.withColumn("allowed", F.coalesce(best["allow"], F.lit(True)) if fits else F.lit(True))
