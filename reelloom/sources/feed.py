"""XML feeds of release items."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from reelloom.functions.infohash import hash_of_delivery, normalize_info_hash
from reelloom.functions.text import non_blank

ITEM = StructType([StructField(n, StringType()) for n in ("title", "link", "guid", "size", "info_hash", "magnet")])
PARSED = StructType([StructField("items", ArrayType(ITEM)), StructField("error", StringType())])
# Parameters of download addresses that hold credentials.
CREDENTIALS = ("apikey", "jackett_apikey")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def read_items(xml: str | bytes) -> list[dict[str, str]]:
    """Raw fields of each item; ElementTree errors for malformed XML.

    Names are compared without their namespace. A ``size`` attribute counts
    only where no size stands before it; an enclosure's address replaces the link.
    """
    out = []
    for item in ET.fromstring(xml).iter():
        if _local(item.tag) != "item":
            continue
        got = dict.fromkeys(ITEM.fieldNames(), "")
        for child in item.iter():
            name = _local(child.tag)
            if name in ("title", "link", "guid", "size"):
                got[name] += (child.text or "").strip()
            elif name == "enclosure" and "url" in child.attrib:
                got["link"] = child.attrib["url"]
            elif name == "attr":
                kind, value = child.attrib.get("name", "").lower(), child.attrib.get("value", "")
                if kind == "infohash":
                    got["info_hash"] = value
                elif kind == "magneturl":
                    got["magnet"] = value
                elif kind == "size" and not got["size"]:
                    got["size"] = value
        out.append(got)
    return out


@F.pandas_udf(PARSED)
def _items(xml: pd.Series) -> pd.DataFrame:
    rows = []
    for text in xml:
        try:
            rows.append((read_items(text), None))
        except (ET.ParseError, TypeError, ValueError) as e:
            rows.append(([], f"malformed: {e}"))
    return pd.DataFrame(rows, columns=["items", "error"])


def _magnet(text: Column) -> Column:
    return F.when(F.lower(non_blank(text)).startswith("magnet:"), hash_of_delivery(text))


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """One row per item of the feeds (indexer, xml), with ``entry``.

    A hash comes from the item's attribute, else from the first magnet link
    among attribute, link and guid; then it is a record. Without one an HTTP
    link makes the item pending. No title, a broken hash and no usable link
    make it skipped. A malformed feed gives one row of entry error.
    """
    rows = feeds.withColumn("p", _items("xml")).select("indexer", "p.error", F.explode_outer("p.items").alias("i"))
    given = non_blank(F.col("i.info_hash"))
    hashed = F.when(given.isNotNull(), normalize_info_hash(given)).otherwise(
        F.coalesce(_magnet(F.col("i.magnet")), _magnet(F.col("i.link")), _magnet(F.col("i.guid")))
    )
    title, link = non_blank(F.col("i.title")), non_blank(F.col("i.link"))
    entry = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(title.isNull(), F.lit("skipped"))
        .when(hashed.isNotNull(), F.lit("record"))
        .when(given.isNotNull(), F.lit("skipped"))
        .when(link.rlike("(?i)^https?://"), F.lit("pending"))
        .otherwise(F.lit("skipped"))
    )
    size = F.coalesce(F.when(F.trim("i.size").rlike(r"^\+?[0-9]+$"), F.trim("i.size").try_cast("bigint")), F.lit(0))
    return rows.where("i is not null or error is not null").select(
        F.concat(F.lit("jackett-"), "indexer").alias("source"), entry.alias("entry"), hashed.alias("info_hash"), title.alias("name"), size.alias("size"), link.alias("link"), "error"
    )


def without_credentials(url: str) -> str:
    """The address without the parameters that hold credentials."""
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in CREDENTIALS]
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path, urlencode(kept), parts.fragment))


@F.pandas_udf(StringType())
def _bare_address(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else without_credentials(u))


def locator_fingerprint(url: Column) -> Column:
    return F.sha2(_bare_address(url), 256)


def downloadable(base: str, url: Column) -> Column:
    """Same origin as ``base`` and a path under ``/dl/``."""
    parts = urlsplit(base)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    host = re.escape((parts.hostname or "").lower())
    stated = rf"(:{port})" + ("" if parts.port and parts.port not in (80, 443) else "?")
    return url.rlike(rf"(?i)^{re.escape(parts.scheme)}://{host}{stated}/dl/")
