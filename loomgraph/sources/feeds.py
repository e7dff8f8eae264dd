"""Feed snapshots and OPML lists: rows of raw bodies to rows of items and feeds.

Bodies are parsed one by one in Arrow batches; what follows (fallbacks, promotion of descriptions,
first occurrences) is column expressions. A body that can't be parsed gives one row with an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as tx

FIELDS = ["guid", "link", "title", "description", "content", "published", "author"]
OUTLINE = ["xml_url", "title", "html_url"]


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def texts(element: ElementTree.Element) -> dict[str, str]:
    """Texts of the children by local name, the first of each; of links the first address."""
    out: dict[str, str] = {}
    for child in element:
        name = local(child.tag)
        value = child.get("href") if name == "link" and child.get("href") else "".join(child.itertext())
        out.setdefault(name, value)
    return out


def xml_items(body: str) -> Iterator[dict[str, str | None]]:
    root = ElementTree.fromstring(body)
    for element in root.iter():
        kind = local(element.tag)
        if kind == "item":
            t = texts(element)
            yield {"guid": t.get("guid"), "link": t.get("link"), "title": t.get("title"), "description": t.get("description"), "content": t.get("encoded"), "published": t.get("pubDate"), "author": t.get("author")}
        elif kind == "entry":
            t = texts(element)
            author = next((texts(c).get("name") for c in element if local(c.tag) == "author"), None)
            yield {"guid": t.get("id"), "link": t.get("link"), "title": t.get("title"), "description": t.get("summary", t.get("content")), "content": None, "published": t.get("published", t.get("updated")), "author": author}


def json_items(body: str) -> Iterator[dict[str, str | None]]:
    for item in json.loads(body).get("items") or []:
        described = next((item[k] for k in ("summary", "content_html", "content_text") if item.get(k) is not None), None)
        yield {"guid": item.get("id"), "link": item.get("url"), "title": item.get("title"), "description": described, "content": None, "published": item.get("date_published"), "author": (item.get("author") or {}).get("name")}


def feed_rows(body: str) -> Iterator[dict[str, str | None]]:
    return json_items(body) if body.lstrip("\ufeff \t\r\n").startswith("{") else xml_items(body)


def outline_rows(body: str) -> Iterator[dict[str, str | None]]:
    """Outlines with a feed address, in document order at any depth."""
    for element in ElementTree.fromstring(body).iter():
        if local(element.tag) == "outline" and element.get("xmlUrl"):
            yield {"xml_url": element.get("xmlUrl"), "title": element.get("title") or element.get("text") or None, "html_url": element.get("htmlUrl")}


def parsed(bodies: DataFrame, key: str, rows_of: Callable[[str], Iterator[dict]], fields: list[str]) -> DataFrame:
    """key, place (from 0), the fields as strings, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "place", *fields, "error"]
        for batch in batches:
            for k, body in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows = [{"key": k, "place": i, **{f: None if v is None else str(v) for f, v in r.items()}} for i, r in enumerate(rows_of(body or ""))]
                except (ElementTree.ParseError, ValueError, AttributeError) as e:
                    rows = [{"key": k, "place": 0, "error": f"{type(e).__name__}: {e}"}]
                types = [pa.string(), pa.int32(), *[pa.string()] * len(fields), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    schema = f"key string, place int, {', '.join(f'{f} string' for f in fields)}, error string"
    return bodies.select(F.col(key).cast("string").alias("key"), F.col("body").cast("string").alias("body")).mapInArrow(run, schema)


def feed_items(bodies: DataFrame, source: str = "source_id") -> DataFrame:
    """source_id, place, guid, title, link, published, description, full_content, author, error from RSS, Atom and JSON bodies.

    guid falls back to the link, then to a digest of the item, so that reruns agree; the title to
    "Untitled". The full content is the feed's own, else a description of 200 characters or more
    that isn't cut off; markup is stripped from both.
    """
    rows = parsed(bodies, source, feed_rows, FIELDS)
    filled = F.when(F.col("content") != "", F.col("content"))
    promoted = F.when((F.length("description") >= 200) & ~tx.is_cut_off(F.col("description")), F.col("description"))
    digest = F.sha2(F.to_json(F.struct("key", *FIELDS)), 256)
    return rows.select(
        F.col("key").alias("source_id"), "place", F.when(F.col("error").isNull(), F.coalesce("guid", "link", digest)).alias("guid"),
        F.when(F.col("error").isNull(), F.coalesce("title", F.lit("Untitled"))).alias("title"), F.coalesce(F.trim("link"), F.lit("")).alias("link"), "published",
        tx.strip_html(F.col("description")).alias("description"), tx.strip_html(F.coalesce(filled, promoted)).alias("full_content"), "author", "error")


def opml_feeds(bodies: DataFrame, key: str = "list_id") -> DataFrame:
    """list_id, place, xml_url, title, html_url: each list's feeds, the first of those whose addresses agree but for case."""
    rows = parsed(bodies, key, outline_rows, OUTLINE).where(F.col("error").isNull())
    rank = F.row_number().over(Window.partitionBy("key", F.lower("xml_url")).orderBy("place"))
    return rows.withColumn("rank", rank).where("rank = 1").select(F.col("key").alias("list_id"), "place", *OUTLINE)
