"""Items as Markdown files in folders of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as tx


def articles(items: DataFrame) -> DataFrame:
    """id, folder, file, markdown, place (newest first) of items (id, title, link, author, pub_date, source, full_content, description)."""
    body = F.coalesce("full_content", "description")
    markdown = tx.article_markdown(F.col("title"), F.col("link"), F.col("author"), F.col("pub_date"), F.col("source"), body)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("pub_date"), F.desc("id")))
    # texts stay out of the sort by source
    narrow = items.select("id", "source", "pub_date").withColumn("place", place).select("id", "place")
    return items.join(narrow, "id").select("id", tx.file_name(F.col("source")).alias("folder"), F.concat(tx.file_name(F.col("title")), F.lit(".md")).alias("file"), markdown.alias("markdown"), "place")


def write_articles(items: DataFrame, path: str) -> None:
    """Writes files under ``path``/folder=…: a row of text per article, in as many files as tasks wrote."""
    articles(items).select("folder", "file", "markdown").write.partitionBy("folder").parquet(path)
