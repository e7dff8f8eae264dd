import time

from pyspark.sql import functions as F

from loomgraph.functions import chunks
from loomgraph.sources import feeds

RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>
<item><guid isPermaLink="false">g1</guid><title>One</title><link>http://a/1</link><description>&lt;b&gt;short&lt;/b&gt;</description><content:encoded>&lt;p&gt;whole  text&lt;/p&gt;</content:encoded></item>
<item><link>http://a/2</link><description>{long}</description></item><item/></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>T</title><link href="http://b/1"/><updated>2024-01-02</updated><content>body</content><author><name>N</name></author></entry>
<entry><link href="http://b/2"/><summary>s</summary><published>2024-01-01</published><updated>2024-01-02</updated></entry></feed>"""
JSON = '{"items": [{"id": 7, "url": "http://c/1", "content_html": "<i>x</i>", "content_text": "y"}, {"url": "http://c/2"}]}'
OPML = """<opml><body><outline text="group"><outline text="A" xmlUrl="http://x/Feed" htmlUrl="http://x"/><outline title="" xmlUrl="http://y/feed"/></outline>
<outline text="again" xmlUrl="HTTP://X/feed"/></body></opml>"""


def test_feeds(spark):
    bodies = spark.createDataFrame([(1, RSS.replace("{long}", "d" * 200)), (2, ATOM), (3, JSON), (4, "<rss><item>"), (5, None), (6, "{}"), (7, '{"items": [1]}')], "source_id int, body string")
    rows = feeds.feed_items(bodies).collect()
    got = {(r.source_id, r.place): r for r in rows}
    assert len(rows) == 10
    assert (got["1", 0].guid, got["1", 0].description, got["1", 0].full_content) == ("g1", "short", "whole text")
    assert (got["1", 1].guid, got["1", 1].title, got["1", 1].full_content) == ("http://a/2", "Untitled", "d" * 200)
    assert len(got["1", 2].guid) == 64 and got["1", 2].link == ""
    assert (got["2", 0].guid, got["2", 0].published, got["2", 0].description, got["2", 0].author) == ("e1", "2024-01-02", "body", "N")
    assert (got["2", 1].guid, got["2", 1].published, got["2", 1].full_content) == ("http://b/2", "2024-01-01", None)
    assert (got["3", 0].guid, got["3", 0].description, got["3", 1].guid) == ("7", "x", "http://c/2")
    assert {k for k, _ in got if got[k, 0].error} == {"4", "5", "7"} and "6" not in {k for k, _ in got}


def test_opml(spark):
    bodies = spark.createDataFrame([(1, OPML), (2, "no xml"), (3, None)], "list_id int, body string")
    assert [tuple(r) for r in feeds.opml_feeds(bodies).orderBy("place").collect()] == [("1", 0, "http://x/Feed", "A", "http://x"), ("1", 1, "http://y/feed", None, None)]
    assert feeds.opml_feeds(bodies.limit(0)).count() == 0


def test_chunks(spark):
    said = {
        "one\n\ntwo\n\nthree three": ["one\n\ntwo", "three", "three"],
        "one\ntwo\n\n": ["one\ntwo"],
        "A b. C d. E f": ["A b. C d."],
        "no marks here at all": ["no marks", "here at", "all"],
        "x" * 25 + " tail": ["x" * 10, "x" * 10, "x" * 5, "tail"],
        "": [],
        "  ": [""],
    }
    rows = spark.createDataFrame([(k,) for k in [*said, None]], "t string").select("t", chunks.text_chunks(F.col("t"), 10).alias("c")).collect()
    assert {r.t: r.c for r in rows} == {**said, None: []}


def test_chunks_take_linear_time():
    """Long stretches without an end mark and long blanks; searches from every character took seconds here."""
    began = time.process_time()
    assert [len(c) for c in chunks.chunks_of("word " * 20_000, 800)] == [799] * 125
    assert chunks.chunks_of(f"a.{' ' * 50_000}b c. d", 800) == ["a. b c."]
    assert chunks.chunks_of(f"{'.' * 50_000}{'a' * 50_000}", 60_000) == [f"{'.' * 50_000}{'a' * 10_000}", "a" * 40_000]
    assert time.process_time() - began < 2
