"""Data source and sink, status machine over restarts, and vector functions by SQL text."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import sql_names
from loomgraph.sources import snapshots
from loomgraph.streaming import status

RSS = '<rss version="2.0"><channel><item><title>{0}</title><link>https://a.b/{0}</link><guid>g{0}</guid></item><item><title>x{0}</title></item></channel></rss>'


def test_snapshots_in_batches_and_streams(spark, tmp_path):
    spark.dataSource.register(snapshots.FeedSnapshots)
    folder = tmp_path / "in"
    folder.mkdir()
    assert spark.read.format("feed_snapshots").load(str(folder)).count() == 0
    for i in range(3):
        (folder / f"2024-01-0{i + 1}--s{i}.xml").write_text(RSS.format(i))
    (folder / "2024-01-04--bad.xml").write_text("<rss><broken")
    rows = spark.read.format("feed_snapshots").option("filesPerTask", 2).load(f"file://{folder}").collect()
    assert sorted((r.source_id, r.place, r.title) for r in rows) == [("bad", 0, None), *[(f"s{i}", k, t) for i in range(3) for k, t in enumerate((f"{i}", f"x{i}"))]]
    assert [r.error is not None for r in rows if r.source_id == "bad"] == [True]

    def run():
        stream = spark.readStream.format("feed_snapshots").load(str(folder))
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        assert q.awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 7 and run() == 7
    (folder / "2024-02-01--s9.xml").write_text(RSS.format(9))
    assert run() == 9  # the new snapshot only


def articles(spark, n=12):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"Title {i % 5}", f"https://a.b/{i}", None, None if i == 7 else day + datetime.timedelta(hours=9 * (i % 6)), f"S{i % 2}", f"Body {i}", None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, link string, author string, pub_date timestamp, source string, full_content string, description string")


def test_one_file_per_article(spark, tmp_path):
    out = tmp_path / "articles"
    snapshots.write_articles(articles(spark), str(out))
    files = sorted(p.relative_to(out).as_posix() for p in out.rglob("*") if p.is_file())
    assert len(files) == 12 and {f.count("/") for f in files} == {2} and {f.split("/")[0] for f in files} == {"2024-01-01", "2024-01-02", "undated"}
    bodies = sorted(next(line for line in (out / f).read_text().splitlines() if line.startswith("Body")) for f in files)
    assert bodies == sorted(f"Body {i}" for i in range(12))


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(snapshots.ArticleFiles)
    out = tmp_path / "articles"
    bad = F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise("x").cast("string")
    rows = articles(spark).repartition(4).select(F.lit("d").alias("day"), "source", F.concat("id", F.lit(".md")).alias("file"), bad.alias("markdown")).toDF("day", "folder", "file", "markdown")
    with pytest.raises(Exception, match="no"):
        rows.write.format("article_files").mode("append").save(str(out))
    assert not out.exists() or not [p for p in out.iterdir() if not p.name.startswith("_job-")]


def test_status_over_restarts(spark, tmp_path):
    into = tmp_path / "in"

    def extract(item, content):
        if content.startswith("bad"):
            raise ValueError(content)
        return {"chunks": len(content.split())}

    def run(items, wait=3600.0):
        spark.createDataFrame(items, "id long, content string").coalesce(1).write.mode("append").parquet(str(into))
        stream = spark.readStream.schema("id long, content string").parquet(str(into))
        q = status.write_transitions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), extract, most=2, wait=wait)
        assert q.awaitTermination(40)
        return {r.id: (r.status, r.attempts, r.error, json.loads(r.result) if r.result else None) for r in status.current(spark, str(tmp_path / "out")).collect()}

    try:
        first = run([(1, "one two"), (2, "bad text"), (3, None), (1, "one two")])
        assert first == {1: ("completed", 1, None, {"chunks": 2}), 2: ("failed", 1, "ValueError: bad text", None), 3: ("pending", 0, None, None)}
        # stopped and started again: completed items stay, failed and pending ones are tried when they come again
        second = run([(1, "bad now"), (2, "good"), (3, "a b c"), (4, "bad"), (5, "")], wait=0.0)
        assert second == {1: first[1], 2: ("completed", 2, None, {"chunks": 1}), 3: ("completed", 1, None, {"chunks": 3}), 4: ("failed", 1, "ValueError: bad", None), 5: ("pending", 0, None, None)}
        # the timer of item 4 has run out: it is tried by itself, for the last time
        third = run([(6, "x")], wait=0.0)
        assert third[4] == ("failed", 2, "ValueError: bad", None) and third[6][0] == "completed"
        assert run([(7, "y")])[4] == third[4]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_vector_functions_by_sql_text(spark):
    sql_names.register(spark)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=16), rng.normal(size=16)
    spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").createOrReplaceTempView("pair")
    r = spark.sql("""SELECT vec_distance_l2(a, b) l2, vec_distance_l1(a, b) l1, vec_distance_cosine(a, b) c, vec_distance_hamming(vec_quantize_binary(a), vec_quantize_binary(b)) h,
        vec_add(a, b) s, vec_sub(a, b) d, vec_slice(a, 2, 5) p, vec_normalize(a) n, vec_length(a) k, vec_quantize_int8(array(1D, -1D, 0D)) q, vec_to_json(vec_f32('[1, 2.5]')) j, vec_int8('[1, -2]') i FROM pair""").first()
    assert r.l2 == pytest.approx(np.linalg.norm(a - b)) and r.l1 == pytest.approx(np.abs(a - b).sum()) and r.c == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert r.h == ((a > 0) != (b > 0)).sum() and r.s == pytest.approx(a + b) and r.d == pytest.approx(a - b) and r.p == pytest.approx(a[2:5]) and r.n == pytest.approx(a / np.linalg.norm(a))
    assert (r.k, r.q, r.j, r.i) == (16, [127, -128, 0], "[1.000000,2.500000]", [1, -2])
    bits = [x.value for x in spark.sql("SELECT * FROM vec_each_bit(array(1, 128)) ORDER BY rowid").collect()]
    assert bits == [0] * 7 + [1, 1] + [0] * 7
    assert [(x.rowid, x.value) for x in spark.sql("SELECT rowid, value FROM pair, LATERAL vec_each(a) ORDER BY rowid").collect()] == [(i, pytest.approx(x)) for i, x in enumerate(a)]
    for wrong in ("vec_distance_l2(a, array(1D))", "vec_slice(a, 3, 3)", "vec_slice(a, 0, 17)", "vec_quantize_binary(array(1D))"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT {wrong} FROM pair").collect()


def test_short_article_that_the_page_names():
    from loomgraph.functions.article import extracted

    page = "<body><nav><a href='/x'>Way</a></nav><article></article><article><h1>Short.</h1><p><b>Short.<br></article><footer>Foot</footer></body>"
    assert extracted(page) == "# Short.\n\n**Short.**"
    assert extracted("<body><article><script>x</script></article><p>few</p></body>") is None


def test_articles_of_pages(spark):
    from loomgraph.functions.article import article, extracted

    prose = "This sentence is long enough to be taken for prose, and goes on."
    page = f"""<html><head><title>t</title><script>var p = "<p>{prose}</p>";</script></head><body><nav><ul><li><a href="/x">{prose}</a></li></ul></nav>
    <div class="ad banner"><p>{prose} Buy.</p></div><article><h1>The  <i>head</i></h1><p>{prose} With a <a href="/more?x=1">link</a>, <b>bold </b>and <em>more</em>.<br>Next line<p>Second. {prose}
    <ul><li>one<li>two <b>2</b></ul><h2>Part</h2><blockquote>{prose}</blockquote><ol><li>first</li></ol><pre>  code
   x</pre><div id="comments"><p>{prose} Comment.</p></div></article><footer><p>{prose} Foot.</p></footer></body></html>"""
    want = "\n\n".join(["# The *head*", f"{prose} With a [link](https://a.b/more?x=1), **bold** and *more*.\nNext line", f"Second. {prose}", "- one\n- two **2**", "## Part", f"> {prose}", "1. first", "```\n  code\n   x\n```"])
    assert extracted(page, "https://a.b/c/d") == want
    side = f"<div><div id=side><a href=/a>{prose}</a><a href=/b>{prose}</a></div><div id=main><p>{prose}</p><p>{prose}</p></div></div>"
    assert extracted(side, "") == f"{prose}\n\n{prose}"
    odd = [None, "", "<p>short</p>", "no markup at all, but long enough to be prose, perhaps", "</div></p><b>x", "<div>" * 3000 + prose]
    assert [extracted(h, None) for h in odd[:3]] == [None, None, None] and extracted(odd[3], "") == odd[3] and extracted(odd[4], "") is None and extracted(odd[5], "") == prose
    nested = f"<article><p>{prose}</p><p>{prose}</p><ul><li>one<ul><li>inner</li></ul></li></ul></article>"
    assert extracted(nested, "") == f"{prose}\n\n{prose}\n\n- one\n\ue000".replace("\ue000", "  - inner")
    got = spark.createDataFrame([(page, "https://a.b/c/d"), (None, None)], "h string, u string").select(article(F.col("h"), F.col("u")).alias("a")).collect()
    assert [r.a for r in got] == [want, None]


def test_new_items_of_a_refresh(spark):
    from loomgraph.operators.history import new_items

    before = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)] + [("gone",)], "s string")
    after = spark.createDataFrame([("a",)] * 5 + [("b",)] + [(None,)] * 2 + [("c",)], "s string")
    assert {r["s"]: r["new_items"] for r in new_items(before, after, "s").collect()} == {"a": 2, "b": 0, None: 1, "c": 1}


def test_article_files_read_back(spark, tmp_path):
    """Days are moved whole or into what is there; undated files are shared by tasks and each is read once."""
    items = [(i, f"T{i % 9}", f"l{i}", None, None if i % 3 else f"2024-01-0{1 + i % 4} 05:00:00", f"s{i % 2}", f"text {i}", None) for i in range(60)]
    rows = spark.createDataFrame(items, "id long, title string, link string, author string, pub_date string, source string, full_content string, description string").withColumn("pub_date", F.to_timestamp("pub_date"))
    path = str(tmp_path / "out")
    snapshots.write_articles(rows.where("id < 50"), path)
    before = {tuple(r) for r in spark.read.format("article_files").load(path).collect()}
    assert len(before) == 50 and {r[0] for r in before} == {"undated", "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"}
    kept = {(r[0], r[1], r[2]) for r in before}
    snapshots.write_articles(rows.where("id >= 50").withColumn("title", F.concat(F.lit("Late "), "id")), path)
    after = [tuple(r) for r in spark.read.format("article_files").load(path).collect()]
    assert len(after) == len(set(after)) == 60 and before <= set(after) and len({r[:3] for r in after}) == 60 and kept <= {r[:3] for r in after}
    assert {int(r[3].rsplit("text ", 1)[1]) for r in after} == set(range(60))
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    assert spark.read.format("article_files").load(str(tmp_path / "none")).count() == 0
