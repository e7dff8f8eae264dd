"""Queries on texts of items: export, names, addresses, previews, answers and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.plans.queries import query, stripped_sql
from loomgraph.sources import tables as src

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(r"""WITH t AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/feed' WHEN 1 THEN 'a: "b"/c|d?e*f<g>h%i\j' WHEN 2 THEN '-- x --- y -- ' WHEN 3 THEN repeat('long name ', 20) WHEN 4 THEN 'http://' ELSE url || '/rss.xml' END AS name FROM pages),
a AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(name, '^https?://', ''), '/feed', ''), '/rss', ''), '.xml', ''), '/', '-') AS name FROM t),
b AS (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(name, '[:/\\?%*|"<>]', '', 'g'), '-{2,}', '-', 'g'), '^[- ]+|[- ]+$', '', 'g'), 1, 80) AS name FROM a) SELECT page_id, CASE WHEN name = '' THEN 'untitled' ELSE name END AS name FROM b""")
def file_names(spark, sf_dir):
    """Names for files from addresses and titles."""
    by, url = F.col("page_id") % 6, F.col("url")
    name = F.when(by == 0, F.concat(url, F.lit("/feed"))).when(by == 1, 'a: "b"/c|d?e*f<g>h%i\\j').when(by == 2, "-- x --- y -- ").when(by == 3, F.repeat(F.lit("long name "), F.lit(20))).when(by == 4, "http://").otherwise(F.concat(url, F.lit("/rss.xml")))
    return src.table(spark, sf_dir, "pages").select("page_id", tx.file_name(name).alias("name"))


BODY = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)<br>', chr(10), 'g'), '(?i)<br/>', chr(10), 'g'), '(?i)<br />', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '(?i)</div>', chr(10), 'g'), '(?i)</li>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"""SELECT page_id, CASE WHEN contains(html, '</') THEN {BODY.format('html')} ELSE html END AS text FROM pages""")
def markdown_bodies(spark, sf_dir):
    """Pages as plain text with line ends for block tags."""
    return src.table(spark, sf_dir, "pages").select("page_id", tx.markdown_text(F.col("html")).alias("text"))


@query(f"""SELECT source AS folder, 'Article ' || doc_id || '.md' AS file, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS INTEGER) AS place,
md5('# Article ' || doc_id || chr(10) || chr(10) || '**Source:** ' || source || chr(10) || CASE WHEN lang <> 'en' THEN '**Author:** ' || lang || chr(10) ELSE '' END || '**Published:** ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id), '%B %-d, %Y at %-I:%M %p') || chr(10) || '**Link:** https://example.org/a/' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
CASE WHEN coalesce(text, '') = '' THEN '*No content available*' WHEN contains(text, '</') THEN {BODY.format('text')} ELSE text END) AS markdown FROM documents WHERE source IS NOT NULL AND regexp_matches(source, '^[a-z0-9]+$')
UNION ALL SELECT regexp_replace(replace(regexp_replace(source, '^https?://', ''), '/', '-'), '[:/\\?%*|"<>]', '', 'g'), 'Article ' || doc_id || '.md', CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS INTEGER),
md5('# Article ' || doc_id || chr(10) || chr(10) || '**Source:** ' || source || chr(10) || CASE WHEN lang <> 'en' THEN '**Author:** ' || lang || chr(10) ELSE '' END || '**Published:** ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id), '%B %-d, %Y at %-I:%M %p') || chr(10) || '**Link:** https://example.org/a/' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
CASE WHEN coalesce(text, '') = '' THEN '*No content available*' WHEN contains(text, '</') THEN {BODY.format('text')} ELSE text END) FROM documents WHERE source IS NOT NULL AND NOT regexp_matches(source, '^[a-z0-9]+$')""")
def markdown_export(spark, sf_dir):
    """Items as Markdown, a folder per source and a file per item, newest first; sources without items have no folder."""
    from loomgraph.sources import export

    items = src.feed_items(spark, sf_dir).join(src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    items = items.withColumns({"author": F.when(F.col("lang") != "en", F.col("lang")), "source": F.col("source_id"), "description": F.lit(None).cast("string")}).where("source is not null")
    return export.articles(items).select("folder", "file", "place", F.md5("markdown").alias("markdown"))


@query(r"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || ', ' || url || chr(10) || 'no' WHEN 1 THEN chr(10) || 'https://a.b/c,' WHEN 2 THEN '' ELSE ' ' || url END AS t FROM pages) SELECT page_id, u AS url FROM (SELECT page_id, unnest(list_transform(string_split_regex(t, '[,\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS u FROM t) WHERE starts_with(u, 'http')""")
def pasted_urls(spark, sf_dir):
    by, url = F.col("page_id") % 4, F.col("url")
    text = F.when(by == 0, F.concat(url, F.lit(", "), url, F.lit("\nno"))).when(by == 1, "\nhttps://a.b/c,").when(by == 2, "").otherwise(F.concat(F.lit(" "), url))
    return src.table(spark, sf_dir, "pages").select("page_id", F.explode(tx.url_list(text)).alias("url"))


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://news.com/about' || page_id WHEN 1 THEN 'https://a.org:80' WHEN 2 THEN url WHEN 3 THEN NULL ELSE 'http://shop.co/.uk' END AS url, page_id % 3 = 0 AS repository FROM pages""")
def repaired_urls(spark, sf_dir):
    """Addresses whose path follows the host without a slash; and which addresses are those of repositories."""
    by, three = F.col("page_id") % 5, F.col("page_id") % 3
    odd = F.when(by == 0, F.concat(F.lit(" https://news.comabout"), F.col("page_id"))).when(by == 1, "https://a.org:80").when(by == 2, F.col("url")).when(by == 3, " \n").otherwise("http://shop.co.uk")
    repo = F.when(three == 0, "https://github.com/one/two/").when(three == 1, "https://github.com/one/two/three").otherwise("https://example.org/one/two")
    return src.table(spark, sf_dir, "pages").select("page_id", tx.repaired_url(odd).alias("url"), tx.is_repository_url(repo).alias("repository"))


@query(rf"""WITH p AS (SELECT page_id, {stripped_sql()} AS t FROM pages) SELECT page_id, CASE WHEN length(t) <= 150 THEN t ELSE substr(t, 1, 150) || '...' END AS snippet, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 300) || '...' END AS preview,
CASE WHEN len(list_filter(string_split(t, ' '), lambda w: w <> '')) <= 4 THEN t ELSE array_to_string(list_slice(list_filter(string_split(t, ' '), lambda w: w <> ''), 1, 4), ' ') || '...' END AS label,
CASE WHEN len(list_filter(string_split(t, ' '), lambda w: w <> '')) = 0 THEN 0 ELSE greatest(1, len(list_filter(string_split(t, ' '), lambda w: w <> '')) // 200) END AS minutes, regexp_replace(t, '(?i)(the|de)', '<b>\1</b>', 'g') AS marked FROM p""")
def item_previews(spark, sf_dir):
    """Snippets, previews, short labels, minutes of reading, and query words marked."""
    rows = src.table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("t"))
    words = F.size(F.filter(F.split("t", " "), lambda w: w != ""))
    return rows.select("page_id", tx.cut(F.col("t"), 150).alias("snippet"), tx.cut(F.col("t"), 300).alias("preview"), tx.first_words(F.col("t"), 4).alias("label"), tx.reading_minutes(words).cast("long").alias("minutes"), tx.highlighted(F.col("t"), F.lit(" the de ")).alias("marked"))


@query("""SELECT doc_id AS id FROM documents WHERE contains(lower(strip_accents(coalesce('Article ' || doc_id, ''))), 'article 7') OR contains(lower(strip_accents(coalesce(substr(text, 1, 150), ''))), 'ero') OR contains(lower(strip_accents(coalesce(source, ''))), 'ero')""")
def item_search(spark, sf_dir):
    """Items with a text in title, snippet or source, whatever its case and accents."""
    from loomgraph.functions.search import contains_folded

    items = src.feed_items(spark, sf_dir)
    fields = [F.col("title"), F.substring("full_content", 1, 150), F.col("source_id")]
    return items.where(contains_folded(fields[0], "Article 7") | contains_folded(fields[1], "érO") | contains_folded(fields[2], "érO")).select("id")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role || ' ' || conv_id END AS keywords, CASE turn % 4 WHEN 1 THEN role END AS title, CASE WHEN turn % 4 = 1 THEN 'about ' || conv_id END AS summary FROM conversations""")
def parsed_answers(spark, sf_dir):
    """Keywords and labels out of a model's JSON answers, some fenced, some broken, some without text."""
    by, role, conv = F.col("turn") % 4, F.coalesce("role", F.lit("")), F.col("conv_id").cast("string")
    answer = F.when(by == 0, F.concat(F.lit('```json\n{"keywords": ["'), role, F.lit('", "'), conv, F.lit('"]}\n```'))).when(by == 1, F.concat(F.lit('```json\n{"title": "'), role, F.lit('", "summary": "about '), conv, F.lit('"}\n```'))).when(by == 2, '{"keywords": [], "title": "", "summary": "x"}').otherwise("no {json")
    label = tx.label_of_answer(answer)
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.keywords_of_answer(answer), " ").alias("keywords"), label["title"].alias("title"), label["summary"].alias("summary"))


@query("""WITH h AS (SELECT conv_id AS id, conv_id * 10 AS created_at, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT id, '[{"id":' || id || ',"relation":"asked_about","sourceNodes":["u' || id || '"],"targetNodes":["t' || turns || '"]}]' AS paths, 'asked_about' AS label, CAST(turns AS BIGINT) AS read FROM h WHERE id % 3 <> 0 ORDER BY created_at DESC LIMIT 20""")
def recent_history(spark, sf_dir):
    """Saved answers: paths encoded as JSON and read back, the newest twenty, those of every third id deleted."""
    from loomgraph.operators import history

    rows = src.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns")).withColumn("created_at", F.col("id") * 10)
    path = F.struct(F.col("id"), F.lit("asked_about").alias("label"), F.array(F.concat(F.lit("u"), "id")).alias("sourceNodes"), F.array(F.concat(F.lit("t"), "turns")).alias("targetNodes"), F.lit(None).cast("string").alias("provenanceText"))
    saved = rows.select("id", "created_at", history.encoded_paths(F.array(path)).alias("paths"))
    kept = history.deleted(saved, rows.where("id % 3 = 0").select("id"))
    read = history.decoded_paths(F.col("paths"))
    return history.recent(kept, 20).select("id", "paths", read[0]["label"].alias("label"), F.substring(read[0]["targetNodes"][0], 2, 20).cast("long").alias("read"))


@query("""SELECT event_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' Of ' || event_id AS title, event_type || ' of' AS relation, 0 AS chunk, event_type || ' of x' AS verb, 'A, B → ' || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' Of X → C' AS arrow FROM events""")
def relation_texts(spark, sf_dir):
    """Relations from edge ids: title, plain form and chunk number; as verb and with arrows."""
    key = F.concat(F.lit("12_"), "event_type", F.lit("_of_"), "event_id", F.lit("_chunk_3"))
    edge = F.concat("event_type", F.lit("_of_chunk0_0"))
    label = F.concat("event_type", F.lit("_OF_x"))
    return src.table(spark, sf_dir, "events").select("event_id", tx.relation_title(key).alias("title"), tx.relation_of_edge(edge).alias("relation"), tx.chunk_number(edge).alias("chunk"), tx.verb_phrase(label).alias("verb"), tx.relation_arrow(F.array(F.lit("A"), F.lit("B")), label, F.array(F.lit("C"))).alias("arrow"))


@query("""SELECT vec_id, 'float32' AS type, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x + x)), 4) AS doubled, 0.0::DOUBLE AS none, CAST(-2 AS TINYINT) AS wrapped, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS unit,
'[0.500000,null]' AS json, 2.5::DOUBLE AS l2, round(CAST(CAST(printf('%.6f', embedding[1]::DOUBLE) AS FLOAT) AS DOUBLE), 5) AS first, true AS nan FROM embeddings""")
def vector_forms(spark, sf_dir):
    """Types, sums, differences, unit length, JSON both ways."""
    v = F.col("embedding")
    two = vx.from_json(F.lit("[1.5, 0]"))
    wrapped = vx.added_int8(F.array(F.lit(127)).cast("array<tinyint>"), F.array(F.lit(127)).cast("array<tinyint>"))
    back = vx.from_json(vx.as_json(v))
    return src.table(spark, sf_dir, "embeddings").select(
        "vec_id", vx.type_of(v, "float32").alias("type"), F.round(vx.total(vx.added(v, v)), 4).alias("doubled"), vx.total(vx.subtracted(v, v)).alias("none"), F.element_at(wrapped, 1).alias("wrapped"), F.round(vx.norm(vx.normalized(v)), 6).alias("unit"),
        vx.as_json(F.array(F.lit(0.5), F.lit(float("nan")))).alias("json"), vx.l2_distance(two, vx.from_json(F.lit("[0, 2]"))).alias("l2"), F.round(back[0].cast("double"), 5).alias("first"), F.isnan(vx.normalized_or_nan(F.array(F.lit(0.0)))[0]).alias("nan"))


@query("""SELECT doc_id AS id, 1704067200 + doc_id * 3600 AS epoch, strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%d') AS day, doc_id * 3600 < 86400 * 7 AS first_week FROM documents""")
def item_dates(spark, sf_dir):
    """Epoch seconds, days, and whether an item is older than seven days before a date."""
    at = F.col("pub_date")
    return src.feed_items(spark, sf_dir).select("id", F.unix_timestamp(at).alias("epoch"), F.date_format(at, "yyyy-MM-dd").alias("day"), (at < F.timestamp_seconds(F.lit(1_704_067_200)) + F.expr("INTERVAL 7 DAYS")).alias("first_week"))


@query("""SELECT r_name AS source, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 5 > 1) AS items, greatest(0, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 5 > 1) - 3) AS added FROM region""")
def items_per_source(spark, sf_dir):
    """Items of every source, also of those without any, and how many are new beyond three."""
    items = src.table(spark, sf_dir, "nation").where("n_nationkey % 5 > 1").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("items"))
    rows = src.table(spark, sf_dir, "region").join(items, "r_regionkey", "left")
    return rows.select(F.col("r_name").alias("source"), F.coalesce("items", F.lit(0)).alias("items"), F.greatest(F.lit(0), F.coalesce("items", F.lit(0)) - 3).alias("added"))
