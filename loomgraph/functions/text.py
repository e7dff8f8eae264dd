"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.vectors import bound

#: Entities decoded when HTML is stripped, in this order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
#: Words left out of keyword queries.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as",
    "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "just", "and", "but", "if", "or", "because", "until", "while", "what",
    "which", "who", "whom", "this", "that", "these", "those", "am", "about", "it", "its", "they", "their", "them", "we", "us", "our",
    "you", "your", "he", "she", "him", "her", "his", "i", "me", "my",
)
#: Relation families and the word parts that decide them; the first family that matches counts.
FAMILIES = (
    ("Cause & Effect", ("cause", "result in", "lead to", "leads to", "led to", "trigger", "enable", "prevent", "block", "reduce", "increase", "impact", "affect", "disrupt", "transform", "drive", "accelerate")),
    ("Partnership", ("partner", "collaborate", "team up", "ally", "join", "integrate", "work with", "cooperate", "support")),
    ("Acquisition & Investment", ("acquire", "buy", "purchase", "invest", "fund", "merge", "raise", "sell", "divest", "ipo")),
    ("Competition", ("compete", "rival", "challenge", "outperform", "surpass", "overtake", "beat", "versus", "alternative")),
    ("Regulation & Legal", ("regulate", "ban", "approve", "fine", "sue", "comply", "enforce", "legislat", "sanction", "antitrust", "patent", "licens", "lawsuit")),
    ("Security Incident", ("hack", "breach", "attack", "vulnerab", "exploit", "malware", "ransomware", "phish", "compromis", "leak")),
    ("Pricing & Cost", ("price", "cost", "fee", "tariff", "discount", "revenue", "profit", "margin", "valuation", "billion", "million", "worth")),
    ("Performance & Benchmark", ("benchmark", "perform", "test", "evaluat", "score", "speed", "latency", "throughput", "accuracy", "efficien")),
    ("Hiring & Layoffs", ("hire", "recruit", "layoff", "lay off", "laid off", "fire", "restructur", "downsize", "appoint", "resign", "ceo")),
    ("Product Launch", ("launch", "release", "announc", "unveil", "introduce", "debut", "ship", "deploy", "roll out", "open source")),
    ("Association", ("use", "run", "has", "is", "include", "contain", "feature", "offer", "provide", "consist")),
)
#: The families' places in a one-hot vector.
FAMILY_ORDER = ("Cause & Effect", "Association", "Competition", "Partnership", "Acquisition & Investment", "Regulation & Legal", "Security Incident", "Pricing & Cost", "Performance & Benchmark", "Hiring & Layoffs", "Product Launch", "Other")
#: Prefixes and the suffix that a relation's readable form leaves out.
RELATION_PREFIXES, RELATION_SUFFIX = (r"^\d+_", r"^chunk_\d+_", r"^rel_\d+_"), r"_chunk_\d+$"
#: Ends of host names after which a path may follow without a slash, in the order of search.
HOST_ENDS = (".com", ".org", ".net", ".edu", ".gov", ".io", ".co", ".dev", ".info", ".biz", ".us", ".uk", ".ca", ".au")
MISSING_TEXT = "(Source text not available)"


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def sentences(text: Column) -> Column:
    """Stretches that end with full stops, exclamation or question marks; what stands behind the last mark is none.

    A mark is put behind an open end and its stretch dropped, or every place of the end would be tried as a start.
    """
    whole = F.regexp_like(text, F.lit(r"[.!?]\z"))
    found = F.regexp_extract_all(F.when(whole, text).otherwise(F.concat(text, F.lit("."))), F.lit("[^.!?]+[.!?]+"), F.lit(0))
    return F.when(whole, found).otherwise(bound(found, lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))))


def match_query(text: Column) -> Column:
    """Each word quoted, inner quotes doubled, the last with a star inside its quotes."""
    words = F.filter(F.split(trimmed(text), " "), lambda w: w != "")
    n = F.size(words)
    return F.array_join(F.transform(words, lambda w, i: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.when(i == n - 1, '*"').otherwise('"'))), " ")


def keywords(text: Column, most: int = 5) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.slice(F.array_except(F.filter(F.array_distinct(words), lambda w: F.length(w) > 2), F.array(*map(F.lit, STOPWORDS))), 1, most)


def relation_family(verb: Column) -> Column:
    verb = F.lower(F.coalesce(verb, F.lit("")))
    found = None
    for family, parts in FAMILIES:
        hit = verb.rlike("|".join(parts))
        found = F.when(hit, family) if found is None else found.when(hit, family)
    return found.otherwise("Other")


def relation_one_hot(family: Column) -> Column:
    """Array of as many zeros as there are families, with a one at the family's place."""
    return F.array(*[(family == f).cast("double") for f in FAMILY_ORDER])


def capitalised(words: Column) -> Column:
    """Words joined by spaces, each with a capital first letter and small ones behind."""
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")


def relation_title(edge_id: Column) -> Column:
    """Readable relation from an edge id: number prefixes and chunk suffix off, title case."""
    text = edge_id
    for pattern in (*RELATION_PREFIXES, RELATION_SUFFIX):
        text = F.regexp_replace(text, pattern, "")
    text = capitalised(F.split(text, "_"))
    return F.when(text == "", edge_id).otherwise(text)


def relation_of_edge(edge_id: Column) -> Column:
    """Relation in an edge id: what stands before "_chunk", else all but the first of its parts; spaces for underscores in the first case."""
    before = F.substring_index(edge_id, "_chunk", 1)
    parts = F.split(edge_id, "_")
    rest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "_")).otherwise(edge_id)
    return F.when(F.contains(edge_id, F.lit("_chunk")) & (before != ""), F.replace(before, F.lit("_"), F.lit(" "))).otherwise(rest)


def chunk_number(chunk_id: Column) -> Column:
    """The number after the last underscore; null if there is none."""
    return F.element_at(F.split(chunk_id, "_"), -1).try_cast("int")


def verb_phrase(label: Column) -> Column:
    return F.lower(F.replace(label, F.lit("_"), F.lit(" ")))


def relation_sentence(sources: Column, label: Column, targets: Column) -> Column:
    """"A, B verb C."; without targets "A, B verb."."""
    said = F.concat(F.array_join(sources, ", "), F.lit(" "), verb_phrase(label))
    return F.when(F.size(targets) == 0, F.concat(said, F.lit("."))).otherwise(F.concat(said, F.lit(" "), F.array_join(targets, ", "), F.lit(".")))


def relation_arrow(sources: Column, label: Column, targets: Column) -> Column:
    title = capitalised(F.split(F.replace(label, F.lit("_"), F.lit(" ")), " "))
    return F.concat_ws(" → ", F.array_join(sources, ", "), title, F.array_join(targets, ", "))


def path_description(source: Column, between: Column, target: Column) -> Column:
    return F.when(F.size(between) == 0, F.concat(source, F.lit(" connects directly to "), target)).otherwise(F.concat_ws(" → ", source, F.array_join(between, " → "), target))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def trimmed(text: Column) -> Column:
    """White space at both ends off."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and a slash at the end of the path off; a lone slash stays.

    User names before an @ stay as they are. An address without a scheme (no colon in its first part) is a path with
    what follows. Other text is trimmed and stays.
    """
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*)([^?#\s]*)([^\s]*)$"
    bare = r"^((?!//)[^/?#:\s]+(?:/[^?#\s]*)?|/(?!/)[^?#\s]*)([?#][^\s]*)?$"
    part = [F.regexp_extract(url, form, i) for i in range(1, 5)]
    scheme, host = F.lower(part[0]), F.lower(F.regexp_extract(part[1], "[^@]*$", 0))
    user = F.regexp_extract(part[1], "^(.*@)?", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(F.length(part[2]) > 1, F.regexp_replace(part[2], "/$", "")).otherwise(part[2])
    return F.when(F.regexp_like(url, F.lit(form)), F.concat(scheme, F.lit("://"), user, host, path, part[3])).otherwise(
        F.when(F.regexp_like(url, F.lit(bare)), F.concat(F.regexp_replace(F.regexp_extract(url, bare, 1), "(.)/$", "$1"), F.regexp_extract(url, bare, 2))).otherwise(trimmed(url)))


def repaired_url(url: Column) -> Column:
    """Trimmed; a path that follows the end of the host name without a slash gets one; null if nothing is left."""
    text = trimmed(url)
    scheme, host = F.regexp_extract(text, "^([^:]*://)", 1), F.regexp_replace(text, "^[^:]*://", "")
    fixed = F.when(F.contains(host, F.lit("/")) | (scheme == ""), text)
    for end in HOST_ENDS:  # the first that occurs decides
        at = F.instr(F.lower(host), F.lit(end))
        rest = F.substr(host, at + len(end))
        open_end = (rest == "") | rest.startswith(":")
        fixed = fixed.when(at > 0, F.when(open_end, text).otherwise(F.concat(scheme, F.substr(host, F.lit(1), at + len(end) - 1), F.lit("/"), rest)))
    return F.when(text != "", fixed.otherwise(text))


def is_repository_url(url: Column) -> Column:
    """Whether the address is that of a source repository on github.com: two parts in its path."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    return F.coalesce(host.isin("github.com", "www.github.com") & (F.size(parts) == 2), F.lit(False))


def url_list(text: Column) -> Column:
    """Addresses in pasted text, between line ends or commas."""
    parts = F.transform(F.split(text, r"[,\n\r\x0B\x0C\x85\u2028\u2029]"), trimmed)
    return F.filter(parts, lambda p: p.startswith("http"))


def file_name(title: Column) -> Column:
    """A name for a file: scheme, feed words and characters that file systems refuse off, at most 80 code points."""
    text = F.regexp_replace(title, "^https?://", "")
    for word, by in (("/feed", ""), ("/rss", ""), (".xml", ""), ("/", "-")):
        text = F.replace(text, F.lit(word), F.lit(by))
    text = F.regexp_replace(F.translate(text, ':/\\?%*|"<>', ""), "-{2,}", "-")
    text = F.substring(F.regexp_replace(text, "^[- ]+|[- ]+$", ""), 1, 80)
    return F.when(F.coalesce(text, F.lit("")) == "", "untitled").otherwise(text)


def cut(text: Column, most: int) -> Column:
    """The first ``most`` code points, with dots where something is left out."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def first_words(label: Column, most: int) -> Column:
    words = F.filter(F.split(label, " "), lambda w: w != "")
    return F.when(F.size(words) <= most, label).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("...")))


def reading_minutes(words: Column) -> Column:
    """At 200 words a minute, at least one; 0 without words."""
    return F.when(words > 0, F.greatest(F.lit(1), F.floor(words / 200).cast("int"))).otherwise(0)


def highlighted(text: Column, query: Column) -> Column:
    """Occurrences of the query's words in <b> and </b>, whatever their case."""
    words = F.filter(F.split(trimmed(query), " "), lambda w: w != "")
    quoted = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.array_join(F.transform(F.array_distinct(words), quoted), "|")
    return F.when(F.size(words) == 0, text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?iu)("), pattern, F.lit(")")), F.lit("<b>$1</b>")))


#: Tags that become line ends in Markdown, and entities decoded there, in order.
LINE_TAGS = (("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n"), ("</li>", "\n"))
MARKDOWN_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def markdown_text(html: Column) -> Column:
    """Plain text with line ends for block tags; text without closing tags stays as it is."""
    text = html
    for tag, end in LINE_TAGS:
        text = F.regexp_replace(text, f"(?i){tag}", end)
    text = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in MARKDOWN_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = trimmed(F.regexp_replace(text, "\n{3,}", "\n\n"))
    return F.when(F.contains(html, F.lit("</")), text).otherwise(html)


def article_markdown(title: Column, link: Column, author: Column, published: Column, source: Column, content: Column) -> Column:
    """Title, metadata, a rule and the body or a placeholder; absent metadata is left out."""
    by = F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit("**Author:** "), author, F.lit("\n"))).otherwise("")
    at = F.coalesce(F.concat(F.lit("**Published:** "), F.date_format(published, "MMMM d, yyyy 'at' h:mm a"), F.lit("\n")), F.lit(""))
    body = F.when(F.coalesce(content, F.lit("")) == "", "*No content available*").otherwise(markdown_text(content))
    return F.concat(F.lit("# "), title, F.lit("\n\n**Source:** "), source, F.lit("\n"), by, at, F.lit("**Link:** "), link, F.lit("\n\n---\n\n"), body)


def without_fences(text: Column) -> Column:
    """An answer without Markdown code fences around it."""
    inner = trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), r"^```[^\n]*\n", ""), "```$", ""))
    return F.when(F.startswith(trimmed(text), F.lit("```")), inner).otherwise(trimmed(text))


def keywords_of_answer(answer: Column) -> Column:
    """Array of keywords in a JSON answer; null when there are none."""
    found = F.from_json(trimmed(F.replace(F.replace(answer, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))), "keywords array<string>")["keywords"]
    return F.when(F.size(found) > 0, found)


def label_of_answer(answer: Column) -> Column:
    """Struct of title and summary in a JSON answer; null unless both have text."""
    found = F.from_json(without_fences(answer), "title string, summary string")
    return F.when((F.coalesce(found["title"], F.lit("")) != "") & (F.coalesce(found["summary"], F.lit("")) != ""), found)


def deep_analysis(synthesis: Column, hypotheses: Column, analyzed_at: Column, created_at: Column, legacy: Column) -> Column:
    """Struct of synthesizedAnswer, hypotheses, analyzedAt from the columns, or else from the older JSON column."""
    old = F.from_json(legacy, "synthesizedAnswer string, hypotheses string, analyzedAt double")
    old = F.when(old["synthesizedAnswer"].isNotNull() & old["hypotheses"].isNotNull() & old["analyzedAt"].isNotNull(), old)
    own = F.struct(synthesis.alias("synthesizedAnswer"), hypotheses.alias("hypotheses"), F.coalesce(analyzed_at, created_at).cast("double").alias("analyzedAt"))
    return F.when(synthesis.isNotNull() & hypotheses.isNotNull(), own).otherwise(old)


def is_cut_off(text: Column) -> Column:
    return F.endswith(text, F.lit("...")) | F.endswith(text, F.lit("…"))


def needs_full_content(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce((F.length(text) < 500) | is_cut_off(text) | F.contains(low, F.lit("read more")) | F.contains(low, F.lit("continue reading")), F.lit(True))


def admitted(text: Column) -> Column:
    body = trimmed(text)
    return F.coalesce((F.length(body) >= 100) & ~is_cut_off(body), F.lit(False))
