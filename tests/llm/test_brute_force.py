"""Operators that SQL can't express, against plain loops and dictionaries."""

import collections
import functools
import math
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomgraph.llm")
from loomgraph.llm import fingerprints, language, line_dedup, quality  # noqa: E402

sys.path.insert(0, "tests")
from test_queries import SF  # noqa: E402

LONG = " ".join(f"word{i % 700}" for i in range(3_000))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def kneser_ney(texts):
    """A function that gives a text's loss, whole and beyond the cache, under a model of the texts."""
    order, begin = quality.ORDER, -1

    def grams(t):
        codes = [begin] * (order - 1) + [ord(c) for c in t]
        return [tuple(codes[i: i + order]) for i in range(len(t))]

    counts = {order: collections.Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    off, totals, back = {}, collections.Counter(), collections.Counter()
    for k in counts:
        seen = collections.Counter(counts[k].values())
        n1, n2, n3, n4 = (seen[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        off[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(raw, 1)]
        for g, n in counts[k].items():
            totals[k, g[:-1]] += n
            back[k, g[:-1]] += off[k][min(n, 3) - 1]

    @functools.cache
    def chance(g):
        lower = chance(g[1:]) if len(g) > 1 else 1 / 0x110000
        total = totals[len(g), g[:-1]]
        n = counts[len(g)].get(g, 0)
        return (((n - off[len(g)][min(n, 3) - 1]) if n else 0) + back[len(g), g[:-1]] * lower) / total if total else lower

    def losses(text):
        found, last, total, fresh = grams(text), {}, 0.0, 0.0
        for i, g in enumerate(found):
            loss = -math.log(chance(g))
            total += loss
            fresh += loss if i - last.get(g, -math.inf) > quality.CACHE else 0
            last[g] = i
        return total, fresh

    return losses


def test_quality_brute_force(spark):
    """Rates, thresholds and decisions over all documents."""
    docs = documents(spark)
    held = {r.doc_id for r in docs.where("pmod(xxhash64(text), 4) = 0").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = [r for r in docs.collect() if (r.text or "").strip()]
    losses = kneser_ney([r.text for r in rows if r.doc_id in trusted - held])
    found = {r.doc_id: (*losses(r.text), len(r.text), r.lang) for r in rows}

    def exact(values, share):
        steps = sorted(round(v / quality.STEP) for v in values)
        return next(x for i, x in enumerate(steps, 1) if i >= share * len(steps)) * quality.STEP

    limits = {}
    for lang in {None, *(r.lang for r in rows)}:
        mine = [found[i] for i in trusted if i in found and lang in (None, found[i][3])]
        if lang is None or len(mine) >= quality.FEWEST:
            middles = [exact([x[k] / x[2] for x in mine], 0.5) for k in (0, 1)]
            drawn = [[(x[k] + quality.SHRINK * middles[k]) / (x[2] + quality.SHRINK) for x in mine] for k in (0, 1)]
            limits[lang] = (*middles, exact(drawn[0], quality.HIGH) * quality.MARGIN, exact(drawn[1], quality.LOW) / quality.MARGIN)
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == docs.count() and not any(r.keep for i, r in got.items() if i not in found)
    for i, (loss, fresh, n, lang) in found.items():
        middle, middle_fresh, high, low = limits.get(lang, limits[None])
        rate, rest = (loss + quality.SHRINK * middle) / (n + quality.SHRINK), (fresh + quality.SHRINK * middle_fresh) / (n + quality.SHRINK)
        assert (got[i].perplexity, got[i].fresh_perplexity) == pytest.approx((math.exp(rate), math.exp(rest)), rel=3e-3)
        assert (got[i].low, got[i].high) == pytest.approx((math.exp(low), math.exp(high)), rel=3e-3)
        assert got[i].keep == (rate <= high and rest >= low) or min(abs(rate - high), abs(rest - low)) < 2 * quality.STEP
    again = {r.doc_id: r for r in quality.report(docs.repartition(5), labels).collect()}
    assert again == got


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rate = {(r.quality, r.toxic): r.n for r in quality.report(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.expr("avg(int(keep)) AS n")).collect()}
    assert rate[1, 0] > 0.99 and rate[0, 0] < 0.05 and rate[0, 1] < 0.05
    rows = spark.createDataFrame([(1, "some text", "en", 7), (1, "some text", "en", 7), (2, None, None, 7), (3, " \n", "fr", 7), (None, LONG, "xx", 7)], "doc_id long, text string, lang string, `part.hi` int")
    assert quality.report(rows.limit(0), labels).count() == quality.good_documents(rows.limit(0), labels).count() == 0
    unlabelled = quality.good_documents(rows, labels.limit(0))
    assert unlabelled.columns == rows.columns and sorted(str(r.doc_id) for r in unlabelled.collect()) == ["1", "1", "None"]
    some = spark.createDataFrame([(1, 1, 0), (1, 0, None)], "doc_id long, quality int, toxic int")
    found = quality.report(rows, some).collect()
    assert len(found) == 5 and {r.doc_id: r.keep for r in found if r.doc_id in (2, 3)} == {2: False, 3: False} and len({r for r in found if r.doc_id == 1}) == 1


def test_quality_pieces(monkeypatch):
    """Cutting a text, for its length or its alphabet, changes nothing."""
    texts = [LONG[:5000], "", "".join(chr(0x4E00 + i * 7 % 9000) for i in range(20_000)), "ab" * 300]

    def facts():
        out = collections.defaultdict(list)
        for spans in quality.pieces(texts):
            for p in quality.grams(texts, spans):
                words = list(zip(*(x.tolist() for x in p.words())))
                for i, at, recent in zip(p.owner.tolist(), p.at.tolist(), p.recent.tolist()):
                    out[i].append((words[at], recent))
        return [out[i] for i in range(len(texts))]

    def listed():
        return {w for spans in quality.pieces(texts) for p in quality.grams(texts, spans, numbered=False) for w in zip(*(x.tolist() for x in p.words()))}

    whole = facts()
    assert [len(whole[i]) for i in range(4)] == [len(t) for t in texts] and listed() == {w for x in whole for w, _ in x}
    for i, text in enumerate(texts):
        codes, last = [quality.BEGIN] * 4 + [ord(c) for c in text], {}
        for k, (word, recent) in enumerate(whole[i]):
            a, b, c, d, e = codes[k: k + 5]
            assert word == (a << 21 | b, c << 42 | d << 21 | e) and recent == (k - last.get(word, -99) <= quality.CACHE)
            last[word] = k
    monkeypatch.setattr(quality, "PIECE", 700)
    assert facts() == whole and listed() == {w for x in whole for w, _ in x}
    monkeypatch.setattr(quality, "MOST_SYMBOLS", 90)
    assert facts() == whole and listed() == {w for x in whole for w, _ in x}


def test_language_brute_force():
    """Windows, states and pooling, byte by byte."""
    net = language.Network.new(["a", "b", "c"])
    w = {k: v.astype(float) for k, v in net.weights.items()}
    texts = ["Überall", "x" * 300, LONG[:2000], "ñ"]
    for text, p in zip(texts, language.pooled(net, texts, abreast=8)):
        raw, total = text.encode(), np.zeros(3)
        for a in range(0, len(raw), language.WINDOW):
            x = [*raw[a: a + language.WINDOW]]
            x += [256] * (language.WINDOW - len(x))
            states = {}
            for d, at in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
                h = np.zeros(language.HIDDEN)
                for t in at:
                    given = w[f"table_{d}"][x[t]]
                    zr = 1 / (1 + np.exp(-(given[: 2 * len(h)] + h @ w[f"gates_{d}"])))
                    z, r = zr[: len(h)], zr[len(h):]
                    h = (1 - z) * np.tanh(given[2 * len(h):] + (r * h) @ w[f"new_{d}"]) + z * h
                    states[d, t] = h
            for t in range(min(language.WINDOW, len(raw) - a)):
                score = np.concatenate([states["f", t], states["b", t]]) @ w["out"] + w["bias"]
                total += score - np.log(np.exp(score).sum())
        mean = total / len(raw) * min(len(raw), language.WINDOW) ** 0.5
        assert p == pytest.approx(np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum(), abs=1e-3)


def test_language_sample(spark):
    """All languages are learnt, whatever their ids, from all places of their texts."""
    many = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "if(id % 4 = 0, 'fr', 'en') AS lang", "concat(repeat('x', 300), id, repeat('y', 300)) AS text")
    others = spark.range(300).selectExpr("7L AS doc_id", "concat('l', id) AS lang", "concat('text ', id) AS text")
    found = collections.Counter(lang for _, lang in language.sample(many.unionByName(others), F.lit(True)))
    assert len(found) == 302 and found["en"] == found["fr"] == min(language.PER_LANGUAGE, language.SAMPLE // 302)
    slices = [t for t, lang in language.sample(many, F.lit(True)) if lang == "en"]
    assert min(sum("x" in t for t in slices), sum("y" in t for t in slices)) > len(slices) / 3


def filters(text, ranks):
    """Bits of the chained filters, window by window."""
    width, margin = fingerprints.WINDOW, fingerprints.FILLER * fingerprints.MARGIN
    raw = margin + text.encode() + margin if text else b""
    keys = [(ranks[x], i) for i, x in enumerate(levels(raw))]
    span = min(fingerprints.NEAR, len(keys))
    best = collections.Counter(min(keys[i: i + span])[1] for i in range(len(keys) - span + 1)) if keys else {}
    chosen = sorted(i for i, n in best.items() if n >= fingerprints.POPULAR) or ([min(keys)[1]] if keys else [])
    features = []
    for i in chosen:
        total, power = 0, 1
        for byte in raw[i: i + width]:
            power = power * int(fingerprints._ODD) % 2**64
            total = (total + int(fingerprints._BYTE[byte]) * power) % 2**64
        features.append(int(fingerprints.mixed(np.array([total], np.uint64))[0]))
    features = list(dict.fromkeys(features))
    m, out = fingerprints.FILTER_BYTES * 8, []
    for at in range(0, len(features), fingerprints.PER_FILTER):
        out.append({((f & 0xFFFFFFFF) + k * (f >> 32 | 1)) % m for f in features[at: at + fingerprints.PER_FILTER] for k in range(fingerprints.HASHES)})
    return out


def levels(raw):
    width, found = fingerprints.WINDOW, []
    for i in range(len(raw) - width + 1):
        n = collections.Counter(raw[i: i + width])
        found.append(min(max(round((math.log2(width) - sum(c * math.log2(c) for c in n.values()) / width) * 16), 0), fingerprints.LEVELS - 1))
    return found


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    m, total = fingerprints.FILTER_BYTES * 8, 0.0
    for x in a:
        near = []
        for y in b:
            chance, most = len(x) * len(y) / m, min(len(x), len(y))
            least = chance + 3 * math.sqrt(chance * (1 - len(x) / m) * (1 - len(y) / m))
            near.append((len(x & y) - least) / (most - least) if most > least else float(len(x & y) >= most))
        total += min(max(max(near), 0), 1) * len(x)
    return total / sum(map(len, a))


def test_fingerprints_brute_force(spark):
    """Features, filters and likeness over a whole table of odd lengths."""
    whole = [r.text for r in documents(spark).where("n_chars > 3000").orderBy("doc_id").limit(3).collect()]
    texts = ["", "x", "short", *(whole[0][:n] for n in (15, 40, 100, 255, 256, 2500)), whole[1], "", None, whole[2][:300]]
    margin = fingerprints.FILLER * fingerprints.MARGIN
    seen = collections.Counter(x for t in texts if t for x in levels(margin + t.encode() + margin))
    ranks = {x: k for k, x in enumerate(sorted(range(fingerprints.LEVELS), key=lambda x: (seen[x] == 0, seen[x], x)))}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.report(rows).collect():
        text, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [filters(t, ranks) for t in (text, edited, after)]
        for got, want in zip((r.fingerprint, r.edited_fingerprint), prints):
            assert [set(np.flatnonzero(f).tolist()) for f in fingerprints.decoded(got)] == want if got else not want
        assert (r.near_edited, r.near_next) == pytest.approx((alike(prints[0], prints[1]), alike(prints[0], prints[2])), abs=1e-5)


def test_fingerprints_of_all_lengths(spark):
    """A text less its end is alike at every length from 60 bytes on; shorter ones have one or two features."""
    docs = documents(spark)
    ranks = fingerprints.corpus_ranks(docs)
    one, two = (r.text for r in docs.where("n_chars > 2000").orderBy("doc_id").limit(2).collect())
    for n in range(65, 400, 7):
        a, b, c = fingerprints.fingerprints([one[:n].encode(), one[: n - 6].encode(), two[:n].encode()], ranks)
        assert fingerprints.likeness(a, b) > 0.5 > fingerprints.likeness(a, c)


def test_fingerprint_of_a_long_text(monkeypatch):
    ranks = fingerprints.ranks_of(np.arange(fingerprints.LEVELS))
    raw = np.random.default_rng(1).integers(97, 110, 30_000, np.uint8).tobytes()
    whole = fingerprints.fingerprints([raw], ranks)[0]
    monkeypatch.setattr(fingerprints, "PIECE", 1000)
    assert (fingerprints.fingerprints([raw], ranks)[0] == whole).all()


def test_line_dedup_over_partitions(spark):
    """Common lines' runs go on over partitions."""
    lines = [f"line number {i} of the common ones" for i in range(3)]
    texts = {i: "\n".join([lines[0], lines[0], f"own line of document {i}", lines[1 + i % 2]]) for i in range(1500)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    keeper = {lines[0]: 1499, lines[1]: 1498, lines[2]: 1499}
    want = {i: "\n".join(x for x in t.split("\n") if keeper.get(x, i) == i) for i, t in texts.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(rows).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_runs():
    """Dropped lines from runs cut anywhere equal those of whole runs."""
    rng = np.random.default_rng(3)
    rows = sorted({(int(h), 0, int(d), 0, int(k)) for h, d, k in zip(rng.integers(0, 6, 400), rng.integers(0, 40, 400), rng.integers(0, 5, 400))}, key=lambda r: (r[0], -r[2], r[4]))
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(6)}
    want = {r for r in rows if len(docs[r[0]]) >= 3 and r[2] != max(docs[r[0]])}
    for cuts, most in ((1, 1_000_000), (9, 1_000_000), (9, 20)):
        lines, summaries, dropped = [], collections.defaultdict(list), set()
        for part in np.array_split(np.arange(len(rows)), cuts):
            mine = [rows[i] for i in part]
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 4 else pa.int64()) for k, c in enumerate(zip(*mine[a: a + 7]))], names=["h1", "h2", "doc", "row", "line"]) for a in range(0, len(mine), 7)]
            for batch in line_dedup.runs(3, most)(iter(batches)):
                for r in batch.to_pylist():
                    key = (r["h1"], r["h2"], r["doc"], r["row"], r["line"])
                    if not r["open"]:
                        dropped.add(key)
                    elif r["line"] is None:
                        summaries[r["h1"]].append((r["doc"], r["last"], r["docs"]))
                    else:
                        lines.append(key)
        for h, found in summaries.items():
            found.sort(reverse=True)
            n = sum(x[2] for x in found) - sum(a[1] == b[0] for a, b in zip(found, found[1:]))
            dropped |= {r for r in lines if r[0] == h and n >= 3 and r[2] != found[0][0]}
        assert dropped == want
