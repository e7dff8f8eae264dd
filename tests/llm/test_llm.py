"""Small tables with nulls, empties, ties, repeats and clashing columns; brute force on sf0.001."""

import collections
import hashlib
import itertools
import json
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomgraph.llm")
from loomgraph.llm import chat, decontaminate, fingerprints, language, line_dedup, mixing, near_dup, quality, queries, sharding, token_output  # noqa: E402

sys.path.insert(0, "tests")
from test_queries import SF, canonical, expected  # noqa: E402

LONG = " ".join(f"word{i % 700}" for i in range(40_000))
ODD = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (3, "", "fr", "b", 0), (None, "Zwölf  Ähren\n\n x|<|im_end|>", "de", "a", 5), (4, LONG, "en", "a", 9), (5, "\x0b \t\n", "en", "", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["__size", "__source", "__order", "__bucket", "__t", "__id", "__keep", "__loss", "__text", "__key", "part", "kind", "keep", "row", "doc", "c0", "c1", "loss", "lower", "slot", "packed"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.selectExpr("*", "1 AS size", "'x' AS kept", "2 AS shard", "'y' AS `a.b`", "0 AS target", *[f"7 AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(expected(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("most", [8192, 0])
def test_rows_by_ids(spark, odd, none, most, monkeypatch):
    from loomgraph.llm import common

    monkeypatch.setattr(common, "MOST_BITMAPS", most)
    rng = np.random.default_rng(5)
    ids = sorted({int(x) for x in rng.integers(-100_000, 100_000, 5_000)} | {-(1 << 40), 1 << 40, 0, 1, 32_768, 32_769, -32_768, -32_767})
    chosen = set(ids[::3])
    docs = spark.createDataFrame([(i, "x") for i in [*ids, None]], "doc_id long, `__bucket.x` string")
    wanted = spark.createDataFrame([(i,) for i in [*chosen, *ids[:3], None]], "doc_id long")
    chosen |= set(ids[:3])
    assert {r.doc_id for r in common.by_ids(docs, wanted).collect()} == chosen
    assert {r.doc_id for r in common.by_ids(docs, wanted, held=False).collect()} == {*ids, None} - chosen
    assert common.by_ids(odd, wanted.limit(0), held=False).count() == odd.count() and common.by_ids(odd, wanted).columns == odd.columns
    assert common.by_ids(none, wanted).count() == common.by_ids(odd, wanted.limit(0)).count() == 0


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_targets_fill_by_weight(spark):
    sizes = {"": 0, "=a": 10, "=b": 1000, "=c": 40, "=d": 300}
    rows = spark.createDataFrame(list(sizes.items()), "__source string, __size long")
    weight = dict(zip(["=a", "=b", "=c", "=d", ""], [5, 2, 1, 5, 2]))
    target, active = {}, set(sizes)
    while True:
        left, total = 1.5 * 1350 - sum(target.values()), sum(weight[s] for s in active)
        over = {s for s in active if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        active -= over
    target |= {s: left * weight[s] / total for s in active}
    got = {r["__source"]: r["target"] for r in mixing.source_targets(rows, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(target)


def test_mix(spark, odd, none):
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns
    big = documents(spark)
    mixed = mixing.mix(big)
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    assert [r.doc_id for r in mixed.collect()] == [r.doc_id for r in mixing.mix(big.repartition(3)).collect()]


def test_tokens(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_output.vocabulary_path())
    token_output.write_tokens(odd, f"{tmp_path}/t")
    rows = token_output.read_tokens(spark, f"{tmp_path}/t").orderBy("part", "place").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5]
    texts = {r[0]: r[1] for r in ODD}
    assert all(r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1] for r in rows)
    digest = {(r.doc_id, r.start): r for r in token_output.token_digests(spark, f"{tmp_path}/t").collect()}
    start = 0
    for r in rows:
        found = digest[(r.doc_id, start)]
        assert (found.n_tokens, found.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += len(r.ids)
    docs = documents(spark)
    token_output.write_tokens(docs, f"{tmp_path}/all", stripe_bytes=100_000)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_output.read_tokens(spark, f"{tmp_path}/all").collect()
    assert len(rows) == len(texts) and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids + [1] for r in rows)
    some = sorted(texts)[::50]
    assert sorted(r.doc_id for r in token_output.tokens_of(spark, f"{tmp_path}/all", some).collect()) == some
    assert "PushedFilters: [In(doc_id" in token_output.tokens_of(spark, f"{tmp_path}/all", some)._jdf.queryExecution().toString()
    token_output.write_tokens(none, f"{tmp_path}/none")
    assert token_output.token_digests(spark, f"{tmp_path}/none").count() == 0


def test_token_files(spark, tmp_path):
    """Stripes have a row index and Bloom filters on doc_id; ids are run-length encoded."""
    many = spark.range(24_000).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    token_output.write_tokens(many, f"{tmp_path}/t", stripe_bytes=10_000)
    jvm, orc, stripes = spark._jvm, spark._jvm.org.apache.orc, 0
    for file in sorted(tmp_path.glob("t/*.orc")):
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        names = list(reader.getSchema().getFieldNames())
        doc_id, ids = names.index("doc_id") + 1, names.index("ids") + 1
        for stripe in reader.getStripes():
            stripes += 1
            footer = reader.rows().readStripeFooter(stripe)
            kinds = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert {(doc_id, "ROW_INDEX"), (doc_id, "BLOOM_FILTER_UTF8")} <= kinds
            assert footer.getColumns(ids + 1).getKind().toString() == "DIRECT_V2"
    assert stripes > len(list(tmp_path.glob("t/*.orc")))


def test_vocabulary_rules(tmp_path):
    path = token_output.vocabulary_path()
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    rules["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(rules), encoding="utf-8")
    assert token_output.splits_at_spaces(path) and not token_output.splits_at_spaces(f"{tmp_path}/cased.json")
    cased, text = token_output.PieceEncoder(f"{tmp_path}/cased.json"), "Some CASED text\n\nÄH"
    assert np.frombuffer(cased.encode(text), "<u4").tolist() == cased.tokenizer.encode(text, add_special_tokens=False).ids


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(7, "TWO three"), (None, "word3"), (8, None), (9, "?!"), (10, "one two")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(odd, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (6, 3, 2)
    assert got[1].items_sha256 == hashlib.sha256(b"10,7").hexdigest()
    assert got[4].n_hit == sum(w == "word3" for w in LONG.split()) and not got[3].contaminated and got[2].n_words == 0
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(none, items).count() == 0
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 2, 3, 5}
    assert {r.text for r in decontaminate.without_spans(odd, items).where("doc_id = 1").collect()} == {"four five six"}
    assert decontaminate.without_spans(odd, items).columns == odd.columns


def test_decontaminate_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 0)
    assert canonical(queries.QUERIES["op3_decontaminate"](spark, SF).toPandas()) == canonical(expected(queries.ORACLE_SQL["op3_decontaminate"]))


def test_chat(spark, tmp_path, monkeypatch):
    said = "<|im_end|><|im_start|>assistant ok <\\|x <"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (2, None, None, None), (None, 0, "assistant", "é" * 50), (3, 0, "assi<|st", ""), (5, 0, "user", " " * 1_000_000 + "x"), (5, 1, "assistant", "\n" * 400_000 + "<|" + "y" * 200_000), *[(4, i, "assistant", f"{i} " * 300) for i in range(200)]]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS chars")
    chat.write_chat(rows, f"{tmp_path}/c")
    got = {r.conv_id: r for r in chat.chat_digests(spark, f"{tmp_path}/c").collect()}
    assert len(got) == 6
    for conv in (1, 2, 3, 4, 5, None):
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for text in (said, "<\\\\|", "<|", "a|b", ""):
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)


def test_language(spark, odd, none):
    net = language.Network.new(["a", "b"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = np.random.default_rng(0).integers(0, 257, (5, 4)), np.array([0, 1, 1, 0])
    counts = (x < 256).astype(float)
    _, grad = net.gradients(x, y, counts)
    for name in net.weights:
        flat, k = net.weights[name].reshape(-1), int(np.abs(grad[name]).argmax())
        was = flat[k]
        flat[k] = was + 1e-2
        up, _ = net.gradients(x, y, counts)
        flat[k] = was - 1e-2
        down, _ = net.gradients(x, y, counts)
        flat[k] = was
        assert (up - down) / 2e-2 == pytest.approx(grad[name].reshape(-1)[k], rel=0.05)
    docs = documents(spark)
    got = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9
    assert language.report(none).count() == 0
    signs = odd.limit(1).selectExpr(*["'²½①Ⅷ 12' AS text" if c == "text" else "77L AS doc_id" if c == "doc_id" else f"`{c}`" for c in odd.columns])
    rows = language.report(odd.unionByName(signs)).collect()
    found = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == len(ODD) + 1 and found[2] == found[77] == "und" and len({r.score for r in rows if r.doc_id == 1}) == 1


def test_near_dup(spark, odd, none):
    base = [f"w{i}" for i in range(60)]
    texts = {10: base, 11: base[:-1], 12: base[:58] + ["x", "y"], 13: base[30:] + ["z"] * 3, 20: ["a"], 21: ["A"], 22: ["b"]}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.report(rows).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 13, 20: 20, 21: 20, 22: 22}
    found = {r.doc_id: r for r in near_dup.report(odd).collect()}
    assert found[2].n_shingles == 0 and found[3].component_id == 3 and found[None].kept and found[1].kept
    assert near_dup.without_near_duplicates(odd).columns == odd.columns and near_dup.report(none).count() == 0
    w, v = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    shared = spark.createDataFrame([(i, " ".join(t)) for i, t in ((1, w), (1, v), (1, v), (2, w[:-1]), (3, v[:-1]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.report(shared).collect()} == {(1, 1), (2, 1), (3, 1)}


def least_reachable(sets):
    """The least id that each id reaches over pairs that share at least 75 of 100."""
    holders = collections.defaultdict(list)
    for i, found in sets.items():
        for x in found:
            holders[x].append(i)
    near = {(a, b) for found in holders.values() for a, b in itertools.combinations(sorted(found), 2)}
    least, changed = {i: i for i in sets}, True
    links = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dup_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    least = least_reachable(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.report(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_dup_template_family(spark, monkeypatch, block):
    """Parts of one template, nearly all unlike each other, each with one partner that is like it."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    passages, texts = [[f"p{i}w{j}" for j in range(10)] for i in range(60)], {}
    for i, k in enumerate(np.random.default_rng(4).permutation(400).tolist()):
        lost = set(np.random.default_rng(k // 2).permutation(60)[: 10 + 8 * (k % 2)].tolist())
        texts[i] = " ".join(w for j, p in enumerate(passages) if j not in lost for w in p)
    sets = {i: {tuple(w[j: j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    least, changed = {i: i for i in sets}, True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    assert len(links) >= 100 and len(set(least.values())) >= 250
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.report(rows).collect()} == least


def test_long_text_is_hashed_in_pieces(monkeypatch):
    raw = np.frombuffer(LONG.encode(), np.uint8)
    whole = near_dup.hashed_texts(raw, np.array([0, len(raw)]))[0]
    monkeypatch.setattr(near_dup, "PIECE", 1000)
    assert (near_dup.hashed_texts(raw, np.array([0, len(raw)]))[0] == whole).all()


def test_line_dedup(spark, odd, none):
    line = "A line that is long enough"
    rows = spark.createDataFrame([(1, f"{line}\nown 1"), (2, f"x\n {line.upper()}\t\n{line}"), (3, f"{line}\n{line}"), (None, line)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(rows).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 1, sha("own 1")), 2: (3, 2, sha("x")), 3: (2, 0, sha(f"{line}\n{line}")), None: (1, 1, sha(""))}
    assert line_dedup.report(odd).count() == len(ODD) and line_dedup.report(none).count() == 0
    assert line_dedup.without_repeated_lines(odd).columns == odd.columns
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(rows).collect()} == {1: "own 1", 2: "x", 3: f"{line}\n{line}", None: ""}


def test_fingerprints(spark, odd, none):
    rows = fingerprints.report(odd).collect()
    assert len(rows) == len(ODD) and fingerprints.report(none).count() == 0
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    big = documents(spark).orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fingerprints.report(documents(spark)).collect()}
    for k, r in enumerate(big):
        text, after = r.text or "", big[(k + 1) % len(big)].text or ""
        half = len(text) // 2
        assert got[r.doc_id].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert np.mean([r.near_edited for r in got.values()]) > 0.35 and np.mean([r.near_next for r in got.values()]) < 0.05


def test_sharding(spark, odd, none):
    assert sharding.best_fit_decreasing([5, 4, 3, 3, 2, 2, 1], 10) == [0, 0, 1, 1, 1, 1, 0]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 400).tolist()
    bins = sharding.pack_into(sizes, 7)
    load = np.bincount(bins, weights=sizes)
    assert len(load) == 7 and load.max() == -(-sum(sizes) // 7)  # as even as can be
    got = sharding.report(documents(spark)).toPandas()
    assert got.groupby("shard")["size"].sum().agg(lambda x: x.max() / x.mean()) < 1.2
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert sharding.report(none).count() == 0 and sharding.report(odd).count() == len(ODD)
    by_id = {r.doc_id: (r.size, r.text_crc32) for r in sharding.report(documents(spark)).collect()}
    assert by_id == {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents(spark).collect()}


def test_written_shards(spark, odd, none, tmp_path):
    sharding.write_shards(odd, f"{tmp_path}/shards", 3)
    rows = spark.read.parquet(f"{tmp_path}/shards")
    assert rows.drop("__shard").columns == odd.columns and sorted(map(str, rows.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert rows.where("doc_id = 1").select("__shard").distinct().count() == 1
    kept = [c for c in odd.columns if c not in sharding.ADDED]
    assert sharding.in_order(odd).columns == [*kept, *sharding.ADDED] and sharding.in_order(odd).count() == len(ODD) and sharding.in_order(none).count() == 0


def test_many_sources(spark):
    rows = spark.range(200_000).selectExpr("concat('=', id % 50000) AS __source", "id % 7 AS __size")
    found = mixing.source_targets(rows, (5, 2, 1), 1.5, 2.0)
    total = found.selectExpr("sum(target)", "sum(source_size)").first()
    assert found.count() == 50_000 and total[0] == pytest.approx(1.5 * total[1])


def test_pipeline(spark):
    """Every stage on what its predecessor kept, against brute force."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, at = documents(spark), {}
    for name, stage in pipeline.STAGES:
        at[name] = docs
        docs = pipeline.stored(stage(spark, docs, SF), "stage")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (name == "sharding" or len(docs.columns) == 5)
    names = [name for name, _ in pipeline.STAGES]
    ids = {name: collections.Counter(r.doc_id for r in at[name].collect()) for name in names}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert set(ids[names[1]]) == {r.doc_id for r in quality.report(documents(spark), labels).where("keep").collect()}
    least = least_reachable({r.doc_id: shingles(r.text) for r in at[names[1]].collect()})
    assert set(ids[names[2]]) == {i for i, low in least.items() if i == low}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    windows = {tuple(w[i: i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [cut(r.text or "")] if w for i in range(max(1, len(w) - 9))}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i: i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    assert set(ids[names[3]]) == {r.doc_id for r in at[names[2]].collect() if not hit(cut(r.text))}
    taken = mixing.assign(mixing.keyed(at[names[3]], mixing.word_count(F.col("text")))).select("doc_id", "__copies", "__positions", "__order").collect()
    assert ids[names[4]] == collections.Counter({r.doc_id: r["__copies"] for r in taken if r["__copies"]})
    order = [r.doc_id for r in at[names[4]].collect()]
    assert order == [i for *_, i in sorted((p, r["__order"], r.doc_id) for r in taken for p in r["__positions"])]
    last, place = docs.orderBy("shard", "slot").collect(), collections.defaultdict(list)
    for k, i in enumerate(order):
        place[i].append(k)
    for shard in range(16):
        mine, met, ranks = [r for r in last if r.shard == shard], collections.Counter(), []
        assert [r.slot for r in mine] == list(range(len(mine)))
        for r in mine:
            ranks.append(place[r.doc_id][met[r.doc_id]])
            met[r.doc_id] += 1
        assert ranks == sorted(ranks)
    text = {r.doc_id: r.text for r in documents(spark).collect()}
    assert collections.Counter(r.doc_id for r in last) == ids[names[4]] and all(r.text == text[r.doc_id] for r in last)


def test_pipeline_of_odd_and_empty_tables(spark, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, none):
        docs = docs.drop(*sharding.ADDED)
        columns = docs.columns
        for _, stage in pipeline.STAGES:
            before, docs = docs, pipeline.stored(stage(spark, docs, SF), "stage")
            assert docs.columns[: len(columns)] == columns and docs.count() <= 2 * before.count()
        assert docs.columns == [*columns, *sharding.ADDED]
