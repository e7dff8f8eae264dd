"""Long texts, repeated rows and large file numbers in operators 3, 4, 7 and 10."""

import collections
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("loomgraph.llm")
from loomgraph.llm import chat, decontaminate, near_dup, sharding  # noqa: E402
from loomgraph.llm.common import new_path  # noqa: E402
from loomgraph.llm.token_output import vocabulary_path  # noqa: E402


def test_common_word_in_a_very_long_text(spark):
    rng = random.Random(1)
    words = [rng.choice(["the", "a", "of"]) for _ in range(1_000_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "no such"), (None, "of the")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "the"), ("y", "of the a of the a of the a of the")], "item_id string, text string")
    started = time.time()
    got = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    assert time.time() - started < 90
    window = "of the a of the a of the a of".split(), "the a of the a of the a of the".split()
    hit = np.array([w == "the" for w in words])
    text = " ".join(words)
    for w in window:
        at = text.find(" ".join(w))
        while at >= 0:
            first = text[:at].count(" ")
            hit[first:first + 10] = True
            at = text.find(" ".join(w), at + 1)
    assert got[1].n_hit == hit.sum() and got[1].n_words == 1_000_000
    assert not got[2].contaminated and got[None].n_hit == 1


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 0])
def test_windows_across_blocks_and_ends(spark, monkeypatch, most):
    """Every length of item from 1 to 12, at every offset, in repeated rows too."""
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)
    rng = random.Random(2)
    vocabulary = ["v%d" % i for i in range(6)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(1 + i % 12 if i % 12 > 1 else 3 + i))) for i in range(30)]
    docs = [(rng.randint(0, 90), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    docs += docs[:5]
    want = collections.Counter()
    for doc, text in docs:
        w, hit, named = text.split(), set(), set()
        for item, say in items:
            x = say.split()
            for n, parts in [(min(10, len(x)), [x[i:i + 10] for i in range(max(1, len(x) - 9))])]:
                for i in range(len(w) - n + 1):
                    if w[i:i + n] in parts:
                        hit |= set(range(i, i + n))
                        named.add(item)
        want[(doc, len(w), len(hit), len(named))] += 1
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == want


def test_chat_ids_are_the_whole_texts():
    enc = chat.codec(vocabulary_path(chat.VOCABULARY))
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice(["word", " ", "  ", "\n", "7", "é", ".", "\t "]) for _ in range(n))
    blank = lambda n: "".join(rng.choice(" \n \t") for _ in range(n))
    for text in (say(60_000), "x" * 70_000, say(10) + " " * 5000 + "end", " " * 3000, blank(2500), "a" + blank(1500) + "b" + blank(999) + "c" + blank(1000), blank(1200) + "1", ""):
        assert chat.encoded(text, enc) == enc.encode_ordinary(text)
    ids = chat.encoded("a" + " " * 400_000 + "b", enc)
    assert enc.decode_bytes(ids) == b"a" + b" " * 400_000 + b"b"


def test_chat_template_by_hand(spark):
    turns = [(1, 0, "user", "hi <|im_end|> there"), (1, 1, "assistant", "well, <\\|x"), (2, 0, None, None), (1, 2, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    path = new_path(spark, "chat")
    chat.write_chat(df, path)
    enc = chat.codec(vocabulary_path(chat.VOCABULARY))
    want = {}
    for conv, _, role, text in sorted(turns, key=lambda t: t[:2]):
        ids, mask = want.setdefault(conv, ([], []))
        head, body = [chat.START, *enc.encode_ordinary(role or ""), chat.BODY], enc.encode_ordinary((text or "").replace("<\\|", "<\\\\|").replace("<|", "<\\|"))
        ids += [*head, *body, chat.END]
        mask += [0] * len(head) + [int(role == "assistant")] * len(body) + [0]
    got = collections.defaultdict(lambda: ([], []))
    for r in spark.read.parquet(path).orderBy("conv_id", "part", "block").collect():
        got[r.conv_id][0].extend(r.ids)
        got[r.conv_id][1].extend(r["mask"])
    assert dict(got) == want
    rendered = {1: 0, 2: 0}
    for conv, _, role, text in turns:
        rendered[conv] += len("<|im_start|>" + (role or "") + "\n" + (text or "").replace("<\\|", "<\\\\|").replace("<|", "<\\|") + "<|im_end|>\n")
    assert {r.conv_id: r.chars for r in spark.read.parquet(path).groupBy("conv_id").sum("chars").withColumnRenamed("sum(chars)", "chars").collect()} == rendered
    chat.write_chat(df.limit(0), path + "-none")
    assert spark.read.schema(chat.BLOCKS).parquet(path + "-none").count() == 0


def test_repeated_rows_come_down_to_one(spark):
    text = "the quick brown fox jumps over the lazy dog and then sleeps for an hour"
    other = "nothing in common with what the first of these rows says at all, truly"
    rows = [(1, text, "x"), (1, text, "x"), (1, text, "x"), (5, other, "a"), (5, other, "b"), (7, None, "n"), (7, None, "n"), (7, "", "e"), (None, other + " x y", "z"), (None, other + " x y", "z"), (9, text, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `k.x` string")
    left = near_dup.without_near_duplicates(df)
    assert left.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter({(1, text): 1, (5, other): 1, (7, None): 1, (7, ""): 1, (None, other + " x y"): 2})


def test_slots_follow_file_numbers(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    want = []
    for number in (99_998, 99_999, 100_000, 100_001, 1_000_000):
        ids = list(range(number, number + 3))
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [f"text {i}" for i in ids]}), folder / f"part-{number}-c000.snappy.parquet")
        want += [(number, i) for i in ids]
    out = sharding.in_order(spark.read.parquet(str(folder)), shards=1).orderBy("slot").collect()
    assert [(r.doc_id, r.slot) for r in out] == [(i, k) for k, (_, i) in enumerate(sorted(want))]


def test_best_fit_beside_a_plain_one():
    rng = random.Random(4)
    for _ in range(200):
        sizes, capacity = [rng.randint(1, 60) for _ in range(rng.randint(0, 60))], rng.randint(30, 100)
        room, bins = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            if not fits:
                fits = [(max(capacity, sizes[i]), len(room))]
                room.append(fits[0][0])
            bins[i] = min(fits)[1]
            room[bins[i]] -= sizes[i]
        assert sharding.best_fit_decreasing(sizes, capacity) == bins


def test_fixed_capacity_in_bins(spark):
    """Packets cost no more than one bin in a hundred against single groups."""
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 400)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g long, size long")
    placed = sharding.shard(df, ["g"], "size", capacity=50_000).groupBy("shard").sum("size").collect()
    alone = 1 + max(sharding.best_fit_decreasing([s for _, s in rows], 50_000))
    assert all(r[1] <= 50_000 for r in placed) and sum(r[1] for r in placed) == sum(s for _, s in rows)
    assert len(placed) <= alone * 1.01 + 1


def test_quality_is_the_same_however_it_is_dealt(spark, monkeypatch):
    """Many buckets, small parts, and buckets split by part with prices routed to their lists."""
    from loomgraph.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = lambda: sorted(((r.doc_id, r.keep, round(r.perplexity or 0, 6), round(r.fresh_perplexity or 0, 6)) for r in quality.report(docs, labels).collect()))
    want = rows()
    for name, value in (("BUCKETS", 7), ("BUCKET_TEXT", 20_000), ("BUCKET_PARTS", 2), ("PART_BYTES", 60_000)):
        monkeypatch.setattr(quality, name, value)
    assert rows() == want
