"""Operators 11 to 13 against brute force, on odd rows, empty tables and random small inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomgraph.llm")
from loomgraph.llm import periodic, repeated_windows, spelling  # noqa: E402

LONG = " ".join(f"word{i % 700}x" for i in range(2_500))
SHARED = "a passage of more than fifty bytes, that several documents hold in common; "
ODD = [
    (1, "one two three four five six " * 9), (1, "one two three four five six " * 9), (2, None), (3, ""), (4, LONG),
    (None, "Zwölf Ähren " + SHARED + "x"), (5, "\x0b \t\n"), (6, "è" + SHARED + SHARED + "è"), (7, "ab" * 200), (8, SHARED[:49]), (9, SHARED[:50]),
    (10, "abababab" * 40), (-11, "receive receive recieve received receives"), (12, "receive receive receive receive receive receive receive receive receive receive receive receive receive receive receive receive recieve receve recceive teceive recieve"),
]
CLASHING = ["doc", "word", "n", "at", "own", "heavy", "node", "near", "keys", "chunk", "bucket", "kept", "runs", "root", "form", "a.b"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", *[f"7 AS `{c}`" for c in CLASHING])


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def runs_by_hand(words, least, times):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_by_hand(doc, text, plant=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc is None else doc).encode())
    if plant and h % 10 == 0 and n:
        a, p = (h // 10) % n, 0
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_hand(words, 24, 3)
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1] or [(None,) * 3]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best[0], 1000 * best[0][1] // best[0][2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept)), kept


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, size, p = rng.randint(0, 70), rng.randint(1, 4), rng.randint(1, 8)
            words = [rng.randrange(size) for _ in range(n)]
            texts.append([words[i % min(p, n)] for i in range(n)] if rng.random() < 0.4 else words)
        least, times = rng.choice([(24, 3), (4, 2), (2, 2), (6, 3), (10, 4)])
        monkeypatch.setattr(periodic, "TOGETHER", rng.choice([10, 50, 1000]))
        want, begin = [], 0
        for words in texts:
            want += [(s + begin, n, q) for s, n, q in runs_by_hand(words, least, times)]
            begin += len(words)
        got = periodic.runs_of(np.array(sum(texts, []), np.int64), np.array([len(w) for w in texts]), least, times)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_of_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(periodic, "TEXTS", 1000)
    for plant in (False, True):
        assert rows(periodic.report(odd, plant=plant)) == collections.Counter(periodic_by_hand(d, t, plant)[0] for d, t in ODD)
    assert periodic.report(odd.limit(0)).count() == 0
    cut = periodic.collapsed(odd)
    assert cut.columns == odd.columns
    want = collections.Counter((d, (t if not (p := periodic_by_hand(d, t))[0][1] else p[1])) for d, t in ODD)
    assert rows(cut.select("doc_id", "text")) == want
    runs = rows(periodic.found_runs(odd))
    assert runs == collections.Counter((d, *r) for d, t in ODD for r in runs_by_hand(re.findall(r"[^\x20\x09-\x0D]+", t or ""), 24, 3))


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(docs, shortest=7, least=2, ratio=10, one_in=31):
    count = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= shortest and c >= least}
    friends = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, f in friends.items():
        best = min(f, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return collections.Counter((w, form[w], root(w), n[w], len(friends[w]), n[form[w]] if form[w] else None) for w in n)


def test_variants_of_odd_rows(odd):
    assert rows(spelling.variants(odd)) == variants_by_hand(ODD)
    assert rows(spelling.variants(odd, least=1, ratio=2, one_in=3)) == variants_by_hand(ODD, least=1, ratio=2, one_in=3)
    assert spelling.variants(odd.limit(0)).count() == 0
    groups = {r["root"]: (r["n"], set(r["words"])) for r in spelling.merged_variants(odd, least=1, one_in=None).collect()}
    hand = collections.defaultdict(lambda: (0, set()))
    for w, _, r, n, _, _ in variants_by_hand(ODD, least=1, one_in=None):
        hand[r] = (hand[r][0] + n, hand[r][1] | {w})
    assert groups == dict(hand) and {"recceive", "receive", "receives", "teceive"} <= groups["receive"][1]


def test_variants_of_random_words(spark):
    """Few letters, so that words differ by every kind of edit, in runs of equal letters, at ends and at the root."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 + k * k for k in range(400)], k=60))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spelling.variants(df, shortest=1, least=1, ratio=2)) == variants_by_hand(docs, shortest=1, least=1, ratio=2)


def removed_by_hand(docs, width):
    smallest = {}
    key = lambda d: -(1 << 63) if d is None else d
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, t in texts:
        for i in range(len(t) - width + 1):
            smallest[t[i:i + width]] = min(key(d), smallest.get(t[i:i + width], key(d)))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if smallest[t[i:i + width]] < key(d):
                gone[i:i + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = [m.span() for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        out.append((d, kept, spans, len(t)))
    return out


def same_windows(df, docs, width):
    hand = removed_by_hand(docs, width)
    want = collections.Counter((d, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, kept, spans, n in hand)
    assert rows(repeated_windows.report(df, width)) == want
    return hand


def test_windows_of_odd_rows(odd):
    hand = same_windows(odd, ODD, 50)
    assert rows(repeated_windows.removed_spans(odd)) == collections.Counter((d, *s) for d, _, spans, _ in hand for s in spans)
    assert collections.Counter((r["doc_id"], bytes(r["kept"])) for r in repeated_windows.kept_bytes(odd).collect()) == collections.Counter((d, kept) for d, kept, _, _ in hand)
    assert repeated_windows.report(odd.limit(0)).count() == 0


@pytest.mark.parametrize("width,letters,chunk,piece", [(50, "abcdefgh ", 3000, 1 << 17), (9, "ab", 200, 64), (4, "abé", 500, 16), (50, "a", 4000, 100)])
def test_windows_of_random_texts(spark, monkeypatch, width, letters, chunk, piece):
    """Passages in several documents, with other neighbours, within and across chunks and slices."""
    monkeypatch.setattr(repeated_windows, "CHUNK", chunk)
    monkeypatch.setattr(repeated_windows, "SLICE", piece)
    rng = random.Random(width)
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [draw(rng.randint(width // 2, 4 * width)) for _ in range(12)]
    docs = [(rng.randint(0, 50), "".join(rng.choice(passages) if rng.random() < 0.5 else draw(rng.randint(0, width)) for _ in range(rng.randint(0, 6)))) for _ in range(70)]
    same_windows(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), docs, width)
