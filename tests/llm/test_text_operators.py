"""Substring dedup, Jaccard join and decontamination against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, repeats
from ledgerloom.llm import textkernel as K

WORDS = ["the", "of", "an", "Zué", "x1", "é", "ñandú", "to", "be", "or", "not", "$$", "a-b", "is"]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    phrase = lambda k: [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(k)]
    shared = [phrase(rng.randrange(14, 40)) for _ in range(4)]
    base = [phrase(rng.randrange(30, 80)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            words = phrase(rng.randrange(0, 30))
        elif kind == 1:
            words = phrase(10) + rng.choice(shared) + phrase(8)
        elif kind == 2:
            words = list(rng.choice(base))
        elif kind == 3:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "changed"
        elif kind == 4:
            words = rng.choice(base)[5:] + rng.choice(shared)
        else:
            words = ["same"] * rng.randrange(0, 30)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, " ".join(phrase(3000)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


def test_words_match_bytes_split():
    texts = ["a B\tc\x0bd", None, "", "é  ñ\r\n", "x" * 3000 + " y"]
    got = []
    for w in K.words(pa.array(texts), K.BLANK_WORDS_LOWER):
        got += [w.texts(w.ptr[r], w.ptr[r + 1]) for r in range(w.hi - w.lo)]
    assert got == [(t or "").encode().lower().split() for t in texts]


def brute_repeats(rows, k=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def got_repeats(df):
    rows = df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_repeats_match_brute_force(docs):
    out = repeats.remove_repeats(docs)
    assert got_repeats(out) == brute_repeats(corpus())
    spans = out.where("n_removed > 0").select("n_removed", "repeats").collect()
    assert spans and all(sum(s["end"] - s["start"] for s in r["repeats"]) == r["n_removed"] for r in spans)


def test_repeats_when_the_bitmap_is_full(docs, monkeypatch):
    monkeypatch.setattr("ledgerloom.llm.common.MOST_BITS", 16)
    monkeypatch.setattr(repeats.Bitmap, "leak", 1.0, raising=False)
    original = repeats.Bitmap.__init__

    def full(self, *args):
        original(self, *args)
        self.leak = 1.0

    monkeypatch.setattr(repeats.Bitmap, "__init__", full)
    assert got_repeats(repeats.remove_repeats(docs)) == brute_repeats(corpus())


def test_repeats_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(None, text, 1), (5, text, 2), (5, text, 3), (7, text, 4)], "doc_id long, text string, n_words int")
    got = sorted((str(r.doc_id), r.n_removed) for r in repeats.remove_repeats(rows).collect())
    assert got == [("5", 0), ("5", 0), ("7", 20), ("None", 20)]
    assert repeats.remove_repeats(rows.limit(0)).count() == 0


def brute_groups(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("small", [32, 2])
def test_groups_match_brute_force(docs, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_groups(docs).collect()}
    want = brute_groups(corpus())
    assert got == want
    assert len({v[1] for v in want.values()}) < len(want)


def test_groups_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (None, None), (4, None)], "doc_id long, text string")
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.jaccard_groups(rows).collect())
    assert got == [("3", 2, "3"), ("4", 0, "4"), ("None", 0, "None"), ("None", 2, "3")]
    assert jaccard.jaccard_groups(rows.limit(0)).count() == 0


def letter_words(t):
    table = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c > 127) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
    return (t or "").encode().translate(table).split()


def brute_hits(docs, items, size=10):
    windows = []
    for item, t in items:
        w = letter_words(t)
        if w:
            windows += [(str(item), w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    out = {}
    for i, t in docs:
        w, hit, found = letter_words(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        out[i] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(0, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda"), (1, "short one"), (2, None), (3, "..."), (2, "Zué"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa mu")]
DOCS = [(1, "xx alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda yy"), (2, "alpha beta gamma delta epsilon zeta eta theta iota nothing"), (3, "a short-one here, short one"), (4, None), (5, ""), (6, "ZUé zué"), (7, "short one " * 500), (7, "short one " * 500)]


@pytest.mark.parametrize("gram", [3, 1])
def test_decontamination_matches_brute_force(spark, gram):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in DOCS], "doc_id long, text string, hits string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(docs, items, gram=gram).collect()
    got = {r.doc_id: (r.n_words, sum(h["end"] - h["start"] for h in r.hits), r.item_ids) for r in out}
    assert len(out) == len(DOCS) and got == brute_hits(DOCS, ITEMS)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.n_words for r in decontaminate.decontaminate(docs, items.limit(0)).where("size(hits) > 0").collect()} == set()
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
