"""Language ID, quality, PII and mixing: held-out accuracy, exact formulas, brute force and edge cases."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, pii, quality
from ledgerloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_is_crc32(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_kneser_ney_sums_to_one():
    s = np.array([0, 0, 0, 0, 1, 2, 1, 3, 0, 0, 0, 0, 2, 2, 1, 0, 0, 0, 0], np.uint8)
    keys, n = np.unique(langid.packed(s, 4), return_counts=True)
    model = langid.fit_counts(["xx"], {"xx": (keys[keys > 0], n[keys > 0])}, 4)
    for ctx in (0, int(model.ctx[3][0]), 5 << 7 | 9):
        grams = (np.uint32(ctx) << np.uint32(7)) | np.arange(128, dtype=np.uint32)
        assert np.isclose(np.exp2(langid.gram_logp(model, grams)).sum(), 1, atol=1e-4)


def plain_kneser_ney(text, order):
    """Interpolated Kneser-Ney by dictionaries: probability of a symbol after a context (tuples of symbols)."""
    tables, grams = {}, {}
    for i in range(order - 1, len(text)):
        g = tuple(text[i - order + 1 : i + 1])
        if any(g):
            grams[g] = grams.get(g, 0) + 1
    for o in range(order, 0, -1):
        tables[o], left = grams, {}
        for g in grams:
            left[g[1:]] = left.get(g[1:], 0) + 1
        grams = left

    def prob(ctx, x):
        o, t = len(ctx) + 1, tables[len(ctx) + 1]
        once, twice = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        lower = prob(ctx[1:], x) if o > 1 else 1 / langid.SYMBOLS
        mine = {g: n for g, n in t.items() if g[:-1] == ctx}
        total = sum(mine.values())
        return (max(mine.get((*ctx, x), 0) - d, 0) + d * len(mine) * lower) / total if total else lower

    return prob


def test_kneser_ney_matches_brute_force():
    rng = np.random.default_rng(4)
    s = np.concatenate((np.zeros(4, np.uint8), rng.choice(np.array([0, 1, 2, 3, 9], np.uint8), 300), np.zeros(4, np.uint8)))
    keys, n = np.unique(langid.packed(s, 4), return_counts=True)
    model = langid.fit_counts(["xx"], {"xx": (keys[keys > 0], n[keys > 0])}, 4)
    prob = plain_kneser_ney(s.tolist(), 4)
    for _ in range(200):
        g = rng.choice([0, 1, 2, 3, 9, 40], 4).tolist()
        packed = langid.packed(np.array(g, np.uint8), 4)
        assert np.isclose(np.exp2(langid.gram_logp(model, packed)[0, 0]), prob(tuple(g[:3]), g[3]), rtol=1e-4)


def test_language_sample_is_bounded_and_calibrated(spark):
    """With a bound far under the text, predictions stay; the bounds come from what was left out, at about the stated rate."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~held_out(F.col("doc_id")), max_letters=60_000, rate=0.02)
    assert len(model.keys[-1]) < 60_000 * 4 and model.z < langid.WIDE
    out = langid.identify(docs, model).where(held_out(F.col("doc_id"))).select("lang", "lang_pred", "rejected").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and 0 < out.rejected.mean() < 0.08


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    out = langid.identify(docs, model).where(held_out(F.col("doc_id"))).select("lang", "lang_pred", "rejected").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert out.rejected.mean() < 0.05


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(1, "the cat and the dog " * 9, "en"), (2, "le chat et le chien " * 9, "fr"), (3, "x", None), (4, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(train, F.lit(True))
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !!", "q"), (4, "the dog", "q"), (5, "le chien " * 20000, "q"), (5, "le chien " * 20000, "q")], "doc_id long, text string, score string")
    got = sorted(tuple(r) for r in langid.identify(odd, model).select("doc_id", "lang_pred").collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (5, "fr")]
    assert langid.fit(train.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_equal_texts_score_alike_whatever_their_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, F.lit(True))
    a = {r.doc_id: r.cross_entropy for r in langid.identify(docs.repartition(7), model).collect()}
    b = {r.doc_id: r.cross_entropy for r in langid.identify(docs.orderBy(F.desc("doc_id")).coalesce(1), model).collect()}
    assert all(np.isclose(a[k], b[k]) for k in a if a[k] is not None)


def test_language_bounds_come_from_all_distinct_texts(spark):
    """A rare language is calibrated beside a large one, and copies of one text count once."""
    rng = np.random.default_rng(3)
    text = lambda words: " ".join(rng.choice(words, 30))
    en, fr = "the cat and dog sat on this mat with that hat under their house".split(), "le chat et chien sur ce tapis avec cette maison sous notre toit".split()
    rows = [(text(en), "en") for _ in range(9000)] + [(text(fr), "fr") for _ in range(40)] + [("chat et chien sur ce tapis " * 9, "fr")] * 500 + [("der hund und die katze " * 9, "de")] * 30
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    de, en_at, fr_at = (model.langs.index(x) for x in ("de", "en", "fr"))
    assert model.mean[fr_at] < 4 and model.mean[de] < 4 and model.spread[de] < 1
    bits = np.sort([b[0, fr_at] for t, x in rows[9000:9041] for b, _ in langid.cross_entropies(model, pa.array([t]))])
    assert abs(model.mean[fr_at] - np.quantile(bits, 0.5)) < 0.01
    assert model.mean[de] >= np.median(model.mean[[en_at, fr_at]]) - 1e-9


def auc(y, s):
    order = pd.Series(s).rank()
    y = np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id")))
    out = quality.rate(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    assert out.score.between(0, 1).all() and auc(out.quality, out.score) > 0.9


def test_word_vectors_match_brute_force(spark):
    texts = ["a b a c", "", "d a b", "x1 y, z", None] * 3
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        (w,) = quality.K.words(pa.array([t or ""]), quality.K.TYPED_RUNS)
        b = quality._bucket(w.value)
        for i in range(len(b)):
            for j in range(len(b)):
                if 0 < abs(i - j) <= quality.REACH:
                    np.add.at(want[b[i]], place[b[j]], sign[b[j]])
    got = quality.word_vectors(spark.createDataFrame([(t or "",) for t in texts], "text string"))
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), atol=1e-6)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, "$$ ## $$"), (3, None), (4, ""), (None, "good text"), (5, "word " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.rate(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert len(got) == 6 and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.rate(docs, None).collect()} == {0.5}


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TEXTS = [
    "mail é a.b+c@x-y.org, b@c, d@@e.fr f@g.h@i.j end", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0004", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 44111111111111111", "+33 (0)1 23 45 67 89, +1 2, +49-30-1234567+49 30 7654321",
    "ça 12 34", "", None, "@@@ . @.", "+" * 50, "9" * 4000, "1." * 3000, "a" * 20000 + "@b.c", "é@b.c ü+@b.c.", "0000000000000000",
]


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns():
    for t in TEXTS[:9] + TEXTS[11:]:
        assert pii.base_spans(t or "") == plain_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans(TEXTS[9]) == [] and pii.base_spans(TEXTS[10])[:1] == [("ip", 0, 7)]


def test_sanitising_terms_that_give_entities_away(spark):
    rows = [(i, f"plain w{i} text {'x' * i} helpline: +1 555 010 {1000 + i} then more plain words w{i + 1}") for i in range(12)]
    rows += [(100 + i, "plain text then more plain words text " * 30) for i in range(5)] + [(200, "a helpline without number"), (300, None), (301, "")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "[TERM]: [PHONE]" in out[3].clean_text and "helpline" not in out[3].clean_text
    assert out[200].clean_text == "a helpline without number" and out[300].clean_text == "" and out[300].spans == []
    blocks = {r.doc_id: r.clean_text for r in pii.sanitise(docs, block_terms=1).collect()}
    assert blocks == {k: r.clean_text for k, r in out.items()}
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_disclosure_counts_distinct_texts_and_keeps_rare_names(spark):
    filler = [f"plain words on page {i} about {'abcdefghij'[i % 10]} and more plain words without any mark at all " * 3 for i in range(60)]
    mine = [f"Ana{'x' * i} writes {'uvwxyz'[i]} here Zorro a{i}@b.org and goes on with plain words about more words" for i in range(6)]
    once = "so far plain words and then Quasimodo q@b.org and again plain words about more"
    texts = [*filler, *mine, once, *[mine[0]] * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.text: r.clean_text for r in pii.sanitise(docs).collect()}
    assert all("[TERM] [EMAIL]" in out[t] and "plain" in out[t] for t in mine)
    assert "[TERM] [EMAIL]" in out[once] and out[filler[0]] == filler[0]
    terms = {r.term: r.share for r in pii.disclosing_terms(docs).collect()}
    assert all(0 < s <= 1 for s in terms.values())


def plain_terms(texts, reach=4, alpha=0.8, beta=0.98, prior=1.0):
    """{term: (kinds generalised, kinds removed)} by plain counting over distinct texts."""
    n, joint, all_n, all_joint = {}, {}, 0, dict.fromkeys(pii.KINDS, 0)
    for text in set(texts):
        spans = plain_spans(text)
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        words = [w for w in words if not re.fullmatch("[0-9]+", w[0]) and all(w[2] <= s or w[1] >= e for _, s, e in spans)]
        for w in words:
            n[w[0]] = n.get(w[0], 0) + 1
        all_n += len(words)
        for kind in pii.KINDS:
            close = set()
            for k, s, e in spans:
                if k == kind:
                    close |= set([i for i, w in enumerate(words) if w[2] <= s][-reach:]) | set([i for i, w in enumerate(words) if w[1] >= e][:reach])
            for i in close:
                joint[words[i][0], kind] = joint.get((words[i][0], kind), 0) + 1
            all_joint[kind] += len(close)
    out = {}
    for (t, kind), j in joint.items():
        common = all_joint[kind] / all_n
        share = (j + prior * common) / (n[t] + prior)
        if share >= common ** (1 - alpha):
            out.setdefault(t, (set(), set()))[share >= common ** (1 - beta)].add(kind)
    return out


def test_disclosing_terms_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}x" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    texts += [f"{' '.join(rng.choice(words, 9))} Owner a{i}@b.org and Host 10.0.0.{i} {' '.join(rng.choice(words, 9))} call +1 555 0{i:03d} 77" for i in range(150)]
    want = plain_terms(texts)
    name = {int(next(pii.K.words(pa.array([t]), pii.K.LETTER_WORDS)).value.view(np.int64)[0]): t for t in [*want, *words]}
    got = {name[r.term]: r for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    bits = lambda kinds: sum(1 << pii.KINDS.index(k) for k in kinds)
    assert {t: (r.general, r.remove) for t, r in got.items()} == {t: (bits(a), bits(b)) for t, (a, b) in want.items()}
    assert "owner" in want and any(b for _, b in want.values())


def test_terms_go_only_beside_what_they_give_away(spark):
    texts = [f"plain words on page {i} of many more plain words about {'abcdefghij'[i % 10]} things and places" for i in range(80)]
    mails = [f"page {i} has one Keeper a{i}@b.org and plain words on things" for i in range(90)]
    both = "plain words Keeper and 10.0.0.1 on things"
    out = {r.text: r for r in pii.sanitise(spark.createDataFrame([(t,) for t in [*texts, *mails, both]], "text string")).collect()}
    assert all("Keeper" not in out[t].clean_text and "  [EMAIL] and plain" in out[t].clean_text and "removed" in {s.kind for s in out[t].spans} for t in mails)
    assert "Keeper and [IP]" in out[both].clean_text and out[texts[0]].clean_text == texts[0]


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(0)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(5)])
    tokens = rng.integers(1, 1000, len(codes)).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in (4, 3, 5)]
    share = mixing.rake(codes, tokens, targets)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], share), t, atol=1e-8)


def test_calibrated_probabilities_spend_the_budget():
    tokens, weight = np.array([10.0, 50, 40, 5]), np.array([3.0, 1, 0.5, 0])
    for budget in (5, 30, 80, 99):
        p = mixing.calibrate(tokens, weight, budget)
        assert (p <= 1).all() and np.isclose((p * tokens).sum(), budget)
        low = p < 1
        assert np.ptp((p / np.maximum(weight, 1e-9))[low & (weight > 0)], axis=0) < 1e-9 if (low & (weight > 0)).any() else True
    assert mixing.calibrate(tokens, weight, 1000).tolist() == [1, 1, 1, 0]


def test_mix_by_spark_equals_mix_by_numpy(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).select("doc_id", "text", "lang", "source").cache()
    targets = {"lang": {"en": 0.4, "fr": 0.3, "de": 0.3}}
    a = {r.doc_id: r.probability for r in mixing.mix(docs, targets).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    monkeypatch.setattr(mixing, "_rake_by_spark", lambda *x: mixing_full(*x))
    from functools import partial

    mixing_full = partial(ORIGINAL, rounds=6)
    b = {r.doc_id: r.probability for r in mixing.mix(docs, targets).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 0.05


ORIGINAL = mixing._rake_by_spark


def test_mix_is_the_same_on_both_sides_of_the_switch(spark, monkeypatch):
    """Cells that need 25 rounds, and a budget that draws some of them in full."""
    tokens = {("a", "en"): 50, ("a", "fr"): 10, ("b", "en"): 8, ("b", "fr"): 60}
    docs = spark.createDataFrame([(i, "word " * n, s, x) for i, ((s, x), n) in enumerate(tokens.items())], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.45, "fr": 0.55}}
    a = {r.doc_id: (r.weight, r.probability, r.selected) for r in mixing.mix(docs, targets).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    b = {r.doc_id: (r.weight, r.probability, r.selected) for r in mixing.mix(docs, targets).collect()}
    assert np.allclose([a[k][:2] for k in a], [b[k][:2] for k in a], rtol=5e-9, atol=0) and all(a[k][2] == b[k][2] for k in a)
    assert max(p for _, p, _ in a.values()) == 1 and min(p for _, p, _ in a.values()) < 1


def test_documents_without_words_belong_to_no_cell(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else "alpha " * 9, "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    topic = mixing.with_topics(docs).where("n_tokens > 0").first().topic
    word = next(w for w in (f"w{i}" for i in range(99)) if mixing.with_topics(spark.createDataFrame([(w,)], "text string")).first().topic == "t0") if topic != "t0" else "alpha"
    out = mixing.mix(docs.withColumn("text", F.regexp_replace("text", "alpha", word)), keep=0.3).collect()
    assert all(r.weight == 1 and r.probability == 1 and r.selected for r in out if r.n_tokens == 0)
    assert any(r.probability < 0.5 for r in out if r.n_tokens)


def test_topics_part_subjects_within_each_language(spark):
    rng = np.random.default_rng(2)
    subjects = {("en", "sea"): "ship sail wave port crew".split(), ("en", "farm"): "field cow plough barn crop".split(), ("fr", "mer"): "navire voile vague quai marin".split(), ("fr", "ferme"): "champ vache charrue grange blé".split()}
    common = {"en": "the of and to".split(), "fr": "le de et la".split()}
    rows = [(i, lang, name, " ".join([*rng.choice(words, 12), *rng.choice(common[lang], 12)])) for i, ((lang, name), words) in enumerate(list(subjects.items()) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, subject string, text string")
    out = mixing.with_topics(docs, topics=2).toPandas()
    for lang in ("en", "fr"):
        table = pd.crosstab(out[out.lang == lang].subject, out[out.lang == lang].topic)
        assert table.shape == (2, 2) and (table.max(axis=1) / table.sum(axis=1)).min() > 0.9
    again = mixing.with_topics(docs.repartition(7).drop("topic"), topics=2).toPandas()
    assert dict(zip(out.doc_id, out.topic)) == dict(zip(again.doc_id, again.topic))


def test_targets_that_cannot_be_met_are_reported(spark, monkeypatch):
    """Source a is English alone: it can't be 60 % of the tokens while English is 40 %."""
    rows = [(i, "word " * 20, s, x) for i, (s, x) in enumerate([("a", "en"), ("b", "en"), ("b", "fr")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.4, "fr": 0.6}}
    a = mixing.mix(docs, targets).collect()
    monkeypatch.setattr(mixing, "MAX_CELLS", 1)
    b = mixing.mix(docs, targets).collect()
    for out in (a, b):
        assert all(abs(r.raking_error - 0.2) < 0.05 for r in out)
    assert all(r.raking_error == 0 or r.raking_error < 1e-9 for r in mixing.mix(docs).collect())


def test_mix_edge_cases(spark):
    rows = [(1, "a b", "en", "s", 5), (2, None, None, None, 5), (3, "", "en", "s", 5), (3, "", "en", "s", 5), (None, "c d e", "fr", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    out = mixing.mix(docs, keep=1.0).collect()
    assert len(out) == 5 and all(r.selected for r in out if r.n_tokens == 0)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("power", [0.0, 1.0])
def test_smoothing(power):
    assert np.isclose(sum(mixing.smoothed({"a": 1.0, "b": 3.0}, power).values()), 1)
