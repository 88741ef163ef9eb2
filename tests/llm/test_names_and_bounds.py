"""Columns of clashing names or another case change nothing; language models don't depend on the size of other languages or on copies."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, langid, mixing, repeats

CLASH = ["__mark", "__ord", "__w", "__p", "__e", "__source", "__lang", "__topic", "__later", "__spans", "__ids", "__key", "_0", "Host"]
ROWS = [(i, f"the quick brown fox {i % 5} jumps over a lazy dog and then some more words {i % 3} follow it here", ["en", "fr"][i % 2], "abc"[i % 3]) for i in range(30)] + [(99, None, None, None), (None, "", "en", "a")]


def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


def clashing(spark):
    df = plain(spark).withColumns({c: F.concat(F.lit(c), F.lit("!"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})
    return df.withColumnsRenamed({"text": "Text", "lang": "LANG", "source": "Source", "doc_id": "Doc_ID"})


OPERATORS = {
    "op3": (lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([("i", "jumps over a lazy dog and then some more words 1 follow")], "item_id string, text string")), ["n_words", "hits", "item_ids"]),
    "op4": (lambda d: langid.identify(d, langid.fit(d, F.lit(True))), ["lang_pred", "score", "cross_entropy", "rejected"]),
    "op7": (lambda d: repeats.remove_repeats(d), ["n_words", "n_removed", "kept_text", "repeats"]),
    "op10": (lambda d: mixing.mix(d), ["topic", "n_tokens", "weight", "probability", "raking_error", "selected"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_and_differently_cased_names(spark, name):
    run, new = OPERATORS[name]
    want = {str(tuple(r[c] for c in ("doc_id", "text", "lang", "source"))): [r[c] for c in new] for r in run(plain(spark)).collect()}
    out = run(clashing(spark))
    assert out.columns == ["Doc_ID", "Text", "LANG", "Source", *CLASH, *new]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r[c] == f"{c}!{'-' if r.Doc_ID is None else r.Doc_ID}" for r in rows for c in CLASH)
    assert {str(tuple(r[c] for c in ("Doc_ID", "Text", "LANG", "Source"))): [r[c] for c in new] for r in rows} == want
    if name == "op10":
        assert min(r.probability for r in rows) < 1


def entropies(model, lang, texts):
    at = model.langs.index(lang)
    return np.concatenate([b[:, at] for b, _ in langid.cross_entropies(model, pa.array(texts))])


def test_other_languages_and_copies_change_no_cross_entropy(spark):
    rng = np.random.default_rng(1)
    text = lambda words, n=30: " ".join(rng.choice(words, n))
    aa = [(text("alpha beta gamma delta eins zwei".split()), "aa") for _ in range(150)]
    cc = [(text("one two three four five six seven".split(), 200), "cc") for _ in range(600)]
    fit = lambda rows, most: langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), F.lit(True), max_letters=most)
    probe = [text("alpha beta gamma".split()) for _ in range(5)]
    for most in (1 << 30, 20_000):  # below and beyond the bound of cc, and in the second case of aa and of copies
        alone = entropies(fit(aa, most), "aa", probe)
        assert np.allclose(alone, entropies(fit(aa + cc, most), "aa", probe))
        assert np.allclose(alone, entropies(fit(aa + aa[:40] * 30 + cc[:9], most), "aa", probe))


def test_the_tail_bound_has_no_step(spark):
    rng = np.random.default_rng(5)
    far = rng.exponential(1.0, 400_000)
    assert langid.tail_bound(far[:0], np.zeros(0, int), 1e-4) == pytest.approx(langid.WIDE)
    bounds = {n: langid.tail_bound(far[:n], np.ones(n, int), 1e-4) for n in (10, 100, 1000, 9_999, 10_001, 100_000, 400_000)}
    values = list(bounds.values())
    assert all(a > b - 0.6 for a, b in zip(values, values[1:])) and abs(bounds[9_999] - bounds[10_001]) < 0.05
    for n in (9_000, 11_000, 300_000):  # rates on both sides of 1 / rate, on texts that the bound has not seen
        got = (rng.exponential(1.0, 2_000_000) > langid.tail_bound(far[:n], np.ones(n, int), 1e-4)).mean()
        assert 1e-5 < got <= 1.5e-4
    near = langid.tail_bound(np.sort(far[:1000]), np.ones(1000, int), 1e-4)
    assert near == pytest.approx(langid.tail_bound(np.repeat(far[:1000], 2), np.full(2000, 1), 1e-4), rel=0.1)


def test_rows_that_cannot_be_hit_skip_the_join(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(50)] + [(50, "a b c d e f g h i j k l"), (51, "A b c d e f g h i j k l")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "b c d e f g h i j k")], "item_id string, text string")
    out = decontaminate.decontaminate(docs, items)
    assert {r.doc_id: [(h.start, h.end) for h in r.hits] for r in out.collect() if r.hits} == {50: [(1, 11)], 51: [(1, 11)]}
    assert out.count() == 52 and {r.n_words for r in out.collect()} == {30, 12}
