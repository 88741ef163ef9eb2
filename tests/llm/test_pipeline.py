"""Every stage of the pipeline against a brute-force version of its decision, and the whole on odd rows."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.test_text_operators import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "mixture"]
    first = cp.language_id(spark, docs, SF)
    assert first.columns == cp.COLUMNS and first.count() > 0.97 * docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_groups(rows)
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in groups.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in cp.decontamination(spark, docs, SF).collect()}
    assert clean == {i for i, (_, n, _) in brute_hits(rows, items).items() if not n}
    masked = cp.personal_data(spark, docs, SF)
    assert masked.count() == docs.count() and masked.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9-]+\.")).count() == 0
    drawn = cp.mixture(spark, docs, SF)
    assert 0 < drawn.count() < docs.count() and "probability" in drawn.columns


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, "the cat sat on the mat " * 20, "en", "s", 1), (1, "the cat sat on the mat " * 20, "en", "s", 1), (2, None, None, None, None), (None, "le chat est sur le tapis " * 20, "fr", None, 3), (4, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, None} and len(out) <= 2


def test_near_duplicates_lose_no_unlike_document(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text("a"), "en"), (None, text("b"), "en"), (None, text("b"), "en"), (1, text("c"), "en"), (1, text("d"), "fr"), (1, text("d"), "fr")]
    rows += [(2, text("c") + " more", "en"), (3, text("e"), "en"), (None, text("e") + " more", "en"), (4, "", "en"), (4, None, "en"), (5, "", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_duplicates(spark, docs, SF)
    assert got.columns == cp.COLUMNS
    want = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (3, text("e")), (4, ""), (4, None), (5, "")]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in got.collect())
