"""Arrays of objects are of bounded size, however many rows there are."""

import json

from ledgerloom.plans import governance


def test_json_arrays_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(governance, "_folder", lambda spark: f"{tmp_path}/arrays")
    sf = "/root/testdata/sf0.01"
    rows = governance.s2_json_array_scan(spark, sf).count()
    sizes = [len(json.loads(r.value)) for r in spark.read.text(f"{tmp_path}/arrays").collect()]
    assert rows == sum(sizes) == spark.read.parquet(f"{sf}/orders.parquet").count() and max(sizes) <= 512
