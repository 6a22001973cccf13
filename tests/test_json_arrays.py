"""JSON arrays are files of bounded size."""

import json

from gridlore.sources import files as N


def test_files_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "ARRAY_BYTES", 2_000, raising=False)
    for n, least, name in ((1_000, 10, "many"), (3, 1, "few"), (0, 1, "none")):
        records = spark.createDataFrame([("same question", f"answer {i % 2}") for i in range(n)], "question string, answer string")
        N.write_json_arrays(records, str(tmp_path / name))
        texts = [p.read_text() for p in (tmp_path / name).glob("part-*")]
        assert len(texts) >= least and all(len(t) <= 2 * 2_000 for t in texts)
        assert sum(len(json.loads(t)) for t in texts) == n
        assert N.read_json_array(spark, str(tmp_path / name), "question string, answer string").count() == n
