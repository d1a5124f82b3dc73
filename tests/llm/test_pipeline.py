import random

import corpus_pipeline
from foliant.llm import bpe, langid, mixing, simhash, toxicity


def test_stages_follow_brute_force(spark, tmp_path):
    r = random.Random(4)
    en = ["the", "with", "thing", "other", "again", "where", "under"]
    base = [" ".join(r.choices(en, k=40)) for _ in range(60)]
    docs = [(i, base[i % 60] if i < 90 else base[i % 60] + " scum idiot", "en", f"s{i % 3}", 10) for i in range(150)]
    docs += [(900, "...", "en", "s0", 3), (901, None, None, None, None), (902, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 90)) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append([x.doc_id for x in at.collect()])
        if name != "BPE":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept[0]) == set(range(150)) and set(kept[1]) == set(range(90)) and set(kept[2]) == set(range(60)) and len(kept[2]) == 60
    assert set(kept[3]) <= set(kept[2]) and len(kept[4]) == len(kept[3])
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept[4])
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
    assert all((bpe, langid, mixing, simhash, toxicity))


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """Columns that the stages might use themselves, and an empty table, pass through all stages but the last unchanged."""
    extra = ["__n", "__id", "__text", "__copies", "id", "text_key", "row", "link", "doc", "one", "words", "size", "i", "t"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    text = "the thing with the other where under again " * 4
    rows = [(i, f"{text} {i} {i + 1}", "en", f"s{i % 2}", 5, *("x",) * len(extra)) for i in range(12)]
    rows += [rows[0], (None, text, "en", None, 5, *(None,) * len(extra)), (99, "under " * 60_000, "en", "s1", 5, *("x",) * len(extra))]
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, data in enumerate((rows, [])):
        at = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            at = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert name == "BPE" or at.dtypes == spark.createDataFrame([], schema).dtypes
        assert (at.count() > 0) == bool(data)
