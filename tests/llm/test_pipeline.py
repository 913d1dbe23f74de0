"""The pipeline's stages over odd rows, and run() against what the stages' brute force would keep."""

import corpus_pipeline as pipeline

ITEM = " ".join(f"t{i}" for i in range(20))
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
TEXT = lambda k, n=60: " ".join(f"word{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
ROWS = [
    (1, TEXT(0), "en", 3, "a"), (2, TEXT(0) + " more", "en", 3, None), (None, TEXT(0), "en", 3, "c"), (3, f"an {ITEM} b", "fr", 3, "d"), (None, f"c {ITEM}", None, 3, "e"), (4, "½ ² 12 !!", "en", 3, "f"),
    (5, None, "en", None, "g"), (6, "", "en", 0, "h"), (7, TEXT(1) + f' token = "{KEY}"', "en", 99, "i"), (7, TEXT(2), "de", 3, "j"), (8, TEXT(3, 600), None, 3, "k"), (8, TEXT(3, 600), None, 3, "k"),
]


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long, score string")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("i1", ITEM)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = [sorted(map(str, map(tuple, docs.collect())))]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString() and stage(spark, docs.limit(0), sf).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted(map(str, map(tuple, docs.collect()))))
    gone = lambda i: [r for r in ROWS if str(r) in kept[i] and str(r) not in kept[i + 1]]
    assert gone(0) == [ROWS[5], ROWS[6], ROWS[7]]
    assert gone(1) in ([ROWS[1], ROWS[2]], [ROWS[1], ROWS[2], ROWS[4]], [ROWS[1], ROWS[2], ROWS[3]]) and kept[2].count(str(ROWS[10])) == 1
    assert set(map(str, (ROWS[3], ROWS[4]))) & set(kept[3]) == set() and len(kept[3]) == 4
    masked = (7, TEXT(1) + ' token = "[SECRET]"', "en", len(TEXT(1)) + len(' token = "[SECRET]"'), "i")
    assert str(masked) in kept[4] and len(kept[4]) == 4
    final = pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == [1, 7, 7, 8] and all(len(r.ids) == r.n_tokens > 0 for r in final)
