"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from rasterforest.llm import mixing


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    docs, labels = [], []
    for i in range(300):
        t = text(80)
        if i % 3 == 0:
            t = "badword " + t + " badword"
        labels.append((i, int(i % 3 == 0), 1))
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
    docs[4] = (4, docs[1][1], "en", "s0", 1)
    docs[7] = (7, docs[7][1] + " " + passage, "en", None, 1)
    docs[8] = (8, passage + " " + docs[8][1], "en", "s0", 1)
    docs += [(1000, None, "en", "s1", 0), (None, "no id at all", None, "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not [i for i in seen["toxicity"] if i is not None and i < 300 and i % 3 == 0]
    assert len(seen["toxicity"]) == 202
    assert 4 not in seen["ngram_jaccard"] and len(seen["ngram_jaccard"]) == 201
    assert passage not in seen["suffix_dedup"][7] and passage not in seen["suffix_dedup"][8]
    assert seen["suffix_dedup"][1] == docs[1][1] and len(seen["suffix_dedup"]) == 201
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and pieces.count() > 200


def test_mixing_of_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = [(None, 5), (None, 9), (None, 3), (None, 9), (1, 6), (1, 4), (1, 6), (2, 7)]
    rows = [(i, " ".join(f"r{k}w{j}" for j in range(n)), "en", f"s{k % 2}", 0) for k, (i, n) in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [r["text"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()]
    taken = mixing.mix(docs, mixing.label_quality(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert sum(len(t.split()) for t in got) == taken.agg(F.sum("taken")).first()[0]
    # Each text comes at most twice, as epochs allow, and in part at most once.
    for _, text, *_ in rows:
        parts = [t for t in got if text.startswith(t)]
        assert len(parts) <= 2 and sum(t != text for t in parts) <= 1
    assert all(any(text.startswith(t) for _, text, *_ in rows) for t in got)


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"badword {text(80)} badword" if i % 3 == 0 else text(80)) for i in range(300)]
    one, two, three = text(80), text(80), text(80)
    # Toxic without an id; clean beside a toxic row of the same id; copies under one id, without ids, and of both kinds.
    rows += [(None, f"badword {text(80)} badword"), (500, f"badword {text(80)} badword"), (500, text(80))]
    rows += [(501, one), (501, one), (None, two), (None, two), (None, two + " end"), (None, three), (502, three)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, t) for i, t in rows if "badword" not in t]
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got = [(r["doc_id"], r["text"]) for r in now.collect()]
        if name == "toxicity":
            assert sorted(got, key=str) == sorted(want, key=str)
        else:
            rest = [r for r in got if r[0] is None or r[0] >= 501]
            assert len(got) == len(want) - 4 and len(rest) == 3
            assert (501, one) in rest and (502, three) in rest and any(i is None and t.startswith(two) for i, t in rest)
