"""The pipeline's stages, each against plain Python on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests_helpers import brute_groups  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run(spark):
    from sedge.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF)))
    rows = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    # only documents without letters or without a clear language go
    kept = {r["doc_id"] for r in rows[1]}
    assert all(r["doc_id"] in kept for r in rows[0] if len(re.findall(r"[^\W\d_]+", r["text"] or "")) >= 20)
    assert not any(r["doc_id"] in kept for r in rows[0] if not re.search(r"[^\W\d_]", r["text"] or ""))
    groups = brute_groups([(r["doc_id"], r["text"]) for r in rows[1]])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(d for d, _, c in groups if d == c)
    assert len(rows[3]) == len(rows[2])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in rows[3])
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 3
    ends = Counter((r["doc_id"]) for r in rows[5] if r["piece"] == 0)
    assert ends == Counter(r["doc_id"] for r in rows[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows[5])


def test_odd_tables(spark):
    odd = [(None, None, None, None, 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the of and the of and 4111 1111 1111 1111 x@y.zz", None, "s", 9), (2, "the of and the of and 4111 1111 1111 1111 x@y.zz", None, "s", 9)]
    df = spark.createDataFrame([(*r, "q") for r in odd], SCHEMA + ", _hash string")
    for some in (df, df.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != "packing":
                assert out.columns == df.columns
                now = spark.createDataFrame(out.collect(), df.schema)
    # extra columns named like the operators' helpers come back as they were
    names = ["_row", "_text", "score", "lang_pred", "_own", "base", "extra", "_hash", "size", "copies", "target", "n", "node"]
    full = [(i, f"the of and {w} the of and the {w}", "en", "s", 9) for i, w in enumerate(["to", "in", "that"])]
    plain = spark.createDataFrame(full, SCHEMA)
    clash = plain.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted((*r, *[f"own {n}" for n in names]) for r in stage(spark, plain, SF).collect())
        assert sorted(map(tuple, stage(spark, clash, SF).collect())) == want, name
    one = corpus_pipeline.one_of_each(spark, df, SF).collect()
    assert sorted((r["doc_id"] for r in one), key=str) == [1, 2, None]
