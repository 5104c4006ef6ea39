import os
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from pagecorpus.llm import contamination, jaccard_join, language, mixing, tokens


def test_registered():
    names = set(E.queries())
    assert {f"op{i}_" for i in range(1, 14)} <= {n[:n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "token_files"]


def test_stages_by_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(400)
    os.makedirs(tmp_path / "in")
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "in" / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "in" / "documents.parquet"))
    seen = []
    for name, stage in P.STAGES:
        out = str(tmp_path / name)
        stage(spark, d, str(tmp_path / "in")).write.parquet(out)
        before, d = d, spark.read.parquet(out)
        seen.append((before.collect(), d.collect()))
        if name != "token_files":
            assert d.columns == docs.columns
    a, b = seen[0]
    model = language.fit(docs)
    bad = {r.doc_id for r in language.predict(docs, model, "doc_id", "text").collect() if r.rejected}
    assert {r.doc_id for r in b} == {r.doc_id for r in a} - bad
    a, b = seen[1]
    from test_jaccard_join import _plain
    want, _ = _plain([(r.doc_id, r.text) for r in a], 5, 80)
    assert sorted(r.doc_id for r in b) == sorted(set(want.values())) and len(b) < len(a)
    a, b = seen[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = contamination.Index(items)
    assert {r.doc_id for r in b} == {r.doc_id for r in a if all(m[1] < 0.5 for m in index.matches(r.text))} and len(b) < len(a)
    a, b = seen[3]
    copies = {r.doc_id: r.copies for r in mixing.decisions(spark.createDataFrame(a, docs.schema)).collect()}
    assert Counter(r.doc_id for r in b) == Counter({k: v for k, v in copies.items() if v})
    a, b = seen[4]
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    start, expect = 0, []
    for r in sorted(a, key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        expect.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, b)) == sorted(expect)
    whole = P.run(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, whole.collect())) == sorted(expect)


def test_odd_rows_and_empty(odd, nothing, spark, sf_dir):
    for df in (odd, nothing):
        d = df
        for _, stage in P.STAGES:
            d = stage(spark, d, sf_dir)
        assert d.count() >= 0
    assert jaccard_join.keep_one(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_pieces_of_the_registry_survive(n):
    assert E.oracle_sql().get("pipeline") is None
