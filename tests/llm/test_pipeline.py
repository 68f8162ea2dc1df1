"""The pipeline against a brute-force version of its stages on a small corpus."""

import random
import re

import pytest

import corpus_pipeline
from planloom.llm.mixing import mix
from tests_llm_helpers import brute_near_groups, prose

SECRET = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}", re.A)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    item = prose(900, 25)
    rows = []
    for i in range(70):
        text = prose(i, rng.randint(20, 90))
        if i % 11 == 3:
            text = rows[i - 2][1]  # an exact copy
        if i % 13 == 5:
            text = f"{text} {item} {prose(i + 500, 10)}"
        if i % 9 == 2:
            text += ' token = "abcdef0123456789" end'
        rows.append((i, text, ("en", "de", None)[i % 3], ("a", "b", None)[i % 4 % 3], len(text), "kept"))
    rows += [(200, None, "en", "a", None, "x"), (201, "12 34 !", "en", "a", 7, "x"), (202, "", None, None, 0, "x")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages(spark, corpus):
    path, rows, item = corpus
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    kept = [r for i, (r, first) in enumerate(zip(kept, brute_near_groups([r[1] for r in kept]), strict=True)) if i == first]
    kept = [r for r in kept if item not in r[1]]
    kept = [(*r[:1], SECRET.sub("[SECRET]", r[1]), *r[2:]) for r in kept]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    got = sorted(map(tuple, docs.collect()))
    assert [g[:4] + g[5:] for g in got] == [k[:4] + k[5:] for k in kept] and all(g[4] == len(g[1]) for g in got)
    assert any("[SECRET]" in g[1] for g in got) and len(got) < len(rows) - 6
    want = mix(spark.createDataFrame(kept, docs.schema)).taken().where("taken > 0").select("id", "source", "size", "source_size", "target", "taken")
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(str(r).replace("id=", "doc_id=", 1) for r in want.collect())


def test_empty_corpus(spark, corpus, tmp_path):
    path = corpus[0]
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
