import re

import corpus_pipeline as cp
import pytest

from tessera.llm import quality
from tessera.llm.queries import table


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """Each stage written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs = table(spark, small, "documents")
    out = [docs]
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, out[-1], small).write.parquet(str(root / str(i)))
        out.append(spark.read.parquet(str(root / str(i))))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert len(cp.STAGES) == 5


def test_quality_stage(spark, small, steps):
    docs = steps[0]
    model = quality.fit(docs, table(spark, small, "labels"))
    good = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert ids(steps[1]) == good


def test_one_of_each_group(steps):
    from test_jaccard import plain

    data = sorted((r["doc_id"], r["text"]) for r in steps[1].collect())
    want = {d for d, (n, c) in plain(data).items() if n == 0 or c == d}
    assert ids(steps[2]) == want


def test_benchmark_is_gone(spark, small, steps):
    from test_decontaminate import plain

    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    data = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    hit = {d for d, _ in plain(data, items)}
    assert ids(steps[3]) == {d for d, _ in data} - hit


def test_masked(steps):
    before = {r["doc_id"]: r for r in steps[3].collect()}
    after = {r["doc_id"]: r for r in steps[4].collect()}
    assert set(before) == set(after)
    for d, r in after.items():
        assert r["n_chars"] == len(r["text"])
        assert not re.search(r"[A-Za-z0-9]@[a-z0-9-]+\.[a-z]", r["text"])


def test_run_equals_stages(spark, small, steps):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in df.collect())
    assert key(cp.run(spark, small)) == key(steps[-1])


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_rows(spark, small, odd, empty, stage):
    rows = odd.selectExpr("doc_id", "text", "lang", "lang AS source", "cast(0 as bigint) AS n_chars", "score AS predicted")
    out = cp.STAGES[stage][1](spark, rows, small)
    assert out.count() <= rows.count()
    if stage < 4:
        assert out.columns == rows.columns
    none = rows.limit(0)
    assert cp.STAGES[stage][1](spark, none, small).count() == 0
