"""The registered text queries: check SQL, the pipeline, and what is registered."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from sievework.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    known = queries()
    assert all(sum(n.startswith(f"op{i}_") for n in known) == 1 for i in range(1, 14))
    assert "pipeline" in known and set(ORACLES) <= set(oracle_sql()) and set(QUERIES) <= set(known)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_check_sql(spark, name):
    assert difference(spark, connect(SF), name, SF, QUERIES, ORACLES) is None


def test_pipeline(spark):
    """Each stage against what the brute-force versions of its operator keep of the stage before."""
    from tests.llm.test_decontamination import brute as leaks
    from tests.llm.test_packing import placed_well
    from tests.llm.test_pii import brute as base
    from tests.llm.test_simhash import brute_components, brute_mark

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "one_of_each", "without_benchmark", "without_personal_data", "packed"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    assert all(s.columns == docs.columns for s in seen[:-1])
    rows = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in seen[:-1]]
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert rows[1] == {i: t for i, t in rows[0].items() if verdict[i]} and len(rows[1]) < len(rows[0])
    marks = [(i, brute_mark(t)) for i, t in rows[1].items()]
    assert set(rows[2]) == {i for i, c in ((i, brute_components(marks)[m]) for i, m in marks) if i == c}
    assert set(rows[3]) == set(rows[2]) - {d for d, _ in leaks(list(rows[2].items()), items)}
    assert set(rows[4]) == set(rows[3]) and all(not base(t) for t in rows[4].values())
    assert all(rows[4][i] == t for i, t in rows[3].items() if not any(c.isdigit() or c == "@" for c in t))
    pieces = seen[5].collect()
    assert {r["doc_id"] for r in pieces} == set(rows[4])
    placed_well(pieces, 2048)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
