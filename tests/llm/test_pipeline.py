import pytest

import corpus_pipeline as cp
from webloom.llm import exact_dedup, near_copies, pii, toxicity
from webloom.llm.common import materialize
from webloom.llm.queries import ORACLES, QUERIES


def canon(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = ", ".join(sorted(df.columns))
    assert canon(df.select(sorted(df.columns)).collect()) == canon(duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_each_query_returns_every_document(spark, sf, some, name):
    ids = {r["doc_id"] for r in QUERIES[name](spark, sf).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in some.select("doc_id").collect()}


def test_stages(spark, sf, some):
    """Each stage against what its operator says, on what the stage before it kept."""
    rows = some
    model = toxicity.train(rows, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.toxicity(rows, model).filter("predicted = 1").collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in rows.collect()}
        after = stage(spark, rows, sf)
        if k == 4:
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert after.columns == some.columns and after.dtypes == some.dtypes
        kept = {r["doc_id"]: r for r in after.collect()}
        if name == "toxicity":
            assert set(kept) == set(before) - toxic
        elif name == "exact_dedup":
            assert set(kept) == {r["doc_id"] for r in exact_dedup.exact_dedup(rows).filter("kept").collect()}
        elif name == "simhash_near_dedup":
            groups = {}
            for r in near_copies.similar_groups(rows).collect():
                groups.setdefault(r["root"], []).append(r["doc_id"])
            assert set(kept) == {min(g, key=lambda i: (-len(before[i]["text"] or ""), i)) for g in groups.values()}
        else:
            field = pii.train()
            for i, r in kept.items():
                found = pii.find_pii(field, [before[i]["text"] or ""])[0][1]
                assert r["text"] == pii.masked(before[i]["text"], found) and r["n_chars"] == len(r["text"])
        if name != "pii":
            assert all(kept[i] == before[i] for i in kept)
        rows, _ = materialize(after, "test")


def test_odd_and_empty_tables(spark, sf, odd, nothing):
    for table in (odd, nothing):
        rows = table
        for name, stage in cp.STAGES:
            rows = stage(spark, rows, sf)
            if name != "packing":
                assert rows.columns == table.columns
        n = rows.count()
        assert n == 0 if table is nothing else n > 5


def test_run(spark, sf):
    rows = cp.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0
