"""The pipeline's stages, each on its own input, against plain versions."""

import brute
import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    """The input of each stage and the last result, as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, spark.createDataFrame(out[-1], docs.schema), SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_rules(chain):
    f = quality.INSTALLED.load()
    want = []
    for r in chain[0]:
        _, inside = brute.fertility(r.text, r.lang, f.model, f.byte_level, quality.LANGUAGE_BANDS, quality.SCRIPT_BANDS, quality.ENTROPY_FLOOR)
        if inside and not brute.quality_base(r.text)["base_failed"]:
            want.append(r.doc_id)
    assert ids(chain[1]) == sorted(want) and 0.5 * len(chain[0]) < len(want) < len(chain[0])


def test_near_dedup(chain):
    classes = brute.simhash_classes([(r.doc_id, r.text) for r in chain[1]])
    assert ids(chain[2]) == sorted({c for _, c in classes.values()})


def test_decontamination(spark, chain):
    items = [brute.words((r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in chain[2] for w in items if brute.edit_distance(w, brute.words(r.text.lower())) <= int(0.2 * len(w))}
    assert leaking and ids(chain[3]) == sorted(set(ids(chain[2])) - leaking)


def test_mix(spark, chain):
    con = duckdb.connect()
    con.register("kept", spark.createDataFrame(chain[3]).toPandas())
    sql = mixing.oracle("kept", corpus_pipeline.MIX_NUMERATOR, corpus_pipeline.MIX_DENOMINATOR, 1, columns="doc_id")
    assert ids(chain[4]) == sorted(x for (x,) in con.execute(sql).fetchall())


def test_sharding(chain):
    brute.shard_sizes_ok([r.asDict() for r in chain[5]], len(chain[4]), {r.doc_id: r.text for r in chain[4]})


def test_run_is_the_chain(spark, chain):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, chain[5]))


def test_awkward_rows(spark):
    """Null and empty texts, repeated rows, ties, null ids and a very long text through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(40).collect()
    long = " ".join(r.text for r in some) * 20
    extra = [(None, None, None, None, None), (1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (None, some[5].text, "en", "src2", 1), (None, some[5].text, "en", "src2", 1), (900_001, long, "en", "src3", len(long))]
    rows = [tuple(r) for r in some] + [tuple(r) for r in some[:10]] + extra
    at = spark.createDataFrame(rows, docs.schema).repartition(6)
    texts = {r[1] for r in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        got = stage(spark, at, SF).collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert {tuple(r) for r in got} <= {tuple(r) for r in before}
            at = spark.createDataFrame(got, docs.schema)
        else:
            assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((r.doc_id or 0, r.text) for r in before)
        if k == 1:  # one row of each class
            assert len({r.text for r in got}) == len(got) and {r.text for r in got} <= texts
    assert got


def test_empty_input(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
