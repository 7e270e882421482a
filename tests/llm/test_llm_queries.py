"""Registered queries against their SQL, whole results, and the pipeline stage by stage against brute force."""
from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__
import check_oracle
import corpus_pipeline
from alarmspan.llm import catalog, simhash
from alarmspan.session import cut_lineage
from test_llm_text import check_packing, shipped, slow_groups, slow_line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    ok, note = check_oracle.compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, note


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name, table, columns", [
    ("op2_html_text", "pages", {"page_id", "url", "text", "n_chars"}),
    ("op7_toxicity", "documents", {"doc_id", "held_out", "score", "predicted"}),
    ("op8_secret_scan", "documents", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    ("op10_token_counts", "documents", {"doc_id", "n_bytes", "n_tokens", "over_limit"}),
    ("op12_periodic_runs", "documents", {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                         "collapsed_sha256"}),
    ("op13_hyperminhash", "documents", {"doc_id", "n_shingles", "component_id", "kept"})])
def test_a_row_for_every_row(spark, name, table, columns):
    out = catalog.QUERIES[name](spark, SF)
    assert columns <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_native_operator_runs_no_python(spark):
    plan = catalog.op1_source_mix(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_near_copies_stage_ships_no_variants(spark, monkeypatch):
    seen, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda pairs: seen.append(shipped(pairs)) or components(pairs))
    docs = catalog.table(spark, SF, "documents")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert seen == [False] and 0 < kept.count() < docs.count()


def test_pipeline_stages(spark):
    docs = catalog.table(spark, SF, "documents")
    columns, rows = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
        rows = cut_lineage(stage(spark, rows, SF), name)
        if name != "packing":
            assert rows.columns == columns
            after = [(r["doc_id"], r["text"]) for r in rows.collect()]
            assert all(r["n_chars"] == len(r["text"]) for r in rows.collect()) or name == "toxicity"
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > len(before) / 2
        elif name == "line_dedup":
            ordered = sorted(before)
            assert sorted(after) == sorted(zip([d for d, _ in ordered], slow_line_dedup(ordered, catalog.LEAST_WORDS)))
        elif name == "simhash_near_dedup":
            groups = slow_groups(before)
            assert sorted(d for d, _ in after) == sorted({c for _, _, c in groups}) and set(after) <= set(before)
        elif name == "source_mix":
            assert set(after) == set(before) and max(Counter(after).values()) <= 3
            seen["mixed"] = after
        else:
            check_packing(rows.collect(), seen["mixed"])


def test_pipeline_on_no_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        catalog.table(spark, SF, t).where("1 = 0").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
