"""The driver contract, and a part of the registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
from checks import compare

SMALL = "/root/testdata/sf0.001"
QUICK = [
    "chunk_or_whole", "path_exclude", "text_read", "knn_batch", "knn_lsh", "dup_suffix",
    "insert_if_absent", "json_or_fallback", "batch_progress", "concat_until_done", "field_mappings",
    "scope_forms", "embed_faults", "generate_faults", "mapping_document", "embed_ok",
]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 80


def test_mappings_are_extracted_once(spark):
    """Doubling the mappings adds neither a second extraction nor a shuffle."""

    def nodes(name):
        found = entry.queries()[name](spark, SMALL)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange"), plan.count("Window [")

    assert nodes("mapping_dedup") == nodes("field_mappings")


def test_entries_stay_in_their_tasks(spark):
    """Entries are grouped in the tasks of the extraction: neither held mappings nor a shuffle between."""

    def plan(name):
        return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()

    def nodes(name):
        return plan(name).count("Exchange"), plan(name).count("Window [")

    whole = nodes("field_mappings")
    for name in ("mapping_entries", "fields_per_mapping", "mapping_id", "mapping_context", "mapping_grouped"):
        assert nodes(name) == whole, name
    for name in ("describe_prompt", "mapping_document", "mapping_summary", "report_text"):
        assert nodes(name)[1] == whole[1], name


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    assert compare.compare(spark, compare.duck(SMALL), name, SMALL) == ""
