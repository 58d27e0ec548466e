import pytest

import __spark_entry__
from lumenloom.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


#: Their rows are compared with plain computations in other tests; building them alone takes rounds.
COMPARED = {"gen_07_shortest_ways", "gen_08_nodes_of_ways", "gen_09_clear_ways", "join_13_grid_conflicts", "gen_12_assignment", "gen_13_dispositions", "agg_02_assignment_cost", "srt_04_resolvable", "srt_05_appended_points", "srt_06_merged_points", "stm_03_repaired_assignment"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - COMPARED))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["site_id", "atom_id", "cost"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
