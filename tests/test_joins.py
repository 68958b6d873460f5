import pytest
from conftest import rows

from cohortloom.operators.joins import stored_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_stored_join_equals_plain_join(spark, how):
    # one person owns two thirds of the rows; equal rows stay as many as they were
    facts = spark.range(900).selectExpr("if(id % 3 < 2, 1, id % 20) as person_id", "id div 7 as v")
    facts = facts.unionAll(facts.limit(50))
    people = spark.createDataFrame([(p, f"n{p}") for p in range(0, 20, 2)] + [(1, "hot")], "person_id long, name string")
    want = facts.join(people, "person_id", how)
    got = stored_join(facts, people, how=how)
    assert got.columns == want.columns and rows(got) == rows(want)
