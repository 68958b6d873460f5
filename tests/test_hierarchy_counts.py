import pytest
from conftest import plus, rows

from cohortloom.operators import counts as ct
from cohortloom.operators import hierarchy as hi

CONCEPT = ("concept_id long, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, "
           "standard_concept string")
EDGE = ("ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int, "
        "max_levels_of_separation int")
DX = "person_id long, condition_concept_id long, condition_concept_name string"


def snomed(spark, names):
    return spark.createDataFrame([(i, n, "Condition", "SNOMED", "x", "S") for i, n in names.items()], CONCEPT)


def edges(spark, *pairs):
    return spark.createDataFrame([(a, d, lvl, lvl) for a, d, lvl in pairs], EDGE)


def test_ingredients(spark):
    concept = spark.createDataFrame([
        (1, "Ing A", "Drug", "RxNorm", "Ingredient", "S"), (2, "Ing B", "Drug", "rxnorm", "Ingredient", "S"),
        (3, "Brand", "Drug", "RxNorm", "Brand", "S"), (4, "Old", "Drug", "RxNorm", "Ingredient", None)], CONCEPT)
    drugs = spark.createDataFrame([(1, 10, "pill", plus(0), 5), (1, 10, "pill", plus(0), 5), (2, 11, "other", plus(0), 6)],
                                  "person_id long, drug_concept_id long, drug_concept_name string, "
                                  "drug_exposure_start_date date, visit_occurrence_id long")
    closure = edges(spark, (1, 10, 1), (2, 10, 1), (3, 10, 1), (4, 11, 1))
    got = hi.ingredient_rollup(drugs, closure, concept)
    assert rows(got, "person_id", "ancestor_drug_concept_id") == [(1, 1), (1, 2)]


def _rollup(spark, mode):
    names = {1: "Cough", 2: "Airway problem", 3: "Disease", 4: "Left lung", 5: "Chest finding", 6: "Deep parent"}
    dx = spark.createDataFrame([(p, 1, "Cough") for p in (1, 2, 2, 3, 9)] + [(1, 7, "Lung finding")], DX)
    labelled = spark.createDataFrame([(p,) for p in (1, 2, 3)], "person_id long")
    closure = edges(spark, (1, 1, 0), (2, 1, 2), (6, 1, 3), (3, 1, 1), (4, 1, 1), (5, 1, 1), (5, 7, 1), (2, 7, 1))
    return hi.rollup_candidates(dx, labelled, closure, snomed(spark, names), mode=mode)


def test_rollup_modes(spark):
    got = rows(_rollup(spark, "either"), "parent_concept_name", "child_concept_name", "ptct_training")
    assert got == [("Airway problem", "Cough", 3), ("Cough", "Cough", 3)]
    got = rows(_rollup(spark, "parent_only"), "parent_concept_name", "child_concept_name", "ptct_training")
    assert got == [("Airway problem", "Cough", 3), ("Airway problem", "Lung finding", 1),
                   ("Chest finding", "Lung finding", 1), ("Cough", "Cough", 3)]
    with pytest.raises(ValueError):
        _rollup(spark, "none")


def test_parent_threshold_and_fan_out(spark):
    cand = spark.createDataFrame([("P", "a", 2), ("P", "b", 1), ("Q", "a", 2), ("R", "a", 3)],
                                 "parent_concept_name string, child_concept_name string, ptct_training long")
    final = hi.final_rollup(hi.parent_totals(cand), cand)
    assert rows(final) == [("P", "a"), ("P", "b"), ("R", "a")]
    dx = spark.createDataFrame([(1, 1, "a"), (1, 2, "c")], DX)
    got = rows(hi.apply_rollup(dx, final), "condition_concept_name", "high_level_condition")
    assert got == [("a", "P"), ("a", "R"), ("c", None)]
    label_map = spark.createDataFrame([("a", "Osteo "), ("b", "EXCLUDE")], "condition_concept_name string, high_level_condition string")
    assert rows(hi.apply_label_map(dx, label_map), "condition_concept_name", "high_level_condition") == [("a", "Osteo"), ("c", None)]


def naive_selection(counts, closure, cutoff, blocked):
    total = {}
    for a, d, _ in closure:
        total[a] = total.get(a, 0) + counts.get(d, 0)
    kept = {a for a, n in total.items() if n >= cutoff}
    out = set()
    for d in counts:
        options = [(lvl, a) for a, x, lvl in closure if x == d and a in kept]
        least = min((lvl for lvl, _ in options), default=None)
        out |= {(a, d) for lvl, a in options if lvl == least and a not in blocked and d not in blocked}
    return sorted(out)


def test_selection_against_naive(spark):
    # 1 reaches the cutoff itself; 2 and 3 through two ancestors at one level; 4 never; 5 is blocked
    closure = [(i, i, 0) for i in range(1, 13)] + [(10, 2, 1), (11, 2, 1), (10, 3, 1), (11, 3, 1), (12, 2, 2), (12, 1, 1),
                                                  (12, 4, 3), (10, 5, 1)]
    counts = {1: 6, 2: 3, 3: 3, 4: 1, 5: 2}
    facts = spark.createDataFrame([(p, c, "n") for c, n in counts.items() for p in range(n)], DX)
    concept = snomed(spark, {i: f"c{i}" for i in range(1, 13)})
    for cutoff in (4, 5, 6, 7, 100):
        got = hi.selected_features(facts, edges(spark, *closure), concept, cutoff, (), (5,))
        assert rows(got, "ancestor_concept_id", "descendant_concept_id") == naive_selection(counts, closure, cutoff, {5})


def test_blocked_ancestor_removes_its_descendants(spark):
    closure = edges(spark, (1, 1, 0), (2, 2, 0), (9, 1, 1), (9, 9, 0))
    facts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], DX)
    concept = snomed(spark, {1: "a", 2: "b", 9: "z"})
    got = hi.selected_features(facts, closure, concept, 1, (9,), ())
    assert rows(got, "descendant_concept_id") == [(2,)]


COHORT = "person_id long, pre_window_start_dt date, pre_window_end_dt date, post_window_start_dt date, post_window_end_dt date"


def cohort(spark, *persons):
    return spark.createDataFrame([(p, plus(-365), plus(-45), plus(45), plus(300)) for p in persons], COHORT)


def test_pre_post_counts_edges(spark):
    facts = spark.createDataFrame([
        (1, 7, "x", plus(-365), 1), (1, 7, "x", plus(-45), 2),   # both bounds, one episode
        (1, 7, "x", plus(-44), 3), (1, 7, "x", plus(45), 4), (1, 7, "x", plus(301), 5),
        (1, 8, "x", plus(50), 4),                               # the same name under another id
        (1, 9, "y", plus(50), None), (1, 9, "y", plus(50), 77),  # no visit, unknown visit
        (2, 7, "x", plus(0), 1)],
        "person_id long, cid long, cname string, d date, visit_occurrence_id long")
    vm = spark.createDataFrame([(1, "e"), (2, "e"), (3, None), (4, None), (5, None)], "visit_occurrence_id long, macrovisit_id string")
    got = rows(ct.pre_post_counts(facts, cohort(spark, 1, 2), vm, ("cid", "cname"), "d", ("pre", "post")))
    assert got == [(1, 7, "x", 1, 1), (1, 8, "x", 0, 1)]


def test_inpatient_days_counts_an_episode_once(spark):
    vm = spark.createDataFrame([(1, plus(45), plus(47)), (1, plus(45), plus(47)), (1, plus(300), plus(310)), (1, plus(301), plus(302)),
                                (2, plus(44), plus(60))],
                               "person_id long, macrovisit_start_date date, macrovisit_end_date date")
    assert rows(ct.inpatient_days(cohort(spark, 1, 2), vm), "person_id", "tot_ip_days") == [(1, 3 + 11)]


def test_labs(spark):
    labs = spark.createDataFrame([
        (1, "s", plus(-50), 1, 4.0, 1), (1, "s", plus(-50), 1, 4.0, 1), (1, "s", plus(-60), 1, 10.0, 1), (1, "s", plus(50), 1, None, 1),
        (2, "s", plus(60), 1, 3.0, 1), (3, "s", plus(0), 1, 3.0, 1)],
        "person_id long, concept_set_name string, measurement_date date, visit_occurrence_id long, "
        "harmonized_value_as_number double, harmonized_unit_concept_id int")
    got = rows(ct.pre_post_labs(labs, cohort(spark, 1, 2, 3)), "person_id", "pre_min_val", "pre_max_val", "pre_avg_val", "post_max_val")
    assert got == [(1, 4.0, 10.0, 7.0, -999.0), (2, -999.0, -999.0, -999.0, 3.0)]
    pop = rows(ct.lab_population(labs), "concept_set_name", "harmonized_unit_concept_id", "pop_avg")
    assert pop == [("s", 1, 4.8)]


def test_prevalence_and_flags(spark):
    counts = spark.createDataFrame([(p, 1, "a", 0, 2) for p in range(100)] + [(0, 2, "b", 1, 1)],
                                   "person_id long, cid long, cname string, pre long, post long")
    kept = ct.prevalent_concepts(counts, ("cid", "cname"))
    assert rows(kept) == [(1, "a", 100), (2, "b", 1)]
    assert rows(ct.prevalent_concepts(counts, ("cid", "cname"), share=0.02), "cid") == [(1,)]
    flags = ct.with_post_flags(ct.above_threshold(counts, kept, "cid"), "pre", "post", "post_only")
    assert flags.filter("cid = 2").select("post_only", "more_in_post").first() == (0, 0)
    assert flags.filter("cid = 1").select("post_only", "more_in_post").first() == (1, 1)
