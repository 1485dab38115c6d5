"""Every query outside the llm package against its SQL, on whole small tables; those without SQL by what must hold of their rows."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from threadloom.plans import catalog

Q = catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, folder, name):
    compare(spark, folder, name, Q[name], catalog.SQL[name])


def test_every_query_is_tested():
    assert set(Q) - set(catalog.SQL) == {"near_pairs", "logistic_classes", "stratified_queue", "challenge_queue"}


def test_queues_hold_each_group_once(spark, folder):
    for name, most in (("stratified_queue", 300), ("challenge_queue", 200)):
        rows = Q[name](spark, folder).collect()
        assert 0 < len(rows) <= most and len({r.group_id for r in rows}) == len(rows) and [r.position for r in rows] == list(range(1, len(rows) + 1))


def test_logistic_classes_beat_the_majority(spark, folder):
    # The labels of the given vectors are noisy; what must hold is that the fit knows more than the commonest class.
    rows = Q["logistic_classes"](spark, folder).collect()
    assert sum(r.correct for r in rows) > max(r.n for r in rows) and len(rows) > 1


def test_near_pairs_hold_the_pairs_of_the_band(spark, folder):
    pairs = Q["near_pairs"](spark, folder)
    assert pairs.where("similarity < 0.92").count() == 0
    # Candidates are pairs of ids either way round; every one whose texts match is found.
    assert pairs.select(F.least("left_id", "right_id"), F.greatest("left_id", "right_id")).distinct().count() == pairs.count()
