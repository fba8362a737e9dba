"""Queries that take the next identity, on a table of more than ten identities."""

import pytest

from stridelake.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many"))
    rows = [(i, i % 13, [float((7 * i + 3 * d + i * d) % 11 - 5) for d in range(64)]) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["triplet_loss", "dual_claim"])
def test_one_row_a_vector(spark, many, name):
    assert sorted(r.vec_id for r in QUERIES[name](spark, many).collect()) == list(range(130))


def test_every_identity_is_claimed(spark, many):
    rows = QUERIES["three_way_verdict"](spark, many).collect()
    assert sum(r.n for r in rows) == 130 and {r.claimed_identity for r in rows} == {str(i) for i in range(13)}
