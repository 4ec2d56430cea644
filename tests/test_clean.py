import pytest

from starlens.operators import clean


@pytest.fixture()
def rows(spark):
    texts = ["", "abc", "hello", "hello", "world!", "hello"]
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "review_id long, text string")


def test_counters_are_sequential(rows):
    got = clean.cleaning_stats(rows, 5).first()
    assert (got.initial_rows, got.removed_empty, got.removed_short, got.removed_duplicate, got.final_rows) == (6, 1, 1, 2, 2)
    none = clean.cleaning_stats(rows, 5, "none").first()
    assert (none.removed_duplicate, none.final_rows) == (3, 1)


@pytest.mark.parametrize(("keep", "ids"), [("first", [3, 5]), ("last", [5, 6]), ("none", [5]), (None, [3, 4, 5, 6])])
def test_keep(rows, keep, ids):
    kept = clean.clean_reviews(rows, 5, keep)
    assert sorted(r["review_id"] for r in kept.collect()) == ids
    assert kept.count() == clean.cleaning_stats(rows, 5, keep).first().final_rows


def test_hot_text_is_pruned_before_the_shuffle(rows):
    plan = clean.drop_duplicates(rows)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before


def test_unknown_keep(rows):
    with pytest.raises(ValueError):
        clean.drop_duplicates(rows, "some")


def test_shared_folder(spark, rows):
    from types import SimpleNamespace

    from starlens.session import shared_dir, stage

    class Unset:
        def get(self, key, default=None):
            return spark.conf.get("no.such.key", default)

    def session(master):
        return SimpleNamespace(conf=Unset(), sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://somewhere"))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "/shared"))
    assert shared_dir(named) == "/shared"
    assert sorted(r["review_id"] for r in stage(rows, "review_id").collect()) == [1, 2, 3, 4, 5, 6]
