"""Physical-plan properties that matter at scale (checked on sf0.001)."""

import pytest

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
TRAINED = {"word2vec_train", "svm_grid_search", "gbt_grid_search", "mlp_classify", "svm_rbf_classify"}
QUERIES = entry_mod.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_cartesian_or_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan


def test_word_table_is_one_shuffle_on_word(spark):
    plan = _plan(QUERIES["word_distribution_tf"](spark, SF))
    assert plan.count("hashpartitioning(word") == 1
    assert "SinglePartition" not in plan
    assert "partial_count" in plan            # map-side combine before the shuffle


def test_exact_sample_is_a_filter(spark):
    plan = _plan(QUERIES["exact_sample"](spark, SF))
    assert "Window" not in plan and "TakeOrdered" not in plan and "Sort " not in plan


def test_top_n_is_limited_before_the_shuffle(spark):
    for name in ["common_words", "attribution_top_words"]:
        assert "WindowGroupLimit" in _plan(QUERIES[name](spark, SF)), name


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(QUERIES["word_distribution_tf"](spark, SF))
    assert "PushedFilters: [IsNotNull(doc_id), IsNotNull(text), IsNotNull(lang)]" in plan
    preds = _plan(QUERIES["confusion_matrix"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in preds   # no text read for predictions


def test_vocabulary_is_a_bounded_top_n(spark):
    plan = _plan(QUERIES["vocabulary_index"](spark, SF))
    assert "TakeOrderedAndProject(limit=9999" in plan


def test_document_frequency_needs_no_dedup_shuffle(spark):
    plan = _plan(QUERIES["word_distribution_df"](spark, SF))
    assert plan.count("hashpartitioning(word") == 1
    assert "array_distinct" in plan


@pytest.mark.parametrize("name, module, search, points", [("svm_grid_search", "kernel_svm", "svm_search", "svm_points"),
                                                        ("gbt_grid_search", "boosting", "boosted_search", "tree_points")])
def test_registered_grid_searches_cover_the_whole_grid(spark, monkeypatch, name, module, search, points):
    import importlib

    own, seen = importlib.import_module(f"lexis.operators.{module}"), {}

    def stop(train, classes, dim, **options):
        seen.update(train=train.count(), folds=sorted(r[0] for r in train.select("fold").distinct().collect()), options=options)
        raise StopIteration

    monkeypatch.setattr(own, search, stop)
    with pytest.raises(StopIteration):
        QUERIES[name](spark, SF)
    assert seen["train"] == 450 and seen["folds"] == [0, 1, 2] and set(seen["options"]) <= {"id_col", "vec_col"}
    assert len(getattr(own, points)()) == {"svm_points": 12, "tree_points": 18}[points]
