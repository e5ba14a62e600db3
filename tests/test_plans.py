"""Plans that must not change unseen: push-down, pruning, partial steps, number of scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as driver


@pytest.fixture
def plan(spark, data):
    def text(name):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            driver.queries()[name](spark, data).explain("formatted")
        return out.getvalue()

    return text


def scans(text):
    return len(re.findall(r"^\(\d+\) Scan parquet", text, re.M))


def test_filter_reaches_the_scan_and_the_limit_the_sort(plan):
    text = plan("sql_filter_topk")
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "IsNotNull(l_discount)" in pushed and "GreaterThan(l_discount,0.05)" in pushed
    assert "TakeOrderedAndProject" in text and "l_tax" not in text
    assert "l_shipdate" not in text


@pytest.mark.parametrize("name", ["knn_cosine_topk", "retrieved_block", "attempt_history"])
def test_top_k_is_cut_before_the_shuffle(plan, name):
    tree = plan(name).split("\n\n")[0]
    steps = re.findall(r"WindowGroupLimit|Exchange", tree[tree.index("WindowGroupLimit") :])
    assert steps[:3] == ["WindowGroupLimit", "Exchange", "WindowGroupLimit"]


def test_profile_scans_once(plan):
    assert scans(plan("column_profile_orders")) == 1


def test_usage_scans_once(plan):
    assert scans(plan("usage_rollup")) == 1


@pytest.mark.parametrize("name", ["load_reconcile", "load_differences", "progress_latest", "usage_periods"])
def test_no_join_and_a_partial_step(plan, name):
    text = plan(name)
    assert "Join" not in text
    assert "partial_" in text


def test_points_are_parsed_once(plan):
    text = plan("coord_bbox")
    assert "Generate" in text and text.count("RLIKE") <= 8


@pytest.mark.parametrize("name", ["no_data_filter", "sentence_cut", "line_clean", "feature_names", "coord_bbox"])
def test_no_python(plan, name):
    text = plan(name)
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
