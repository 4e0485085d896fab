"""Plan-shape guards for the scale design (what Catalyst must keep doing)."""

from lookout.plans import catalog as C

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_debounce_has_no_window_and_pre_aggregates(spark):
    p = plan(C.QUERIES["debounce_events"](spark, SF_SMALL))
    assert "Window" not in p
    assert "partial_max_by" in p and "partial_min" in p
    assert p.count("FileScan") == 1 and p.count("Exchange") == 1 and "Join" not in p


def test_debounce_sorts_what_a_shuffle_dealt_not_a_whole_split(spark):
    for name in ("debounce_events", "debounce_null_sessions"):
        above, below = plan(C.QUERIES[name](spark, SF_SMALL)).split("Exchange")
        assert "SortAggregate" in above and "Sort" not in below and "Aggregate" not in below, name


def test_debounced_search_reads_the_events_once(spark):
    p = plan(C.QUERIES["debounce_search_repeated_ids"](spark, SF_SMALL))
    assert "events.parquet" not in p  # they were read for the checkpoint of the queries


def test_viewport_without_limit_does_not_sort(spark):
    assert "Exchange" not in plan(C.QUERIES["viewport"](spark, SF_SMALL))


def test_single_search_prunes_and_takes_top_k(spark):
    p = plan(C.QUERIES["search_basic"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    read = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "p_size" not in read and "p_retailprice" not in read


def test_multi_part_pattern_is_a_locate_chain(spark):
    p = plan(C.QUERIES["search_documents"](spark, SF_SMALL))
    assert "locate(" in p and " LIKE " not in p


def test_batch_paths_never_cross_join(spark):
    for name in ("batch_search", "batch_search_blocked", "batch_geocode", "batch_search_documents"):
        p = plan(C.QUERIES[name](spark, SF_SMALL))
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name
        assert "WindowGroupLimit" in p, name


def test_geometry_is_a_narrow_projection(spark):
    p = plan(C.QUERIES["centroid"](spark, SF_SMALL))
    assert "Exchange" not in p
