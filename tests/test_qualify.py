"""Health ticks and boundary counters by hand: one clean cell, and one with every kind of fault."""

from lodestar.operators import qualify

HEALTH = "cell string, period string, observed_at int, role string, replica string, error string, seq int, value double"


def test_health_ticks(spark):
    rows = [("c", "p", 1, "proxy", None, None, 1, 1.0), ("c", "p", 1, "replica", "a", "", 2, 2.0), ("c", "p", 1, "replica", "a", None, 3, 9.0), ("c", "p", 1, "replica", "z", None, 4, 9.0),
            ("c", "p", 2, "proxy", None, "down", 5, 9.0), ("c", "p", 2, "replica", "a", None, 6, 3.0), ("c", "p", 2, "replica", "b", None, 7, 4.0), ("c", "p", 2, "other", None, None, 8, 9.0)]
    wide, faults = qualify.health_ticks(spark.createDataFrame(rows, HEALTH), "cell", ["value"])
    got = {r["observed_at"]: (r["proxy_observed"], r["proxy_value"], r["replica_a_value"], r["replica_b_observed"], r["replica_b_value"]) for r in wide.collect()}
    assert got == {1: (True, 1.0, 2.0, False, None), 2: (False, None, 3.0, True, 4.0)}
    # A second row of a role, a replica of no name, a row with an error and one of no role; and two roles without a row.
    assert [tuple(r) for r in faults.collect()] == [("c", "p", 6, 2)]


def cell(name, **more):
    base = dict(cell=name, source_ok=True, labels_off=0, usable_source=True, files_missing=0, privileged_copied=0, expected_learner=2, expected_auxiliary=1, expected_test=1) | more
    return tuple(base.values())


def test_boundary_quality(spark):
    cells = spark.createDataFrame([cell("good"), cell("bad", source_ok=False, labels_off=2, usable_source=False, files_missing=1, privileged_copied=3, expected_learner=9), cell("empty", expected_learner=0, expected_auxiliary=0, expected_test=0)],
                                  "cell string, source_ok boolean, labels_off int, usable_source boolean, files_missing int, privileged_copied int, expected_learner int, expected_auxiliary int, expected_test int")
    requests = [("good", "cal", 1, "t1", True), ("good", "cal", 2, "t2", False), ("good", "aux", 3, "t3", True), ("good", "test", 4, "t4", True),
                ("bad", "cal", 1, "u1", True), ("bad", "cal", 1, "u1", True), ("bad", "cal", 2, "u2", True), ("bad", "test", 2, "u2", True), ("bad", "test", 5, "u5", True)]
    joins = [("good", "cal", 1, True), ("good", "cal", 2, True), ("good", "aux", 3, False), ("bad", "cal", 2, True), ("bad", "cal", 7, True)]
    traces = [("good", "t1", 3, ["a", "b"]), ("good", "t2", 2, ["b"]), ("bad", "u1", 1, ["a"])]
    scans = [("good", 0, 0, 0), ("bad", 4, 5, 6)]
    edges, health = [("good", "x")], [("good", "cal", 0, 5), ("good", "test", 0, 5), ("bad", "cal", 3, 5), ("bad", "test", 2, 5)]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in (
        (requests, "cell string, period string, request_id int, trace_id string, success boolean"), (joins, "cell string, period string, request_id int, trace_present boolean"), (traces, "cell string, trace_id string, span_count int, replicas array<string>"),
        (scans, "cell string, invalid_records int, duplicate_spans int, unknown_replicas int"), (edges, "cell string, source string"), (health, "cell string, period string, malformed long, ticks long"))]
    limits = qualify.Boundary("cal", ("aux",), least_linked=0.9, least_assignments=1, denied=("outcome",))
    got = {r["cell"]: r.asDict() for r in qualify.boundary_quality(cells, *frames, "cell", limits, [frames[0]]).collect()}
    good, bad, empty = got["good"], got["bad"], got["empty"]
    assert good["usable"] and not any(v for k, v in good.items() if k not in ("cell", "usable")) and len(good) == 24
    assert not bad["usable"] and {k: v for k, v in bad.items() if k not in ("cell", "usable")} == dict(
        source_mismatches=1, source_label_mismatches=2, source_unusable=1, missing_source_files=1, learner_count_mismatches=1, auxiliary_count_mismatches=1, test_count_mismatches=1, duplicate_request_ids=1, learner_test_overlap=1, trace_join_mismatches=2,
        linked_traces_without_spans=1, invalid_trace_records=4, duplicate_trace_spans=5, unknown_target_instances=6, link_share_below_minimum=1, missing_topology_edges=1, replicas_below_minimum=1, malformed_health=3, missing_test_health=0, malformed_test_health=2,
        denied_learner_fields=0, privileged_files_copied=3)
    assert {k for k, v in empty.items() if v and k != "cell"} == {"link_share_below_minimum", "missing_topology_edges", "replicas_below_minimum", "missing_test_health"}


def test_denied_columns_are_found_in_nested_fields(spark):
    frame = spark.createDataFrame([], "id int, Semantic_Success boolean, m array<struct<x int, deep struct<true_outcome string>>>")
    assert qualify.denied_columns([frame], ("success", "outcome")) == ["Semantic_Success", "true_outcome"]
