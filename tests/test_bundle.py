"""Every rule of the bundle's tables once."""

import pytest

from lodestar.sources import bundle as b

PERIODS = {"calibration": b.Period("2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", (1, 2, 3)), "test": b.Period("2026-01-03T00:00:00+01:00", "2026-01-04T00:00:00Z", (1, 2, 4))}
RULES = {"visit": b.OperationRule(("ok", "made"), ("fast",)), "list": b.OperationRule(("ok",))}
GOOD = dict(request_id="r", trace_id="", started_at="2026-01-01T10:00:00Z", completed_at="2026-01-01T10:00:01.5+00:00", period="calibration", operation_class="visit", branch_class="", outcome="ok", success="yes", timed_out="0")
REQUESTS = [
    ({}, None), (dict(trace_id="AB" * 16, branch_class="fast", outcome="made"), None), (dict(trace_id="cd" * 8, success="false", outcome="what", timed_out="TRUE"), None), (dict(request_id="twin"), "repeated_request"), (dict(request_id="twin"), "repeated_request"),
    (dict(trace_id="ee" * 8), "repeated_trace"), (dict(trace_id="EE" * 8), "repeated_trace"), (dict(period="rest"), "unknown_period"), (dict(operation_class="buy"), "unknown_operation"), (dict(started_at="2026-01-01T10:00:00"), "no_time"), (dict(completed_at=""), "no_time"),
    (dict(completed_at="2026-01-01T09:00:00Z"), "outside_period"), (dict(period="test"), "outside_period"), (dict(completed_at="2026-01-02T00:00:01Z"), "outside_period"), (dict(success="maybe"), "no_boolean"), (dict(timed_out="1"), "successful_timeout"),
    (dict(operation_class="list", outcome="made"), "outcome_not_accepted"), (dict(branch_class="slow"), "undeclared_branch"), (dict(operation_class="list", branch_class="fast"), "undeclared_branch"), (dict(trace_id="xyz"), "no_trace_id"), (dict(trace_id="ab" * 5), "no_trace_id"),
]


def write(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *[",".join(str(r.get(c, "")) for c in columns) for r in rows]]) + "\n")
    return str(path)


def test_requests(spark, tmp_path):
    rows = [GOOD | dict(request_id=f"r{i}") | change | dict(extra=i) for i, (change, _) in enumerate(REQUESTS)]
    got = {int(r["extra"]): r for r in b.load_requests(spark, write(tmp_path / "r.csv", [*b.COLUMNS["requests"], "extra"], rows), PERIODS, RULES).collect()}
    assert {i: r["problem"] for i, r in got.items()} == {i: p for i, (_, p) in enumerate(REQUESTS)}
    assert (got[0]["trace_id"], got[1]["trace_id"], got[0]["success"], got[2]["timed_out"]) == (None, "ab" * 16, True, True) and (got[0]["completed_at"] - got[0]["started_at"]).total_seconds() == 1.5
    with pytest.raises(ValueError, match="requests"):
        b.sound(b.load_requests(spark, str(tmp_path / "r.csv"), PERIODS, RULES), "requests")
    assert "problem" not in b.sound(b.load_requests(spark, write(tmp_path / "s.csv", b.COLUMNS["requests"], [GOOD]), PERIODS, RULES), "requests").columns
    with pytest.raises(ValueError, match="outcome"):
        b.load_requests(spark, write(tmp_path / "t.csv", [c for c in b.COLUMNS["requests"] if c != "outcome"], [GOOD]), PERIODS, RULES)


@pytest.mark.parametrize("change", [dict(test=b.Period("2026-01-01T12:00:00Z", "2026-01-04T00:00:00Z", (9, 9, 9))), dict(test=b.Period("2026-01-03T00:00:00Z", "2026-01-04T00:00:00Z", (1, 2, 3))), dict(test=b.Period("2026-01-04T00:00:00Z", "2026-01-04T00:00:00Z", (9, 9, 9))), dict(more=PERIODS["test"])])
def test_periods(spark, change):
    b.check_periods(spark, PERIODS)
    with pytest.raises(ValueError):
        b.check_periods(spark, PERIODS | change)


TABLES = {
    "deployments": (b.load_deployments, dict(instance_id="i", service="s", version="1", valid_from="2026-01-01T00:00:00Z", valid_to="", domain_id="d", routing_policy="rr"),
                    [({}, None), (dict(valid_to="2026-01-02T00:00:00Z"), None), (dict(valid_to="2026-01-01T00:00:00Z"), "reversed"), (dict(valid_from="soon"), "no_time"), (dict(valid_to="later"), "no_time"), (dict(domain_id=""), "no_identity")]),
    "health": (b.load_health, dict(timestamp="2026-01-01T00:00:00Z", instance_id="i", signal="liveness", state="up", source="x"), [({}, None), (dict(signal="mood"), "unknown_signal"), (dict(state="UP"), "unknown_state"), (dict(timestamp="2026-01-01"), "no_time")]),
    "mesh": (b.load_mesh, dict(timestamp="2026-01-01T00:00:00Z", request_id="q", source_instance="i", target_service="s", logical_call_id="c", attempt="1", outcome="ok"),
             [({}, None), (dict(attempt="2"), None), (dict(attempt="3"), "repeated_attempt"), (dict(attempt="+3"), "repeated_attempt"), (dict(attempt="0"), "no_attempt"), (dict(attempt="x"), "no_attempt"), (dict(timestamp="", request_id="p"), "no_time")]),
    "injections": (b.load_injections, dict(intent_at="2026-01-01T00:00:00Z", applied_at="2026-01-01T00:00:01Z", verified_start="2026-01-01T00:00:02Z", verified_end="2026-01-01T00:00:03Z", scope="s", mechanism="m", confirmed="yes"),
                   [(dict(incident_id="1"), None), (dict(incident_id="2", verified_end="2026-01-01T00:00:02Z"), "reversed"), (dict(incident_id="3", applied_at=""), "no_time"), (dict(incident_id="4", confirmed="so"), "no_boolean"), (dict(incident_id="5"), "repeated_incident"), (dict(incident_id="5"), "repeated_incident")]),
}


@pytest.mark.parametrize("table", sorted(TABLES))
def test_tables(spark, tmp_path, table):
    load, good, cases = TABLES[table]
    rows = load(spark, write(tmp_path / "t.csv", [*b.COLUMNS[table], "extra"], [good | change | dict(extra=i) for i, (change, _) in enumerate(cases)]))
    assert {int(r["extra"]): r["problem"] for r in rows.collect()} == {i: p for i, (_, p) in enumerate(cases)}
    assert sum(r["n"] for r in b.problems(rows, table).collect()) == sum(p is not None for _, p in cases)
