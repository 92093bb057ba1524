"""Queries over the driver's tables and the SQL that each is checked against.

The tables stand in for telemetry: an order is an external request (operation = priority, campaign =
customer), a line item is a call in its trace, and events are the ticks of a user's health.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.expr import micros, stable_uniform, tri
from lodestar.functions.workers import reachable
from lodestar.operators import evidence, graph, identify, law, masking, paths, scoring, sequence, stats, timejoin, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = reachable(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signals(spark, d) -> DataFrame:
    """Calls with three signals: a and b from status codes, c from discount and tax."""
    calls = _table(spark, d, "lineitem").join(_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = F.when(F.col("l_tax") > 0.06, None).otherwise(F.col("l_discount") > 0.05)
    return calls.select("l_orderkey", F.col("o_orderpriority").alias("operation"), tri("l_returnflag", "A", "R").alias("a"), tri("o_orderstatus", "F", "O").alias("b"), c.alias("c"))


_SIGNALS = """sig AS (SELECT l_orderkey, o_orderpriority AS operation, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS a,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS b, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_discount > 0.05 END AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _ticks(spark, d) -> DataFrame:
    """Health ticks of a user: error is down, signup unknown, anything else up."""
    e = _table(spark, d, "events")
    state = F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "signup", None).otherwise(True)
    return e.select(F.col("event_id").alias("id"), "user_id", "event_type", "value", micros("ts").alias("t"), state.alias("state"))


_TICKS = """ticks AS (SELECT event_id AS id, user_id, event_type, value, epoch_us(ts) AS t,
  CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN NULL ELSE true END AS state FROM events)"""


def _calls(spark, d) -> DataFrame:
    """Calls without repeats of (order, line): the row that is first in a total order stays."""
    rows = graph.keep_first(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus").repartition("l_orderkey"), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"])
    return rows.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), (F.col("l_linenumber") - 1).alias("parent_id"), F.col("l_suppkey").alias("service"), micros("l_shipdate").alias("t"), "l_quantity", "l_returnflag")


_CALLS = """calls AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, l_linenumber - 1 AS parent_id, l_suppkey AS service, epoch_us(l_shipdate) AS t, l_quantity, l_returnflag FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1)"""


def _r(column: str | Column, digits: int = 8) -> Column:
    return F.round(column if isinstance(column, Column) else F.col(column), digits)


# Joint laws and bounds


@query(f"""WITH {_SIGNALS} SELECT operation, count(*) AS n, count(*) FILTER (WHERE a AND b) AS lower_count,
  count(*) FILTER (WHERE (a AND b) IS DISTINCT FROM false) AS upper_count FROM sig GROUP BY operation""")
def kleene_bounds(spark, d):
    return law.conjunctive_bounds(law.category_law(_signals(spark, d), ["operation"], ["a", "b"]), ["operation"], ["a", "b"])


@query(f"WITH {_SIGNALS} SELECT operation, a, b, c, count(*) AS cnt FROM sig GROUP BY ALL")
def category_law(spark, d):
    return law.category_law(_signals(spark, d), ["operation"], ["a", "b", "c"])


@query(f"WITH {_SIGNALS} SELECT a, (b AND c) AS completed, count(*) AS cnt FROM sig GROUP BY ALL")
def projected_law(spark, d):
    full = law.category_law(_signals(spark, d), ["operation"], ["a", "b", "c"])
    return law.category_law(full.withColumn("completed", F.col("b") & F.col("c")), [], ["a", "completed"], F.col("cnt"))


@query(f"""WITH {_SIGNALS} SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE NOT a) > 0 THEN false WHEN count(a) = count(*) THEN true END AS conjunction, count(*) AS n
  FROM sig GROUP BY l_orderkey""")
def group_conjunction(spark, d):
    return law.group_conjunction(_signals(spark, d), ["l_orderkey"], "a")


_STATES = """states AS (SELECT (i & 1) = 1 AS x, (i & 2) = 2 AS y, (i & 4) = 4 AS z FROM range(8) t(i)),
  l AS (SELECT operation, a, b, c, count(*) AS cnt FROM sig GROUP BY ALL),
  f AS (SELECT l.*, x, y, z FROM l JOIN states ON (a IS NULL OR a = x) AND (b IS NULL OR b = y) AND (c IS NULL OR c = z))"""


@query(f"""WITH {_SIGNALS}, {_STATES}, p AS (SELECT operation, a, b, c, cnt, min(((x OR y) AND z)::INT) AS lo, max(((x OR y) AND z)::INT) AS hi FROM f GROUP BY ALL)
  SELECT operation, sum(cnt)::BIGINT AS n, sum(cnt * lo)::BIGINT AS execution_lower, sum(cnt * hi)::BIGINT AS execution_upper FROM p GROUP BY operation""")
def fiber_bounds_enum(spark, d):
    joint = law.category_law(_signals(spark, d), ["operation"], ["a", "b", "c"])
    return law.sharp_bounds(joint, ["operation"], ["a", "b", "c"], {"execution": lambda a, b, c: (a | b) & c})


@query(f"""WITH {_SIGNALS}, {_STATES}, g AS (SELECT *, ((x OR y) AND z)::INT AS e, (x AND y AND z)::INT AS r FROM f),
  p AS (SELECT operation, a, b, c, cnt, min(e) AS e0, max(e) AS e1, min(r) AS r0, max(r) AS r1, min(r - e) AS d0, max(r - e) AS d1 FROM g GROUP BY ALL)
  SELECT operation, sum(cnt)::BIGINT AS n, sum(cnt*e0)::BIGINT AS e_lower, sum(cnt*e1)::BIGINT AS e_upper, sum(cnt*r0)::BIGINT AS r_lower, sum(cnt*r1)::BIGINT AS r_upper,
  sum(cnt*d0)::BIGINT AS gap_lower, sum(cnt*d1)::BIGINT AS gap_upper FROM p GROUP BY operation""")
def joint_gap_bounds(spark, d):
    joint = law.category_law(_signals(spark, d), ["operation"], ["a", "b", "c"])
    e, r = (lambda a, b, c: (a | b) & c), (lambda a, b, c: a & b & c)
    return law.sharp_bounds(joint, ["operation"], ["a", "b", "c"], {"e": e, "r": r, "gap": lambda a, b, c: r(a, b, c).cast("int") - e(a, b, c).cast("int")})


_RATES = "q AS (SELECT count(*) FILTER (WHERE a) / count(a)::DOUBLE AS pa, count(*) FILTER (WHERE b) / count(b)::DOUBLE AS pb, count(*) FILTER (WHERE c) / count(c)::DOUBLE AS pc FROM sig)"


@query(f"""WITH {_SIGNALS}, {_RATES}, s AS (SELECT (i & 1) = 1 AS x, (i & 2) = 2 AS y, (i & 4) = 4 AS z FROM range(8) t(i))
  SELECT round(sum(CASE WHEN (x AND z) OR (y AND z) THEN (CASE WHEN x THEN pa ELSE 1-pa END)*(CASE WHEN y THEN pb ELSE 1-pb END)*(CASE WHEN z THEN pc ELSE 1-pc END) ELSE 0 END), 8) AS probability FROM s, q""")
def dnf_probability(spark, d):
    p = _signals(spark, d).agg(*[F.avg(F.col(x).cast("int")).alias(x) for x in "abc"]).first()
    states = law.state_table(spark, ["a", "b", "c"])
    return law.dnf_probability(states, {x: p[x] for x in "abc"}, [["a", "c"], ["b", "c"]]).select(_r("probability").alias("probability"))


@query("""WITH f AS (SELECT n_regionkey AS family, count(*) AS size, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
  k AS (SELECT family, greatest(round_even(4 * p, 0)::INT, (p > 0)::INT) AS kk FROM f), s AS (SELECT i, bit_count(i::INT)::INT AS ones, ((i & 3) > 0 AND (i & 12) > 0)::INT AS ok FROM range(16) t(i))
  SELECT family, kk AS failures, round(avg(1.0 - ok), 8) AS failure_share FROM k JOIN s ON ones = kk GROUP BY ALL""")
def fixed_count_law(spark, d):
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = o.groupBy(F.col("n_regionkey").alias("family")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p")).select("family", F.greatest(F.bround(4 * F.col("p"), 0).cast("int"), (F.col("p") > 0).cast("int")).alias("failures"))
    states = law.state_table(spark, ["s0", "s1", "s2", "s3"]).withColumn("ones", F.bit_count("id").cast("int"))
    ok = (F.col("s0") | F.col("s1")) & (F.col("s2") | F.col("s3"))
    return k.join(F.broadcast(states), F.col("failures") == F.col("ones")).groupBy("family", "failures").agg(_r(F.avg(1.0 - ok.cast("double"))).alias("failure_share"))


@query("""WITH g AS (SELECT DISTINCT o_orderpriority AS operation FROM orders UNION SELECT '0-NEVER'), s AS (SELECT o_orderpriority AS operation, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS s FROM orders GROUP BY 1)
  SELECT g.operation, coalesce(n, 0) AS attempts, coalesce(s, 0) AS successes, round(s / n::DOUBLE, 8) AS probability, CASE WHEN n IS NULL THEN 'unsupported' ELSE 'supported' END AS status FROM g LEFT JOIN s USING (operation)""")
def frequency_baseline(spark, d):
    o = _table(spark, d, "orders")
    seen = o.groupBy(F.col("o_orderpriority").alias("operation")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"))
    grid = o.select(F.col("o_orderpriority").alias("operation")).distinct().unionByName(spark.sql("SELECT '0-NEVER' AS operation"))
    return grid.join(seen, "operation", "left").select("operation", F.coalesce("n", F.lit(0)).alias("attempts"), F.coalesce("s", F.lit(0)).alias("successes"), _r(F.col("s") / F.col("n")).alias("probability"), F.when(F.col("n").isNull(), "unsupported").otherwise("supported").alias("status"))


# Joins in time

_AB = f"{_TICKS}, a AS (SELECT * FROM ticks WHERE event_type = 'purchase'), p AS (SELECT * FROM ticks WHERE event_type IN ('error', 'signup'))"


def _asks(spark, d):
    t = _ticks(spark, d)
    return t.filter("event_type = 'purchase'"), t.filter("event_type IN ('error', 'signup')")


@query(f"""WITH {_AB}, j AS (SELECT a.id, a.user_id, a.t, p.t AS pt, p.state FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t >= p.t)
  SELECT id, user_id, t, CASE WHEN t - pt <= {2 * DAY} THEN pt END AS probe_t, CASE WHEN t - pt <= {2 * DAY} THEN state END AS state FROM j""")
def asof_backward_age(spark, d):
    return timejoin.asof_backward(*_asks(spark, d), "user_id", "state", 2 * DAY)


@query(f"""WITH {_AB}, b AS (SELECT a.id, a.user_id, a.t, p.t AS bt, p.state AS bs FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t >= p.t),
  f AS (SELECT a.id, p.t AS ft, p.state AS fs FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t <= p.t)
  SELECT id, user_id, t, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t < t - bt) THEN ft ELSE bt END AS probe_t, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t < t - bt) THEN fs ELSE bs END AS state FROM b JOIN f USING (id)""")
def asof_nearest(spark, d):
    return timejoin.asof_nearest(*_asks(spark, d), "user_id", "state")


@query(f"""WITH {_AB} SELECT a.user_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = a.user_id AND p.t BETWEEN a.t - {6 * HOUR} AND a.t + {6 * HOUR})) AS guarded FROM a GROUP BY a.user_id""")
def guard_band(spark, d):
    near = timejoin.asof_nearest(*_asks(spark, d), "user_id", "state")
    return near.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("t") - F.col("probe_t")) <= 6 * HOUR).alias("guarded"))


@query(f"""WITH {_TICKS}, a AS (SELECT id, user_id, t FROM ticks WHERE event_type = 'purchase'), j AS (SELECT a.id, k.t AS kt, k.state, k.t - lag(k.t) OVER (PARTITION BY a.id ORDER BY k.t) AS gap FROM a LEFT JOIN ticks k ON k.user_id = a.user_id AND k.t BETWEEN a.t - {12 * HOUR} AND a.t + {12 * HOUR}),
  g AS (SELECT id, count(kt) AS n_ticks, count(*) FILTER (WHERE kt IS NOT NULL AND state IS NULL) AS unknown, max(gap) AS gap, count(DISTINCT state) AS kinds FROM j GROUP BY id)
  SELECT id, n_ticks, CASE WHEN n_ticks = 0 THEN 'uncovered' WHEN unknown > 0 THEN 'unknown' WHEN gap > {8 * HOUR} THEN 'gap' WHEN kinds > 1 THEN 'changed' ELSE 'stable' END AS reason FROM g""")
def interval_homogeneous(spark, d):
    t = _ticks(spark, d)
    return timejoin.interval_homogeneous(t.filter("event_type = 'purchase'").select("id", "user_id", "t"), t.select("user_id", "t", "state"), "user_id", 12 * HOUR, 8 * HOUR)


@query(f"""WITH {_TICKS}, a AS (SELECT * FROM ticks WHERE event_type = 'purchase'), p AS (SELECT user_id, t FROM ticks WHERE event_type = 'error' AND value > 20)
  SELECT a.id, p.t - a.t AS "offset" FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t <= p.t""")
def first_match_after(spark, d):
    t = _ticks(spark, d)
    return timejoin.first_match_after(t.filter("event_type = 'purchase'"), t, "user_id", F.expr("event_type = 'error' AND value > 20"))


@query(f"""WITH {_TICKS}, v AS (SELECT user_id, t AS valid_from, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS valid_to FROM ticks WHERE event_type = 'click'), p AS (SELECT id, user_id, t FROM ticks WHERE event_type <> 'click')
  SELECT p.id, count(valid_from) AS n_active FROM p LEFT JOIN v ON p.user_id = v.user_id AND p.t >= valid_from AND (valid_to IS NULL OR p.t < valid_to) GROUP BY p.id""")
def point_in_interval(spark, d):
    from pyspark.sql import Window

    t = _ticks(spark, d)
    spans = t.filter("event_type = 'click'").select("user_id", F.col("t").alias("valid_from"), F.lead("t").over(Window.partitionBy("user_id").orderBy("t")).alias("valid_to"))
    return timejoin.point_in_interval(t.filter("event_type <> 'click'").select("id", "user_id", "t"), spans, ["user_id"])


# Ordered ticks


@query(f"WITH {_TICKS}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM ticks) SELECT user_id, max(gap) AS max_gap, count(*) FILTER (WHERE gap > {12 * HOUR}) AS stale_gaps FROM g GROUP BY user_id")
def health_gaps(spark, d):
    return sequence.gaps(_ticks(spark, d), "user_id", 12 * HOUR)


@query(f"""WITH {_TICKS}, w AS (SELECT user_id, t, state, lag(state) OVER (PARTITION BY user_id ORDER BY t) AS before, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM ticks)
  SELECT user_id, t, CASE WHEN before AND NOT state THEN 'degradation' WHEN NOT before AND state THEN 'recovery' ELSE 'other' END AS direction FROM w WHERE k > 1 AND state IS DISTINCT FROM before""")
def transitions(spark, d):
    return sequence.transitions(_ticks(spark, d), "user_id")


@query(f"""WITH {_TICKS}, w AS (SELECT *, row_number() OVER o > 1 AND state IS DISTINCT FROM lag(state) OVER o AS changed, lag(t) OVER o AS prior FROM ticks WINDOW o AS (PARTITION BY user_id ORDER BY t)),
  e AS (SELECT *, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY t) AS episode FROM w), f AS (SELECT *, first_value(t) OVER i AS start, first_value(prior) OVER i AS pre FROM e WINDOW i AS (PARTITION BY user_id, episode ORDER BY t))
  SELECT user_id, t, episode::BIGINT AS episode, pre IS NULL AS left_censored, t - start AS age_lower, t - pre AS age_upper FROM f""")
def episodes_age(spark, d):
    return sequence.episodes(_ticks(spark, d), "user_id")


@query(f"""WITH {_TICKS}, b AS (SELECT user_id, (t - min(t) OVER (PARTITION BY user_id)) // {3 * DAY} AS block, value FROM ticks), m AS (SELECT user_id, block, avg(value) AS m FROM b GROUP BY ALL)
  SELECT user_id, count(*) AS blocks, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS deviation FROM m GROUP BY user_id""")
def block_means(spark, d):
    m = sequence.block_means(_ticks(spark, d), "user_id", 3 * DAY, "value")
    return m.select("user_id", "blocks", _r("mean", 6).alias("mean"), _r("deviation", 6).alias("deviation"))


_BINS = f"""{_TICKS}, m AS (SELECT t // {HOUR} AS bin, avg(value) AS m FROM ticks WHERE event_type = 'error' GROUP BY 1), g AS (SELECT unnest(range((SELECT min(bin) FROM m), (SELECT max(bin) FROM m) + 1)) AS bin)"""


@query(f"WITH {_BINS} SELECT bin, round(coalesce(m, 0), 6) AS zero_filled FROM g LEFT JOIN m USING (bin)")
def second_bins_zero_fill(spark, d):
    return sequence.binned(_ticks(spark, d).filter("event_type = 'error'"), HOUR, "value").select("bin", _r("zero_filled", 6).alias("zero_filled"))


@query(f"WITH {_BINS} SELECT bin, round(last_value(m IGNORE NULLS) OVER (ORDER BY bin), 6) AS carried FROM g LEFT JOIN m USING (bin)")
def forward_fill(spark, d):
    return sequence.binned(_ticks(spark, d).filter("event_type = 'error'"), HOUR, "value").select("bin", _r("carried", 6).alias("carried"))


def _intervals(spark, d):
    return _calls(spark, d).select("trace_id", F.col("t").alias("start"), (F.col("t") + F.col("l_quantity").cast("long") * DAY).alias("stop"))


_INTERVALS = f"{_CALLS}, v AS (SELECT trace_id, t AS start, t + l_quantity::BIGINT * {DAY} AS stop FROM calls)"


@query(f"""WITH {_INTERVALS}, w AS (SELECT *, max(stop) OVER (PARTITION BY trace_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)
  SELECT trace_id, sum(greatest(stop - greatest(start, coalesce(reach, start)), 0))::BIGINT AS covered, sum(stop - start)::BIGINT AS total FROM w GROUP BY trace_id""")
def interval_union(spark, d):
    return sequence.interval_union(_intervals(spark, d), "trace_id")


@query(f"""WITH {_INTERVALS}, m AS (SELECT trace_id, start AS t, 1 AS d FROM v UNION ALL SELECT trace_id, stop, -1 FROM v), r AS (SELECT trace_id, sum(d) OVER (PARTITION BY trace_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS active FROM m)
  SELECT trace_id, max(active)::BIGINT AS most_active FROM r GROUP BY trace_id""")
def active_causes(spark, d):
    return sequence.active_causes(_intervals(spark, d), "trace_id")


@query(f"WITH {_TICKS}, p AS (SELECT user_id, value AS x, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS y FROM ticks) SELECT user_id, count(*) AS pairs, round(corr(x, y), 6) AS r FROM p WHERE y IS NOT NULL GROUP BY user_id")
def autocorrelation(spark, d):
    return sequence.autocorrelation(_ticks(spark, d), "user_id", "value").select("user_id", "pairs", _r("r", 6).alias("r"))


@query("""WITH p AS (SELECT n_regionkey AS family, n_nationkey AS test, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE ((n_nationkey * 37) % 101) / 1000.0::DOUBLE END AS p FROM nation),
  k AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p AS step FROM p WHERE p IS NOT NULL)
  SELECT family, test, p, round(least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 8) AS adjusted FROM k UNION ALL SELECT family, test, p, NULL FROM p WHERE p IS NULL""")
def holm_adjust(spark, d):
    p = F.when(F.col("n_nationkey") % 7 == 0, None).otherwise(((F.col("n_nationkey") * 37) % 101) / F.lit(1000.0))
    rows = _table(spark, d, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), p.alias("p"))
    return sequence.holm(rows, ["family"], "p", "test").withColumn("adjusted", _r("adjusted"))


# Graphs


@query(f"WITH {_CALLS} SELECT p.service AS source, c.service AS target, count(*) AS spans, count(DISTINCT c.trace_id) AS traces FROM calls c JOIN calls p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE p.service <> c.service GROUP BY ALL")
def topology_edges(spark, d):
    return graph.topology_edges(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT trace_id, count(*) AS span_count, string_agg(DISTINCT service::VARCHAR, ';' ORDER BY service::VARCHAR) AS services, count(DISTINCT service) AS n_services FROM calls GROUP BY trace_id")
def trace_features(spark, d):
    return graph.trace_features(_calls(spark, d).withColumn("service", F.col("service").cast("string")))


@query(f"""WITH RECURSIVE {_CALLS}, up AS (SELECT trace_id, span_id, parent_id AS pos FROM calls WHERE l_returnflag <> 'N' UNION ALL
  SELECT up.trace_id, up.span_id, c.parent_id AS pos FROM up JOIN calls c ON c.trace_id = up.trace_id AND c.span_id = up.pos WHERE c.l_returnflag = 'N'), ends AS (SELECT trace_id, span_id, min(pos) AS pos FROM up GROUP BY ALL)
  SELECT l.trace_id, l.span_id, c.span_id AS ancestor FROM ends l LEFT JOIN calls c ON c.trace_id = l.trace_id AND c.span_id = l.pos""")
def parent_contraction(spark, d):
    return graph.nearest_selected_ancestor(_calls(spark, d).withColumn("selected", F.col("l_returnflag") != "N"))


def _nation_edges(spark, d):
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = o.select((F.col("c_nationkey") % 25).alias("a"), (F.col("o_orderkey") % 25).cast("int").alias("b"))
    return pairs.groupBy("a", "b").count().filter("a <> b AND (a + b) % 5 = 1").select("a", "b")


_NATION_EDGES = """e AS (SELECT c_nationkey % 25 AS a, (o_orderkey % 25)::INT AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING a <> b AND (a + b) % 5 = 1),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@query(f"WITH RECURSIVE {_NATION_EDGES} SELECT a, b FROM r")
def reachability(spark, d):
    return graph.closure(_nation_edges(spark, d))


@query(f"WITH RECURSIVE {_NATION_EDGES} SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
def scc_pairs(spark, d):
    return paths.cycle_components(_nation_edges(spark, d))


@query(f"""WITH {_CALLS}, w AS (SELECT trace_id, string_agg(service % 5, ',' ORDER BY t, span_id) AS word FROM calls GROUP BY trace_id) SELECT word, count(*) AS traces FROM w GROUP BY word""")
def route_words(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("t", "span_id", (F.col("service") % 5).cast("string").alias("label"))))
    words = _calls(spark, d).groupBy("trace_id").agg(F.array_join(F.transform(steps, lambda s: s["label"]), ",").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("traces"))


@query(f"""WITH {_TICKS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, t // {DAY}, event_type ORDER BY t) AS n FROM ticks), p AS (SELECT user_id, t // {DAY} AS tick, event_type, value FROM k WHERE n = 1)
  SELECT user_id, tick, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'error') AS error, max(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM p WHERE event_type IN ('click', 'error', 'purchase') GROUP BY ALL""")
def health_pivot(spark, d):
    rows = _ticks(spark, d).withColumn("tick", F.floor(F.col("t") / DAY)).filter("event_type IN ('click', 'error', 'purchase')")
    first = graph.keep_first(rows, ["user_id", "tick", "event_type"], ["t"])
    return first.groupBy("user_id", "tick").pivot("event_type", ["click", "error", "purchase"]).agg(F.first("value"))


@query(f"""WITH {_CALLS}, f AS (SELECT o_orderkey, o_orderpriority AS operation, o_orderstatus, count(span_id) AS calls, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN calls ON o_orderkey = trace_id GROUP BY ALL),
  x AS (SELECT *, 'all' AS view FROM f UNION ALL SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failure' END FROM f UNION ALL SELECT *, 'untraced' FROM f WHERE calls = 0)
  SELECT operation, view, count(*) AS requests, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, round(sum(quantity), 4) AS quantity FROM x GROUP BY ALL""")
def request_census(spark, d):
    calls = _calls(spark, d).groupBy("trace_id").agg(F.count("*").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.sum("l_quantity").alias("quantity"))
    facts = _table(spark, d, "orders").join(calls, F.col("o_orderkey") == F.col("trace_id"), "left")
    views = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure"), F.when(F.col("calls").isNull(), "untraced")))
    return facts.select(F.col("o_orderpriority").alias("operation"), F.explode(views).alias("view"), "calls", "errors", "quantity").groupBy("operation", "view").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), _r(F.coalesce(F.sum("quantity"), F.lit(0.0)), 4).alias("quantity"))


@query("SELECT o_orderpriority AS operation, o_orderstatus AS class, min(o_orderkey) AS exemplar, arg_min(o_totalprice, o_orderkey) AS price, count(*) AS n FROM orders GROUP BY ALL")
def exemplar_per_class(spark, d):
    return _table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("operation"), F.col("o_orderstatus").alias("class")).agg(F.min("o_orderkey").alias("exemplar"), F.min_by("o_totalprice", "o_orderkey").alias("price"), F.count("*").alias("n"))


# Masks


_UNIFORM = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(f"SELECT o_orderkey, round({_UNIFORM.format("'42|' || o_orderkey")}, 10) AS u FROM orders WHERE {_UNIFORM.format("'42|' || o_orderkey")} < 0.3")
def stable_uniform_sample(spark, d):
    kept = masking.stable_sample(_table(spark, d, "orders"), 42, F.col("o_orderkey").cast("string"), 0.3)
    return kept.select("o_orderkey", _r(stable_uniform("|", 42, F.col("o_orderkey").cast("string")), 10).alias("u"))


@query(f"WITH {_SIGNALS} SELECT CASE WHEN l_orderkey % 2 = 0 THEN a END AS a, CASE WHEN (l_orderkey + 1) % 2 = 0 THEN b END AS b, count(*) AS cnt FROM sig GROUP BY ALL")
def staggered_mask(spark, d):
    return law.category_law(masking.staggered(_signals(spark, d).select("l_orderkey", "a", "b"), "l_orderkey", ["a", "b"]), [], ["a", "b"])


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS operation, u.signal, CASE u.signal WHEN 'a' THEN o_orderstatus = 'F' ELSE o_totalprice > 100000 END AS value FROM orders, (VALUES ('a'), ('b')) u(signal)),
  r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY sha256('7' || chr(0) || id || chr(0) || signal), id, signal) AS rank, count(*) OVER (PARTITION BY operation) AS total FROM c),
  h AS (SELECT id, operation, level, signal, CASE WHEN rank > floor(level * total) THEN value END AS value FROM r, (VALUES (0.0::DOUBLE), (0.5), (1.0)) l(level)),
  w AS (SELECT id, operation, level, bool_or(value) FILTER (WHERE signal = 'a') AS a, bool_or(value) FILTER (WHERE signal = 'b') AS b FROM h GROUP BY ALL)
  SELECT operation, level, count(*) AS n, count(*) FILTER (WHERE a AND b) AS lower_count, count(*) FILTER (WHERE (a AND b) IS DISTINCT FROM false) AS upper_count FROM w GROUP BY ALL""")
def mask_experiment(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("operation"), (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 100000).alias("b"))
    return masking.mask_experiment(rows, ["operation"], ["a", "b"], [0.0, 0.5, 1.0], "7")


# Scores


def _cells(spark, d) -> DataFrame:
    """Attempts and successes per (region, nation, operation)."""
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_regionkey").alias("stratum"), F.col("n_nationkey").alias("campaign"), F.col("o_orderpriority").alias("operation")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("p"))


_CELLS = """cells AS (SELECT n_regionkey AS stratum, n_nationkey AS campaign, o_orderpriority AS operation, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS s, avg((o_totalprice > 250000)::INT::DOUBLE) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_BRIER = "(s * (1 - p) * (1 - p) + (n - s) * p * p) / n"


@query(f"WITH {_CELLS} SELECT stratum, campaign, operation, n, s, round({_BRIER}, 8) AS brier, round(100 * (p - s / n::DOUBLE), 8) AS signed_pp, round(100 * abs(p - s / n::DOUBLE), 8) AS absolute_pp FROM cells")
def brier_scores(spark, d):
    p, s, n = F.col("p"), F.col("s"), F.col("n")
    return _cells(spark, d).select("stratum", "campaign", "operation", "n", "s", _r(scoring.brier(p, s, n)).alias("brier"), _r(100 * (p - s / n)).alias("signed_pp"), _r(100 * F.abs(p - s / n)).alias("absolute_pp"))


@query(f"WITH {_CELLS}, b AS (SELECT stratum, campaign, operation, {_BRIER} AS brier FROM cells WHERE s > 0) SELECT stratum, campaign, round(avg(brier), 8) AS mean_brier FROM b GROUP BY ALL HAVING count(brier) = 5")
def complete_cells(spark, d):
    rows = _cells(spark, d).filter("s > 0").withColumn("brier", scoring.brier(F.col("p"), F.col("s"), F.col("n")))
    return scoring.complete_cells(rows, ["stratum", "campaign"], 5, "brier").withColumn("mean_brier", _r("mean_brier"))


@query(f"""WITH {_CELLS}, b AS (SELECT stratum, campaign, {_BRIER} AS brier FROM cells), c AS (SELECT stratum, campaign, avg(brier) AS brier FROM b GROUP BY ALL), e AS (SELECT stratum, avg(brier) AS brier FROM c GROUP BY 1)
  SELECT 'all' AS scope, round(avg(brier), 8) AS brier FROM e""")
def equal_weight_means(spark, d):
    rows = _cells(spark, d).select(F.lit("all").alias("scope"), "stratum", "campaign", scoring.brier(F.col("p"), F.col("s"), F.col("n")).alias("brier"))
    return scoring.equal_weight(rows, [["scope", "stratum", "campaign"], ["scope", "stratum"], ["scope"]], "brier").withColumn("brier", _r("brier"))


def _methods(spark, d) -> DataFrame:
    c = _cells(spark, d)
    s, n = F.col("s"), F.col("n")
    both = F.array(F.struct(F.lit("plain").alias("method"), scoring.brier(F.col("p"), s, n).alias("brier")), F.struct(F.lit("smooth").alias("method"), scoring.brier(scoring.smoothed_mean(s, n, 1.0, 1.0), s, n).alias("brier")))
    return c.select("stratum", "campaign", "operation", F.explode(both).alias("m")).select("stratum", "campaign", "operation", "m.*")


_METHODS = f"{_CELLS}, c2 AS (SELECT *, (s + 1.0::DOUBLE) / (n + 2) AS q FROM cells), con AS (SELECT stratum, campaign, operation, (s * (1 - q) * (1 - q) + (n - s) * q * q) / n AS a, {_BRIER} AS b FROM c2)"


@query(f"WITH {_METHODS} SELECT stratum, campaign, operation, round(a, 8) AS a, round(b, 8) AS b, round(a - b, 8) AS difference FROM con")
def paired_contrast(spark, d):
    found = scoring.paired_contrast(_methods(spark, d), ["stratum", "campaign", "operation"], "method", "smooth", "plain", "brier")
    return found.select("stratum", "campaign", "operation", *[_r(c).alias(c) for c in ("a", "b", "difference")])


@query(f"WITH {_CELLS} SELECT stratum, round(median(p), 8) AS p50, round(quantile_cont(p, 0.9), 8) AS p90, quantile_disc(n, 0.5) AS n50 FROM cells GROUP BY stratum")
def own_support_quantiles(spark, d):
    return _cells(spark, d).groupBy("stratum").agg(_r(F.median("p")).alias("p50"), _r(F.percentile("p", 0.9)).alias("p90"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("n50"))


@query(f"""WITH {_CELLS}, w AS (SELECT campaign, operation, n, s, p, 1.959964::DOUBLE AS z, s / n::DOUBLE AS q FROM cells), i AS (SELECT *, ((q + z*z/(2*n)) / (1 + z*z/n)) AS c, z * sqrt(q*(1-q)/n + z*z/(4.0*n*n)) / (1 + z*z/n) AS h FROM w)
  SELECT campaign, operation, round(c - h, 8) + 0.0 AS lower, round(c + h, 8) + 0.0 AS upper, CASE WHEN c - h > 0.5 THEN 'accept' WHEN c + h < 0.5 THEN 'reject' ELSE 'abstain' END AS decision, round(greatest(c + h - 0.5, 0), 8) AS regret FROM i""")
def decision_regret(spark, d):
    low, high = scoring.wilson(F.col("s"), F.col("n"))
    decision = F.when(low > 0.5, "accept").when(high < 0.5, "reject").otherwise("abstain")
    return _cells(spark, d).select("campaign", "operation", (_r(low) + 0.0).alias("lower"), (_r(high) + 0.0).alias("upper"), decision.alias("decision"), _r(F.greatest(high - 0.5, F.lit(0.0))).alias("regret"))


@query(f"""WITH {_METHODS}, m AS (SELECT stratum, campaign, round(avg(a - b), 12) AS x FROM con GROUP BY ALL), l AS (SELECT stratum, list(x ORDER BY x) AS xs, count(*) AS n FROM m GROUP BY stratum),
  f AS (SELECT stratum, n, abs(list_sum(list_transform(range(0, n), lambda i: CASE WHEN (st >> i) & 1 = 1 THEN xs[i + 1] ELSE -xs[i + 1] END))) >= abs(list_sum(xs)) - 1e-9 AS hit FROM l, range(65536) t(st) WHERE n <= 16 AND st < (1 << least(n, 16))),
  g AS (SELECT stratum, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 8) AS p FROM f GROUP BY ALL)
  SELECT stratum, n, p, CASE WHEN p IS NULL THEN 'unsupported' ELSE 'supported' END AS status FROM l LEFT JOIN g USING (stratum)""")
def exact_sign_flip(spark, d):
    found = scoring.paired_contrast(_methods(spark, d), ["stratum", "campaign", "operation"], "method", "smooth", "plain", "brier")
    means = found.groupBy("stratum", "campaign").agg(_r(F.avg("difference"), 12).alias("x"))
    return scoring.sign_flip(means, ["stratum"], "x").withColumn("p", _r("p"))


# Statistics and identification


@query()
def clopper_pearson(spark, d):
    cells = _cells(spark, d)
    return cells.select("campaign", "operation", "s", "n", stats.clopper_pearson(F.col("s"), F.col("n")).alias("i")).select("campaign", "operation", "s", "n", "i.lower", "i.upper")


@query(f"""WITH {_CELLS}, x AS (SELECT stratum, s / n::DOUBLE AS r FROM cells), g AS (SELECT stratum, avg(r) AS m, var_samp(r) / count(r) AS v, count(r) AS n FROM x GROUP BY 1 HAVING n > 1)
  SELECT count(*) AS strata, round(avg(m), 8) AS mean, round(sqrt(sum(v)) / count(*), 8) AS standard_error, round(sum(v) * sum(v) / sum(v * v / (n - 1)), 4) AS df FROM g""")
def satterthwaite(spark, d):
    t = stats.stratified(_cells(spark, d).withColumn("r", F.col("s") / F.col("n")), "stratum", "r")
    return t.select("strata", _r("mean").alias("mean"), _r("standard_error").alias("standard_error"), _r("df", 4).alias("df"))


@query()
def bootstrap_mean(spark, d):
    return stats.bootstrap_mean(_ticks(spark, d), "user_id", "value")


@query()
def block_bootstrap(spark, d):
    return stats.bootstrap_mean(_ticks(spark, d), "user_id", "value", block=8)


def _tables22(spark, d):
    s = _signals(spark, d)
    hit = lambda x: F.count_if(x).alias
    return s.groupBy("operation").agg(hit(F.col("a").isNull() & F.col("b"))("w"), hit(F.col("a").isNull() & ~F.col("b"))("x"), hit(F.col("a").isNotNull() & F.col("b"))("y"), hit(F.col("a").isNotNull() & ~F.col("b"))("z"))


@query(f"WITH {_SIGNALS} SELECT operation, count(*) FILTER (WHERE a IS NULL AND b) AS w, count(*) FILTER (WHERE a IS NULL AND NOT b) AS x, count(*) FILTER (WHERE a IS NOT NULL AND b) AS y, count(*) FILTER (WHERE a IS NOT NULL AND NOT b) AS z FROM sig GROUP BY 1")
def dependence_counts(spark, d):
    return _tables22(spark, d)


@query()
def fisher_2x2(spark, d):
    return _tables22(spark, d).select("*", stats.fisher(*[F.col(c) for c in "wxyz"]).alias("p"))


@query(f"WITH {_SIGNALS} SELECT operation, count(*) FILTER (WHERE a AND NOT b) AS violations, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n FROM sig GROUP BY 1")
def implication_violations(spark, d):
    return _signals(spark, d).groupBy("operation").agg(F.count_if(F.col("a") & ~F.col("b")).alias("violations"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"))


@query(f"""WITH {_SIGNALS}, m AS (SELECT 'a' AS observables, count(a) AS observations, count(*) FILTER (WHERE a) AS successes FROM sig UNION ALL SELECT 'b', count(b), count(*) FILTER (WHERE b) FROM sig UNION ALL SELECT 'c', count(c), count(*) FILTER (WHERE c) FROM sig
  UNION ALL SELECT 'a;b', count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), count(*) FILTER (WHERE a AND b) FROM sig UNION ALL SELECT 'a;c', count(*) FILTER (WHERE a IS NOT NULL AND c IS NOT NULL), count(*) FILTER (WHERE a AND c) FROM sig
  UNION ALL SELECT 'b;c', count(*) FILTER (WHERE b IS NOT NULL AND c IS NOT NULL), count(*) FILTER (WHERE b AND c) FROM sig) SELECT *, round(successes / observations::DOUBLE, 8) AS moment FROM m""")
def joint_moments(spark, d):
    return identify.joint_moments(_signals(spark, d), ["a", "b", "c"], 2).withColumn("moment", _r("moment"))


_FACTORS = {"a": ["x", "z"], "b": ["y", "z"], "c": ["z"]}


@query()
def log_moment_fit(spark, d):
    return identify.log_moment_fit(identify.joint_moments(_signals(spark, d), ["a", "b", "c"], 2), _FACTORS)


@query()
def observed_mle(spark, d):
    return identify.observed_mle(_signals(spark, d), ["a", "b", "c"], _FACTORS)


@query(f"""WITH {_SIGNALS}, m AS (SELECT operation, count(*) FILTER (WHERE a) / count(a)::DOUBLE AS ma, count(*) FILTER (WHERE b) / count(b)::DOUBLE AS mb, count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL)::DOUBLE AS mab FROM sig GROUP BY 1)
  SELECT operation, round(ma * mb / mab, 8) AS shared, round(ma * mb, 8) AS independent, round(mab, 8) AS joint FROM m""")
def two_domain_moments(spark, d):
    a, b = F.col("a"), F.col("b")
    m = _signals(spark, d).groupBy("operation").agg(F.avg(a.cast("int")).alias("ma"), F.avg(b.cast("int")).alias("mb"), (F.count_if(a & b) / F.count_if(a.isNotNull() & b.isNotNull())).alias("mab"))
    return m.select("operation", _r(F.col("ma") * F.col("mb") / F.col("mab")).alias("shared"), _r(F.col("ma") * F.col("mb")).alias("independent"), _r("mab").alias("joint"))


@query("""SELECT string_agg(s_suppkey, ';' ORDER BY s_suppkey) AS merged, count(*) AS n FROM (SELECT s_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS signature
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1) GROUP BY signature""")
def factor_merge(spark, d):
    used = _table(spark, d, "supplier").join(_table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"))
    signed = used.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("signature"))
    return signed.groupBy("signature").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ";").alias("merged"), F.count("*").alias("n")).drop("signature")


# Constraints, sets, maps


@query("""SELECT 'duplicate call' AS rule, count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
  SELECT 'order without call', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'call without order', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL
  SELECT 'missing cell', count(*) FROM (SELECT n_nationkey, o_orderpriority FROM nation, (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000)""")
def violations_fk_unique(spark, d):
    orders, lines, customers = (_table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    grid = _table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(orders.select("o_orderpriority").distinct()))
    found = orders.filter("o_totalprice > 300000").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority")
    return (validate.duplicates(lines, ["l_orderkey", "l_linenumber"], "duplicate call").unionByName(validate.orphans(orders, lines, "o_orderkey", "l_orderkey", "order without call"))
            .unionByName(validate.orphans(lines, orders, "l_orderkey", "o_orderkey", "call without order")).unionByName(validate.missing_from_grid(grid, found, ["n_nationkey", "o_orderpriority"], "missing cell")))


@query("""WITH a AS (SELECT l_orderkey % 100 AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey % 100 AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber = 2)
  SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_diff(spark, d):
    side = lambda n: _table(spark, d, "lineitem").filter(F.col("l_linenumber") == n).select((F.col("l_orderkey") % 100).alias("k"), F.col("l_returnflag").alias("f"))
    return validate.multiset_difference(side(1), side(2))


# Evidence


_PROBES = """probes AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'down' WHEN 'signup' THEN 'maint' WHEN 'click' THEN '* up' ELSE ' UP ' END AS status, CASE WHEN value > 20 THEN 'L7OK' ELSE '* L4OK' END AS checked FROM events)"""


@query(f"""WITH {_PROBES}, p AS (SELECT user_id, regexp_replace(upper(trim(status)), '^\\* ', '') AS s, regexp_replace(upper(trim(checked)), '^\\* ', '') AS c FROM probes),
  v AS (SELECT user_id, CASE WHEN s = 'UP' AND c = 'L7OK' THEN true WHEN s = 'DOWN' THEN false END AS verdict FROM p) SELECT user_id, verdict, count(*) AS n FROM v GROUP BY ALL""")
def probe_verdicts(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "down").when(kind == "signup", "maint").when(kind == "click", "* up").otherwise(" UP ")
    checked = F.when(F.col("value") > 20, "L7OK").otherwise("* L4OK")
    return _table(spark, d, "events").select("user_id", evidence.probe_verdict(status, checked).alias("verdict")).groupBy("user_id", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_SIGNALS}, x AS (SELECT operation, c, a AND b AS conjunction FROM sig) SELECT operation, CASE WHEN c AND conjunction IS NOT DISTINCT FROM false THEN 'success_excluded'
  WHEN NOT c AND conjunction IS NOT DISTINCT FROM true THEN 'failure_excluded' ELSE 'compatible' END AS class, count(*) AS n FROM x GROUP BY ALL""")
def compatibility_classes(spark, d):
    found = evidence.compatibility(F.col("a") & F.col("b"), F.col("c"))
    return _signals(spark, d).select("operation", found.alias("class")).groupBy("operation", "class").agg(F.count("*").alias("n"))


@query(f"""WITH {_CALLS} SELECT 'not one root' AS rule, count(*) AS violations FROM (SELECT trace_id FROM calls GROUP BY trace_id HAVING count(*) FILTER (WHERE parent_id = 0) <> 1) UNION ALL
  SELECT 'missing parent', count(*) FROM (SELECT trace_id, parent_id FROM calls c WHERE parent_id <> 0 AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_id))""")
def span_graph_checks(spark, d):
    return evidence.span_graph_violations(_calls(spark, d))


@query(f"WITH {_SIGNALS} SELECT count(*) AS calls, count(*) FILTER (WHERE a IS NULL) AS a_unknown, count(*) FILTER (WHERE b IS NULL) AS b_unknown, count(*) FILTER (WHERE c IS NULL) AS c_unknown, count(DISTINCT l_orderkey) AS requests FROM sig")
def quality_counters(spark, d):
    unknown = [F.count_if(F.col(s).isNull()).alias(f"{s}_unknown") for s in "abc"]
    return _signals(spark, d).agg(F.count("*").alias("calls"), *unknown, F.countDistinct("l_orderkey").alias("requests"))


@query(f"WITH {_SIGNALS} SELECT operation, least(count(a), count(b), count(c)) AS support, least(count(a), count(b), count(c)) >= 100 AS supported FROM sig GROUP BY operation")
def support_diagnostic(spark, d):
    least = F.least(*[F.count(s) for s in "abc"])
    return _signals(spark, d).groupBy("operation").agg(least.alias("support"), (least >= 100).alias("supported"))


@query(f"WITH {_CELLS}, l AS (SELECT stratum, list(n ORDER BY n) AS ns FROM cells GROUP BY stratum) SELECT stratum, ns[ceil((len(ns) - 1) * 0.9::DOUBLE)::INT + 1] AS n90 FROM l")
def quantile_higher(spark, d):
    return _cells(spark, d).groupBy("stratum").agg(evidence.quantile_higher(F.col("n"), 0.9).alias("n90"))


@query(f"WITH {_CELLS} SELECT campaign, operation, s, n, round((s + 1.0::DOUBLE) / (n + 2), 8) AS smoothed, round((s + 0.5::DOUBLE) / (n + 1), 8) AS endpoint FROM cells")
def beta_smoothed(spark, d):
    s, n = F.col("s"), F.col("n")
    return _cells(spark, d).select("campaign", "operation", "s", "n", _r(scoring.smoothed_mean(s, n, 1.0, 1.0)).alias("smoothed"), _r(scoring.smoothed_mean(s, n, 0.5, 0.5)).alias("endpoint"))


@query(f"""WITH {_CELLS}, w AS (SELECT campaign, operation, n, s, 1.959964::DOUBLE AS z, s / n::DOUBLE AS q FROM cells), i AS (SELECT *, ((q + z*z/(2*n)) / (1 + z*z/n)) AS c, z * sqrt(q*(1-q)/n + z*z/(4.0*n*n)) / (1 + z*z/n) AS h FROM w)
  SELECT campaign, operation, s, n, round(c - h, 8) + 0.0 AS lower, round(c + h, 8) + 0.0 AS upper FROM i""")
def wilson(spark, d):
    low, high = scoring.wilson(F.col("s"), F.col("n"))
    return _cells(spark, d).select("campaign", "operation", "s", "n", (_r(low) + 0.0).alias("lower"), (_r(high) + 0.0).alias("upper"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT % 3 = 0 AS selected FROM events")
def json_props(spark, d):
    k = F.from_json("props", "k BIGINT")["k"]
    return _table(spark, d, "events").select("event_id", k.alias("k"), (k % 3 == 0).alias("selected"))


@query("""WITH r AS (SELECT o_orderpriority AS operation, o_orderstatus AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) SELECT operation, string_agg(reason || '=' || n, ';' ORDER BY reason) AS reasons, sum(n)::BIGINT AS absent FROM r GROUP BY operation""")
def whitelist_maps(spark, d):
    r = _table(spark, d, "orders").filter("o_orderstatus <> 'F'").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    pairs = F.map_filter(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))), lambda k, _: k.rlike("^[A-Z]$"))
    listed = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return r.groupBy(F.col("o_orderpriority").alias("operation")).agg(F.array_join(listed, ";").alias("reasons"), F.sum("n").alias("absent"))


# The queries of the per-request evidence register themselves here.
from lodestar.plans import evidence_queries as _evidence_queries  # noqa: E402, F401
from lodestar.plans import model_queries as _model_queries  # noqa: E402, F401
