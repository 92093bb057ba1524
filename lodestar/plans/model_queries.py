"""Queries of the caller contexts, forests, predicates, resampling, monotone and polynomial operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.expr import tri
from lodestar.functions.lineage import settle, shared_path
from lodestar.operators import likelihood, monotone, paths, polynomial, predicates, qualify, resampling, stats
from lodestar.plans.catalogue import _CALLS, _TICKS, DAY, HOUR, _calls, _r, _table, _ticks, query
from lodestar.plans.evidence_queries import _TAGGED, _hex, _spans, write_traces
from lodestar.sources import bundle, native, sealed

# Trees of calls: the calls of an order are numbered, and call n is made by call n div 2.

_TREES = f"""{_CALLS}, trees AS (SELECT trace_id, n AS span_id, CASE WHEN n > 1 THEN n // 2 END AS parent_id, 's' || service % 3 AS service, 's' || service % 3 || CASE WHEN l_quantity > 25 THEN '.big' ELSE '.small' END AS operation, l_returnflag = 'R' AS error, l_quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY span_id) AS n FROM calls))"""


def _trees(spark, d) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy("span_id"))
    rows = _calls(spark, d).withColumn("n", n)
    service = F.concat(F.lit("s"), F.col("service") % 3)
    return rows.select("trace_id", F.col("n").alias("span_id"), F.when(F.col("n") > 1, F.expr("CAST(n div 2 AS INT)")).alias("parent_id"), service.alias("service"),
                       F.concat(service, F.when(F.col("l_quantity") > 25, ".big").otherwise(".small")).alias("operation"), (F.col("l_returnflag") == "R").alias("error"), "l_quantity")


_CONTEXTS = f"""{_TREES}, ways AS (SELECT trace_id, span_id, [operation] AS path FROM trees WHERE parent_id IS NULL UNION ALL SELECT t.trace_id, t.span_id, list_append(w.path, t.operation) FROM ways w JOIN trees t ON t.trace_id = w.trace_id AND t.parent_id = w.span_id),
  contexts AS (SELECT t.*, len(path) AS depth, 'operation_' || substr(sha256('["full-caller-context-1","' || array_to_string(path, '","') || '"]'), 1, 24) AS context, EXISTS (SELECT 1 FROM trees c WHERE c.trace_id = t.trace_id AND c.parent_id = t.span_id AND c.error) AS child_error FROM trees t JOIN ways USING (trace_id, span_id))"""


@query(f"""WITH RECURSIVE {_CONTEXTS} SELECT context, operation, service, depth, count(*) AS invocations, count(*) FILTER (WHERE error) AS inclusive_errors, count(*) FILTER (WHERE child_error AND NOT error) AS child_error_parent_success,
  count(*) FILTER (WHERE NOT child_error) AS no_child_error_invocations, count(*) FILTER (WHERE error AND NOT child_error) AS local_errors, round(count(*) FILTER (WHERE error) / count(*)::DOUBLE, 8) AS inclusive_probability,
  round(count(*) FILTER (WHERE error AND NOT child_error) / nullif(count(*) FILTER (WHERE NOT child_error), 0)::DOUBLE, 8) AS local_probability, count(*) FILTER (WHERE child_error AND NOT error) = 0 AS propagates FROM contexts GROUP BY context, operation, service, depth""")
def caller_contexts(spark, d):
    """Operations in their full caller context, with the errors that are their own."""
    found = paths.context_operations(paths.caller_contexts(_trees(spark, d)))
    return found.withColumns({c: _r(c) for c in ("inclusive_probability", "local_probability")})


@query(f"WITH RECURSIVE {_CONTEXTS} SELECT p.context AS caller, c.context AS callee, count(*) AS calls FROM contexts c LEFT JOIN contexts p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id GROUP BY ALL")
def context_edges(spark, d):
    return paths.context_edges(paths.caller_contexts(_trees(spark, d)))


_FOREST = f"""{_TREES}, spans AS (SELECT trace_id, span_id, CASE WHEN l_quantity > 47 AND span_id > 1 THEN 99 ELSE parent_id END AS parent_id, error OR span_id = 1 AS server FROM trees),
  up AS (SELECT s.trace_id, s.span_id, s.parent_id AS above, p.server, 0 AS passed FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id WHERE s.server
    UNION ALL SELECT u.trace_id, u.span_id, m.parent_id, p.server, u.passed + 1 FROM up u JOIN spans m ON m.trace_id = u.trace_id AND m.span_id = u.above AND NOT m.server LEFT JOIN spans p ON p.trace_id = m.trace_id AND p.span_id = m.parent_id),
  servers AS (SELECT trace_id, span_id, CASE WHEN server THEN above END AS ancestor, CASE WHEN server IS NULL THEN above END AS missing_parent, passed FROM up WHERE server IS DISTINCT FROM false),
  roots AS (SELECT trace_id, span_id, span_id AS root FROM servers WHERE ancestor IS NULL UNION ALL SELECT s.trace_id, s.span_id, r.root FROM roots r JOIN servers s ON s.trace_id = r.trace_id AND s.ancestor = r.span_id)"""


def _forest(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _trees(spark, d).select("trace_id", "span_id", F.when((F.col("l_quantity") > 47) & (F.col("span_id") > 1), 99).otherwise(F.col("parent_id")).alias("parent_id"), (F.col("error") | (F.col("span_id") == 1)).alias("server"))
    return rows, paths.server_forest(rows)


@query(f"""WITH RECURSIVE {_FOREST} SELECT trace_id, root, substr(sha256('["server-forest-1","' || trace_id || '","' || root || '"]'), 1, 32) AS tree_id, count(*) AS servers, sum(passed)::BIGINT AS contracted, count(missing_parent) AS missing_parents
  FROM servers JOIN roots USING (trace_id, span_id) GROUP BY trace_id, root""")
def server_forest(spark, d):
    """The trees of server spans: one row a tree."""
    return _forest(spark, d)[1].groupBy("trace_id", "root", "tree_id").agg(F.count("*").alias("servers"), F.sum("contracted").alias("contracted"), F.count("missing_parent").alias("missing_parents"))


@query(f"""WITH RECURSIVE {_FOREST}, a AS (SELECT trace_id, count(*) AS unique_spans FROM spans GROUP BY 1), b AS (SELECT trace_id, count(*) AS servers, count(*) FILTER (WHERE ancestor IS NULL) AS trees, count(missing_parent) AS missing_parent_roots FROM servers GROUP BY 1)
  SELECT trace_id, unique_spans, 0::BIGINT AS repeats, coalesce(servers, 0) AS servers, coalesce(trees, 0) AS trees, coalesce(missing_parent_roots, 0) AS missing_parent_roots, coalesce(trees, 0) = 1 AND coalesce(missing_parent_roots, 0) = 0 AS whole_tree FROM a LEFT JOIN b USING (trace_id)""")
def forest_audit(spark, d):
    rows, forest = _forest(spark, d)
    return paths.forest_audit(paths.unrepeated(rows, ["parent_id", "server"]), forest)


@query("""WITH RECURSIVE c AS (SELECT 'n' || c_nationkey AS n, 's' || l_suppkey AS s, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  e AS (SELECT n AS a, s AS b FROM c WHERE q >= 50 UNION SELECT s, n FROM c WHERE q <= 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def cycle_components(spark, d):
    """Components of nations and suppliers that feed each other by their largest and smallest orders, without the pairs that reach each other."""
    c = _table(spark, d, "lineitem").join(_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n, s = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("s"), "l_suppkey")
    edges = c.select(F.when(F.col("l_quantity") >= 50, F.struct(n.alias("a"), s.alias("b"))).when(F.col("l_quantity") <= 1, F.struct(s.alias("a"), n.alias("b"))).alias("e"))
    return paths.cycle_components(edges.filter("e IS NOT NULL").select("e.*"))


# Predicates of states: orders stand in for requests, replicas a and b of a shop are up by the status codes of calls.

_REQUESTS = """req AS (SELECT o_orderpriority AS operation, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS a, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS b, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_discount > 0.05 END AS da,
  CASE WHEN l_tax < 0.01 THEN NULL ELSE l_quantity > 20 END AS db, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_tax > 0.02 END AS e1, l_quantity > 5 AS e2, l_extendedprice < 50000 AS soon FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_SHOP = predicates.ServiceGraph("gate", ("shop",), {"gate": ((),), "shop": (("a",), ("b",))}, (predicates.Edge("gate", "shop"),))


def _request_signals(spark, d) -> DataFrame:
    rows = _table(spark, d, "lineitem").join(_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderpriority").alias("operation"), tri("l_returnflag", "A", "R").alias("a"), tri("o_orderstatus", "F", "O").alias("b"), F.when(F.col("l_tax") <= 0.06, F.col("l_discount") > 0.05).alias("da"),
                       F.when(F.col("l_tax") >= 0.01, F.col("l_quantity") > 20).alias("db"), F.when(F.col("l_discount") >= 0.02, F.col("l_tax") > 0.02).alias("e1"), (F.col("l_quantity") > 5).alias("e2"), (F.col("l_extendedprice") < 50000).alias("soon"))


_NAMES = ["reachability", "selected", "without_deadline", "execution", "without_selection", "without_completion"]
_PREDICATES = f"""WITH {_REQUESTS}, l AS (SELECT operation, a, b, da, db, (e1 AND e2) AS done, soon, count(*) AS cnt FROM req GROUP BY ALL),
  s AS (SELECT (i & 1) = 1 AS xa, (i & 2) = 2 AS xb, (i & 4) = 4 AS ya, (i & 8) = 8 AS yb, (i & 16) = 16 AS z FROM range(32) t(i)),
  f AS (SELECT l.*, (xa OR xb)::INT AS reachability, ((xa OR xb) AND (ya OR yb) AND (NOT ya OR xa) AND (NOT yb OR xb)) AS sel, (xa OR xb) AS base, z FROM l JOIN s ON (a IS NULL OR a = xa) AND (b IS NULL OR b = xb) AND (da IS NULL OR da = ya) AND (db IS NULL OR db = yb) AND (done IS NULL OR done = z)),
  g AS (SELECT *, sel::INT AS selected, (sel AND z)::INT AS without_deadline, (sel AND z AND soon)::INT AS execution, (base AND z AND soon)::INT AS without_selection, (sel AND soon)::INT AS without_completion FROM f),
  p AS (SELECT operation, a, b, da, db, done, soon, cnt, {', '.join(f'min({n}) AS {n}_0, max({n}) AS {n}_1' for n in _NAMES)}, {', '.join(f'min({n} - execution) AS {n}_2, max({n} - execution) AS {n}_3' for n in _NAMES if n != 'execution')} FROM g GROUP BY ALL)
  SELECT operation, sum(cnt)::BIGINT AS n, {', '.join(f'sum(cnt * {n}_0)::BIGINT AS {n}_lower, sum(cnt * {n}_1)::BIGINT AS {n}_upper' for n in _NAMES)},
  {', '.join(f'sum(cnt * {n}_2)::BIGINT AS {n}_minus_execution_lower, sum(cnt * {n}_3)::BIGINT AS {n}_minus_execution_upper' for n in _NAMES if n != 'execution')} FROM p GROUP BY operation"""


@query(_PREDICATES)
def predicate_bounds(spark, d):
    """Sharp bounds on six predicates of the service graph and on their gaps to execution."""
    return predicates.predicate_bounds(_request_signals(spark, d), ["operation"], _SHOP, (predicates.Demand("shop", ("da", "db")),), ["e1", "e2"], "soon")


_WEB = predicates.ServiceGraph("gate", ("shop", "stock"), {"gate": (("e2",),), "shop": (("a",), ("b",)), "stock": ((),)}, (predicates.Edge("gate", "shop", ("soon",)), predicates.Edge("shop", "stock", ("da",))))


@query(f"""WITH {_REQUESTS}, q AS (SELECT operation, avg(a::INT) AS a, avg(b::INT) AS b, avg(da::INT) AS da, avg(e2::INT) AS e2, CASE WHEN operation <> '5-LOW' THEN avg(soon::INT) END AS soon FROM req GROUP BY operation),
  t AS (SELECT operation, (1 - (1 - a) * (1 - b)) * da * e2 AS known, soon FROM q)
  SELECT operation, CASE WHEN soon IS NULL THEN 'insufficient_observations' ELSE 'estimated' END AS status, round(known * soon, 8) AS prediction, round(known * coalesce(soon, 0), 8) AS lower, round(known * coalesce(soon, 1), 8) AS upper FROM t""")
def independent_probability(spark, d):
    """Probability that all services are reached from independent primitives, one of which the last operation never shows."""
    rows = _request_signals(spark, d)
    names = _WEB.gates()
    wide = rows.groupBy("operation").agg(*[F.struct(F.lit(n).alias("primitive"), F.count_if(n).alias("successes"), F.count(n).alias("observed")).alias(n) for n in names])
    long = wide.select("operation", F.explode(F.array(*names)).alias("m")).select("operation", "m.*").filter("NOT (operation = '5-LOW' AND primitive = 'soon')")
    found = predicates.independent_probability(long, ["operation"], _WEB)
    return found.select("operation", "status", *[_r(c).alias(c) for c in ("prediction", "lower", "upper")])


# Resampling and intervals


def _campaign_scores(spark, d) -> DataFrame:
    """Absolute errors of two forecasts of a customer's share of closed orders, by priority: one half, and a price rule."""
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = o.groupBy(F.col("n_regionkey").alias("stratum"), F.col("o_custkey").alias("campaign"), F.col("o_orderpriority").alias("operation")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("y"), F.avg(F.when(F.col("o_totalprice") > 150000, 0.6).otherwise(0.4)).alias("p"))
    listed = F.array(F.struct(F.lit("half").alias("method"), F.abs(F.col("y") - 0.5).alias("error")), F.struct(F.lit("price").alias("method"), F.abs(F.col("y") - F.col("p")).alias("error")))
    return cells.select("stratum", "campaign", "operation", F.explode(listed).alias("m")).select("stratum", "campaign", "operation", "m.*")


@query("""WITH c AS (SELECT n_regionkey AS stratum, o_custkey AS campaign, o_orderpriority AS operation, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS y, avg(CASE WHEN o_totalprice > 150000 THEN 0.6 ELSE 0.4 END) AS p
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), w AS (SELECT stratum, campaign, avg(abs(y - p) - abs(y - 0.5)) AS difference FROM c GROUP BY ALL HAVING count(*) = 5)
  SELECT stratum, count(*) AS campaigns, round(avg(difference), 8) AS difference FROM w GROUP BY stratum""")
def common_campaigns(spark, d):
    """Paired differences on campaigns in which both forecasts cover every operation."""
    whole = resampling.common_campaigns(_campaign_scores(spark, d), "stratum", "campaign", "operation", "method", "error", "price", "half", 5)
    return whole.groupBy("stratum").agg(F.count("*").alias("campaigns"), _r(F.avg("difference")).alias("difference"))


@query()
def campaign_bootstrap(spark, d):
    """Whole campaigns resampled within regions: errors of both forecasts and their difference, limits for a family of three."""
    scores = _campaign_scores(spark, d)
    wide = scores.groupBy("stratum", "campaign").agg(F.avg(F.when(F.col("method") == "half", F.col("error"))).alias("half"), F.avg(F.when(F.col("method") == "price", F.col("error"))).alias("price"))
    return resampling.stratified_bootstrap(wide, "stratum", "campaign", ["half", "price"], draws=500, family=3, differences=[("price", "half")])


@query()
def stratified_inference(spark, d):
    """Mean paired difference over regions with its t interval and p-value."""
    whole = resampling.common_campaigns(_campaign_scores(spark, d), "stratum", "campaign", "operation", "method", "error", "price", "half", 5)
    return stats.stratified(whole, "stratum", "difference")


@query()
def block_interval(spark, d):
    """Availability of a user's ticks by the means of weeks, with the t interval."""
    return resampling.block_interval(_ticks(spark, d).filter("state IS NOT NULL").withColumn("up", F.col("state").cast("double")), "user_id", 7 * DAY, "up")


_LAGS = 12


@query(f"""WITH {_TICKS}, v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY t, value) AS i FROM ticks WHERE value IS NOT NULL), m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, sum((value - avg) * (value - avg)) AS ss FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS avg FROM v) GROUP BY event_type),
  r AS (SELECT x.event_type, lag, sum((x.value - mean) * (y.value - mean)) / any_value(ss) AS r FROM v x JOIN m USING (event_type), range(1, {_LAGS + 1}) l(lag) JOIN v y ON y.event_type = x.event_type AND y.i = x.i + lag GROUP BY ALL),
  most AS (SELECT event_type, n, least({_LAGS}, greatest(1, n // 3)) AS most FROM m), runs AS (SELECT a.event_type, min(a.lag) AS lag FROM r a JOIN r b ON b.event_type = a.event_type AND b.lag = a.lag + 1 JOIN most ON most.event_type = a.event_type WHERE abs(a.r) <= 0.01 AND abs(b.r) <= 0.01 AND b.lag <= most GROUP BY 1)
  SELECT event_type, n, coalesce(lag, most)::BIGINT AS block_length FROM most LEFT JOIN runs USING (event_type)""")
def block_lengths(spark, d):
    """Length of the blocks within which the values of a kind of event hang together."""
    return resampling.block_lengths(_ticks(spark, d), "event_type", "value", threshold=0.01, consecutive=2, max_lag=_LAGS)


@query()
def moving_block_bootstrap(spark, d):
    """Mean value of a kind of event by circular moving blocks of the length that their autocorrelation gives."""
    ticks = settle(_ticks(spark, d))
    lengths = resampling.block_lengths(ticks, "event_type", "value", threshold=0.01, consecutive=2, max_lag=_LAGS)
    return resampling.moving_block_bootstrap(ticks, "event_type", "value", lengths, draws=500)


# Fits

_EDGES = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0]


@query(f"""WITH o AS (SELECT o_orderpriority AS operation, o_totalprice / 20000.0 AS age, (o_orderstatus = 'F')::INT AS s FROM orders), b AS (SELECT operation, CASE {' '.join(f'WHEN age < {e} THEN {i}' for i, e in enumerate(_EDGES[1:]))} ELSE 5 END AS bin, s FROM o WHERE age >= 0),
  c AS (SELECT operation, bin, count(*) AS n, sum(s)::BIGINT AS successes, least(1.0, greatest(0.0, (sum(s) + 0.5) / (count(*) + 1.0) / 0.6)) AS raw FROM b GROUP BY ALL),
  runs AS (SELECT x.operation, x.bin AS j, y.bin AS k, sum(z.n * z.raw) / sum(z.n) AS mean FROM c x JOIN c y ON y.operation = x.operation AND y.bin >= x.bin JOIN c z ON z.operation = x.operation AND z.bin BETWEEN x.bin AND y.bin GROUP BY ALL),
  low AS (SELECT c.operation, c.bin, j, min(mean) AS m FROM c JOIN runs ON runs.operation = c.operation AND j <= c.bin AND k >= c.bin GROUP BY ALL), fit AS (SELECT operation, bin, max(m) AS fitted FROM low GROUP BY ALL),
  grid AS (SELECT operation, i AS bin FROM (SELECT DISTINCT operation FROM c), range(6) t(i))
  SELECT grid.operation, grid.bin::INT AS bin, coalesce(c.n, 0) AS n, coalesce(c.successes, 0) AS successes, round((SELECT arg_min(f.fitted, abs(f.bin - grid.bin) * 100 + f.bin) FROM fit f WHERE f.operation = grid.operation), 8) AS fitted FROM grid LEFT JOIN c USING (operation, bin)""")
def monotone_bins(spark, d):
    """Share of closed orders over bins of price, fitted so as not to fall."""
    rows = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("operation"), (F.col("o_totalprice") / 20000.0).alias("age"), (F.col("o_orderstatus") == "F").alias("ok"))
    return monotone.monotone_bins(rows, ["operation"], F.col("age"), F.col("ok"), _EDGES, F.lit(0.6)).withColumn("fitted", _r("fitted"))


_TABLES = """cells AS (SELECT o_orderpriority AS operation, (o_totalprice > 150000)::INT + 2 * (o_custkey % 2)::INT + 4 * (month(o_orderdate) > 6)::INT AS mask, count(*) FILTER (WHERE o_orderstatus = 'F') * 3 > count(*) AS holds FROM orders GROUP BY ALL)"""


def _truth_tables(spark, d) -> DataFrame:
    mask = (F.col("o_totalprice") > 150000).cast("int") + 2 * (F.col("o_custkey") % 2).cast("int") + 4 * (F.month("o_orderdate") > 6).cast("int")
    return _table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("operation"), mask.alias("mask")).agg((F.count_if(F.col("o_orderstatus") == "F") * 3 > F.count("*")).alias("holds"))


@query(f"""WITH {_TABLES}, m AS (SELECT i AS mask FROM range(8) t(i)) SELECT operation, m.mask, sum(CASE WHEN (bit_count(m.mask::INT) - bit_count(c.mask::INT)) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS coefficient
  FROM cells c JOIN m ON (c.mask & m.mask) = c.mask WHERE holds GROUP BY ALL HAVING sum(CASE WHEN (bit_count(m.mask::INT) - bit_count(c.mask::INT)) % 2 = 0 THEN 1 ELSE -1 END) <> 0""")
def moebius_terms(spark, d):
    """Multilinear terms of each operation's truth table over three primitives."""
    return polynomial.moebius_terms(_truth_tables(spark, d), ["operation"], 3)


@query()
def certified_targets(spark, d):
    """Which of those terms the moments of the first primitive, and of the first with the second and third, determine."""
    return polynomial.certified_targets(_truth_tables(spark, d), "operation", 3, [(1, 0, 0), (1, 1, 0), (1, 0, 1)])


@query()
def factor_likelihood(spark, d):
    """Factors of a call, of its order and of demand per operation, from signals of one, of both and of either, by maximum likelihood."""
    rows = _request_signals(spark, d).select("operation", F.col("a").alias("one"), (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("da")).alias("either"))
    model = likelihood.FactorModel({"one": (("x",),), "both": (("x", "y"),), "either": (("x",), ("z",))})
    return likelihood.fit_factors(rows, "operation", model).select("operation", "factor", "probability", "status")


# Native scans of written files with faults: a name that is missing, an end before the start, an id that is none

_FAULTS = f"""{_TAGGED}, asked AS (SELECT o_orderkey AS t, o_orderstatus AS order_status FROM orders WHERE o_orderstatus <> 'O'), faulty AS (SELECT s.*, CASE WHEN q = 50 THEN 'missing_operation_identity' WHEN tax > 0.075 AND n > 1 THEN 'missing_or_invalid_identifier' WHEN discount > 0.095 THEN 'invalid_duration_or_timestamp' END AS problem,
  q::BIGINT * 1000001 AS lasts FROM spans s)"""


def _faulty(spark, d, form: str) -> tuple[str, DataFrame]:
    """(files, expected traces): spans with faults of all orders, of which those that are not open are expected; the documents of pending ones are cut short."""
    spans = _spans(spark, d, True)
    rows = spans.withColumn("name", F.when(F.col("q") == 50, "").otherwise(F.col("name"))).withColumn("parent_id", F.when((F.col("tax") > 0.075) & (F.col("n") > 1), "no id").otherwise(F.col("parent_id"))).withColumn("end_ns", F.when(F.col("discount") > 0.095, F.col("start_ns") - 1).otherwise(F.col("end_ns")))
    orders = _table(spark, d, "orders").select(_hex("o_orderkey", 32).alias("trace_id"), "o_orderstatus")
    cut = orders.filter("o_orderstatus = 'P'").select("trace_id", F.lit(True).alias("cut"))
    return write_traces(rows, form, shared_path(spark, form), cut), orders.filter("o_orderstatus <> 'O'").select("trace_id")


def _native(spark, d, form: str) -> DataFrame:
    path, expected = _faulty(spark, d, form)
    typed, counters = native.read_native(spark, path, form, expected)
    typed = settle(typed)
    rows = typed.groupBy(F.coalesce("problem", F.lit("")).alias("what")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("problem").isNull(), F.col("duration_us"))).alias("duration_us"), F.sum(F.when(F.col("problem").isNull(), F.col("duration_remainder_ns"))).alias("remainders_ns"), F.count_if("server").alias("servers"))
    census = native.trace_census(typed, expected).groupBy(F.when(F.col("spans") + F.col("invalid") == 0, "traces unseen").when(F.col("invalid") > 0, "traces with faults").otherwise("traces whole").alias("what")).agg(F.count("*").alias("n"))
    counted = counters.select(F.explode(F.create_map(F.lit("documents"), "documents", F.lit("malformed"), "malformed")).alias("what", "n"))
    blank = {c: F.lit(None).cast("long") for c in ("duration_us", "remainders_ns", "servers")}
    return rows.unionByName(census.withColumns(blank)).unionByName(counted.withColumns(blank))


def _native_sql(nanos: bool) -> str:
    lasts = "(sum(lasts // 1000) FILTER (WHERE problem IS NULL))::BIGINT AS duration_us, (sum(lasts % 1000) FILTER (WHERE problem IS NULL))::BIGINT AS remainders_ns" if nanos else "(sum(lasts // 1000) FILTER (WHERE problem IS NULL))::BIGINT AS duration_us, (sum(0) FILTER (WHERE problem IS NULL))::BIGINT AS remainders_ns"
    return f"""WITH {_FAULTS}, seen AS (SELECT f.* FROM faulty f JOIN asked USING (t) WHERE order_status = 'F'), traces AS (SELECT a.t, count(s.n) AS k, count(s.problem) AS bad FROM asked a LEFT JOIN seen s USING (t) GROUP BY a.t)
  SELECT coalesce(problem, '') AS what, count(*) AS n, {lasts}, count(*) FILTER (WHERE NOT client) AS servers FROM seen GROUP BY problem
  UNION ALL SELECT CASE WHEN k = 0 THEN 'traces unseen' WHEN bad > 0 THEN 'traces with faults' ELSE 'traces whole' END, count(*), NULL, NULL, NULL FROM traces GROUP BY 1
  UNION ALL SELECT 'documents', count(DISTINCT t), NULL, NULL, NULL FROM faulty UNION ALL SELECT 'malformed', count(DISTINCT t), NULL, NULL, NULL FROM faulty JOIN asked USING (t) WHERE order_status = 'P'"""


@query(_native_sql(True))
def native_otlp(spark, d):
    """Typed spans of expected traces from OTLP JSON lines, what is wrong with others, and the census of traces and documents."""
    return _native(spark, d, "otlp_jsonl_v1")


@query(_native_sql(False))
def native_jaeger(spark, d):
    """The same from Jaeger documents, which count in microseconds."""
    return _native(spark, d, "jaeger_jsonl_v1")


@query(f"""WITH {_FAULTS}, seen AS (SELECT f.* FROM faulty f JOIN asked USING (t) WHERE order_status = 'F'), bad AS (SELECT count(DISTINCT t) AS n FROM faulty JOIN asked USING (t) WHERE order_status = 'P')
  SELECT 'invalid_records' AS counter, n FROM bad UNION ALL SELECT 'truncated_tails', 0 UNION ALL SELECT 'duplicate_spans', 0 UNION ALL SELECT 'unknown_replicas', count(*) FROM seen WHERE service = 's2' AND host = 2
  UNION ALL SELECT 'replica ' || CASE WHEN service = 's2' AND host = 0 THEN 'a' WHEN service = 's2' AND host = 1 THEN 'b' ELSE '-' END, count(*) FROM seen GROUP BY 1""")
def trace_evidence(spark, d):
    """The light scan: replicas of the target's spans by their host name, with its counters."""
    path, expected = _faulty(spark, d, "otlp_jsonl_v1")
    spans, counters = native.trace_evidence(spark, path, "otlp_jsonl_v1", expected, "s2", "host.name", {"host-a": "a", "host-b": "b"})
    placed = spans.groupBy(F.concat(F.lit("replica "), F.coalesce("replica", F.lit("-"))).alias("counter")).agg(F.count("*").alias("n"))
    return counters.unionByName(placed)



_DEMAND = ["reachability", "selected_replicas", "selected_replicas_and_deadline"]
_GAPS = {"reachability_minus_execution": (0, 2), "reachability_minus_selected": (0, 1), "selected_minus_execution": (1, 2)}


@query(f"""WITH {_REQUESTS}, l AS (SELECT operation, a, b, da, db, soon, count(*) AS cnt FROM req GROUP BY ALL), s AS (SELECT (i & 1) = 1 AS xa, (i & 2) = 2 AS xb, (i & 4) = 4 AS ya, (i & 8) = 8 AS yb FROM range(16) t(i)),
  f AS (SELECT l.*, (xa OR xb)::INT AS p0, ((xa OR xb) AND (ya OR yb) AND (NOT ya OR xa) AND (NOT yb OR xb))::INT AS p1, ((xa OR xb) AND (ya OR yb) AND (NOT ya OR xa) AND (NOT yb OR xb) AND soon)::INT AS p2 FROM l JOIN s ON (a IS NULL OR a = xa) AND (b IS NULL OR b = xb) AND (da IS NULL OR da = ya) AND (db IS NULL OR db = yb)),
  g AS (SELECT operation, a, b, da, db, soon, cnt, {', '.join(f'min(p{i}) AS l{i}, max(p{i}) AS u{i}' for i in range(3))}, {', '.join(f'min(p{i} - p{j}) AS l{i}{j}, max(p{i} - p{j}) AS u{i}{j}' for i, j in _GAPS.values())} FROM f GROUP BY ALL)
  SELECT operation, sum(cnt)::BIGINT AS n, {', '.join(f'sum(cnt * l{i})::BIGINT AS {n}_lower, sum(cnt * u{i})::BIGINT AS {n}_upper' for i, n in enumerate(_DEMAND))}, {', '.join(f'sum(cnt * l{i}{j})::BIGINT AS {n}_lower, sum(cnt * u{i}{j})::BIGINT AS {n}_upper' for n, (i, j) in _GAPS.items())} FROM g GROUP BY operation""")
def demand_bounds(spark, d):
    """Bounds of demand and deadline with their paired gaps."""
    return predicates.demand_bounds(_request_signals(spark, d), ["operation"], _SHOP, (predicates.Demand("shop", ("da", "db")),), "soon")


# Quality of cells: a nation's customers are a cell, orders its requests, events its health.


@query(f"""WITH {_TICKS}, h AS (SELECT user_id % 25 AS cell, CASE WHEN t // {DAY} % 2 = 0 THEN 'calibration' ELSE 'test' END AS period, t // {HOUR} AS observed_at, CASE event_type WHEN 'view' THEN 'proxy' WHEN 'click' THEN 'replica_a' WHEN 'purchase' THEN 'replica_b' END AS role, event_type = 'error' AS error, id, value FROM ticks),
  k AS (SELECT *, row_number() OVER (PARTITION BY cell, period, observed_at, role ORDER BY id) AS n FROM h), w AS (SELECT cell, period, observed_at, count(*) AS rows, count(*) FILTER (WHERE role IS NOT NULL AND n = 1) AS used, max(value) FILTER (WHERE role = 'proxy' AND n = 1) AS v FROM k GROUP BY ALL)
  SELECT cell, period, sum(rows - used + 3 - used)::BIGINT AS malformed, count(*) AS ticks, round(sum(v), 4) AS proxy_value FROM w GROUP BY ALL""")
def health_ticks(spark, d):
    """Wide health ticks an hour and cell, with the rows and roles that are malformed."""
    wide, faults = qualify.health_ticks(_health_rows(spark, d), "cell", ["value"])
    return faults.join(wide.groupBy("cell", "period").agg(_r(F.sum("proxy_value"), 4).alias("proxy_value")), ["cell", "period"])


def _health_rows(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return _ticks(spark, d).select(
        (F.col("user_id") % 25).alias("cell"), F.when(F.expr(f"t div {DAY}") % 2 == 0, "calibration").otherwise("test").alias("period"), F.expr(f"t div {HOUR}").alias("observed_at"),
        F.when(kind == "view", "proxy").when(kind.isin("click", "purchase"), "replica").alias("role"), F.when(kind == "click", "a").when(kind == "purchase", "b").alias("replica"), F.when(kind == "error", "down").alias("error"), F.col("id").alias("seq"), "value")


@query(f"""WITH {_TICKS}, o AS (SELECT c_nationkey AS cell, CASE o_orderstatus WHEN 'F' THEN 'calibration' WHEN 'P' THEN 'auxiliary' ELSE 'test' END AS period, o_orderkey AS id, o_totalprice > 100000 AS ok, o_orderpriority AS pr, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
  t AS (SELECT l_orderkey AS id, count(*) AS spans, bool_or(l_suppkey % 2 = 0) AS a, bool_or(l_suppkey % 2 = 1) AS b FROM lineitem WHERE l_quantity > 10 GROUP BY 1), x AS (SELECT o.*, pr <> '5-LOW' AS present, coalesce(spans, 0) AS spans, coalesce(a, false) AS a, coalesce(b, false) AS b FROM o LEFT JOIN t USING (id) WHERE period <> 'test'),
  f AS (SELECT cell, count(*) FILTER (WHERE present AND spans = 0) AS bare, count(*) FILTER (WHERE price > 200000) AS unjoined, count(*) FILTER (WHERE period = 'calibration' AND ok) AS s, count(*) FILTER (WHERE period = 'calibration' AND ok AND present AND price <= 200000) AS l,
    count(*) FILTER (WHERE present AND price <= 200000 AND spans = 0) AS bare_linked, (count(*) FILTER (WHERE period = 'calibration' AND a) < 60)::BIGINT + (count(*) FILTER (WHERE period = 'calibration' AND b) < 60)::BIGINT AS few, count(*) FILTER (WHERE period = 'calibration') AS n FROM x GROUP BY cell)
  SELECT cell, bare_linked AS linked_traces_without_spans, unjoined AS trace_join_mismatches, (l / nullif(s, 0)::DOUBLE < 0.5)::BIGINT AS link_share_below_minimum, few AS replicas_below_minimum, (n <> 200)::BIGINT AS learner_count_mismatches, 1::BIGINT AS denied_learner_fields, false AS usable FROM f""")
def boundary_quality(spark, d):
    """Faults of each cell's evidence; no cell is usable here, as the learner's columns name an outcome."""
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    rows = o.select(F.col("c_nationkey").alias("cell"), F.when(status == "F", "calibration").when(status == "P", "auxiliary").otherwise("test").alias("period"), F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("trace_id"),
                    (F.col("o_totalprice") > 100000).alias("success"), (F.col("o_orderpriority") != "5-LOW").alias("trace_present"), "o_totalprice")
    requests, joins = rows.drop("trace_present", "o_totalprice"), rows.filter("o_totalprice <= 200000").select("cell", "period", "request_id", "trace_present")
    spans = _table(spark, d, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("trace_id")).agg(F.count("*").alias("span_count"), F.collect_set(F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b")).alias("replicas"))
    traces = spans.join(requests.select("cell", "trace_id"), "trace_id")
    counts = requests.groupBy("cell").agg(F.count_if(F.col("period") == "auxiliary").alias("expected_auxiliary"), F.count_if(F.col("period") == "test").alias("expected_test"))
    cells = counts.select("cell", F.lit(True).alias("source_ok"), F.lit(0).alias("labels_off"), F.lit(True).alias("usable_source"), F.lit(0).alias("files_missing"), F.lit(0).alias("privileged_copied"), F.lit(200).alias("expected_learner"), "expected_auxiliary", "expected_test")
    scans = counts.select("cell", F.lit(0).alias("invalid_records"), F.lit(0).alias("duplicate_spans"), F.lit(0).alias("unknown_replicas"))
    _, faults = qualify.health_ticks(_health_rows(spark, d), "cell", ["value"])
    limits = qualify.Boundary("calibration", ("auxiliary",), least_linked=0.5, least_assignments=60, denied=("success",))
    found = qualify.boundary_quality(cells, requests, joins, traces, scans, traces.select("cell"), faults, "cell", limits, [requests])
    return found.select("cell", "linked_traces_without_spans", "trace_join_mismatches", "link_share_below_minimum", "replicas_below_minimum", "learner_count_mismatches", "denied_learner_fields", "usable")


# The request census of a bundle: orders written as CSV and loaded with its checks.

_SPLIT = "1998-07-01T00:00:00Z"
_PERIODS = {"calibration": bundle.Period("1900-01-01T00:00:00Z", _SPLIT, (1, 2, 3)), "test": bundle.Period(_SPLIT, "2100-01-01T00:00:00Z", (4, 5, 6))}


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 1 HOUR * (o_custkey % 900) AS b, o_orderdate < TIMESTAMP '1998-07-01' AS early, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice > 100000 AS ok, o_totalprice > 300000 AS slow, o_totalprice < 5000 AS odd FROM orders),
  r AS (SELECT *, CASE WHEN pr = '4-NOT SPECIFIED' THEN 'unknown_operation' WHEN early AND b > TIMESTAMP '1998-07-01' THEN 'outside_period' WHEN ok AND slow THEN 'successful_timeout' WHEN ok AND st = 'P' THEN 'outcome_not_accepted' WHEN odd THEN 'undeclared_branch' END AS problem FROM o)
  SELECT CASE WHEN early THEN 'calibration' ELSE 'test' END AS period, coalesce(problem, '') AS problem, count(*) AS n, count(*) FILTER (WHERE ok) AS successes, sum(epoch_us(b) - epoch_us(a))::BIGINT AS lasted FROM r GROUP BY ALL""")
def bundle_requests(spark, d):
    """The census of requests as a checked load reads it: what is wrong with which, and the typed times of all."""
    o = _table(spark, d, "orders")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    begun = F.col("o_orderdate").cast("timestamp")
    ended = F.timestamp_micros(F.unix_micros(begun) + F.col("o_custkey") % 900 * HOUR)
    early = begun < F.lit("1998-07-01").cast("timestamp")
    price = F.col("o_totalprice")
    rows = o.select(F.col("o_orderkey").cast("string").alias("request_id"), _hex("o_orderkey", 32).alias("trace_id"), iso(begun).alias("started_at"), iso(ended).alias("completed_at"), F.when(early, "calibration").otherwise("test").alias("period"), F.col("o_orderpriority").alias("operation_class"),
                    F.when(price < 5000, "odd").otherwise("").alias("branch_class"), F.col("o_orderstatus").alias("outcome"), F.when(price > 100000, "yes").otherwise("no").alias("success"), F.when(price > 300000, "1").otherwise("0").alias("timed_out"))
    path = shared_path(spark, "requests")
    rows.write.option("header", True).csv(path)
    rules = {p: bundle.OperationRule(("F", "O")) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")}
    found = bundle.load_requests(spark, path, _PERIODS, rules)
    return found.groupBy("period", F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"), F.count_if("success").alias("successes"), F.sum(F.unix_micros("completed_at") - F.unix_micros("started_at")).alias("lasted"))


@query("SELECT o_orderpriority AS operation, o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def sealed_census(spark, d):
    """Orders sealed by the digests of their files, opened again under the seal, and counted."""
    folder, identity = shared_path(spark, "sealed"), {"role": "census"}
    seal = sealed.seal_tables(spark, folder, identity, {"orders": _table(spark, d, "orders")})
    return sealed.open_sealed(spark, folder, identity, seal)["orders"].groupBy(F.col("o_orderpriority").alias("operation"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
