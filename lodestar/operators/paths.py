"""Products along the parents of a tree, and what is built on them: caller contexts, forests, components of cycles.

``climb`` multiplies each node's value with those of all nodes above it by pointer doubling: in every round a node
takes over the product and the pointer of the node that its pointer stands at, so a chain of any depth costs its
logarithm in rounds, each one join. The product has to be associative; it need not commute.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.lineage import settle

#: Nodes of the largest group whose ways are looked up in a list; a node looks at the list once for each node above it.
SMALL = 64


def climb(nodes: DataFrame, keys: list[str], node: str, up: str, value: str, product: Callable[[Column, Column], Column], cyclic: str | None = None, carry: list[str] = ()) -> DataFrame:
    """(keys, node, up, value, carry): the product from the top down to each node, and the first id above that is no node.

    ``up`` is null where the way ends at a node without a parent. A node in a cycle or below one raises; where
    ``cyclic`` names a column for it, it is marked instead, and its value is a product over at least the whole cycle.
    ``carry`` are columns that stay as they are. Nodes of a group of ``keys`` with up to SMALL of them are dealt out by
    it and look the ways up in a list of the group; only larger groups are doubled by joins.
    """
    if not keys:
        at = _doubled(nodes.select(node, up, value, *carry), keys, node, up, value, product, carry)
    else:
        group = Window.partitionBy(*keys)
        rows = nodes.select(*keys, node, up, value, *carry).repartition(*keys).withColumn("_large", F.count("*").over(group) > SMALL)
        listed = F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], ~F.col("_large")), F.struct(F.col(node).alias("node"), F.col(up).alias("up"), F.col(value).alias("value")))
        rows = rows.withColumn("_list", F.collect_list(listed).over(group))
        place = lambda at: (F.array_position(F.col("_list.node"), at) - 1).cast("int")

        def higher(at, _):
            i = place(at["up"])
            found = F.coalesce(i >= 0, F.lit(False))
            return F.struct(F.when(found, F.get(F.col("_list.up"), i)).otherwise(at["up"]).alias("up"), F.when(found, product(F.get(F.col("_list.value"), i), at["value"])).otherwise(at["value"]).alias("value"))

        way = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("_list"), F.lit(1))), F.struct(F.col(up).alias("up"), F.col(value).alias("value")), higher)
        rows = rows.withColumn("_way", F.when(~F.col("_large"), way))
        moves = ~F.col("_large") & F.coalesce(place(F.col("_way.up")) >= 0, F.lit(False))
        at = settle(rows.select(*keys, node, F.when(F.col("_large"), F.col(up)).otherwise(F.col("_way.up")).alias(up), F.when(F.col("_large"), F.col(value)).otherwise(F.col("_way.value")).alias(value), *carry, moves.alias("_moves"), "_large"))
        if at.filter("_large").head(1):
            large = _doubled(at.filter("_large").drop("_large", "_moves"), keys, node, up, value, product, carry)
            at = at.filter("NOT _large").drop("_large").unionByName(large)
        else:
            at = at.drop("_large")
    if cyclic is None:
        if at.filter("_moves").head(1):
            raise ValueError("a cycle of parents")
        return at.drop("_moves")
    return at.withColumnRenamed("_moves", cyclic)


def _doubled(nodes: DataFrame, keys: list[str], node: str, up: str, value: str, product: Callable[[Column, Column], Column], carry: list[str] = ()) -> DataFrame:
    """``climb`` by pointer doubling, with _moves where a way has no end."""
    at = settle(nodes.select(*keys, node, up, value, *carry, F.col(up).isNotNull().alias("_moves")))
    size = at.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else at.count()
    for _ in range(int(size or 0).bit_length() + 1):
        if not at.filter("_moves").head(1):
            break
        above = at.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(node).alias("_node"), F.col(up).alias("_up"), F.col(value).alias("_value"))
        same = F.col(up) == F.col("_node")
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"_k{i}"))
        step, found = at.join(above, same, "left"), F.col("_node").isNotNull()
        at = settle(step.select(*keys, node, F.when(found, F.col("_up")).otherwise(F.col(up)).alias(up), F.when(found, product(F.col("_value"), F.col(value))).otherwise(F.col(value)).alias(value), *carry, (found & F.col("_up").isNotNull()).alias("_moves")))
    return at


def digest(version: str, *parts: Column, length: int) -> Column:
    """The first digits of SHA-256 over the JSON array of a version and the parts; arrays are laid flat."""
    return F.substring(F.sha2(F.to_json(F.flatten(F.array(F.array(F.lit(version)), *parts))), 256), 1, length)


def caller_contexts(spans: DataFrame, version: str = "full-caller-context-1") -> DataFrame:
    """(trace_id, span_id, parent_id, service, operation, error, root, path, context) of every span of whole traces.

    ``spans`` has (trace_id, span_id, parent_id, service, operation, error). The path is the operations from the root
    down to the span, and the context is named by its digest. Repeated spans, cycles and missing parents raise: a path
    that is not known whole names no context.
    """
    rows = spans.select("trace_id", "span_id", "parent_id", F.col("parent_id").alias("above"), "service", "operation", "error", F.struct(F.array("operation").alias("path"), F.col("span_id").alias("root")).alias("way"))
    rows = rows.repartition("trace_id").withColumn("repeats", F.count("*").over(Window.partitionBy("trace_id", "span_id")))
    ways = climb(rows, ["trace_id"], "span_id", "above", "way", lambda top, own: F.struct(F.concat(top["path"], own["path"]).alias("path"), top["root"].alias("root")), "cyclic", ["parent_id", "service", "operation", "error", "repeats"])
    for holds, what in (("repeats > 1", "a span that occurs twice"), ("cyclic", "a cycle of parents"), ("above IS NOT NULL", "a missing parent")):
        if ways.filter(holds).head(1):
            raise ValueError(what)
    return ways.select("trace_id", "span_id", "parent_id", "service", "operation", "error", "way.root", "way.path", F.concat(F.lit("operation_"), digest(version, F.col("way.path"), length=24)).alias("context"))


def context_operations(contexts: DataFrame) -> DataFrame:
    """Per context: invocations, errors, how errors of callees relate to them, and the two failure shares.

    The local share is null where every invocation had a failing callee; a context is compatible with propagation if
    no invocation succeeded over a failing callee. A context of two services raises.
    """
    failed = contexts.filter("error").select("trace_id", F.col("parent_id").alias("span_id")).filter("span_id IS NOT NULL").distinct().withColumn("child_error", F.lit(True))
    rows = contexts.select("trace_id", "span_id", "context", "service", "operation", "error", F.size("path").alias("depth")).join(failed, ["trace_id", "span_id"], "left").withColumn("child_error", F.coalesce("child_error", F.lit(False)))
    local = rows.groupBy("context").agg(
        F.min("service").alias("service"), F.max("service").alias("_other"), F.min("depth").alias("depth"), F.min("operation").alias("operation"), F.count("*").alias("invocations"), F.count_if("error").alias("inclusive_errors"),
        F.count_if(F.col("child_error") & ~F.col("error")).alias("child_error_parent_success"), F.count_if(~F.col("child_error")).alias("no_child_error_invocations"), F.count_if(F.col("error") & ~F.col("child_error")).alias("local_errors"))
    one = F.when(F.col("service") == F.col("_other"), F.col("service")).otherwise(F.raise_error(F.lit("a context of two services")))
    share = F.when(F.col("no_child_error_invocations") > 0, F.col("local_errors") / F.col("no_child_error_invocations"))
    return local.select("context", "operation", one.alias("service"), F.col("depth").cast("long").alias("depth"), "invocations", "inclusive_errors", "child_error_parent_success", "no_child_error_invocations", "local_errors",
                        (F.col("inclusive_errors") / F.col("invocations")).alias("inclusive_probability"), share.alias("local_probability"), (F.col("child_error_parent_success") == 0).alias("propagates"))


def context_edges(contexts: DataFrame) -> DataFrame:
    """(caller, callee, calls) between contexts; a root's caller is null. Paths grow along edges, so there is no cycle."""
    callers = contexts.select("trace_id", F.col("span_id").alias("parent_id"), F.col("context").alias("caller"))
    return contexts.join(callers, ["trace_id", "parent_id"], "left").groupBy("caller", F.col("context").alias("callee")).agg(F.count("*").alias("calls"))


def unrepeated(spans: DataFrame, content: list[str]) -> DataFrame:
    """One row a span with its number of repeats; repeats that differ in ``content`` raise."""
    rows = spans.groupBy("trace_id", "span_id").agg(*[F.first(c).alias(c) for c in content], F.count("*").alias("_n"), F.min(F.xxhash64(*content)).alias("_a"), F.max(F.xxhash64(*content)).alias("_b"))
    fine = F.when(F.col("_a") == F.col("_b"), F.col("_n") - 1).otherwise(F.raise_error(F.lit("a span that occurs twice with different content")))
    return rows.withColumn("repeats", fine).drop("_n", "_a", "_b")


def server_forest(spans: DataFrame, version: str = "server-forest-1") -> DataFrame:
    """(trace_id, span_id, ancestor, root, tree_id, contracted, missing_parent) of every server span.

    ``spans`` has (trace_id, span_id, parent_id, server) without repeats. A server's ancestor is the next server above
    it; the spans passed over are counted. Where the way up ends at a span that is not in the trace, that one is named
    and the server is a root of its own tree. Cycles raise.
    """
    spans = settle(spans.select("trace_id", "span_id", "parent_id", "server"))
    others = climb(spans.filter("NOT server").withColumn("hops", F.lit(1).cast("long")), ["trace_id"], "span_id", "parent_id", "hops", lambda top, own: top + own)
    passed = others.select("trace_id", F.col("span_id").alias("parent_id"), F.col("parent_id").alias("_up"), "hops", F.lit(True).alias("_passed"))
    servers = spans.filter("server").join(passed, ["trace_id", "parent_id"], "left")
    servers = servers.select("trace_id", "span_id", F.when(F.col("_passed"), F.col("_up")).otherwise(F.col("parent_id")).alias("above"), F.coalesce("hops", F.lit(0)).alias("contracted"))
    known = spans.filter("server").select("trace_id", F.col("span_id").alias("above"), F.lit(True).alias("_known"))
    servers = settle(servers.join(known, ["trace_id", "above"], "left").select("trace_id", "span_id", "contracted", F.when(F.col("_known"), F.col("above")).alias("ancestor"), F.when(F.col("_known").isNull(), F.col("above")).alias("missing_parent")))
    roots = climb(servers.select("trace_id", "span_id", "ancestor", F.col("span_id").alias("root")), ["trace_id"], "span_id", "ancestor", "root", lambda top, own: top)
    named = roots.select("trace_id", "span_id", "root", digest(version, F.array(F.col("trace_id").cast("string"), F.col("root").cast("string")), length=32).alias("tree_id"))
    return servers.join(named, ["trace_id", "span_id"])


def forest_audit(spans: DataFrame, forest: DataFrame) -> DataFrame:
    """(trace_id, unique_spans, repeats, servers, trees, missing_parent_roots, whole_tree) of every trace of ``unrepeated`` spans."""
    spread = spans.groupBy("trace_id").agg(F.count("*").alias("unique_spans"), F.sum("repeats").alias("repeats"))
    trees = forest.groupBy("trace_id").agg(F.count("*").alias("servers"), F.count_if(F.col("ancestor").isNull()).alias("trees"), F.count("missing_parent").alias("missing_parent_roots"))
    rows = spread.join(trees, "trace_id", "left").fillna(0, ["servers", "trees", "missing_parent_roots"])
    return rows.withColumn("whole_tree", (F.col("trees") == 1) & (F.col("missing_parent_roots") == 0))


# Components of cycles


def _drop_ends(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have one coming in and one going out; the others lie on no cycle."""
    heads, tails = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    return settle(edges.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b"))


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chains, rings) after every run of nodes with one edge in and one out has become a single edge.

    Chains are (node, a, b): the node lies between a and b, and on a cycle just if they share one. Rings are (node,
    component): nodes of a cycle with nothing else on it.
    """
    out, into = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")), edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a"))
    inner = settle(out.filter("n = 1").select(F.col("a").alias("node"), F.col("b").alias("next")).join(into.filter("n = 1").select(F.col("b").alias("node"), F.col("a").alias("last")), "node"))
    least = lambda top, own: F.least(top, own)
    ahead = climb(inner.withColumn("least", F.col("node")), [], "node", "next", "least", least, "ring")
    behind = climb(inner.withColumn("least", F.col("node")), [], "node", "last", "least", least, "ring")
    rings = ahead.filter("ring").select("node", F.col("least").alias("component"))
    chains = settle(ahead.filter("NOT ring").select("node", F.col("next").alias("b")).join(behind.select("node", F.col("last").alias("a")), "node").select("node", "a", "b"))
    removed = inner.select("node")
    kept = edges.join(removed.withColumnRenamed("node", "a"), "a", "left_anti").join(removed.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    return settle(kept.unionByName(chains.select("a", "b")).distinct()), chains, rings


def _spread(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``nodes`` (node, label) after every node has taken the largest label of all that lead to it."""
    while True:
        told = edges.join(nodes.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max(label).alias("_told"))
        step = nodes.join(told, "node", "left").select("node", F.greatest(label, "_told").alias(label), (F.col("_told") > F.col(label)).alias("_new"))
        step = settle(step)
        nodes = step.drop("_new")
        if not step.filter("_new").head(1):
            return nodes


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that lie on a cycle of the edges (a, b): the smallest node of the component.

    Ends are trimmed and runs contracted by pointer doubling until neither changes anything, which takes long paths
    and cycles away in a few rounds. What is left is coloured: each node takes the largest node that reaches it, and
    whoever of a colour reaches that node back is its component; those are taken out, and the rest goes on. The rounds
    of the colouring are as many as the longest way in what is left. Nothing of the size of the reachable pairs is made.
    """
    edges = settle(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    rings, records = [], []  # records of loops and chains, in the order in which they were taken out

    def simple(e: DataFrame) -> DataFrame:
        records.append((None, e.filter("a = b").select(F.col("a").alias("node"))))
        return settle(e.filter("a <> b"))

    def reduced(e: DataFrame) -> DataFrame:
        before = e.count()
        while before:
            e, chains, ring = _contract(_drop_ends(e))
            records.append((chains, None))
            rings.append(ring)
            e = simple(e)
            after = e.count()
            if after == before:
                break
            before = after
        return e

    left, parts = reduced(simple(edges)), []
    while left.head(1):
        nodes = settle(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("colour", F.col("node")))
        coloured = _spread(nodes, left, "colour")
        ends = left.join(coloured.select(F.col("node").alias("a"), F.col("colour").alias("_x")), "a").join(coloured.select(F.col("node").alias("b"), F.col("colour").alias("_y")), "b").filter("_x = _y")
        # Backwards from each colour's own node, within the colour.
        marked = _spread(settle(coloured.select("node", (F.col("node") == F.col("colour")).cast("int").alias("back"))), settle(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), "back")
        found = settle(marked.filter("back = 1").select("node").join(coloured, "node").select("node", F.col("colour").alias("component")))
        parts.append(found)
        gone = found.select("node")
        left = reduced(settle(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")))
    empty = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    known = empty
    for p in [*parts, *rings]:
        known = known.unionByName(p)
    # A coloured component of one node is none, unless the node leads to itself.
    sizes = known.groupBy("component").count().filter("count > 1").select("component")
    known = settle(known.join(sizes, "component", "left_semi").select("node", "component"))
    # Backwards, so that both ends of a chain are settled before the chain, and a node that was in one before its own loop.
    for chains, looped in reversed(records):
        if chains is None:
            more = looped.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
        else:
            side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
            more = chains.join(side("a"), "a").join(side("b"), "b").filter("_a = _b").select("node", F.col("_a").alias("component"))
        if more.head(1):
            known = settle(known.unionByName(more))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))
