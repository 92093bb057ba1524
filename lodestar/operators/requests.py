"""What single spans say: protocol status, destination, replica, names; and flags that go down a span tree.

Only an explicit protocol code certifies success and only an explicit failure denies it. A span's ancestors are
followed by pointer doubling, so depth costs its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.lineage import settle

#: Attribute names of the tracing conventions.
HTTP_CODES = ("http.response.status_code", "http.status_code")
RPC_CODES = ("rpc.grpc.status_code", "rpc.response.status_code", "rpc.status_code")
PEER_NAMES = ("server.address", "net.peer.name", "peer.service")
PEER_URLS = ("url.full", "http.url")
HOST_NAMES = ("hostname", "host.name", "service.instance.id")
CLIENT_KINDS = ("3", "client", "span_kind_client")


def protocol_status(attributes: Column, error: Column) -> Column:
    """False on any error flag or failing code, true if there are codes and all succeed, else null."""
    failed, known = F.coalesce(error, F.lit(False)), F.lit(False)
    for keys, good in ((HTTP_CODES, lambda c: c.between(200, 299)), (RPC_CODES, lambda c: c == 0)):
        for key in keys:
            raw = attributes[key]
            coded = F.coalesce(raw.rlike("^[0-9]+$"), F.lit(False))
            failed, known = failed | (coded & ~F.coalesce(good(raw.try_cast("int")), F.lit(False))), known | coded
    return F.when(failed, False).when(known, True)


def is_client(kind: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(*CLIENT_KINDS), F.lit(False))


def client_destination(kind: Column, attributes: Column, declared: list[str]) -> Column:
    """The one declared name among a client span's peer names and URL hosts; null if there is none or are several."""
    names = F.array_compact(F.array(*[attributes[k] for k in PEER_NAMES], *[F.try_parse_url(attributes[k], F.lit("HOST")) for k in PEER_URLS]))
    found = F.array_intersect(names, F.array(*[F.lit(x) for x in declared]).cast("array<string>"))
    return F.when(is_client(kind) & (F.size(found) == 1), found[0])


def ignored_call(name: Column, method: Column, suffixes: list[str]) -> Column:
    """Whether a span's name or RPC method is one of ``suffixes``, or ends with one after a slash or a dot."""
    hit = F.lit(False)
    for label in (name, F.coalesce(method, F.lit(""))):
        for x in suffixes:
            hit = hit | (label == x) | label.endswith(f"/{x}") | label.endswith(f".{x}")
    return F.coalesce(hit, F.lit(False))


def replica_identity(resource: Column, label: str, replicas: dict[str, str]) -> Column:
    """(replica, reason) of a span of the target service, from its resource; ``replicas`` gives each its declared host name.

    An explicit label that is no declared replica decides against any, and so does a host name that several replicas
    share; otherwise label and host names have to agree on one.
    """
    explicit, names = resource[label], {}
    for replica, name in replicas.items():
        names.setdefault(name, []).append(replica)
    table = F.create_map(*[x for name, owners in names.items() for x in (F.lit(name), F.array(*map(F.lit, owners)))]) if names else F.create_map().cast("map<string,array<string>>")
    hosts = F.array_compact(F.array(*[table[resource[k]] for k in HOST_NAMES]))
    found = F.array_distinct(F.array_compact(F.concat(F.array(explicit), F.flatten(hosts))))
    reason = F.when(explicit.isNotNull() & ~explicit.isin(*replicas), "undeclared_explicit_replica").when(F.exists(hosts, lambda h: F.size(h) > 1), "nonunique_declared_name").when(
        F.size(found) > 1, "conflicting_native_identity").when(F.size(found) == 0, "no_exact_native_binding")
    return F.struct(F.when(reason.isNull(), F.get(found, F.lit(0))).alias("replica"), reason.alias("reason"))


def qualified_operation(name: Column, attributes: Column) -> Column:
    """The span's name with its HTTP path behind it, if there is one that the name does not have already."""
    path = F.coalesce(attributes["http.route"], attributes["url.path"], F.try_parse_url(F.coalesce(attributes["url.full"], attributes["http.url"]), F.lit("PATH")))
    return F.when(path.isNotNull() & (path != "") & ~F.contains(name, path), F.concat_ws(" ", name, path)).otherwise(name)


def database_endpoint(attributes: Column) -> Column:
    """system://address:port/database of a database call with all four, else null."""
    parts = [F.coalesce(*[attributes[k] for k in keys]) for keys in (("db.system.name", "db.system"), ("server.address", "net.peer.name"), ("server.port", "net.peer.port"), ("db.namespace", "db.name"))]
    return F.concat(parts[0], F.lit("://"), parts[1], F.lit(":"), parts[2], F.lit("/"), parts[3])


def ancestor_any(spans: DataFrame, flag: str, cyclic: str | None = None) -> DataFrame:
    """(trace_id, span_id, flag): whether a span or one above it has ``flag``.

    Each round joins every span with the span that its pointer stands at, so the pointers double their reach; those
    that have not left the largest trace by then stand in a cycle or below one. That raises, or, where ``cyclic``
    names a column for it, marks these spans.
    """
    at = settle(spans.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.coalesce(flag, F.lit(False)).alias(flag)))
    largest = at.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(largest).bit_length() + 1):
        if not at.filter("up IS NOT NULL").head(1):
            break
        top = at.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"), F.col(flag).alias("_f"))
        step = at.join(top, (at["trace_id"] == F.col("_t")) & (at["up"] == F.col("_s")), "left")
        at = settle(step.select("trace_id", "span_id", F.col("_up").alias("up"), (F.col(flag) | F.coalesce("_f", F.lit(False))).alias(flag)))
    if cyclic is None and at.filter("up IS NOT NULL").head(1):
        raise ValueError("a cycle of parents")
    return at.select("trace_id", "span_id", flag, *([F.col("up").isNotNull().alias(cyclic)] if cyclic else []))
