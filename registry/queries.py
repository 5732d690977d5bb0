"""One entry per operator; every query reads whole tables and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import values as V
from docweave.operators import expansion as E
from docweave.operators import groups as G
from docweave.operators import joins as J
from docweave.operators import pairs as P
from docweave.operators import partitions as PT
from docweave.operators import quality as Q
from docweave.operators import routing as R
from docweave.operators import stats as S
from docweave.operators import windows as W
from docweave.plans import partitioning
from docweave.plans.partitioning import Options, build_table
from docweave.session import stage, stage_dir
from docweave.sources import json_documents as JD
from docweave.sources import sinks
from docweave.sources import tables as T
from docweave.streaming import batches as B
from docweave.streaming.joins import stream_natural_join
from docweave.streaming.ledger import read_late
from registry.fixtures import K, PARTS, WINDOW, keyed, lines_with, mixed_attrs, mixed_events, places, table, universal_events, wide_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{stage_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"


def listed(col: str):
    """Array of ids as comma-joined text."""
    return F.array_join(F.transform(col, lambda d: d.cast("string")), ",")


def pair_text(col: str):
    return F.array_join(F.transform(col, lambda p: F.concat_ws("=", p["attr"], p["val"])), ";")


# --- documents, values -----------------------------------------------------------------


@query
def doc_pairs(spark, sf):
    return P.shred(mixed_events(spark, sf))


@query
def doc_values_canonical(spark, sf):
    """Null as text, trimmed text, numbers as text, a set-valued attribute."""
    part = table(spark, sf, "part")
    cells = {
        "size": F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")),
        "brand": F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")),
    }
    rows = [F.struct(F.lit(a).alias("attr"), V.canonical_value(c).alias("val")) for a, c in cells.items()]
    rows.append(F.struct(F.lit("type").alias("attr"), V.canonical_set_value(F.split("p_type", " ")).alias("val")))
    return part.select(F.col("p_partkey").alias("doc"), F.inline(F.array(*rows)))


@query
def doc_pairs_encoded(spark, sf):
    """Pairs to ``attr-val`` text and back; values may contain the separator."""
    docs = keyed(spark, sf, "orders", "o_orderkey", ["o_orderpriority", "o_orderstatus"])
    encoded = V.encode_pairs(V.map_pairs(F.col("m")))
    back = F.explode(F.arrays_zip(encoded.alias("text"), V.decode_pairs(encoded).alias("p")))
    return docs.select("doc", back.alias("_x")).select("doc", "_x.text", "_x.p.attr", "_x.p.val")


@query
def doc_maps(spark, sf):
    docs = P.to_document(P.shred(mixed_events(spark, sf)))
    return docs.select(
        "w", "doc", F.size("m").cast("bigint").alias("n_attrs"),
        F.array_join(F.transform(V.map_pairs(F.col("m")), lambda p: F.concat_ws("=", p["attr"], p["val"])), ";").alias("pairs"),
    )


@query
def doc_identity(spark, sf):
    """Documents named by origin and labelled with their stream."""
    ev = T.with_doc_id(table(spark, sf, "events"), "event_type", F.col("event_id").cast("string"))
    tagged = T.tag_stream(ev, "events")
    return tagged.select("doc", "stream", F.col("ingest_ts").isNotNull().alias("has_ingest_ts"))


@query
def doc_latest(spark, sf):
    """Several writes of one document id in a window: the last one stays."""
    docs = T.documents_from_table(
        table(spark, sf, "events"),
        "user_id",
        {"type": "event_type", "k": F.get_json_object("props", "$.k")},
        w=F.floor(F.col("event_id") / WINDOW),
        keep=["event_id"],
    )
    return P.shred(P.dedupe_documents(docs, "event_id"))


@query
def doc_neighbours(spark, sf):
    """Pair predicates between each document and the next one of its window."""
    docs = mixed_events(spark, sf)
    x = docs.select("w", F.col("doc").alias("a"), F.col("m").alias("x"))
    y = docs.select("w", (F.col("doc") - 1).alias("a"), F.col("m").alias("y"))
    ax, ay = V.map_pairs(F.col("x")), V.map_pairs(F.col("y"))
    first_x, first_y = F.try_element_at(ax, F.lit(1)), F.try_element_at(ay, F.lit(1))
    return x.join(y, ["w", "a"]).select(
        "w",
        "a",
        F.size(V.pair_overlap(F.col("x"), F.col("y"))).cast("bigint").alias("overlap"),
        V.is_doc_subset(ax, ay).alias("contained"),
        V.shares(F.col("x"), F.col("y")).alias("shares"),
        V.conflicts(F.col("x"), F.col("y")).alias("conflicts"),
        V.pair_equal(first_x, first_y).alias("first_equal"),
        V.same_attr(first_x, first_y).alias("first_same_attr"),
        V.same_val(first_x, first_y).alias("first_same_val"),
    )


def _event_json():
    return F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"),
        F.lit(',"type":"'), F.col("event_type"),
        F.lit('","user":'), F.col("user_id").cast("string"),
        F.lit(',"props":'), F.col("props"),
        F.lit(',"tags":["b","a","'), F.col("event_type"), F.lit('"],"none":null}'),
    )


def _json_files(spark, sf, layout):
    """The events as JSON files: one array per window, or one object per line."""
    path = new_folder(spark, "json")
    rows = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / WINDOW).alias("w"), _event_json().alias("value")
    )
    if layout == "array":
        # A window holds WINDOW events, so one file's text is bounded.
        body = F.array_join(F.collect_list("value"), ",")
        arrays = rows.groupBy("w").agg(F.concat(F.lit("["), body, F.lit("]")).alias("value"))
        arrays.write.partitionBy("w").text(path)
    else:
        rows.repartition(3).select("value").write.text(path)
    return path


def _json_pairs(spark, sf, layout, nested):
    docs = JD.read_json_documents(
        spark, _json_files(spark, sf, layout), layout, "event_id", nested=nested, set_attrs=("tags",)
    )
    return P.explode_pairs(docs, [F.col("doc").cast("bigint").alias("doc")], F.col("m"))


@query
def json_lines(spark, sf):
    return _json_pairs(spark, sf, "lines", "drop")


@query
def json_arrays(spark, sf):
    return _json_pairs(spark, sf, "array", "drop")


@query
def json_nested_whole(spark, sf):
    return _json_pairs(spark, sf, "array", "whole")


@query
def json_nested_flatten(spark, sf):
    return _json_pairs(spark, sf, "lines", "flatten")


@query
def json_nested_deep(spark, sf):
    """Six levels, the depth measured from the files."""
    path = new_folder(spark, "json")
    opened = "".join(f'{{"n{i}":' for i in range(1, 6))
    table(spark, sf, "orders").select(
        F.concat(
            F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"),
            F.lit('","n0":' + opened), F.lit('{"customer":'), F.col("o_custkey").cast("string"), F.lit("}" * 7),
        ).alias("value")
    ).write.text(path)
    docs = JD.read_json_documents(spark, path, "lines", "key", nested="flatten")
    return P.explode_pairs(docs, [F.col("doc").cast("bigint").alias("doc")], F.col("m"))


@query
def doc_trimmed_pairs(spark, sf):
    """Spaces around names and values fall away."""
    padded = F.array(
        F.struct(F.lit(" brand ").alias("attr"), F.concat(F.lit("\t "), F.col("p_brand"), F.lit("  ")).alias("val")),
        F.struct(F.lit("type").alias("attr"), F.concat(F.lit(" "), F.col("p_type")).alias("val")),
    )
    trimmed = V.trim_pairs(padded)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.inline(trimmed))


# --- windows ---------------------------------------------------------------------------


@query
def window_sizes(spark, sf):
    """Windows of 500 events in time order, without relying on gap-free ids."""
    ev = table(spark, sf, "events").select("event_id", "ts")
    return W.window_counts(W.count_window(ev, ["ts", "event_id"], WINDOW))


@query
def window_sizes_by_source(spark, sf):
    """Each event type counts its own windows."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return W.window_counts(W.count_window(ev, ["ts", "event_id"], 300, by=["event_type"]), "event_type")


@query
def window_sizes_sequence(spark, sf):
    return W.window_counts(W.sequence_window(table(spark, sf, "events").select("event_id"), "event_id", WINDOW))


@query
def window_sizes_time(spark, sf):
    return W.window_counts(W.time_window(table(spark, sf, "events").select("ts"), "ts", "1 day"))


# --- statistics ------------------------------------------------------------------------


@query
def attr_profile(spark, sf):
    return S.rank_attrs(S.attr_stats(mixed_events(spark, sf)))


@query
def attr_join_order(spark, sf):
    return S.join_attr_order(keyed(spark, sf, "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@query
def attr_universal(spark, sf):
    return S.universal_attrs(universal_events(spark, sf))


@query
def pair_postings(spark, sf):
    return S.pair_index(mixed_events(spark, sf), PARTS).select("w", "attr", "val", "n_docs", "block", listed("docs").alias("docs"))


@query
def attr_postings(spark, sf):
    return S.posting_lists(keyed(spark, sf, "customer", "c_custkey", ["c_nationkey", "c_mktsegment"]), PARTS).select(
        "w", "attr", "n_occurrences", "n_vals", "val", "block", listed("docs").alias("docs")
    )


@query
def doc_sorted_pairs(spark, sf):
    return S.sorted_pairs(mixed_events(spark, sf)).select("w", "doc", pair_text("pairs").alias("pairs"))


# --- expansion -------------------------------------------------------------------------


def _expansion(docs, k=K):
    return E.expansion_attrs(E.choose_expansion(S.rank_attrs(S.attr_stats(docs)), k))


@query
def expansion_plan(spark, sf):
    return E.choose_expansion(S.rank_attrs(S.attr_stats(mixed_events(spark, sf))), K)


@query
def expansion_lists(spark, sf):
    docs = mixed_events(spark, sf)
    chosen = E.choose_expansion(S.rank_attrs(S.attr_stats(docs)), 5)
    lists = E.expansion_attrs(chosen, docs.select("w").distinct())
    return lists.select("w", F.array_join("attrs", ",").alias("attrs"))


@query
def expanded_pairs(spark, sf):
    docs = mixed_events(spark, sf)
    return E.expand(docs, _expansion(docs)).select("w", "doc", "route_all", F.explode("m").alias("attr", "val"))


@query
def unexpanded_pairs(spark, sf):
    """Expansion switched off leaves documents as they are."""
    docs = mixed_events(spark, sf)
    return E.expand(docs, docs, enabled=False).select("w", "doc", "route_all", F.explode("m").alias("attr", "val"))


@query
def contracted_pairs(spark, sf):
    docs = mixed_events(spark, sf)
    lists = _expansion(docs)
    return P.shred(E.contract(E.expand(docs, lists), lists))


# --- groups and partitions -------------------------------------------------------------


@query
def eq_groups(spark, sf):
    return G.equivalence_groups(mixed_events(spark, sf))


@query
def group_order(spark, sf):
    return G.order_groups(G.equivalence_groups(mixed_events(spark, sf))).select("w", "g_attr", "g_val", "n_docs", "n_pairs", "pos")


@query
def assoc_groups(spark, sf):
    return G.association_groups(mixed_events(spark, sf))


@query
def partition_top_k(spark, sf):
    return G.top_k_groups(G.association_groups(mixed_events(spark, sf)), K)


def _local(spark, sf):
    """Groups of four shards."""
    return G.local_association_groups(mixed_events(spark, sf), 4, F.col("doc") % 4)


@query
def assoc_groups_local(spark, sf):
    return _local(spark, sf)


@query
def assoc_groups_collected(spark, sf):
    """Two runs over half the shards each, united."""
    docs = mixed_events(spark, sf)
    parts = [G.local_association_groups(docs.where(F.col("doc") % 2 == r), 4, F.col("doc") % 4) for r in (0, 1)]
    return G.collect_local_groups(*parts)


@query
def groups_deduped(spark, sf):
    return G.dedupe_group_pairs(stage(_local(spark, sf)))


@query
def groups_merged(spark, sf):
    return G.regroup_global(stage(G.dedupe_group_pairs(stage(_local(spark, sf)))), mixed_events(spark, sf))


def _groups(spark, sf):
    return stage(G.association_groups(mixed_events(spark, sf)))


@query
def partition_assign(spark, sf):
    return PT.assign_partitions(_groups(spark, sf), K).withColumn("pid", F.col("pid").cast("bigint"))


def _snake_table(spark, sf):
    groups = _groups(spark, sf)
    return stage(PT.partition_table(groups, PT.assign_partitions(groups, K, "snake")))


def _own_routes(spark, sf, docs=None):
    """Each window routed by its own table."""
    docs = mixed_events(spark, sf) if docs is None else docs
    return R.route(docs, _snake_table(spark, sf), K)


def _loads(spark, sf, table_=None):
    table_ = _snake_table(spark, sf) if table_ is None else table_
    return PT.partition_loads(R.route(mixed_events(spark, sf), table_, K), table_)


@query
def partition_table(spark, sf):
    return _snake_table(spark, sf).withColumn("pid", F.col("pid").cast("bigint"))


@query
def partition_load(spark, sf):
    return _loads(spark, sf).withColumn("pid", F.col("pid").cast("bigint"))


@query
def partition_load_idle(spark, sf):
    """Documents of one attribute: most partitions of their table get none of them."""
    few = mixed_events(spark, sf).withColumn("m", F.map_filter("m", lambda k, _: k == "grp")).where(F.size("m") > 0)
    table_ = _snake_table(spark, sf)
    return PT.partition_loads(R.route(few, table_, K), table_).withColumn("pid", F.col("pid").cast("bigint"))


@query
def partition_idle_least(spark, sf):
    """The least loaded partition where some are idle."""
    return PT.least_loaded(stage(partition_load_idle(spark, sf)))


@query
def partition_idle(spark, sf):
    return PT.least_loaded(_loads(spark, sf)).withColumn("pid", F.col("pid").cast("bigint"))


@query
def partition_quality(spark, sf):
    return PT.partition_quality(_own_routes(spark, sf))


# --- routing ---------------------------------------------------------------------------


def _next(table_or_routes):
    """Results of window w as seen by window w + 1."""
    return table_or_routes.withColumn("w", F.col("w") + 1)


def _later(docs):
    return docs.where("w >= 1")


def _long_routes(routes):
    return routes.select("w", "doc", F.explode(F.col("pids").cast("array<bigint>")).alias("pid"))


@query
def routes(spark, sf):
    return _long_routes(_own_routes(spark, sf))


@query
def routes_unseen(spark, sf):
    """Each window routed by the table of the window before it."""
    docs = _later(mixed_events(spark, sf))
    return _long_routes(R.route(docs, _next(_snake_table(spark, sf)), K))


@query
def routes_expanded(spark, sf):
    """Expanded documents routed by their composite pair alone."""
    docs = mixed_events(spark, sf)
    wide = E.expand(docs, _expansion(docs))
    groups = stage(G.association_groups(wide))
    own = PT.partition_table(groups, PT.assign_partitions(groups, K, "snake"))
    return _long_routes(R.route(wide, own, K, composite_only=True))


@query
def routes_hash_complete(spark, sf):
    """Unseen pairs sent by hash: joinable couples per window, and those that share a partition."""
    docs = _later(mixed_events(spark, sf))
    r = stage(R.route(docs, _next(_snake_table(spark, sf)), K, "hash"))
    # Partitions go with the documents into the join: a couple looks nothing up.
    met = J.natural_join(stage(docs.join(r, ["w", "doc"])), keep=("pids",))
    return met.groupBy("w").agg(
        F.count(F.lit(1)).alias("n_couples"),
        F.count_if(F.arrays_overlap("pids_a", "pids_b")).alias("n_together"),
    )


@query
def unseen_pairs(spark, sf):
    return R.unseen_counts(_later(mixed_events(spark, sf)), _next(_snake_table(spark, sf)))


def _update_inputs(spark, sf):
    docs = _later(mixed_events(spark, sf))
    own = _snake_table(spark, sf)  # of every window, for its loads and for the window after it
    old = _next(own)
    fresh = docs.join(R.update_candidates(docs, R.unseen_counts(docs, old)), ["w", "doc"], "left_semi")
    loads = _next(_loads(spark, sf, own))
    return old, stage(fresh), stage(loads)


@query
def update_documents(spark, sf):
    return _update_inputs(spark, sf)[1].select("w", "doc")


@query
def partition_update(spark, sf):
    old, fresh, loads = _update_inputs(spark, sf)
    return PT.choose_partition(old, fresh, loads).withColumn("pid", F.col("pid").cast("bigint"))


@query
def partition_updated_loads(spark, sf):
    old, fresh, loads = _update_inputs(spark, sf)
    windows = fresh.select("w").distinct()
    new = PT.update_partitions(old, fresh, loads)[1].join(windows, "w", "left_semi")
    return new.withColumn("pid", F.col("pid").cast("bigint"))


@query
def partition_updated_pairs(spark, sf):
    old, fresh, loads = _update_inputs(spark, sf)
    return PT.update_partitions(old, fresh, loads)[0].withColumn("pid", F.col("pid").cast("bigint"))


@query
def routing_profile(spark, sf):
    docs = _later(mixed_events(spark, sf))
    return R.routing_stats(R.route(docs, _next(_snake_table(spark, sf)), K))


def _drift(spark, sf):
    docs = mixed_events(spark, sf)
    tab = _snake_table(spark, sf)
    base = _next(PT.partition_quality(R.route(docs, tab, K)))
    now = PT.partition_quality(R.route(_later(docs), _next(tab), K))
    return Q.quality_check(stage(base), stage(now))


@query
def quality_drift(spark, sf):
    return _drift(spark, sf).select(
        "w", F.round("comm_pct", 6).alias("comm_pct"), F.round("load_pct", 6).alias("load_pct"),
        "comm_flag", "load_flag", "repartition",
    )


@query
def repartition_causes(spark, sf):
    return Q.repartition_counts(Q.repartition_cause(_drift(spark, sf)))


# --- joins -----------------------------------------------------------------------------


@query
def join_exact(spark, sf):
    return J.natural_join(mixed_events(spark, sf))


@query
def join_index(spark, sf):
    return J.natural_join_index(mixed_events(spark, sf))


@query
def join_universal(spark, sf):
    return J.natural_join_universal(universal_events(spark, sf))


@query
def join_partitioned(spark, sf):
    docs = stage(mixed_events(spark, sf))
    return J.natural_join_partitioned(docs, R.route(docs, build_table(docs, Options(k=K)), K))


@query
def join_partitioned_hash(spark, sf):
    """Groups of each shard, merged; pairs that no group holds go by hash."""
    docs = stage(mixed_events(spark, sf))
    options = Options(k=K, shards=4)
    return J.natural_join_partitioned(docs, R.route(docs, build_table(docs, options), K, "hash"))


@query
def join_partitioned_expanded(spark, sf):
    docs = stage(mixed_events(spark, sf))
    wide = stage(E.expand(docs, _expansion(docs)))
    routed = R.route(wide, build_table(wide, Options(k=K)), K, composite_only=True)
    return J.natural_join_partitioned(docs, routed)


@query
def join_parts(spark, sf):
    """All attributes universal: a pure equi-join."""
    return J.natural_join(keyed(spark, sf, "part", "p_partkey", ["p_brand", "p_type", "p_size"]))


@query
def join_customers(spark, sf):
    """Few values: frequent pairs, no false candidates."""
    return J.natural_join(keyed(spark, sf, "customer", "c_custkey", ["c_nationkey", "c_mktsegment"]))


@query
def join_orders(spark, sf):
    return J.natural_join(keyed(spark, sf, "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@query
def join_places(spark, sf):
    """Documents of two shapes."""
    return J.natural_join(places(spark, sf))


@query
def join_turns(spark, sf):
    """Conversation turns that share a conversation or a role without conflict."""
    turns = T.documents_from_table(
        table(spark, sf, "conversations"),
        F.concat_ws("#", "conv_id", "turn"),
        {"conv": "conv_id", "role": "role"},
        w=F.floor(F.col("conv_id") / 100),
    )
    return J.natural_join(turns)


@query
def join_shared_counts(spark, sf):
    return J.natural_join(mixed_events(spark, sf), shared=True)


@query
def join_sets(spark, sf):
    docs = mixed_events(spark, sf)
    return J.joinable_sets(J.natural_join(docs), docs, PARTS).select("w", "doc", "part", listed("partners").alias("partners"))


@query
def join_wide(spark, sf):
    """One window of all line items, eight optional attributes."""
    return J.natural_join(wide_lines(spark, sf))


@query
def join_wide_index(spark, sf):
    return J.natural_join_index(wide_lines(spark, sf))


def _hot_lines(spark, sf):
    """All order lines; each value of ``flag`` is carried by about a third of them."""
    return lines_with(spark, sf, {
        "flag": "l_returnflag",
        "item": F.when(F.col("doc") % 3 != 0, F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))),
        "order": F.when(F.col("doc") % 4 != 0, F.col("l_orderkey").cast("string")),
    })


def _hot_documents(spark, sf):
    """Lines with an item, so that few of those with the same flag agree; three in four name their order."""
    return _hot_lines(spark, sf).where(F.map_contains_key("m", "item"))


@query
def join_hot(spark, sf):
    """Pairs that a third of a window's documents carry, with attributes that tell most of them apart."""
    return J.natural_join(_hot_documents(spark, sf))


@query
def join_hot_index(spark, sf):
    return J.natural_join_index(_hot_documents(spark, sf))


@query
def join_hot_partitioned(spark, sf):
    docs = _hot_documents(spark, sf)
    return J.natural_join_partitioned(docs, R.route(docs, build_table(docs, Options(k=K)), K))


@query
def join_hot_sets(spark, sf):
    docs = _hot_documents(spark, sf)
    return J.joinable_sets(J.natural_join(docs), docs, PARTS).select("w", "doc", "part", listed("partners").alias("partners"))


@query
def join_wide_sets(spark, sf):
    docs = wide_lines(spark, sf)
    sets = J.joinable_sets(J.natural_join(docs), docs, PARTS)
    return sets.select("w", "doc", "part", listed("partners").alias("partners"))


@query
def join_csv(spark, sf):
    """Partner sets written as ``|``-separated text and read back."""
    docs = mixed_events(spark, sf)
    path = new_folder(spark, "csv")
    sinks.write_joinable_csv(J.joinable_sets(J.natural_join(docs), docs), path)
    return spark.read.csv(path, sep="|", header=True).withColumn("w", F.col("w").cast("bigint"))


@query
def join_table(spark, sf):
    """Couples written as a table per window and read back."""
    path = new_folder(spark, "pairs")
    sinks.write_pairs(J.natural_join(mixed_events(spark, sf)), path)
    return spark.read.parquet(path).withColumn("w", F.col("w").cast("bigint"))


@query
def join_probe(spark, sf):
    """Partners of every document, looked up rather than self-joined."""
    docs = mixed_events(spark, sf)
    return J.joinable_with(docs, docs)


@query
def join_merged(spark, sf):
    docs = keyed(spark, sf, "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])
    merged = J.merged_documents(J.natural_join(docs), docs)
    return merged.select("w", "a", "b", F.explode("m").alias("attr", "val"))


@query
def set_ops(spark, sf):
    """Pairs of documents with and without a user: united, in both, in the first only."""
    docs = mixed_events(spark, sf)
    has_user = F.map_contains_key("m", "user")
    known, unknown = (P.shred(docs.where(c)).select("w", "attr", "val") for c in (has_user, ~has_user))
    named = [
        ("union", P.pair_union(known, unknown)),
        ("both", P.pair_intersection(known, unknown)),
        ("first", P.pair_difference(known, unknown)),
    ]
    out = [df.withColumn("op", F.lit(op)) for op, df in named]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- streams ---------------------------------------------------------------------------


def _event_stream(spark, sf, files):
    """The events as a folder of files read one per micro-batch."""
    ev = table(spark, sf, "events")
    path = new_folder(spark, "stream")
    ev.repartition(files).write.parquet(path)
    return JD.stream_table(spark, path, ev.schema, max_files=1)


def _timed_stream(spark, sf, parts):
    """The events in files of later and later times, written and read one after another."""
    ev = table(spark, sf, "events").withColumn("at", F.unix_micros(W.utc_instant(F.col("ts"))))
    ends = [float("-inf"), *ev.approxQuantile("at", [k / parts for k in range(1, parts)], 0.01), float("inf")]
    path = new_folder(spark, "stream")
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        some = ev.where((F.col("at") >= low) & (F.col("at") < high)).drop("at")
        some.coalesce(1).write.mode("append").parquet(path)
    return JD.stream_table(spark, path, ev.drop("at").schema, max_files=1)


def _stream_join(spark, sf, core, cells=None):
    # State partitions are fixed when a stream first starts; one per core suits this input.  In a
    # session of its own the setting is no other job's.
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    docs = T.documents_from_table(
        _timed_stream(own, sf, 2), "event_id", mixed_attrs(), keep=["ts"]
    ).withColumn("ts", W.utc_instant(F.col("ts")))
    path = new_folder(spark, "out")
    joined = stream_natural_join(docs, "1 day", "1 hour", core, cells)
    sinks.stream_pairs(joined, f"{path}/rows", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query
def stream_join(spark, sf):
    """Stream-stream join over one-day windows with frequent attributes as keys."""
    return _stream_join(spark, sf, ("event_type", "grp"))


@query
def stream_join_index(spark, sf):
    """The same through shared pairs only, the state of frequent ones in cells."""
    return _stream_join(spark, sf, (), {"event_type": 4, "grp": 4})


@query
def stream_batches(spark, sf):
    """Micro-batches that each hold parts of every window."""
    docs = T.documents_from_table(
        _event_stream(spark, sf, 3), "event_id", mixed_attrs(), w=F.floor(F.col("event_id") / WINDOW)
    )
    path = new_folder(spark, "batches")
    B.stream_window_join(docs, path).awaitTermination()
    return B.read_couples(spark, path)


def _event_files(spark, sf, parts):
    """The events as a folder of files, written and read one after another, one per micro-batch."""
    ev = table(spark, sf, "events")
    path = new_folder(spark, "stream")
    for part in range(parts):
        ev.where(_file_of(sf, ev, parts) == part).coalesce(1).write.mode("append").parquet(path)
    return JD.stream_table(spark, path, ev.schema, max_files=1)


def _file_of(sf, ev, parts):
    """Files hold ranges of ids that do not end where windows do; some early events come in the last."""
    i, n = F.col("event_id"), ev.count()
    late = (i < 2 * WINDOW) & (i % 10 == 3)
    return F.when(late, parts - 1).otherwise(F.floor(i * parts / n)).cast("int")


def _windowed_stream(spark, sf, window, parts):
    return T.documents_from_table(
        _event_files(spark, sf, parts), "event_id", mixed_attrs(), w=F.floor(F.col("event_id") / window)
    )


@query
def stream_partitioned(spark, sf):
    """Adaptive partition tables over windows of 2,500 events that come in several batches each.

    The delay is more than the rows out of order take, so no row is late.
    """
    docs = _windowed_stream(spark, sf, 2500, 5)
    path, delay = new_folder(spark, "partitioned"), table(spark, sf, "events").count() // 2500
    B.stream_partitioned_join(docs, path, Options(k=K), delay=delay).awaitTermination()
    B.end_windows(docs, path, Options(k=K))
    return B.read_couples(spark, path)


def _watched():
    """Tables that only a failed check changes."""
    return Options(k=K, load="snake", update=False)


def _plan(rows):
    return rows.select("w", "version", "rebuilt", "n_docs", "max_load", F.round("avg_comm", 9).alias("avg_comm"), "cause")


@query
def repartition_plan(spark, sf):
    """Which version of the partition table serves which window, and why the next one gets another."""
    return _plan(partitioning.repartition_plan(mixed_events(spark, sf), _watched()))


def _watched_stream(spark, sf):
    """Where the stream of events was served whose batches do not end where windows do."""
    ev = table(spark, sf, "events")
    source, path, n = new_folder(spark, "stream"), new_folder(spark, "plans"), ev.count()
    for part in range(3):
        ev.where(F.floor(F.col("event_id") * 3 / n) == part).coalesce(1).write.mode("append").parquet(source)
    docs = T.documents_from_table(
        JD.stream_table(spark, source, ev.schema, max_files=1), "event_id", mixed_attrs(), w=F.floor(F.col("event_id") / WINDOW)
    )
    B.stream_partitioned_join(docs, path, _watched()).awaitTermination()
    B.end_windows(docs, path, _watched())
    return path


@query
def stream_plans(spark, sf):
    """The same decided on a stream."""
    return _plan(B.read_plans(spark, _watched_stream(spark, sf)))


@query
def stream_routes(spark, sf):
    """Where the documents of a stream go, those that came before the first table included, each once."""
    return _long_routes(B.read_routes(spark, _watched_stream(spark, sf)))


@query
def stream_late(spark, sf):
    """Couples of a stream that forgets closed windows, and the documents that came after that."""
    docs = _windowed_stream(spark, sf, WINDOW, 3)
    path = new_folder(spark, "late")
    B.stream_window_join(docs, path, delay=0).awaitTermination()
    late = read_late(spark, path).select("w", F.col("doc").cast("bigint").alias("a"), F.col("doc").cast("bigint").alias("b"))
    return B.read_couples(spark, path).withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


@query
def stream_json(spark, sf):
    """A folder of JSON files, read as a stream and joined per window."""
    path = _json_files(spark, sf, "lines")
    docs = JD.stream_documents(spark, path, 1, "lines", "event_id", set_attrs=("tags",))
    docs = docs.withColumn("doc", F.col("doc").cast("bigint")).withColumn("w", F.floor(F.col("doc") / WINDOW))
    out = new_folder(spark, "json-stream")
    B.stream_window_join(docs, out).awaitTermination()
    return B.read_couples(spark, out)
