"""The entity graph as windows: degrees, sliding distinct counts, pairs, new edges, components.

Every figure is read from events strictly earlier in (t, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_by_span
from .skew import is_small, look_up

CAP = 256
#: A key's events are counted by spans of so many microseconds (a day).
SPAN = 86_400_000_000
#: Name -> (key, counted value).
DEGREES = {
    "device_customers": ("device", "customer"), "device_merchants": ("device", "merchant"), "customer_devices": ("customer", "device"), "customer_merchants": ("customer", "merchant"), "customer_bins": ("customer", "bin"),
    "merchant_customers": ("merchant", "customer"), "merchant_devices": ("merchant", "device"), "agent_merchants": ("agent", "merchant"), "agent_customers": ("agent", "customer"),
}
EDGES = (("customer", "device"), ("customer", "agent"), ("device", "agent"))


def _firsts(events: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, f): the (t, seq) of the first event with each pair of values, nulls apart."""
    there = events.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return there.groupBy(a, b).agg(F.min(F.struct("t", "seq")).alias("f"))


def capped_degrees(events: DataFrame, degrees: dict[str, tuple[str, str]] = DEGREES, cap: int = CAP, span: int = SPAN) -> DataFrame:
    """Distinct earlier values per key, at most ``cap``; null without a key.

    All degrees in one long table: the first event of each (degree, key, value) is a
    mark that counts for the key's later events, so a degree is a running sum of
    marks, and a key's rows are spread over its spans.
    """
    text = lambda c: F.col(c).cast("string")
    keys = list(dict.fromkeys(k for k, _ in degrees.values()))
    here = F.struct("t", "seq")
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("key"), text(k).alias("k"), text(v).alias("v")) for name, (k, v) in degrees.items()])
    firsts = events.select("t", "seq", F.explode(pairs).alias("x")).where("x.k is not null and x.v is not null").groupBy("x.name", "x.key", "x.k", "x.v").agg(F.min(here).alias("f"))
    marks = firsts.select("key", "k", "f.t", "f.seq", F.lit(1).alias("kind"), *[(F.col("name") == name).cast("long").alias(f"d_{name}") for name in degrees])
    reads = events.select("t", "seq", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), text(k).alias("k")) for k in keys])).alias("x")).select("x.key", "x.k", "t", "seq", F.lit(0).alias("kind"), *[F.lit(0).cast("long").alias(f"d_{name}") for name in degrees])
    swept = running_by_span(marks.unionByName(reads.where("k is not null")), ["key", "k"], F.floor(F.col("t") / span), ["t", "seq", "kind"], {name: F.col(f"d_{name}") for name in degrees}).where("kind = 0")
    nothing = events.select(F.lit(None).cast("string").alias("key"), "seq")  # events without any key have a row too
    return swept.select("key", "seq", *degrees).unionByName(nothing, allowMissingColumns=True).groupBy("seq").agg(*[F.max(F.when(F.col("key") == k, F.least(F.lit(cap).cast("long"), F.col(name)))).alias(name) for name, (k, _) in degrees.items()])


def customer_events(events: DataFrame, span: int = SPAN) -> DataFrame:
    """How many earlier events the customer had."""
    rows = events.where(F.col("customer").isNotNull()).select("seq", "t", "customer")
    return running_by_span(rows, ["customer"], F.floor(F.col("t") / span), ["t", "seq"], {"customer_events": F.lit(1)}).select("seq", "customer_events")


def pair_prior(events: DataFrame, a: str = "customer", b: str = "merchant", span: int = SPAN) -> DataFrame:
    """How often the pair occurred before."""
    rows = events.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("seq", "t", a, b)
    return running_by_span(rows, [a, b], F.floor(F.col("t") / span), ["t", "seq"], {"pair_prior": F.lit(1)}).select("seq", "pair_prior")


def new_edge_share(events: DataFrame) -> DataFrame:
    """Share of the event's identity edges that were never seen before; null without edges."""
    firsts = None
    for a, b in EDGES:
        one = _firsts(events, a, b).select(F.col("f.seq").alias("seq"))
        firsts = one if firsts is None else firsts.unionByName(one)
    new = firsts.groupBy("seq").agg(F.count("*").alias("new"))  # an event is first for three edges at most
    there = sum(((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("int") for a, b in EDGES), F.lit(0))
    share = F.when(F.col("there") > 0, F.coalesce("new", F.lit(0)).cast("double") / F.col("there"))
    return events.select("seq", there.alias("there")).join(new, "seq", "left").select("seq", share.alias("new_edge_share"))


def sliding_distinct(events: DataFrame, key: str, value: str, width: int, name: str, span: int = SPAN) -> DataFrame:
    """Distinct values of the key's earlier events with t >= now - width.

    A value enters after its first event and leaves when ``width`` has passed since
    its latest one: a running sum over entries and exits, no sets, spread over the
    key's spans of ``width``.  The neighbours in time of a pair's events are found
    within spans; those beyond a span's ends come from a row for each pair and span.
    """
    rows = events.where(F.col(key).isNotNull()).select("seq", "t", F.col(key).alias("k"), F.col(value).alias("v"))
    there = rows.where(F.col("v").isNotNull()).withColumn("s", F.floor(F.col("t") / span))
    inside = Window.partitionBy("k", "v", "s").orderBy("t", "seq")
    along = Window.partitionBy("k", "v").orderBy("s")
    ends = there.groupBy("k", "v", "s").agg(F.min("t").alias("first"), F.max("t").alias("last")).select("k", "v", "s", F.lag("last").over(along).alias("earlier"), F.lead("first").over(along).alias("later"))
    near = there.withColumn("before", F.lag("t").over(inside)).withColumn("after", F.lead("t").over(inside)).join(ends.hint("merge"), ["k", "v", "s"])
    before, after = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    marked = near.select("k", "t", "seq", (before.isNull() | (F.col("t") - before > width)).alias("enters"), (after.isNull() | (after - F.col("t") > width)).alias("leaves"))
    # Entries and exits are kept only where they are; every event reads, and what enters at it counts after it.
    moves = marked.where("enters").select("k", "t", F.lit(0).alias("kind"), "seq", F.lit(1).alias("part"), F.lit(1).alias("d"))
    moves = moves.unionByName(marked.where("leaves").select("k", (F.col("t") + width).alias("t"), F.lit(1).alias("kind"), "seq", F.lit(1).alias("part"), F.lit(-1).alias("d")))
    reads = rows.select("k", "t", F.lit(0).alias("kind"), "seq", F.lit(0).alias("part"), F.lit(0).alias("d"))
    swept = running_by_span(reads.unionByName(moves), ["k"], F.floor(F.col("t") / span), ["t", "kind", "seq", "part"], {name: F.col("d")})
    return swept.where("part = 0").select("seq", F.col(name).cast("long").alias(name))


def identity_edges(events: DataFrame) -> DataFrame:
    """(a, b) names of linked nodes: customer, device and agent of one event."""
    pairs = F.array(*[F.struct(_named(a).alias("a"), _named(b).alias("b")) for a, b in EDGES])
    return events.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a is not null and b is not null").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable, by minimum labels with pointer jumping.

    Each round is written to the shared checkpoint folder.
    """
    from corvane.plans.session import checkpointed

    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    start = both.select(F.col("a").alias("node"))
    start = (start if nodes is None else start.unionByName(nodes.select("node"))).distinct()
    labels = checkpointed(start.withColumn("component", F.col("node")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("to"))
        new = checkpointed(low.join(jump, low["low"] == jump["at"]).select("node", F.least("low", "to").alias("new"), (F.least("low", "to") != F.col("component")).alias("moved")))
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("moved").isEmpty():
            return labels


def component_sizes(events: DataFrame) -> DataFrame:
    """(component, nodes) of the identity graph."""
    found = connected_components(identity_edges(events))
    return found.groupBy("component").agg(F.count("*").alias("nodes"))


SUMS = ["component_nodes", "component_customers", "component_devices", "component_events", "component_cents", "component_declined", "component_agentic"]


def _named(c: str) -> Column:
    return F.concat(F.lit(c[0] + ":"), F.col(c).cast("string"))


def root_turns(edges: DataFrame, born: DataFrame) -> DataFrame:
    """(node, turn, root, t, seq, k): the roots that each of born(node, t, seq) has in turn under union by rank, as edges(a, b, t, seq, k) arrive in order.

    The side of ``a`` wins ties.  No replay: a component reaches rank r + 1 just
    when two of rank r meet whose first edge that is, each of the other.  So the
    components of rank r are found in rounds, all at once: every unit of rank r
    takes its first edge to another unit; two that take one edge make a unit of rank
    r + 1, named after the root of ``a``; whatever leads there by first edges joins
    it when its own first edge comes.  A node's root at a time is that of the highest
    rank to which its units have joined by then.  There are as many rounds as the
    greatest rank, at most the logarithm of the nodes, and as many turns a node.
    """
    from corvane.plans.session import checkpointed

    at = F.struct("t", "seq", "k")
    edges = checkpointed(edges.where("a <> b"))
    held = checkpointed(born.select("node", F.col("node").alias("root"), F.lit(0).alias("turn"), F.struct("t", "seq", F.lit(-1).alias("k")).alias("at")))
    few_nodes, few = is_small(held), is_small(edges)

    def named(rows: DataFrame, key: str, table: DataFrame, small: bool) -> DataFrame:
        table = table.hint("merge")  # tables grow with the nodes: none is sent to the driver and broadcast
        return rows.join(table, F.col(key) == F.col("u")).drop("u") if small else look_up(checkpointed(rows), key, table, "u")

    turns, level = held, 0
    while not edges.isEmpty():
        few = few or is_small(edges)
        both = edges.select(F.col("a").alias("unit"), at.alias("at"), F.col("b").alias("to"), F.lit(True).alias("is_a")).unionByName(edges.select(F.col("b").alias("unit"), at.alias("at"), F.col("a").alias("to"), F.lit(False).alias("is_a")))
        first = checkpointed(both.groupBy("unit").agg(F.min(F.struct("at", "to", "is_a")).alias("f")).select("unit", "f.at", "f.to", "f.is_a"))
        mutual = F.col("at") == F.col("to_at")
        found = named(first, "to", first.select(F.col("unit").alias("u"), F.col("at").alias("to_at")), few)
        units = checkpointed(found.select("unit", "at", F.when(mutual & F.col("is_a"), F.col("unit")).otherwise(F.col("to")).alias("to"), mutual.alias("done")))
        while not (left := units.where("not done")).isEmpty():  # pointers double until each ends at a named unit
            jump = units.select(F.col("unit").alias("u"), F.col("to").alias("next"), F.col("done").alias("next_done"))
            moved = named(left, "to", jump, few).select("unit", "at", F.col("next").alias("to"), F.col("next_done").alias("done"))
            units = checkpointed(units.where("done").unionByName(moved))
        level += 1
        names = units.select(F.col("unit").alias("u"), F.col("to").alias("name"), F.col("at").alias("joined"))
        # Nodes of units without an edge are final: they fall out here.
        held = checkpointed(named(held, "root", names, few_nodes).select("node", F.col("name").alias("root"), F.lit(level).alias("turn"), F.greatest("at", "joined").alias("at")))
        turns = turns.unionByName(held)
        for side in ("a", "b"):
            edges = named(edges, side, names.select("u", "name"), few).withColumn(side, F.col("name")).drop("name")
        pair = edges.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("t", "seq", "k", "a", "b")).alias("e"))
        edges = checkpointed(pair.select("e.a", "e.b", "e.t", "e.seq", "e.k"))
    along = Window.partitionBy("node").orderBy("turn")  # a row for each rank
    kept = turns.withColumn("next", F.lead("at").over(along)).where(F.col("next").isNull() | (F.col("next") > F.col("at")))
    return kept.withColumn("prior", F.lag("root").over(along)).where(F.col("prior").isNull() | (F.col("prior") != F.col("root"))).select("node", "turn", "root", "at.t", "at.seq", "at.k")


def component_roots(events: DataFrame) -> DataFrame:
    """(seq, root): the root of the customer's component after each event, as in ``component_state``."""
    return _placed(events)[0].select("seq", "root")


def _placed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the customer's root before and after each, and the nodes' turns.

    Only first edges between nodes change components (``root_turns``).  A customer's
    root at a time follows from its few turns.
    """
    from corvane.plans.session import checkpointed

    narrow = events.where(F.col("customer").isNotNull()).select("seq", "t", "customer", "device", "agent", F.col("cents").alias("component_cents"), F.col("declined").cast("long").alias("component_declined"), F.col("agent").isNotNull().cast("long").alias("component_agentic"))
    narrow = checkpointed(narrow)  # read five times
    edges = None
    for k, (a, b) in enumerate(EDGES):
        one = _firsts(narrow, a, b).select(_named(a).alias("a"), _named(b).alias("b"), F.col("f.t").alias("t"), F.col("f.seq").alias("seq"), F.lit(k).alias("k"))
        edges = one if edges is None else edges.unionByName(one)
    born = narrow.select("t", "seq", F.explode(F.array(_named("customer"), _named("device"), _named("agent"))).alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("t", "seq")).alias("f"))
    turns = checkpointed(root_turns(edges, born.select("node", "f.t", "f.seq")))
    mine = turns.where(F.col("node").startswith("c:")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "k", "root"))).alias("turns"))
    here = F.struct("t", "seq")

    def root(kept) -> Column:
        return F.element_at(F.filter("turns", lambda x: kept(F.struct(x["t"], x["seq"]))), -1)["root"]

    placed = look_up(narrow.withColumn("node", _named("customer")), "node", mine.withColumnRenamed("node", "of").hint("merge"), "of").withColumn("before", F.when(F.size(F.filter("turns", lambda x: F.struct(x["t"], x["seq"]) < here)) > 0, root(lambda at: at < here))).withColumn("root", root(lambda at: at <= here))
    return checkpointed(placed.select("seq", "t", "before", "root", F.lit(1).cast("long").alias("component_events"), "component_cents", "component_declined", "component_agentic")), turns


def component_state(events: DataFrame, span: int = SPAN) -> DataFrame:
    """The customer's component as it stood before each event, and its root after it.

    What a root holds is a running sum over what reaches it: nodes and events as
    they come, and what a lost root held of its own, once for each later root, at
    the time of the merge.
    """
    placed, turns = _placed(events)
    facts = SUMS[3:]
    nodes = turns.select("root", "t", "seq", F.lit(1).cast("long").alias("component_nodes"), F.col("node").startswith("c:").cast("long").alias("component_customers"), F.col("node").startswith("d:").cast("long").alias("component_devices"))
    own = placed.groupBy("root").agg(*[F.sum(c).alias(c) for c in facts])
    later = turns.where("turn > 0").select("node", F.col("root").alias("to"), "t", "seq").join(own.hint("merge"), F.col("node") == F.col("root")).select(F.col("to").alias("root"), "t", "seq", *facts)
    gains = nodes.unionByName(later, allowMissingColumns=True).unionByName(placed.select("root", "t", "seq", *facts), allowMissingColumns=True).withColumn("kind", F.lit(1))
    reads = placed.where("before IS NOT NULL").select(F.col("before").alias("root"), "t", "seq", F.lit(0).alias("kind"))
    rows = gains.unionByName(reads, allowMissingColumns=True).select("root", "t", "seq", "kind", *[F.col(c).alias(f"g_{c}") for c in SUMS])
    state = running_by_span(rows, ["root"], F.floor(F.col("t") / span), ["t", "seq", "kind"], {c: F.coalesce(f"g_{c}", F.lit(0)) for c in SUMS}).where("kind = 0")
    alone = {"component_nodes": 1, "component_customers": 1}
    return placed.select("seq", "root").join(state.select("seq", *SUMS).hint("merge"), "seq", "left").select("seq", *[F.coalesce(c, F.lit(alone.get(c, 0))).cast("long").alias(c) for c in SUMS], "root")


def component_features(events: DataFrame) -> DataFrame:
    """component_state with its ratios: mean amount, decline and agentic shares, events per customer."""
    s = component_state(events)
    n = F.col("component_events")

    def per(a: str, b: Column = n) -> Column:
        return F.when(b > 0, F.col(a).cast("double") / b)

    return s.select(
        "seq", "root", "component_nodes", "component_customers", "component_devices", "component_events", (per("component_cents") / 100).alias("component_amount_mean"),
        per("component_declined").alias("component_decline_ratio"), per("component_agentic").alias("component_agentic_share"), F.when(n > 0, n.cast("double") / F.col("component_customers")).alias("component_events_per_customer"),
    )


def fan_in(events: DataFrame, roots: DataFrame, width_short: int, width_long: int) -> DataFrame:
    """merchant's sliding customers and component roots (as recorded when folded), and their ratios."""
    from corvane.plans.session import checkpointed

    # Read twice by each of three counts; without the checkpoint each would find the roots again.
    rooted = checkpointed(events.select("seq", "t", "merchant", "customer").join(roots.select("seq", "root").hint("merge"), "seq", "left"))
    short, long = (sliding_distinct(rooted, "merchant", "customer", w, n) for w, n in ((width_short, "customers_24h"), (width_long, "customers_7d")))
    groups = sliding_distinct(rooted, "merchant", "root", width_long, "components_7d")
    out = short.join(long.hint("merge"), "seq").join(groups.hint("merge"), "seq")
    daily = F.col("customers_7d") / (width_long / width_short)
    return out.select("*", F.when(F.col("components_7d") > 0, F.col("customers_7d").cast("double") / F.col("components_7d")).alias("fanin_per_component"), F.when(daily > 0, F.col("customers_24h") / daily).alias("fanin_burst"))


