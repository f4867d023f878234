"""Problem 6: conversations put together from message rows, by topological order of the reply graph.

Kahn's algorithm takes messages without an open predecessor in layers, lowest id first within a
layer; what is left over when no layer can be taken lies on a cycle, which breaks its ticket. Two
things keep its graphs small. Turns go by time first, so only replies to a message of the same
instant bear on the order, and that is sought in one graph for each ticket and instant with such
replies. And a cycle of replies either lies within an instant or holds a reply to a later message,
so the whole reply graph is only gone through for tickets with such a reply. Everything else is done by
aggregation, so that a ticket that holds a large share of all rows is never gathered: turns are
numbered within a ticket's day and shifted by the counts of its days before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meterlark.session import durable

#: Names of roles; a prefix of at least three letters reads as the name.
ROLES = {"customer": ("customers", "users", "clients"), "agent": ("agents", "supports", "supporters", "staff", "assistants"), "system": ("systems", "bots", "automatic", "automated")}
#: Abbreviations that are no prefix.
SHORT = {"customer": ("usr", "cst", "cstmr", "clnt"), "agent": ("agt", "spt", "supt", "stf", "asst"), "system": ("sysm", "bt")}
#: Messages of one instant that Kahn's algorithm takes in one piece; larger groups go by pointer doubling.
PIECE = 10_000


def readings(name: str) -> list[str]:
    """The words that read as a role."""
    return sorted({w[:n] for w in ROLES[name] for n in range(3, len(w) + 1)} | set(SHORT[name]))


def role(raw: Column) -> Column:
    """customer, agent, system or null: ignoring case, outer space and abbreviation."""
    word = F.regexp_replace(F.lower(raw), r"^[\s\p{Z}]+|[\s\p{Z}.]+$", "")
    out = F
    for name in ROLES:
        out = out.when(word.isin(readings(name)), name)
    return out


def _kahn(groups: DataFrame) -> DataFrame:
    """(message_id, layer) of groups (nodes: array of (id, parent)); layer is null on a cycle or behind one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, layers = [], []
            for nodes in batch.column(0).to_pylist():
                parent = {n["id"]: n["parent"] for n in nodes}
                replies: dict[int, list[int]] = {}
                open_ = dict.fromkeys(parent, 0)
                for node, p in parent.items():
                    if p is not None:
                        replies.setdefault(p, []).append(node)
                        open_[node] += 1
                front, layer = [n for n, k in open_.items() if k == 0], 0
                while front:
                    following = []
                    for n in front:
                        ids.append(n)
                        layers.append(layer)
                        del open_[n]
                        for r in replies.get(n, ()):
                            open_[r] -= 1
                            if open_[r] == 0:
                                following.append(r)
                    front, layer = following, layer + 1
                for n in open_:  # left over: a cycle
                    ids.append(n)
                    layers.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(layers, pa.int64())], ["message_id", "layer"])

    return groups.mapInArrow(run, "message_id long, layer long")


def _doubling(edges: DataFrame) -> DataFrame:
    """The same layers for nodes (message_id, parent) too many for one piece: each round doubles the steps every node looks up."""
    state = durable(edges.select("message_id", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("layer")))
    rounds = max(1, int(state.count()).bit_length())
    for _ in range(rounds):
        up = state.select(F.col("message_id").alias("above"), F.col("above").alias("next"), F.col("layer").alias("more"))
        state = durable(state.join(up, "above", "left").select("message_id", F.col("next").alias("above"), (F.col("layer") + F.coalesce("more", F.lit(0))).alias("layer")))
        if state.filter("above IS NOT NULL").isEmpty():
            break
    return state.select("message_id", F.when(F.col("above").isNull(), F.col("layer")).alias("layer"))


def turns(messages: DataFrame) -> DataFrame:
    """(ticket_id, turn_no, message_id, role, repeats): the turns of every ticket that is whole.

    ``repeats`` tells where roles don't alternate: the last turn before, system messages aside, was of
    the same role. It drops no ticket; a system message doesn't repeat.

    ``messages`` has message_id, ticket_id, author_role, reply_to, body and sent_at; other columns
    don't matter. Rows equal in all but message_id are one message with its lowest id, and a reply
    to any of them is a reply to it. A ticket is dropped if a message has no time, no readable role
    or replies to none of the ticket's messages, if replies run in a circle, or if, without system
    messages, it doesn't begin with a customer and end with an agent; a message whose body is null or blank counts for the first group of reasons only. Rows without a ticket
    belong to none. At equal times a message follows the one it replies to, else the lower id goes
    first. An empty table, or one without a whole ticket, gives an empty table.
    """
    same = ["ticket_id", "author_role", "body", "sent_at", "reply_to"]
    cols = messages.filter(F.col("ticket_id").isNotNull() & F.col("message_id").isNotNull()).select("message_id", *same)
    rows = durable(
        cols.withColumn("first", F.min("message_id").over(W.partitionBy(*same)))
        .select("ticket_id", "message_id", "first", "sent_at", "reply_to", role(F.col("author_role")).alias("role"), (F.col("body").isNull() | F.col("body").rlike(r"^[\s\p{Z}]*$")).alias("blank"))
        .dropDuplicates(["ticket_id", "message_id", "first"])
    )
    ids = rows.select("ticket_id", F.col("message_id").alias("reply_to"), F.col("first").alias("parent"), F.col("sent_at").alias("parent_at"))
    unique = rows.filter("message_id = first").drop("first")
    m = durable(unique.join(ids, ["ticket_id", "reply_to"], "left"))

    inner = m.withColumn("parent", F.when(F.col("parent_at") == F.col("sent_at"), F.col("parent")))
    groups = inner.groupBy("ticket_id", "sent_at").agg(F.count("*").alias("n"), F.count("parent").alias("links")).filter("links > 0 AND sent_at IS NOT NULL")
    sized = inner.join(groups, ["ticket_id", "sent_at"])
    small = sized.filter(F.col("n") <= PIECE).groupBy("ticket_id", "sent_at").agg(F.collect_list(F.struct(F.col("message_id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"))).alias("nodes"))
    layers = _kahn(small.select("nodes"))
    large = sized.filter(F.col("n") > PIECE).select("message_id", "parent")
    if not groups.filter(F.col("n") > PIECE).isEmpty():
        layers = layers.unionByName(_doubling(large))
    layers = layers.withColumn("ordered", F.lit(True))

    forward = m.filter("parent_at > sent_at").select("ticket_id").distinct()
    circles = None
    if not forward.isEmpty():
        graph = m.join(forward, "ticket_id", "left_semi").select("ticket_id", "message_id", "parent")
        sizes = graph.groupBy("ticket_id").agg(F.count("*").alias("n"))
        graph = durable(graph.join(sizes, "ticket_id"))
        gathered = graph.filter(F.col("n") <= PIECE).groupBy("ticket_id").agg(F.collect_list(F.struct(F.col("message_id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"))).alias("nodes"))
        left = _kahn(gathered.select("nodes"))
        if not graph.filter(F.col("n") > PIECE).isEmpty():
            left = left.unionByName(_doubling(graph.filter(F.col("n") > PIECE).select("message_id", "parent")))
        circles = durable(graph.join(left.filter("layer IS NULL").select("message_id"), "message_id", "left_semi").select("ticket_id").distinct())

    placed = m.join(layers, "message_id", "left").select(
        "ticket_id", "message_id", "sent_at", "role", "blank",
        F.coalesce("layer", F.lit(0)).alias("layer"),
        (F.col("sent_at").isNull() | F.col("role").isNull() | (F.col("reply_to").isNotNull() & F.col("parent").isNull()) | (F.col("ordered") & F.col("layer").isNull())).alias("broken"),
    )
    placed = durable(placed)
    spoken = ~F.col("blank") & (F.col("role") != "system")
    at = F.when(spoken, F.struct("sent_at", "layer", "message_id"))
    whole = (
        placed.groupBy("ticket_id")
        .agg(F.max(F.coalesce("broken", F.lit(False))).alias("broken"), F.min_by("role", at).alias("opens"), F.max_by("role", at).alias("closes"))
        .filter("NOT broken AND opens = 'customer' AND closes = 'agent'")
        .select("ticket_id")
    )
    if circles is not None:
        whole = whole.join(circles, "ticket_id", "left_anti")
    kept = placed.filter("NOT blank").join(whole, "ticket_id", "left_semi").withColumn("day", F.to_date("sent_at"))
    speaks = F.when(F.col("role") != "system", F.col("role"))
    so_far = W.partitionBy("ticket_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = kept.groupBy("ticket_id", "day").agg(F.count("*").alias("count"), F.max_by("role", F.when(speaks.isNotNull(), F.struct("sent_at", "layer", "message_id"))).alias("closes"))
    days = days.select("ticket_id", "day", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("before"), F.last("closes", ignorenulls=True).over(so_far).alias("spoke"))
    order = W.partitionBy("ticket_id", "day").orderBy("sent_at", "layer", "message_id")
    numbered = kept.withColumn("within", F.row_number().over(order)).withColumn("spoke_today", F.last(speaks, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    repeats = F.coalesce(speaks == F.coalesce("spoke_today", "spoke"), F.lit(False))
    return numbered.join(days, ["ticket_id", "day"]).select("ticket_id", (F.col("before") + F.col("within")).cast("int").alias("turn_no"), "message_id", "role", repeats.alias("repeats"))
