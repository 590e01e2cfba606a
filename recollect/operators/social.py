"""Social ties: relations from an event log, access weights, decay, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schemas
from recollect.session import broadcast_if_small, cut_lineage

# Weight and cap per relation state, decay per day, floor.
PENDING_WEIGHT, PENDING_CAP = 0.1, 0.4
ACTIVE_WEIGHT, ACTIVE_CAP = 0.7, 1.0
PASSIVE_WEIGHT, PASSIVE_CAP = 0.05, 0.4
ACTIVE_RATE, PENDING_RATE, FLOOR = 0.95, 0.85, 0.02

# events of one pair that are folded together at most
_LOG_SLICE = 10_000
_ACTIONS = ("claim", "confirm", "reject", "block", "unblock", "remove", "co_occur")


def _both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    a = edges.select(F.col("from_user").alias("uid"), F.col("to_user").alias("other"), *cols)
    b = edges.select(F.col("to_user").alias("uid"), F.col("from_user").alias("other"), *cols)
    return a.unionByName(b)


def accessible(edges: DataFrame) -> DataFrame:
    """``(uid, other, weight)`` for all users: self at 1, live ties at their capped weight,
    without anybody tied by a block in either direction."""
    live = edges.filter(F.col("relation_type").isin(*schemas.SOCIAL_RELATIONS) & F.col("status").isin("active", "pending", "passive"))
    ties = _both_ways(live, F.least("weight", "cap").alias("weight"))
    people = _both_ways(edges).select("uid").distinct()
    selves = people.select("uid", F.col("uid").alias("other"), F.lit(1.0).alias("weight"))
    best = ties.unionByName(selves).groupBy("uid", "other").agg(F.max("weight").alias("weight"))
    # a tie of weight 0 that is not active never enters the neighbour set
    best = best.join(_both_ways(live.filter(F.col("status") == "active")).distinct().withColumn("_a", F.lit(True)), ["uid", "other"], "left").filter(
        (F.col("weight") > 0) | F.col("_a")).drop("_a")
    blocked = _both_ways(edges.filter(F.col("relation_type") == "blocked_by")).distinct()
    return best.join(blocked, ["uid", "other"], "left_anti")


def may_read(requests: DataFrame, neighbours: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """``requests(actor, target)`` the actor may read: self, or a neighbour heavy enough."""
    n = neighbours.select(F.col("uid").alias("actor"), F.col("other").alias("target"), "weight")
    j = requests.join(n, ["actor", "target"], "left")
    return j.filter((F.col("actor") == F.col("target")) | (F.col("weight") >= min_weight)).drop("weight")


def may_write(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("actor") == F.col("target"))


def persona_view(requests: DataFrame, neighbours: DataFrame, personas: DataFrame) -> DataFrame:
    """What ``actor`` sees of ``target``: everything from 0.6, short summary and tier from 0.4, tier above 0, else the name."""
    n = neighbours.select(F.col("uid").alias("actor"), F.col("other").alias("target"), "weight")
    p = personas.select(F.col("uid").alias("target"), "summary", "tier")
    j = requests.join(n, ["actor", "target"], "left").join(p, "target", "left").withColumn(
        "weight", F.when(F.col("actor") == F.col("target"), 1.0).otherwise(F.coalesce("weight", F.lit(0.0))))
    level = F.when(F.col("weight") >= 0.6, "full").when(F.col("weight") >= 0.4, "summary").when(F.col("weight") > 0, "tier").otherwise("name")
    return j.select(
        "actor", "target", level.alias("level"),
        F.when(F.col("weight") >= 0.6, F.col("summary")).when(F.col("weight") >= 0.4, F.substring("summary", 1, 200)).alias("summary"),
        F.when(F.col("weight") > 0, F.col("tier")).alias("tier"))


def neighbour_edges(edges: DataFrame, status: str | None = None, relations: tuple[str, ...] | None = None, min_weight: float = 0.0) -> DataFrame:
    rows = edges.filter(F.col("weight") >= min_weight)
    if status:
        rows = rows.filter(F.col("status") == status)
    if relations:
        rows = rows.filter(F.col("relation_type").isin(*relations))
    return _both_ways(rows, "relation_type", "status", "weight").orderBy("uid", F.desc("weight"), "other")


def pending_for(edges: DataFrame) -> DataFrame:
    """Claims waiting for the addressed user."""
    return edges.filter(F.col("relation_type").isin(*schemas.SOCIAL_RELATIONS) & (F.col("status") == "pending")).select(
        F.col("to_user").alias("uid"), F.col("from_user").alias("claimer"), "relation_type", "weight")


def passive_relations(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Passive ``friend_of`` edges for co-occurring pairs without a live friend edge either way."""
    live = edges.filter((F.col("relation_type") == "friend_of") & F.col("status").isin("active", "pending"))
    pairs = _both_ways(live).select(F.col("uid").alias("from_user"), F.col("other").alias("to_user"))
    new = candidates.select("from_user", "to_user").distinct().join(pairs, ["from_user", "to_user"], "left_anti")
    return new.select("from_user", "to_user", F.lit("friend_of").alias("relation_type"), F.lit("passive").alias("status"),
                      F.lit(PASSIVE_WEIGHT).alias("weight"), F.lit(PASSIVE_CAP).alias("cap"))


def decay(edges: DataFrame, days: int = 7) -> DataFrame:
    """Per-day decay: active ties keep a floor, pending ones below it are rejected with their weight kept."""
    if days < 1:
        return edges
    social = F.col("relation_type").isin(*schemas.SOCIAL_RELATIONS)
    act = social & (F.col("status") == "active")
    pend = social & (F.col("status") == "pending")
    pw = F.col("weight") * PENDING_RATE ** days
    return edges.withColumn("_w", F.when(act, F.greatest(F.lit(FLOOR), F.col("weight") * ACTIVE_RATE ** days)).when(
        pend & (pw >= FLOOR), pw).otherwise(F.col("weight"))).withColumn(
        "status", F.when(pend & (pw < FLOOR), "rejected").otherwise(F.col("status"))).withColumn("weight", F.col("_w")).drop("_w")


# ---------------------------------------------------------------- relations from events


# (status, forward, weight, cap, block_f, block_b); forward: the edge runs from the smaller to the larger uid
State = tuple[str | None, bool | None, float | None, float | None, bool, bool]


def _after(s: State, action: str, forward: bool) -> State:
    """One event on one relation of a pair."""
    status, fwd, weight, cap, bf, bb = s
    live = status in ("pending", "active")
    # confirm and reject come from the person the claim was made to
    answers = status == "pending" and fwd != forward
    if action == "claim" and not (bf or bb) and not (live and fwd != forward):
        return "pending", forward, PENDING_WEIGHT, PENDING_CAP, bf, bb
    if action == "confirm" and answers:
        return "active", fwd, ACTIVE_WEIGHT, ACTIVE_CAP, bf, bb
    if action == "reject" and answers:
        return "rejected", fwd, weight, cap, bf, bb
    if action == "block":
        return status and "blocked", fwd, weight, cap, bf or forward, bb or not forward
    if action == "unblock":
        return status, fwd, weight, cap, bf and not forward, bb and forward
    if action == "remove" and status:
        return "rejected", fwd, weight, cap, bf, bb
    if action == "co_occur" and not live:
        return "passive", forward, PASSIVE_WEIGHT, PASSIVE_CAP, bf, bb
    return s


def _machine() -> tuple[list[State], list[int]]:
    """All states that can be reached, the empty one first, and for event ``e`` (action and direction) and state ``s``
    at ``e * states + s`` the state after it. Fewer than 128 states."""
    states: list[State] = [(None, None, None, None, False, False)]
    number = {states[0]: 0}
    for s in states:  # grows while it is read
        for action in _ACTIONS:
            for forward in (False, True):
                t = _after(s, action, forward)
                if t not in number:
                    number[t] = len(states)
                    states.append(t)
    return states, [number[_after(s, a, f)] for a in _ACTIONS for f in (False, True) for s in states]


def relations_from_events(events: DataFrame) -> DataFrame:
    """Edges after an event log ``(seq, actor, target, action, relation_type)``.

    ``seq`` is the unique log position. Actions: claim, confirm, reject, block,
    unblock, remove and co_occur; a confirm or reject counts only from the person
    claimed. A relation is a machine with a few dozen states. The log of a pair with up
    to ``_LOG_SLICE`` events is one fold; a longer one is cut into slices of log positions,
    each folded to a table with one byte for the state after each state before, and
    neighbouring tables are composed two by two, round by round: a task holds a slice or
    two tables, never a busy pair's log.
    """
    small = F.least("actor", "target")
    large = F.greatest("actor", "target")
    base = events.select("seq", small.alias("a"), large.alias("b"), "action", (F.col("actor") <= F.col("target")).alias("forward"), "relation_type")
    own = base.filter(F.col("action").isin("claim", "confirm", "reject", "remove") & F.col("relation_type").isin(*schemas.SOCIAL_RELATIONS))
    met = base.filter(F.col("action") == "co_occur").withColumn("relation_type", F.lit("friend_of"))
    blocks = base.filter(F.col("action").isin("block", "unblock")).withColumn(
        "relation_type", F.explode(F.array(*[F.lit(r) for r in schemas.SOCIAL_RELATIONS])))
    key = ["a", "b", "relation_type"]
    states, after = _machine()
    code = F.coalesce(*[F.when(F.col("action") == x, 2 * i) for i, x in enumerate(_ACTIONS)]) + F.col("forward").cast("int")
    log = cut_lineage(own.unionByName(met).unionByName(blocks).select(*key, "seq", (code * len(states)).alias("e")))
    moves = F.lit([int(x) for x in after])

    def then(s: Column, e: Column) -> Column:
        return F.element_at(moves, e["e"] + s + 1)

    busy = broadcast_if_small(cut_lineage(log.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _LOG_SLICE).select(*key)))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "e"))).alias("ev")  # at most _LOG_SLICE rows
    calm = log.join(busy, key, "left_anti").groupBy(*key).agg(ordered).select(*key, F.aggregate("ev", F.lit(0), then).alias("at"))
    sliced = log.join(busy, key).groupBy(*key, F.expr(f"seq div {_LOG_SLICE}").alias("slice")).agg(ordered)
    start = F.lit(list(range(len(states))))
    table = F.aggregate("ev", start, lambda t, e: F.transform(t, lambda s: then(s, e)))
    tables = cut_lineage(sliced.select(*key, "slice", table.cast("array<tinyint>").alias("t")))
    last = tables.agg(F.max("slice") - F.min("slice"), F.min("slice")).first()
    if last[0] is not None:
        tables = tables.withColumn("slice", F.col("slice") - last[1])
        for k in range(int(last[0]).bit_length()):  # as many rounds as the number of slices has bits
            pair = F.sort_array(F.collect_list(F.struct("slice", "t")))  # one or two
            tables = tables.groupBy(*key, F.expr("slice div 2").alias("_half")).agg(pair.alias("p")).select(
                *key, F.col("_half").alias("slice"), F.when(F.size("p") == 1, F.col("p")[0]["t"]).otherwise(
                    F.transform(F.col("p")[0]["t"], lambda s: F.element_at(F.col("p")[1]["t"], s.cast("int") + 1))).alias("t"))
            tables = cut_lineage(tables) if k % 4 == 3 else tables
    found = calm.unionByName(tables.select(*key, F.col("t")[0].cast("int").alias("at")))
    names = ("status string", "forward boolean", "weight double", "cap double", "block_f boolean", "block_b boolean")
    shown = F.array(*[F.struct(*[F.lit(v).cast(n.split()[1]).alias(n.split()[0]) for v, n in zip(st, names)]) for st in states])
    both = found.select(*key, F.element_at(shown, F.col("at") + 1).alias("s"))
    fwd = F.col("s.forward")
    ties = both.filter(F.col("s.status").isNotNull()).select(
        F.when(fwd, F.col("a")).otherwise(F.col("b")).alias("from_user"), F.when(fwd, F.col("b")).otherwise(F.col("a")).alias("to_user"),
        "relation_type", F.col("s.status").alias("status"), F.col("s.weight").alias("weight"), F.col("s.cap").alias("cap"))
    # the block flags are the same in all three relations of a pair
    one = both.filter(F.col("relation_type") == "friend_of")
    shut = one.filter("s.block_f").select(F.col("a").alias("from_user"), F.col("b").alias("to_user")).unionByName(
        one.filter("s.block_b").select(F.col("b").alias("from_user"), F.col("a").alias("to_user")))
    return ties.unionByName(shut.select("from_user", "to_user", F.lit("blocked_by").alias("relation_type"), F.lit("active").alias("status"),
                                        F.lit(1.0).alias("weight"), F.lit(1.0).alias("cap")))
