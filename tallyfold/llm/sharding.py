"""Shards by balanced label propagation over linked documents. DataFrame functions only.

Documents of one group (here: equal texts) are linked. Linked documents begin in turn on all shards.
In each round a join brings every linked document the number of its neighbours on each shard, and it
asks for the shard that holds most of them; ties are broken by a hash, in the same way for the whole
group. Shards have quotas: pairs of shards exchange as many documents as both sides ask for, and what
is left moves as far as the target has room. Full shards take no part, so a group larger than a shard
settles on the next. Rounds end when nothing moves. Documents without links then fill all shards
evenly: the numbers of rows differ by one at most (law `rows`).

Cases: a null text has size 1 and checksum 0 and is equal to an empty one; repeated rows are rows of
their own, linked by their text; an empty table has no rows; other columns are not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, numbered

ROWS_PER_PART = 20_000
ROUNDS = 16


def quotas(asked: dict, room: list) -> dict:
    """How many of the documents that ask to move from a to b may do so."""
    given = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    room = list(room)
    for (a, b), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - given[a, b], room[b])
        given[a, b] += more
        room[b] -= more
    return {pair: n for pair, n in given.items() if n}


def _case(values: dict, default):
    """A column that looks (shard, target) up."""
    found = F.lit(default)
    for (a, b), n in values.items():
        found = F.when((F.col("shard") == a) & (F.col("target") == b), n).otherwise(found)
    return found


def propagate(linked: DataFrame, capacity: list, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard) for linked documents (row, group); capacity: the most rows of each shard."""
    n = len(capacity)
    size = linked.count()
    parts = max(1, size // ROWS_PER_PART)
    state = numbered(linked.select("row", "group"), [], ["row"], parts)
    state = cut(state.select("row", "group", (F.col("position") % n).cast("int").alias("shard")))
    open_ = [True] * n
    for _ in range(rounds if size else 0):
        loads = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [capacity[k] - loads.get(k, 0) for k in range(n)]
        votes = cut(state.groupBy("group").agg(F.array(
            *[F.count(F.when(F.col("shard") == k, 1)) for k in range(n)]).alias("votes")))
        told = state.join(votes, "group")
        offers = [F.when((F.col("shard") == k) | F.lit(open_[k]), F.struct(
            F.col("votes")[k].alias("votes"), F.xxhash64("group", F.lit(k)).alias("tie"), F.lit(k).alias("shard")))
            for k in range(n)]
        told = told.select("row", "group", "shard", F.array_max(F.array(*offers))["shard"].alias("target"))
        movers = told.where("shard <> target")
        asked = {(r.shard, r.target): r.n for r in movers.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        given = quotas(asked, room)
        came = {b for _, b in given}
        before, open_ = open_, [room[k] > 0 or k in came for k in range(n)]
        if not given:
            if open_ == before:
                break
            continue
        ranked = numbered(movers, ["shard", "target"], ["row"], parts)
        moved = ranked.select("row", "group", F.when(
            F.col("position") < _case(given, 0), F.col("target")).otherwise(F.col("shard")).alias("shard"))
        state = cut(moved.union(told.where("shard = target").select("row", "group", "shard")))
    return state.select("row", "shard")


def shards(docs: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs; links: equal texts."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash")))
    total = rows.count()
    parts = max(1, total // ROWS_PER_PART)
    rows = rows.withColumn("group", F.struct("text_hash", "text_crc32", "size"))
    rows = cut(numbered(rows, [], ["doc_id", "text_hash"], parts, "row"))
    groups = cut(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"))
    capacity = [total // n + (k < total % n) for k in range(n)]
    placed = propagate(rows.join(groups, "group", "left_semi").select("row", "group"), capacity)
    loads = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    single = numbered(rows.join(groups, "group", "left_anti").select("row"), [], ["row"], parts)
    shard, end = F.lit(n - 1), total - sum(loads.values())
    for k in reversed(range(n)):
        shard = F.when(F.col("position") < end, k).otherwise(shard)
        end -= capacity[k] - loads.get(k, 0)
    placed = placed.union(single.select("row", shard.alias("shard")))
    found = numbered(rows.join(placed, "row"), ["shard"], ["row"], max(1, parts // n), "slot")
    return found.select("doc_id", "size", "text_crc32", "shard", "slot")
