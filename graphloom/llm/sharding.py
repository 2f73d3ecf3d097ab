"""Sharding by balanced label propagation. DataFrame functions only.

Units start in a shard by the hash of their key. Links are stars: the smallest unit of each group of equal texts is the
hub of the others, so a group's links grow with its size, not its square. In a round either hubs ask to move where most
of their spokes are, or spokes to where their hub is. No two of those that ask are neighbours, so each move leaves
fewer links cut, and rounds go on until none is admissible. Then groups that are still cut move as a whole to a shard that
can take all of them, again until none can. A shard takes movers, those with most to gain first, up to its quota:
(1 + slack) of an even share, less the linked units that it has. Units without links make way: at last they move from
shards above the even share to those below it, in passes (`BALANCE`) by size; where they don't suffice, whole groups
move, then units of cut groups. The balance cuts no group; shards of whole groups alone may stay apart by up to the slack.

Cut are groups larger than a shard's quota, and those for which no shard has enough room left. No shard or group is
collected: quotas are cut on sums of buckets, and slots are numbered within buckets. The driver sees a few sums for
each shard.

Null texts are equal texts of no bytes. Repeated rows (same id and text) are one unit and stay together. Null ids
are allowed. Empty tables give empty results. Columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, kept, running_total

SHARDS, SLACK, BALANCE = 8, 0.05, (8, 8, 4, 2, 1, 1)
ROWS_A_BUCKET = 2000


def _salt(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30))


def loads(units: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard: as many numbers as shards."""
    got = {r[0]: r[1] for r in units.groupBy("shard").agg(F.sum("size")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _by_shard(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("to") + 1)


def _hub_asks(linked: DataFrame, room: list[float]) -> DataFrame:
    """(uid, size, to, gain): hubs that have more spokes in a shard with room than in their own."""
    hubs = linked.where("uid = hub").select("hub", F.col("size").alias("_size"), F.col("shard").alias("_own"))
    votes = linked.where("uid <> hub").groupBy("hub", F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("votes"))
    seen = votes.join(hubs, "hub").withColumn("_here", F.col("to") == F.col("_own")).where(F.col("_here") | (F.col("_size") <= _by_shard(room)))
    best = seen.groupBy(F.col("hub").alias("uid")).agg(
        F.max(F.struct("votes", "_here", (-F.col("to")).alias("to"))).alias("best"), F.coalesce(F.max(F.when(F.col("_here"), F.col("votes"))), F.lit(0)).alias("here"), F.first("_size").alias("size")
    )
    return best.select("uid", "size", (-F.col("best.to")).alias("to"), (F.col("best.votes") - F.col("here")).alias("gain")).where("gain > 0")


def _spoke_asks(linked: DataFrame, room: list[float]) -> DataFrame:
    """(uid, size, to, gain): spokes that aren't where their hub is, if it has room."""
    hubs = linked.where("uid = hub").select("hub", F.col("shard").alias("to"))
    return linked.where("uid <> hub").join(hubs, "hub").where(F.col("to") != F.col("shard")).where(F.col("size") <= _by_shard(room)).select("uid", "size", "to", F.lit(1).alias("gain"))


def _group_asks(linked: DataFrame, room: list[float], shards: int) -> DataFrame:
    """(hub, size, to, gain): cut groups to the shard that has most of them, of those that can take the rest, which is size."""
    parts = linked.groupBy("hub").agg(F.sum("size").alias("all"), F.countDistinct("shard").alias("k"), *[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("size"))), F.lit(0)).alias(f"_{s}") for s in range(shards)]).where("k > 1")
    fits = [F.when(F.col("all") - F.col(f"_{s}") <= F.lit(room[s]), F.struct(F.col(f"_{s}").alias("has"), F.lit(-s).alias("to"))) for s in range(shards)]
    best = parts.withColumn("best", F.array_max(F.array(*fits))).where("best IS NOT NULL")
    return best.select("hub", (F.col("all") - F.col("best.has")).alias("size"), (-F.col("best.to")).alias("to"), F.lit(1).alias("gain"))


def _admitted(asks: DataFrame, key: str, room: list[float], urgency: Column, buckets: int) -> DataFrame:
    """(key, _new): those that a shard has room for. The first that asks for a shard fits, so some do if any ask."""
    asks = asks.withColumn("_bucket", urgency * buckets + _salt(key, F.lit(-1)) % buckets)
    run = running_total(asks, ["to"], "_bucket", [key], "size", "before")
    return run.where(F.col("before") + F.col("size") <= _by_shard(room)).select(key, F.col("to").alias("_new"))


def _moved(linked: DataFrame, moves: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """linked after the moves, and whether there were any. Moves are written first, so that the join with a hot key can be split."""
    spark = linked.sparkSession
    moves = kept(moves, "lpa-moves")
    if moves.isEmpty():
        return linked, False
    after = kept(linked.join(moves, key, "left").select("uid", "size", "n", "hub", F.coalesce("_new", "shard").alias("shard")), "lpa-linked")
    dropped(spark, linked)
    dropped(spark, moves)
    return after, True


def propagate(units: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """units (uid, size, n, hub), where hub is null for units without links, to (uid, size, n, hub, shard).

    Only linked units take part in the rounds; the others are joined in again for the balance.
    """
    units = kept(units.select("uid", "size", "n", "hub", (_salt("uid") % shards).cast("int").alias("shard")), "lpa-units")
    buckets = max(1, -(-units.count() // ROWS_A_BUCKET))
    quota = (1 + slack) * sum(loads(units, shards)) / shards
    linked = kept(units.where("hub IS NOT NULL"), "lpa-linked")
    if linked.isEmpty():
        return balance(units, shards, buckets)
    free = lambda: [max(0.0, quota - x) for x in loads(linked, shards)]
    hubs, idle = True, 0
    while idle < 2:
        room = free()
        asks = _hub_asks(linked, room) if hubs else _spoke_asks(linked, room)
        urgency = 20 - F.least(F.floor(F.log2(F.col("gain"))), F.lit(20))
        linked, any_moved = _moved(linked, _admitted(asks, "uid", room, urgency, buckets), "uid")
        hubs, idle = not (hubs or any_moved), 0 if any_moved else idle + 1
    any_moved = True
    while any_moved:
        room = free()
        asks = _group_asks(linked, room, shards)
        linked, any_moved = _moved(linked, _admitted(asks, "hub", room, F.floor(F.log2(F.col("size"))), buckets), "hub")
    placed = kept(units.where("hub IS NULL").unionByName(linked), "lpa-units")
    dropped(units.sparkSession, units)
    dropped(units.sparkSession, linked)
    return balance(placed, shards, buckets)


def balance(units: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Moves units and whole groups from shards above the even share to those below. A pass takes items of a part of the excess
    at most: many small ones first, at last single ones that fill what is left. A shard gives no more than its excess."""
    groups = units.where("hub IS NOT NULL").groupBy("hub").agg((F.min("shard") == F.max("shard")).alias("_whole"))
    groups = kept(groups, "lpa-groups")  # written first, so that the join with a hot hub can be split
    units = kept(units.join(groups, "hub", "left").select("uid", "size", "n", "hub", "shard", F.when(F.col("_whole"), F.col("hub")).otherwise(F.col("uid")).alias("item"), F.when(F.col("_whole"), 1).when(F.col("hub").isNull(), 0).otherwise(2).alias("class")), "lpa-balance")
    items = kept(units.groupBy("item", "class", "shard").agg(F.sum("size").alias("size")), "lpa-items")
    for r, part in enumerate(BALANCE):
        now = loads(items, shards)
        even = sum(now) // shards
        over = [max(0, x - even) for x in now]
        if max(over) * 1000 <= even:
            break
        limit = [max(1, x // part) for x in over]
        spare = items.withColumn("to", F.col("shard")).where((_by_shard(over) > 0) & (F.col("size") <= _by_shard(limit)))
        spare = spare.withColumn("_bucket", F.col("class") * buckets + _salt("item", F.lit(100 + r)) % buckets)
        run = running_total(spare, ["to"], "_bucket", ["item"], "size", "before").where(F.col("before") + F.col("size") <= _by_shard(over))
        starts = [sum(over[:s]) for s in range(shards)]
        at = _by_shard(starts) + F.col("before") + F.col("size") / 2  # a place on the line of all excess, dealt out to the shards that have room
        line, new = 0, F.lit(None).cast("int")
        for s, x in enumerate(now):
            if x < even:
                new = F.coalesce(new, F.when((at >= line) & (at < line + even - x), s))
                line += even - x
        moves = run.select("item", new.alias("_new")).where(F.col("_new").isNotNull())
        after = kept(items.join(moves, "item", "left").withColumn("shard", F.coalesce("_new", "shard")).drop("_new"), "lpa-items")
        dropped(units.sparkSession, items)
        items = after
    return units.drop("shard").join(items.select("item", "shard"), "item").select("uid", "size", "n", "hub", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard; with whole, beside all other columns of docs.
    Groups are equal texts. With whole, rows are written once with a number and met again by it."""
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    if whole:
        docs = kept(docs, "shard-docs")
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.when(F.col(text).isNull(), F.lit(1)).otherwise(F.octet_length(body) + 1).cast("long")
    rows = docs.select("_row", F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body).alias("group"))
    rows = kept(rows.withColumn("uid", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "group")), "shard-rows")
    units = kept(rows.groupBy("uid", "group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-units")
    groups = kept(units.groupBy("group").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("_units")).where("_units > 1").select("group", "hub"), "shard-groups")
    placed = propagate(units.join(groups, "group", "left").select("uid", "size", "n", "hub"), shards)
    buckets = max(1, -(-rows.count() // ROWS_A_BUCKET))
    # rows of a unit share a bucket, unless they are more than a bucket's
    spread = F.when(F.col("n") > ROWS_A_BUCKET, F.col("_row")).otherwise(F.lit(7))
    out = rows.join(kept(placed.select("uid", "shard", "n"), "shard-placed"), "uid").withColumn("_one", F.lit(1)).withColumn("_bucket", _salt("uid", spread) % buckets)
    out = running_total(out, ["shard"], "_bucket", ["uid", "_row"], "_one", "slot")
    out = out.select("_row", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    if not whole:
        return out.drop("_row")
    own = [c for c in out.columns if c not in ("_row", "doc_id")]
    return docs.drop(*own).join(out.select("_row", *own), "_row").drop("_row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, texts included, and where each row goes."""
    return shard_documents(docs, whole=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
