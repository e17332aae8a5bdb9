"""Balanced label propagation: linked documents drift into one shard while shards stay equally large.

Documents that share a link key are linked.  In each round every key's members vote (counts are combined before the
shuffle); a document may move to the shard that most of its linked documents are in; the moves into a shard are ranked, key
by key in an order of the round's own, and admitted up to its quota.  At the end each shard gives up what exceeds its
share, documents without links first, and the given-up ones fill the others in link order.  A key with more than
``part_rows`` documents, or more than half a shard, is split by rank into parts that start in neighbouring shards and come
first there, so that no group is larger than a task or a shard, and a large one fills as few shards as it needs.  Rows that
share an id and a text may stand for each other; but for that the layout depends on the rows alone, not on their partitions.

DataFrame functions only.  What the driver collects is a row per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_SPAN = 1 << 40


def ranked(df: DataFrame, part: str, order: list[str], place: Column, buckets: int, name: str) -> DataFrame:
    """Gapless ranks from 0 within ``part``, in the order of ``order``, without a task that holds a whole part.

    ``place`` in [0, 1) must not fall along the order: it cuts a part into ``buckets``, whose sizes are summed first.
    """
    cut = df.withColumn("_bucket", F.floor(place * buckets).cast("int"))
    sizes = cut.groupBy(part, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(part, "_bucket").orderBy(*order)
    return cut.withColumn("_own", F.row_number().over(own)).join(sizes, [part, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_bucket", "_own", "_before")


def _by_number(values: list[int], number: Column) -> Column:
    """The value of a shard: a literal array of one entry a shard."""
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), number + 1)


def propagate(nodes: DataFrame, members: DataFrame, shards: int, scratch: Scratch, *, rounds: int = 3, slack: float = 0.05, bucket_rows: int = 20_000) -> DataFrame:
    """(uid, shard) after label propagation.  ``nodes``: uid, shard; ``members``: uid, key (a document may have many
    keys) and, if the order of moves is to be told by it, doc_id.

    A quota is a shard's equal part of all rows, less ``slack``, and only linked documents count against it: those without
    links make room for them at no cost in cut links when sizes are evened out.
    """
    if "doc_id" not in members.columns:
        members = members.withColumn("doc_id", F.col("uid"))
    total = nodes.count()
    quota = total * (1 - slack) / shards
    buckets = max(1, -(-total // (shards * bucket_rows)))
    state = nodes
    for turn in range(rounds):
        s = scratch.write(members.join(state, "uid"), "votes")
        n = s.groupBy("key", "shard").agg(F.count("*").alias("n"))
        top = n.groupBy("key").agg(F.max(F.struct("n", F.xxhash64("key", "shard", F.lit(turn)).alias("tie"), "shard")).alias("t")).select("key", F.col("t.shard").alias("target"), F.col("t.n").alias("nt"))
        gain = s.join(n, ["key", "shard"]).join(top, "key").where("target != shard and nt >= n")
        best = gain.groupBy("uid", "doc_id", "shard", "target").agg(F.sum(F.col("nt") - F.col("n") + 1).alias("gain"), F.min("key").alias("key"))
        wish = scratch.write(best.groupBy("uid", "doc_id", "shard").agg(F.max(F.struct("gain", "target", "key")).alias("w")).select("uid", "doc_id", "shard", "w.target", "w.key"), "wishes")
        if wish.isEmpty():
            break
        out = {r[0]: r[1] for r in wish.groupBy("shard").count().collect()}
        have = {r[0]: r[1] for r in s.groupBy("shard").agg(F.countDistinct("uid")).collect()}
        room = [int(max(0, quota - have.get(t, 0) + out.get(t, 0))) for t in range(shards)]
        place = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(_SPAN)) / F.lit(float(_SPAN))
        in_turn = ranked(wish.withColumn("place", place), "target", ["place", "key", "doc_id", "uid"], F.col("place"), buckets, "rank")
        moved = in_turn.where(F.col("rank") < _by_number(room, F.col("target"))).select("uid", "target")
        state = scratch.write(state.join(moved, "uid", "left").select("uid", F.coalesce("target", "shard").alias("shard")), "state")
    return state


def shard_documents(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 50_000, bucket_rows: int = 20_000, rounds: int = 3) -> DataFrame:
    """One row an input row: doc_id, size, text_crc32, law ('rows': counts at most one apart), shard, slot, grown_shard (null).

    Documents of equal text are linked.  A null text has size 16, the CRC of no bytes (0) and no link; empty texts are
    equal texts.  Ids may be null or repeated: each row is placed by itself, and repeated rows are linked like copies.
    Fewer rows than shards leave shards empty; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.when(text.isNotNull(), F.xxhash64(text)).alias("h"))
    rows = scratch.write(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    most = max(1, min(part_rows, total // shards // 2))
    groups = rows.where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    base = scratch.write(rows.join(groups, "h", "left"), "linked")
    # ranks within the groups that are split, so that parts are equally large
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)) / F.lit(float(_SPAN))
    split = ranked(base.where(F.col("n") > most).withColumn("place", spread), "h", ["place", "doc_id", "uid"], F.col("place"), max(1, -(-total // bucket_rows)), "r")
    split = split.select("uid", F.floor(F.col("r") / most).alias("part"))
    own = F.pmod(F.xxhash64("doc_id", "h", F.lit(1)), F.lit(shards))
    in_row = F.pmod(F.pmod(F.col("h"), F.lit(shards)) + F.floor(F.col("part") / max(1, total // shards // most)), F.lit(shards))
    key = F.when(F.col("n").isNotNull(), F.xxhash64("h", F.coalesce("part", F.lit(0).cast("long"))))
    base = scratch.write(base.join(split, "uid", "left").select("uid", "doc_id", "size", "text_crc32", "h", key.alias("key"), F.col("part").isNotNull().alias("large"), F.when(F.col("part").isNotNull(), in_row).otherwise(own).cast("int").alias("shard")), "base")
    state = propagate(base.select("uid", "shard"), base.where("key is not null").select("uid", "doc_id", "key"), shards, scratch, rounds=rounds, bucket_rows=bucket_rows)

    # parts of large groups first, then linked documents, in the order of their keys' hashes
    buckets = max(1, -(-total // (shards * bucket_rows)))
    key_place = F.pmod(F.coalesce("key", F.xxhash64("doc_id", "h", F.lit(2))), F.lit(_SPAN)) / F.lit(float(3 * _SPAN))
    placed = base.drop("shard").join(state, "uid").withColumn("place", key_place + F.when(F.col("large"), 0.0).when(F.col("key").isNotNull(), 1 / 3).otherwise(2 / 3))
    order = ["place", "key", "doc_id", "uid"]
    placed = scratch.write(ranked(placed, "shard", order, F.col("place"), 3 * buckets, "rank"), "placed")
    have = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    want = [total // shards + (s < total % shards) for s in range(shards)]
    stays = F.col("rank") < _by_number(want, F.col("shard"))
    # what is given up, in link order, fills the shards that lack rows one after another
    lack = [max(0, want[s] - have.get(s, 0)) for s in range(shards)]
    upto = [sum(lack[: s + 1]) for s in range(shards)]
    # links in a key travel together: the order is by key first
    spare = ranked(placed.where(~stays).withColumn("all", F.lit(0)), "all", order, F.col("place"), 3 * buckets * shards, "r")
    filled = spare.withColumn("shard", F.size(F.filter(F.array(*(F.lit(u).cast("long") for u in upto)), lambda u: u <= F.col("r"))).cast("int")).select("uid", "doc_id", "size", "text_crc32", "key", "place", "shard")
    final = scratch.write(placed.where(stays).select("uid", "doc_id", "size", "text_crc32", "key", "place", "shard").unionByName(filled), "final")
    out = ranked(final, "shard", order, F.col("place"), 3 * buckets, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
