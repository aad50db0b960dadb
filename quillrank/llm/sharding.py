"""Sharding by balanced label propagation (DataFrame operations only).

Documents with equal texts are linked. Every linked document starts in a hashed shard; in each round a linked group
looks at the shards its members are in (counts per group and shard, never pairs) and its members ask to move to the
fullest open one. A shard grants requests in hashed order up to its quota: what its capacity leaves beside the linked
documents that stay. Shards without room close for the next round. Unlinked documents then fill the shards up, so that
their row counts differ by one at most (law `rows`). A group larger than a fraction of a shard is cut into blocks that
move on their own, so no key is larger than a block.

Defined results: null text counts as empty (size 16, crc 0); null ids are hashed and ordered as the smallest id;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, long_id, table, two_level_rank

SHARDS = 40
ROUNDS = 3
#: A shard's requests are granted by this many hashed classes.
CLASSES = 1024


def narrow(docs: DataFrame) -> DataFrame:
    """What sharding needs of a document, read once: its id, size, checksum and a key that equal texts share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        long_id(), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.reverse(text), F.length(text)).alias("k2"),
    )


def closed_form(rooms: list[int]) -> tuple[list[int], list[int]]:
    """Where each shard's free rows start, counted over all free rows."""
    starts, at = [], 0
    for r in rooms:
        starts.append(at)
        at += r
    return starts, rooms


def shard_at(rank, rooms: list[int]):
    """The shard that holds the rank-th free row."""
    starts, at = closed_form(rooms)[0], F.lit(0)
    for j, room in enumerate(rooms):
        at = F.when(rank >= starts[j], F.lit(j)).otherwise(at) if room else at
    return at


def place_large(sizes: list[int], caps: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Pieces (group, first row, shard, first slot) of large groups, and the rows that each shard holds then.

    Largest first into the fullest shard that takes the group whole; a group that no shard takes whole fills the emptiest
    shard and goes on with its rest.
    """
    held, pieces = [0] * len(caps), []
    left = [(-n, i, 0) for i, n in enumerate(sizes)]
    heapq.heapify(left)
    while left:
        n, i, first = heapq.heappop(left)
        room = [c - h for c, h in zip(caps, held, strict=True)]
        fits = [j for j in range(len(caps)) if room[j] >= -n]
        j = min(fits, key=lambda j: (room[j], j)) if fits else max(range(len(caps)), key=lambda j: (room[j], -j))
        put = min(room[j], -n)
        pieces.append((i, first, j, held[j]))
        held[j] += put
        if put < -n:
            heapq.heappush(left, (n + put, i, first + put))
    return pieces, held


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    scratch = Scratch(spark, "shard")
    base = scratch.keep(narrow(docs), "narrow")
    total = base.count()
    caps = [total // shards + (j < total % shards) for j in range(shards)]
    block = max(1, max(caps, default=0) // 8)
    key = ["k1", "k2"]

    groups = scratch.keep(base.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1"), "groups")
    # larger than an eighth of a shard, so fewer than eight a shard
    large = [tuple(r) for r in groups.filter(F.col("copies") > block).select(*key, "copies").orderBy(F.desc("copies"), *key).collect()]
    pieces, fixed = place_large([r[2] for r in large], caps)
    pieces = spark.createDataFrame([(*large[i][:2], first, j, slot) for i, first, j, slot in pieces], "k1 long, k2 long, first long, shard int, start long")
    large = F.broadcast(spark.createDataFrame([r[:2] for r in large], "k1 long, k2 long"))
    rooms = [c - f for c, f in zip(caps, fixed, strict=True)]
    cap = F.array(*[F.lit(c).cast("long") for c in rooms])

    members = two_level_rank(base.join(large, key), key, "doc_id", total, "rank")
    # the piece of a member is the last one that starts at or before it
    nth = pieces.withColumn("upto", F.coalesce(F.lead("first").over(W.partitionBy(*key).orderBy("first")), F.lit(total)))
    placed = members.join(F.broadcast(nth), key).filter("rank >= first and rank < upto").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - F.col("first")).alias("slot"))

    small = base.join(large, key, "left_anti")
    linked = small.join(groups, key, "left_semi").select(
        "doc_id", "size", "text_crc32",
        F.xxhash64(*key).alias("g"),
        shard_at(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(max(1, sum(rooms)))), rooms).cast("int").alias("label"),
    )
    linked = scratch.keep(linked, "linked0")
    shut = [j for j in range(shards) if not rooms[j]]
    for r in range(rounds):
        open_ = [j for j in range(shards) if j not in shut]
        if not open_:
            break
        near = linked.filter(F.col("label").isin(open_)).groupBy("g", "label").agg(F.count("*").alias("here"))
        best = near.groupBy("g").agg(F.max(F.struct("here", F.xxhash64("g", "label").alias("tie"), "label")).alias("b")).select("g", F.col("b.label").alias("want"))
        asked = linked.join(best, "g", "left").withColumn("want", F.coalesce("want", "label")).withColumn("cls", F.pmod(F.xxhash64("g", F.lit(r)), F.lit(CLASSES)).cast("int"))
        asked = scratch.keep(asked, f"asked{r}")
        stay = asked.filter("want = label").groupBy(F.col("label").alias("want")).agg(F.count("*").alias("stay"))
        demand = asked.filter("want <> label").groupBy("want", "cls").agg(F.count("*").alias("d"))
        upto = W.partitionBy("want").orderBy("cls").rowsBetween(W.unboundedPreceding, 0)
        # shards x CLASSES rows at most, so it is broadcast
        granted = demand.withColumn("upto", F.sum("d").over(upto)).join(F.broadcast(stay), "want", "left").withColumn("ok", F.col("upto") + F.coalesce("stay", F.lit(0)) <= cap[F.col("want")])
        full = [j for j in range(shards) if not rooms[j]]
        shut = full + [x[0] for x in granted.groupBy("want").agg(F.min("ok").alias("all_ok")).filter("not all_ok").select("want").collect()]  # one row a shard at most
        moved = asked.join(F.broadcast(granted.select("want", "cls", "ok")), ["want", "cls"], "left")
        linked = scratch.keep(moved.select("doc_id", "size", "text_crc32", "g", F.when(F.coalesce("ok", F.lit(True)), F.col("want")).otherwise(F.col("label")).alias("label")), f"linked{r + 1}")
        scratch.drop(f"linked{r}", f"asked{r}")
        if len(shut) == len(full) and r:
            break

    # groups that found no single shard, and those at the end of an overfull one, go whole to the free rows
    torn = linked.groupBy("g").agg(F.countDistinct("label").alias("n")).filter("n > 1").select("g")
    loose = linked.join(torn, "g", "left_semi").select("doc_id", "size", "text_crc32", "g")
    ranked = scratch.keep(two_level_rank(linked.join(torn, "g", "left_anti"), ["label"], "g", total, "rank", then=("doc_id",)), "ranked")
    last = ranked.groupBy("label", "g").agg(F.max("rank").alias("last"))
    out_ = last.filter(F.col("last") >= cap[F.col("label")]).select("g")
    fit = scratch.keep(ranked.join(out_, "g", "left_anti"), "fit")
    held = {x["label"]: x["n"] for x in fit.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a shard
    held = [fixed[j] + held.get(j, 0) for j in range(shards)]
    rooms = [c - h for c, h in zip(caps, held, strict=True)]
    begin, full, under = (F.array(*[F.lit(x).cast("long") for x in v]) for v in (closed_form(rooms)[0], held, fixed))
    settled = fit.select("doc_id", "size", "text_crc32", F.col("label").cast("int").alias("shard"), (F.col("rank") + under[F.col("label")]).alias("slot"))
    free = small.join(groups, key, "left_anti").select("doc_id", "size", "text_crc32", F.xxhash64(*key).alias("g")).unionByName(loose).unionByName(ranked.join(out_, "g", "left_semi").select("doc_id", "size", "text_crc32", "g"))
    free = two_level_rank(free, [], "g", total, "rank", then=("doc_id",)) if total else free.withColumn("rank", F.lit(0).cast("long"))
    free = free.withColumn("shard", shard_at(F.col("rank"), rooms).cast("int")).select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - begin[F.col("shard")] + full[F.col("shard")]).alias("slot"))
    out = placed.unionByName(settled).unionByName(free)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
