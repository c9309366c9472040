"""Sharding by fixed virtual slots.

Every row is hashed into one of `slots` virtual slots. Rows and bytes are summed per slot (the only thing the
driver sees: at most `slots` rows, whatever the input). A slot map, stored with a version, names the shard of each
slot; rebalancing edits the map and never hashes rows anew.

A stored map is edited by `edit`: the latest version is read, changed and stored as the next one; earlier versions stay.

The law is `bytes`: shards' byte sums are near equal, because slots are dealt largest first to the lightest shard. Rows
that can't be told apart (equal in doc_id, size and text_crc32) are counted first and then dealt in runs of `RUN` copies, each
run hashed on its own, so that however many copies a row has, they spread over all slots.

Defined cases: null text has no bytes (size 8, crc32 0); null doc_id is hashed like a value of its own; repeated
rows get places of their own; of rows that tie, any has any of their places; a very long text is one row of its size, so
shards can't be nearer equal than the largest row allows; extra columns are ignored; an empty table gives an empty
result and a map dealt by slot number alone.
"""

from __future__ import annotations

import bisect
import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stage, table, text_of

SLOTS = 8192
SHARDS = 24
#: Copies of a row that stay in one virtual slot.
RUN = 256


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot; `version` grows by one with each edit."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def deal(cls, weight: dict[int, int], slots: int, shards: int) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far (ties: the lower number)."""
        heap = [(0, s) for s in range(shards)]
        out = [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-weight.get(s, 0), s)):
            load, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + max(weight.get(slot, 0), 1), shard))
        return cls(shards, tuple(out))

    def grow(self, weight: dict[int, int]) -> SlotMap:
        """One more shard: slots move only into it, each from the shard that is then the heaviest."""
        own: dict[int, list[int]] = {}
        for slot, shard in enumerate(self.shard_of):
            own.setdefault(shard, []).append(slot)
        load = {s: sum(weight.get(x, 0) for x in xs) for s, xs in own.items()}
        for xs in own.values():
            xs.sort(key=lambda x: (weight.get(x, 0), x))
        goal, got, new, moved = sum(load.values()) / (self.shards + 1), 0, list(self.shard_of), []
        while own:
            shard = max(load, key=lambda s: (load[s], -s))
            slot = own[shard].pop() if own[shard] else None
            if slot is None or got + weight.get(slot, 0) > goal:
                break
            new[slot], got = self.shards, got + weight.get(slot, 0)
            load[shard] -= weight.get(slot, 0)
            moved.append(slot)
        return SlotMap(self.shards + 1, tuple(new), self.version + 1, tuple(moved))

    def rebalance(self, weight: dict[int, int], tolerance: float = 0.01) -> SlotMap:
        """The same shards for other weights: slots move one at a time from the heaviest shard to the lightest, each the largest
        that doesn't make that one the heavier of the two, until no shard is over the mean by more than tolerance."""
        own: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, shard in enumerate(self.shard_of):
            own[shard].append(slot)
        load = {s: sum(weight.get(x, 0) for x in xs) for s, xs in own.items()}
        for xs in own.values():
            xs.sort(key=lambda x: (weight.get(x, 0), x))
        most, new, moved = (1 + tolerance) * sum(load.values()) / self.shards, list(self.shard_of), []
        while True:
            high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
            room = (load[high] - load[low]) / 2
            fits = [x for x in own[high] if 0 < weight.get(x, 0) <= room]
            if load[high] <= most or not fits:
                break
            slot = fits[-1]
            own[high].remove(slot)
            bisect.insort(own[low], slot, key=lambda x: (weight.get(x, 0), x))
            load[high], load[low] = load[high] - weight[slot], load[low] + weight[slot]
            new[slot] = low
            moved.append(slot)
        return SlotMap(self.shards, tuple(new), self.version + 1, tuple(moved)) if moved else self

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, x, self.shards) for s, x in enumerate(self.shard_of)], "vslot int, shard int, shards int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version under path; earlier versions stay."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        found = spark.read.schema("vslot int, shard int, shards int").parquet(f"{path}/version={version}")
        rows = sorted((r.vslot, r.shard, r.shards) for r in found.collect())
        return cls(rows[0][2] if rows else 0, tuple(s for _, s, _ in rows), version)


    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> SlotMap:
        """The newest version stored under path."""
        return cls.load(spark, path, spark.read.parquet(path).agg(F.max("version")).first()[0])


def edit(docs: DataFrame, path: str, grow: bool = False, tolerance: float = 0.01) -> SlotMap:
    """The map stored last under path, edited for these documents and stored as the next version: with grow one more shard takes
    slots from all others, else slots move between shards until their bytes are near equal again. Nothing is stored if nothing
    moves. Rows are hashed as before, so what changes place is the rows of the moved slots."""
    spark = docs.sparkSession
    now = SlotMap.latest(spark, path)
    sums = keyed(docs, len(now.shard_of)).groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("b")).collect()  # a row a slot
    weight = {r.vslot: r.b for r in sums}
    new = now.grow(weight) if grow else now.rebalance(weight, tolerance)
    if new is not now:
        new.save(spark, path)
    return new


def keyed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Runs of equal rows: doc_id, size, text_crc32, vslot and how many copies; the text itself is read once and goes nowhere."""
    raw = F.encode(text_of(), "UTF-8")
    rows = docs.select(F.col("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    # Blocks of runs, then runs: no row ever holds an array that grows with the number of copies beyond n / RUN^2.
    block = RUN * RUN
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("b")).withColumn("n", F.least(F.lit(block), F.col("n") - F.col("b") * block))
    rows = rows.select("doc_id", "size", "text_crc32", "b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("r"))
    vslot = F.pmod(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_crc32", F.col("b"), F.col("r")), F.lit(slots)).cast("int")
    return rows.select("doc_id", "size", "text_crc32", vslot.alias("vslot"), F.least(F.lit(RUN), F.col("n") - F.col("r") * RUN).cast("int").alias("copies"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap, dict[int, int]]:
    """Each row with its shard and its place there (0, 1, ... without gaps), the map, and bytes per virtual slot.

    The map is stored as version 1 under path (a new folder in the shared one, if none is given) and read from there. A
    place is the rows in the shard's earlier slots plus those in earlier runs of its own slot plus the copy's number, so no
    task ever holds more than one slot's runs of 32 bytes each.
    """
    spark = docs.sparkSession
    runs = stage(keyed(docs, slots), "shard-keys", wide=True)
    sums = runs.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n")).collect()
    weight, count = {r.vslot: r.b for r in sums}, {r.vslot: r.n for r in sums}
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    SlotMap.deal(weight, slots, shards).save(spark, path)
    slot_map = SlotMap.load(spark, path, 1)
    base, seen = [], [0] * shards
    for slot, shard in enumerate(slot_map.shard_of):
        base.append((slot, shard, seen[shard]))
        seen[shard] += count.get(slot, 0)
    places = spark.createDataFrame(base, "vslot int, shard int, base long")
    before = W.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "copies").rowsBetween(W.unboundedPreceding, -1)
    # The map has `slots` rows, fixed by the parameter, so broadcasting it is bounded.
    out = runs.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(places), "vslot")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("slot", (F.col("base") + F.col("before") + F.col("copy")).cast("long"))
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", "slot"), slot_map, weight


def op6_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


QUERIES = {"op6_virtual_slot_shards": op6_virtual_slot_shards}
ORACLE: dict[str, str] = {}
