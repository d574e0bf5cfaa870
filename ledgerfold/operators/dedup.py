"""Exactly one copy of each message that was delivered more than once, over any number of batches and runs.

Identifiers are encoded exactly through a stored dictionary: (consumer_id, ns_name) becomes a code, dense from 0, and the
message is (code, lsn). Messages settled so far are kept by code and shard of 32,768 LSNs: as a bitmap, or where a run settles
few in a shard as an array of places. A run picks one arrival for each message that isn't settled, and adds what it settles
in the same commit that publishes its picks.

The copy that stays is the first undamaged one by (batch_id, rec_pos), or the first of all if every copy is damaged.
A message of which only damaged copies have come is doubtful: it isn't settled, and a later undamaged copy replaces
the pick. Runs may take batches in any order: where a run has a batch_id at or below an earlier run's, its undamaged copies
are compared with the picks of settled messages too, and a lower one replaces the pick. Records without lsn have no identifier
and are never dropped.

Parts: dictionary, seen and kept hold what each run adds, doubtful all that is doubtful by bucket. Seen, kept and doubtful
are cut into buckets by shard; a run reads only those it touches. compact() unites the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import bitmaps
from ..session import attempt
from .parts import PartStore, at_once, bucket_of, dense, numbers_of, observed

DICTIONARY = "consumer_id string, ns_name string, code bigint"
SEEN = "code bigint, shard bigint, bits binary, places array<bigint>, bucket int"
PICK = "code bigint, lsn bigint, batch_id bigint, rec_pos bigint, bucket int"
#: Shards in which a run settles at most this many messages get an array of places, no bitmap.
SPARSE = 256
SHARD = ["code", "shard"]


def damaged(record, checksum):
    """True if there is a checksum that isn't the IEEE CRC-32 of the record; a null record has none."""
    return F.coalesce(checksum.isNotNull() & (F.crc32(record) != checksum), checksum.isNotNull())


class DedupStore(PartStore):
    PARTS = {"dictionary": DICTIONARY, "seen": SEEN, "kept": PICK, "doubtful": PICK}
    SORTED = {"seen": SHARD, "kept": ["code", "lsn"], "doubtful": ["code", "lsn"]}
    HELD = {"doubtful"}

    def manifest(self) -> dict:
        """The folders of each part, the number of codes and the bytes of what they stand for, the highest batch_id so far, and whether
        any run took one below it."""
        return {"codes": 0, "words": 0, "last_batch": None, "late": False} | super().manifest()

    def _encode(self, batches: DataFrame, before: dict, name: str) -> tuple[DataFrame, dict]:
        """batches with the code of their consumer and namespace, and what the manifest tells after this run. New pairs get the next numbers."""
        old = self.read_part("dictionary", before["dictionary"])
        counted = Observation()
        pairs = batches.select("consumer_id", "ns_name").distinct()
        o = old.select(F.col("consumer_id").alias("o_c"), F.col("ns_name").alias("o_n"))
        new = pairs.join(o, F.col("consumer_id").eqNullSafe(F.col("o_c")) & F.col("ns_name").eqNullSafe(F.col("o_n")), "left_anti")
        size = F.coalesce(F.octet_length("consumer_id"), F.lit(0)) + F.coalesce(F.octet_length("ns_name"), F.lit(0)) + 64
        new.observe(counted, F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).write.parquet(self.folder / f"new_pairs/{name}")
        n, size = observed(counted, "n", 0), observed(counted, "size", 0) or 0
        after = before | {"codes": before["codes"] + n, "words": before["words"] + size}
        if n:
            staged = self.spark.read.schema("consumer_id string, ns_name string").parquet(self.folder / f"new_pairs/{name}")
            self.write_part(dense(staged, "code", before["codes"]), "dictionary", name)
            after["dictionary"] = [*before["dictionary"], name]
        self.folder.delete(f"new_pairs/{name}")
        first, last = batches.agg(F.min("batch_id"), F.max("batch_id")).first()
        highest = before["last_batch"]
        after["late"] = before["late"] or (None not in (first, highest) and first <= highest)
        after["last_batch"] = max((b for b in (last, highest) if b is not None), default=None)
        words = self.read_part("dictionary", after["dictionary"]).select(F.col("consumer_id").alias("d_c"), F.col("ns_name").alias("d_n"), "code")
        if after["words"] <= self.broadcast_bytes:
            words = F.broadcast(words)
        same = F.col("consumer_id").eqNullSafe(F.col("d_c")) & F.col("ns_name").eqNullSafe(F.col("d_n"))
        return batches.join(words, same).drop("d_c", "d_n"), after

    def ingest(self, batches: DataFrame) -> int:
        """Take batches (batch_id, consumer_id, ns_name, records); returns the run's number. Null and empty lists hold nothing."""
        before = self.manifest()
        run = before["epoch"] + 1
        name, bucket = attempt(run), bucket_of(SHARD, before)
        coded, after = self._encode(batches.select("batch_id", "consumer_id", "ns_name", "records"), before, name)
        copies = (
            coded.select("code", "batch_id", F.posexplode("records").alias("rec_pos", "r"))
            .where(F.col("r.lsn").isNotNull())
            .select("code", F.col("r.lsn").alias("lsn"), damaged(F.col("r.record"), F.col("r.crc32_checksum")).alias("bad"), "batch_id", F.col("rec_pos").cast("bigint").alias("rec_pos"))
        )
        best = F.min(F.struct("bad", "batch_id", "rec_pos")).alias("b")
        found = copies.groupBy("code", "lsn").agg(best).select("code", "lsn", "b.*", bitmaps.bucket(F.col("lsn")).alias("shard"))
        seen_buckets = Observation()
        found = found.withColumn("bucket", bucket).observe(seen_buckets, F.bitmap_construct_agg(F.col("bucket").cast("bigint")).alias("touched"))
        found.write.parquet(self.folder / f"picks/{name}")
        touched = numbers_of(observed(seen_buckets, "touched", None))
        found = self.spark.read.schema(found.schema).parquet(self.folder / f"picks/{name}")

        doubtful = self.read_held("doubtful", before, touched)
        columns = ["code", "lsn", "bad", "batch_id", "rec_pos"]
        picks = found.select(*columns, "bucket")
        if before["seen"]:
            fresh = self._unsettled(found, before, touched).select(*columns)
            picks = fresh.unionByName(doubtful.select(*columns[:2], F.lit(True).alias("bad"), *columns[3:])).groupBy("code", "lsn").agg(best)
            picks = picks.select("code", "lsn", "b.*", bucket_of_pick(before).alias("bucket"))
            picks.write.parquet(self.folder / f"settled/{name}")
            picks = self.spark.read.schema(picks.schema).parquet(self.folder / f"settled/{name}")
        settled = picks.where("NOT bad").drop("bad")
        kept = settled
        if after["late"] and before["seen"]:
            kept = settled.unionByName(self._replaced(found, before, touched).select(*settled.columns))
        marked = containers(settled.withColumn("shard", bitmaps.bucket(F.col("lsn")))).withColumn("bucket", bucket)
        _, _, still = at_once(
            lambda: self.write_part(kept, "kept", name),
            lambda: self.write_part(marked, "seen", name),
            lambda: self.write_part(picks.where("bad").drop("bad"), "doubtful", name, F.col("bucket")),
        )
        self.folder.delete(f"picks/{name}")
        self.folder.delete(f"settled/{name}")
        added = {p: [*before[p], name] for p in ("seen", "kept")}
        return self.commit(after | {"epoch": run, "doubtful": self.held_after(before["doubtful"], touched, name, still)} | added)

    def _unsettled(self, found: DataFrame, before: dict, touched: list[int]) -> DataFrame:
        """Picks whose message no earlier run has settled."""
        bits, places = self._seen(found, before, touched)
        known = F.coalesce(bitmaps.is_set(F.col("bits"), bitmaps.bit(F.col("lsn"))), F.lit(False))
        return found.join(bits, SHARD, "left").where(~known).join(places, ["code", "lsn"], "left_anti").drop("bits")

    def _seen(self, found: DataFrame, before: dict, touched: list[int]) -> tuple[DataFrame, DataFrame]:
        """(code, shard, bits) and (code, lsn) of settled messages in the shards that found has."""
        seen = self.read_part("seen", before["seen"], touched).drop("bucket").join(found.select(*SHARD).distinct(), SHARD, "left_semi")
        bits = seen.where("bits IS NOT NULL").groupBy(*SHARD).agg(F.bitmap_or_agg("bits").alias("bits"))
        places = seen.where("places IS NOT NULL").select("code", "shard", F.explode("places").alias("place"))
        return bits, places.select("code", (F.shiftleft("shard", 15) + F.col("place")).alias("lsn"))

    def _replaced(self, found: DataFrame, before: dict, touched: list[int]) -> DataFrame:
        """Undamaged copies that come before the picks of settled messages."""
        kept = self._kept(before, touched).select("code", "lsn", F.struct("batch_id", "rec_pos").alias("old"))
        good = found.where("NOT bad").drop("bucket", "shard", "bad")
        lower = good.join(kept, ["code", "lsn"]).where(F.struct("batch_id", "rec_pos") < F.col("old")).drop("old")
        return lower.withColumn("bucket", bucket_of_pick(before))

    def _kept(self, now: dict, buckets: list[int] | None = None) -> DataFrame:
        """The picks of settled messages; after late runs a message can have several, of which the lowest stays."""
        kept = self.read_part("kept", now["kept"], buckets).drop("bucket")
        if not now["late"]:
            return kept
        return kept.groupBy("code", "lsn").agg(F.min(F.struct("batch_id", "rec_pos")).alias("b")).select("code", "lsn", "b.*")

    def compact(self) -> int:
        """Unite the folders of seen, kept and the dictionary; returns the run's number."""
        before = self.manifest()
        run = before["epoch"] + 1
        name, bucket = attempt(run), bucket_of(SHARD, before)
        seen = self.read_part("seen", before["seen"]).drop("bucket")
        dense_shards = seen.where("bits IS NOT NULL").select(*SHARD).distinct()
        # a shard that has a bitmap takes its places into it; the others may outgrow an array
        few = seen.where("places IS NOT NULL").select(*SHARD, F.explode("places").alias("place"))
        into = few.join(dense_shards, SHARD, "left_semi").groupBy(*SHARD).agg(F.bitmap_construct_agg("place").alias("bits"))
        bits = seen.where("bits IS NOT NULL").select(*SHARD, "bits").unionByName(into).groupBy(*SHARD).agg(F.bitmap_or_agg("bits").alias("bits"))
        alone = few.join(dense_shards, SHARD, "left_anti").select("code", "shard", (F.shiftleft("shard", 15) + F.col("place")).alias("lsn"))
        united = bits.select(*SHARD, "bits", F.lit(None).cast("array<bigint>").alias("places")).unionByName(containers(alone))
        self.write_part(united.withColumn("bucket", bucket), "seen", name)
        self.write_part(self.read_part("dictionary", before["dictionary"]), "dictionary", name)
        self.write_part(self._kept(before).withColumn("bucket", bucket_of_pick(before)), "kept", name)
        return self.commit(before | {"epoch": run, "late": False} | {p: [name] for p in ("seen", "dictionary", "kept")})

    def kept(self) -> DataFrame:
        """(code, lsn, batch_id, rec_pos): the one copy that stays of each message so far."""
        now = self.manifest()
        return self._kept(now).unionByName(self.read_held("doubtful", now).drop("bucket"))

    def dropped(self, batches: DataFrame) -> DataFrame:
        """(batch_id, rec_pos) of the copies in batches that don't stay; batches must have been ingested.

        The places that stay are gathered by batch, whose records are one row already, so no group outgrows a row.
        """
        stay = self.kept().groupBy(F.col("batch_id").alias("k_batch")).agg(F.collect_set("rec_pos").alias("stay"))
        places = F.filter(F.sequence(F.lit(0), F.size("records") - 1), lambda i: F.element_at("records", (i + 1).cast("int"))["lsn"].isNotNull())
        had = batches.where(F.size("records") > 0).select("batch_id", F.transform(places, lambda i: i.cast("bigint")).alias("had"))
        gone = F.array_except("had", F.coalesce("stay", F.array().cast("array<bigint>")))
        return had.join(stay, F.col("batch_id") == F.col("k_batch"), "left").select("batch_id", F.explode(gone).alias("rec_pos"))


def bucket_of_pick(now: dict):
    """The bucket of a pick: that of its code and shard."""
    return F.pmod(F.xxhash64(F.col("code"), bitmaps.bucket(F.col("lsn"))), F.lit(now["buckets"])).cast("int")


def containers(messages: DataFrame) -> DataFrame:
    """(code, shard, bits, places) from (code, shard, lsn), each message once: places where a shard has at most SPARSE, else bits."""
    counts = messages.groupBy(*SHARD).agg(F.count("*").alias("_n"))
    sized = messages.join(counts, SHARD)
    bits = sized.where(F.col("_n") > SPARSE).groupBy(*SHARD).agg(F.bitmap_construct_agg(bitmaps.bit(F.col("lsn"))).alias("bits"))
    places = sized.where(F.col("_n") <= SPARSE).groupBy(*SHARD).agg(F.collect_list(bitmaps.bit(F.col("lsn"))).alias("places"))
    return bits.select(*SHARD, "bits", F.lit(None).cast("array<bigint>").alias("places")).unionByName(places.select(*SHARD, F.lit(None).cast("binary").alias("bits"), "places"))
