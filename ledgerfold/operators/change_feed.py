"""A table kept current under a feed of inserts, updates and deletes, read through delete vectors.

Each batch of log records is appended as immutable images. An index from key to file and position finds the
images that the batch supersedes; their positions go into one bitmap per file and 32,768 rows. A read scans
the images and leaves out the positions whose bit is set, so nothing is rewritten.

A batch writes in proportion to itself: images, index entries, barriers and bits of the keys it touches. Index and barriers
are cut into buckets by key, open and finished transactions into buckets by transaction, each sorted by key; a batch reads
and, of what waits, rewrites only the buckets it touches. With many more buckets than keys in a batch, that is in
proportion to the batch. compact() folds pieces together from time to time.

Parts, each with a folder of its own for each attempt at an epoch; the manifest commits/E.json names the folders that make
up the table at E, so what a failed attempt or a writer that came second has left is never read:
  data      images (ns_name, entry_type, entry_key, part, value, kind, commit_lsn, lsn, entry_no)
  index     for keys touched the place (file_no, row_pos) and order of the newest change; later epochs outdo earlier ones
  barriers  for rows and large objects touched the last barrier
  waiting   prepared entries whose transaction hasn't been committed yet, by bucket
  done      committed transactions, for entries that arrive after their commit
  vectors   bits that the epoch sets: (file_no, bucket, bits)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import bitmaps
from ..session import attempt
from . import txn
from .parts import PartStore, bucket_of, epoch_of, numbers_of, observed

ID = ["ns_name", "entry_type", "entry_key", "part"]
KEY = ID[:3]
TXN = ["ns_name", "txn_id"]
PLACE = ["file_no", "row_pos"]
#: What makes an index entry the newest of its key and part: the order of the change, then the epoch that recorded it.
#: An index folder also has the place that the entry's value had before, which only its own epoch reads.
NEWEST_COLUMNS = [*txn.ORDER, "epoch", "live", *PLACE]

IMAGE = "ns_name string, entry_type string, entry_key binary, part string, value binary, kind string, commit_lsn bigint, lsn bigint, entry_no bigint"
INDEX = "ns_name string, entry_type string, entry_key binary, part string, commit_lsn bigint, lsn bigint, entry_no bigint, epoch bigint, live boolean, file_no bigint, row_pos bigint, bucket int"
OWN_INDEX = INDEX + ", prev_file_no bigint, prev_row_pos bigint"
BARRIER = "ns_name string, entry_type string, entry_key binary, bar struct<commit_lsn:bigint,lsn:bigint,entry_no:bigint>, bucket int"
WAITING = "ns_name string, lsn bigint, operation_type string, txn_state string, entry_type string, txn_id binary, entry_no bigint, entry_key binary, entry_value binary, cells map<string,binary>, bucket int"
DONE = "ns_name string, txn_id binary, commit_lsn bigint, commit_op string, bucket int"
VECTOR = "file_no bigint, bucket bigint, bits binary"


def file_no(epoch: Column, name: Column) -> Column:
    """An exact number for a data file: its epoch, and the task and part in the name that Spark gives it."""
    task = F.regexp_extract(name, r"part-(\d+)-", 1).cast("bigint")
    piece = F.regexp_extract(name, r"-c(\d+)", 1).cast("bigint")
    return F.shiftleft(epoch.cast("bigint"), 44) + F.shiftleft(task, 16) + piece


class FeedTable(PartStore):
    """Applies batches of log records in any order of arrival, and reads the state they leave.

    Repeated records, late records and transactions over several batches are allowed: an image is superseded by
    any change of its key with a higher (commit_lsn, lsn, entry_no), whenever that arrived; of repeats one stays.
    Null keys in entries change nothing. An empty batch is a valid epoch. A transaction ends at its first commit; of two
    commits of one transaction the one that arrives in an earlier batch counts as the first.

    buckets, at most 32,768, is fixed by the first epoch.
    """

    PARTS = {"data": IMAGE, "index": INDEX, "barriers": BARRIER, "waiting": WAITING, "done": DONE, "vectors": VECTOR}
    SORTED = {"index": ID, "barriers": KEY, "waiting": [*TXN, "lsn"], "done": TXN}
    HELD = {"waiting"}

    def manifest(self) -> dict:
        """The table's folders by part, and how many delete vectors they have."""
        return {"n_vectors": 0} | super().manifest()

    def _images(self, folders: list[str]) -> DataFrame:
        """The images with their places, in one scan; the epoch, part of the place, comes from the path."""
        if not folders:
            return self.spark.createDataFrame([], f"{IMAGE}, {', '.join(f'{c} bigint' for c in PLACE)}")
        epoch = F.regexp_extract(F.col("_metadata.file_path"), r"/attempt=(\d+)-", 1)
        columns = [c.split(" ")[0] for c in IMAGE.split(", ")]
        return self.files_of("data", folders, IMAGE).select(*columns, file_no(epoch, F.col("_metadata.file_name")).alias("file_no"), F.col("_metadata.row_index").alias("row_pos"))

    # ---- applying ----

    def apply(self, log: DataFrame) -> int:
        """Apply one batch of log records; returns its epoch. Nothing of it shows before its manifest is there. An attempt
        that fails leaves folders that no manifest names. Of two writers of one epoch one gets FileExistsError."""
        before = self.manifest()
        epoch = before["epoch"] + 1
        name = attempt(epoch)
        rows = txn.entries(log)
        by_txn, by_key = bucket_of(TXN, before), bucket_of(KEY, before)

        # Transactions: entries wait until their commit is known; commits stay known for entries that come late.
        touched_txns = self._transactions_of(log, before) if before["done"] or before["waiting"] else []
        own = txn.commits(log).withColumn("bucket", by_txn)
        self.write_part(own, "done", name)
        done = self.read_part("done", [*before["done"], name], touched_txns if before["done"] else None)
        done = done.groupBy(*TXN).agg(F.min(F.struct("commit_lsn", "commit_op")).alias("c")).select(*TXN, "c.*")
        waiting = txn.prepared(rows).withColumn("bucket", by_txn).unionByName(self.read_held("waiting", before, touched_txns))
        still = self.write_part(txn.uncommitted(waiting, done), "waiting", name, F.col("bucket"))
        held = self.held_after(before["waiting"], touched_txns, name, still)

        # Append the new images.
        changes = txn.units(txn.plain(rows).unionByName(txn.visible(waiting.drop("bucket"), done)))
        images = changes.select("ns_name", "entry_type", "entry_key", "part", "value", "kind", *txn.ORDER)
        touched_keys = self.write_part(images, "data", name, by_key)

        # Find what they supersede: the old entries of the keys they touch.
        placed = self._images([name]).drop("value")
        bars = txn.barriers(placed)
        number = F.lit(epoch).cast("bigint").alias("epoch")
        entries = placed.where("kind <> 'bar'").select(*ID, *txn.ORDER, number, (F.col("kind") == "put").alias("live"), *PLACE)
        if before["index"]:
            keys = placed.select(*KEY).distinct()
            entries = entries.unionByName(touched(self.read_part("index", before["index"], touched_keys).drop("bucket"), keys))
            bars = bars.unionByName(touched(self.read_part("barriers", before["barriers"], touched_keys).drop("bucket"), keys))
        self.write_part(bars.groupBy(*KEY).agg(F.max("bar").alias("bar")).withColumn("bucket", by_key), "barriers", name)
        bars = self.read_part("barriers", [name])
        best = F.struct(*NEWEST_COLUMNS)
        newest = entries.groupBy(*ID).agg(F.max(best).alias("n"), F.max(F.when(F.col("epoch") < epoch, best)).alias("p")).select(*ID, "n.*", "p")
        b = bars.select(*[F.col(c).alias(f"b_{c}") for c in KEY], "bar")
        stays = F.col("live") & (F.col("bar").isNull() | (txn.order_key() > F.col("bar")))
        before_place = [F.when(F.col("p.live"), F.col(f"p.{c}")).alias(f"prev_{c}") for c in PLACE]
        index = newest.join(b, same_key("b_"), "left").select(*ID, *txn.ORDER, number, stays.alias("live"), *PLACE, by_key.alias("bucket"), *before_place)
        self.write_part(index, "index", name)
        index = self.read_paths("index", [name], OWN_INDEX)

        # Set their bits: new places that aren't live, and old ones that were and aren't now.
        live = index.where("live").select(*PLACE, F.lit(1).alias("stays"))
        new = placed.select(*PLACE, F.lit(0).alias("stays")).unionByName(live).groupBy(*PLACE).agg(F.max("stays").alias("stays")).where("stays = 0")
        moved = ~F.col("live") | (F.col("file_no") != F.col("prev_file_no")) | (F.col("row_pos") != F.col("prev_row_pos"))
        old = index.where(F.col("prev_file_no").isNotNull() & moved).select(*[F.col(f"prev_{c}").alias(c) for c in PLACE])
        gone = new.select(*PLACE).unionByName(old)
        vectors = gone.groupBy("file_no", bitmaps.bucket(F.col("row_pos")).alias("bucket")).agg(F.bitmap_construct_agg(bitmaps.bit(F.col("row_pos"))).alias("bits"))
        counted = Observation()
        self.write_part(vectors.observe(counted, F.count(F.lit(1)).alias("n")), "vectors", name)
        added = {p: [*before[p], name] for p in self.PARTS if p not in self.HELD} | {"waiting": held}
        return self.commit(before | {"epoch": epoch, "n_vectors": before["n_vectors"] + observed(counted, "n", 0), **added})

    def _transactions_of(self, log: DataFrame, now: dict) -> list[int]:
        """The buckets of the transactions that the batch has prepared entries or commits of."""
        found = log.where(F.col("txn_id").isNotNull() & F.col("txn_state").isin(txn.PREPARE, txn.COMMIT))
        return numbers_of(found.agg(F.bitmap_construct_agg(bucket_of(TXN, now).cast("bigint"))).first()[0])

    def abandon(self, txns: DataFrame) -> int:
        """End open transactions (ns_name, txn_id), such as those a reaper found: what they have prepared, or prepare yet, waits
        no longer, and has no effect if a commit comes after all. Returns the epoch."""
        before = self.manifest()
        epoch = before["epoch"] + 1
        name = attempt(epoch)
        ended = txns.select(*TXN).distinct()
        touched_txns = numbers_of(ended.agg(F.bitmap_construct_agg(bucket_of(TXN, before).cast("bigint"))).first()[0])
        e = ended.select(*[F.col(c).alias(f"e_{c}") for c in TXN])
        same = F.col("ns_name").eqNullSafe(F.col("e_ns_name")) & (F.col("txn_id") == F.col("e_txn_id"))
        still = self.write_part(self.read_held("waiting", before, touched_txns).join(e, same, "left_anti"), "waiting", name, F.col("bucket"))
        # known as if ended by a commit before all records, which makes nothing visible
        self.write_part(ended.select(*TXN, F.lit(-1).cast("bigint").alias("commit_lsn"), F.lit("NoOperation").alias("commit_op"), bucket_of(TXN, before).alias("bucket")), "done", name)
        held = self.held_after(before["waiting"], touched_txns, name, still)
        return self.commit(before | {"epoch": epoch, "waiting": held, "done": [*before["done"], name]})

    # ---- reading ----

    def changes(self, epoch: int) -> DataFrame:
        """(ns_name, entry_type, entry_key, operation_type, commit_lsn, lsn, entry_no): the entries that an epoch made effective, each once."""
        folders = [f for f in self.manifest()["data"] if epoch_of(f) == epoch]
        removed = F.when(F.col("kind") == "put", txn.INSERT).when((F.col("kind") == "bar") & (F.col("entry_type") == txn.ROW), txn.DELETE_ROW).otherwise(txn.DELETE)
        return self.read_part("data", folders).select(*KEY, removed.alias("operation_type"), *txn.ORDER).distinct()

    def vectors(self) -> DataFrame:
        """(file_no, bucket, bits): the delete vectors of all epochs, united."""
        return self.read_part("vectors", self.manifest()["vectors"]).groupBy("file_no", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def read(self) -> DataFrame:
        """The live images: (ns_name, entry_type, entry_key, part, value, commit_lsn, lsn, entry_no).

        The delete vectors are broadcast if all of them together are below broadcast_bytes, as the manifest counts
        them; else the join on (file_no, bucket) shuffles.
        """
        now = self.manifest()
        return self._live(now, now["data"])

    def _live(self, now: dict, folders: list[str]) -> DataFrame:
        images = self._images(folders).where("kind = 'put'")
        vectors = self.vectors().select(F.col("file_no").alias("v_file"), F.col("bucket").alias("v_bucket"), "bits")
        if now["n_vectors"] * (bitmaps.BYTES + 32) <= self.broadcast_bytes:
            vectors = F.broadcast(vectors)
        joined = images.join(vectors, (F.col("file_no") == F.col("v_file")) & (bitmaps.bucket(F.col("row_pos")) == F.col("v_bucket")), "left")
        dropped = F.coalesce(bitmaps.is_set(F.col("bits"), bitmaps.bit(F.col("row_pos"))), F.lit(False))
        return joined.where(~dropped).select(*ID, "value", *txn.ORDER)

    # ---- upkeep ----

    def compact(self, last: int | None = None) -> int:
        """Write the live images of the last data folders, or of all, as one epoch without delete vectors; returns it.

        With all of them, the other parts are folded together too. With some, the index gets their new places as one more
        folder, and the vectors of the others stay, so the work is in proportion to what is rewritten. Deletes and barriers
        stay known, for changes that are older and come later. Old folders are left for readers that still use them; vacuum()
        removes them.
        """
        before = self.manifest()
        epoch = before["epoch"] + 1
        name = attempt(epoch)
        folders = before["data"] if last is None else before["data"][-last:]
        kept = before["data"][: len(before["data"]) - len(folders)]
        by_key = bucket_of(KEY, before).alias("bucket")
        images = self._live(before, folders).withColumn("kind", F.lit("put"))
        self.write_part(images.select("ns_name", "entry_type", "entry_key", "part", "value", "kind", *txn.ORDER), "data", name)
        mark = F.lit(epoch).cast("bigint").alias("epoch")
        index = self._images([name]).select(*ID, *txn.ORDER, mark, F.lit(True).alias("live"), *PLACE, by_key)
        now = before | {"epoch": epoch, "data": [*kept, name]}
        if kept:
            self.write_part(index, "index", name)
            inside = [epoch_of(f) for f in folders]
            vectors = self.vectors().where(~F.shiftright("file_no", 44).isin(inside))
            now["index"] = [*before["index"], name]
        else:
            dead = self.read_part("index", before["index"]).groupBy(*ID).agg(F.max(F.struct(*NEWEST_COLUMNS)).alias("n")).select(*ID, "n.*").where("NOT live")
            self.write_part(index.unionByName(dead.select(*ID, *txn.ORDER, mark, "live", *PLACE, by_key)), "index", name)
            bars = self.read_part("barriers", before["barriers"]).groupBy(*KEY).agg(F.max("bar").alias("bar"))
            self.write_part(bars.withColumn("bucket", by_key), "barriers", name)
            done = self.read_part("done", before["done"]).groupBy(*TXN).agg(F.min(F.struct("commit_lsn", "commit_op")).alias("c"))
            self.write_part(done.select(*TXN, "c.*", bucket_of(TXN, before).alias("bucket")), "done", name)
            still = self.write_part(self.read_held("waiting", before), "waiting", name, F.col("bucket"))
            vectors = self.empty("vectors")
            now |= {p: [name] for p in ("index", "barriers", "done")} | {"waiting": {str(b): name for b in still}}
        counted = Observation()
        self.write_part(vectors.observe(counted, F.count(F.lit(1)).alias("n")), "vectors", name)
        return self.commit(now | {"vectors": [name], "n_vectors": observed(counted, "n", 0)})


def same_key(prefix: str) -> Column:
    ns, kind, key = (F.col(f"{prefix}{c}") for c in KEY)
    return F.col("ns_name").eqNullSafe(ns) & (F.col("entry_type") == kind) & (F.col("entry_key") == key)


def touched(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the given keys. Spark broadcasts the keys if they are few, so the index isn't shuffled."""
    return rows.join(keys.select(*[F.col(c).alias(f"t_{c}") for c in KEY]), same_key("t_"), "left_semi")


def live_values(state: DataFrame) -> DataFrame:
    """The state as (ns_name, entry_type, key_hex, cell_name, lsn, entry_no); a large object gives its last chunk."""
    single = state.where(F.col("entry_type") != txn.CHUNKED)
    objects = state.where(F.col("entry_type") == txn.CHUNKED).groupBy(*KEY).agg(F.max(F.struct(*txn.ORDER)).alias("o"))
    out = single.select(*KEY, F.col("part").alias("cell_name"), "lsn", "entry_no").unionByName(
        objects.select(*KEY, F.lit("").alias("cell_name"), "o.lsn", "o.entry_no")
    )
    return out.select("ns_name", "entry_type", F.hex("entry_key").alias("key_hex"), "cell_name", "lsn", "entry_no")
