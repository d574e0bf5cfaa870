"""Replication of a log: contiguity, what a follower may apply, ranges by LSN, batches to send, and set comparisons."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text
from . import segments


def applicable(records: DataFrame, followers: DataFrame) -> DataFrame:
    """Per namespace what of the incoming records a follower may apply: its last_lsn, the first LSN that is missing after
    it, and n_ready, the records before that one; records beyond it are refused, none is reordered or buffered."""
    first = records.join(followers, "ns_name").where(F.col("lsn") > F.col("last_lsn")).select("ns_name", "lsn")
    base = followers.select("ns_name", F.col("last_lsn").alias("lsn"))
    seen = first.unionByName(base)
    missing = segments.gaps(seen).groupBy("ns_name").agg(F.min("from_seq").alias("first_missing"))
    top = seen.groupBy("ns_name").agg(F.max("lsn").alias("top"))
    out = followers.join(top, "ns_name").join(missing, "ns_name", "left")
    limit = F.coalesce(F.col("first_missing"), F.col("top") + 1)
    return out.select("ns_name", "last_lsn", limit.alias("first_missing"), (limit - F.col("last_lsn") - 1).alias("n_ready"))


def in_range(log: DataFrame, after: int, upto: int) -> DataFrame:
    """Records with after < lsn <= upto."""
    return log.where((F.col("lsn") > after) & (F.col("lsn") <= upto))


def without(wanted: DataFrame, available: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and not available."""
    return wanted.join(available.select(*on).distinct(), on, "left_anti")


def reconciled(members: DataFrame, servers: DataFrame, key: str, address: str) -> DataFrame:
    """(key, action): add for members that are no server, update for a changed address, remove for servers that are no member."""
    m = members.select(key, F.col(address).alias("_m"), F.lit(True).alias("_in_m"))
    s = servers.select(key, F.col(address).alias("_s"), F.lit(True).alias("_in_s"))
    action = F.when(F.col("_in_s").isNull(), "add").when(F.col("_in_m").isNull(), "remove").when(~F.col("_m").eqNullSafe(F.col("_s")), "update")
    return m.join(s, key, "full_outer").select(key, action.alias("action")).where("action IS NOT NULL")


def notifications(changes: DataFrame, key: Column) -> DataFrame:
    """(topic, message): a JSON message for each effective entry, as subscribers of changes get them."""
    kind = text.lookup(F.col("entry_type"), text.ENTRY_TYPES)
    message = F.to_json(
        F.struct(
            F.base64(key).alias("key"),
            F.col("ns_name").alias("namespace"),
            text.lookup(F.col("operation_type"), text.OPERATIONS).alias("operation"),
            kind.alias("entry_type"),
            F.col("commit_lsn").alias("seq_num"),
        )
    )
    return changes.select(F.concat_ws(".", "ns_name", kind).alias("topic"), message.alias("message"))


def transactions(log: DataFrame) -> DataFrame:
    """(ns_name, txn_id, status, n_prepared, first_lsn, last_lsn, first_ms, last_ms): each transaction once."""
    rows = log.where(F.col("txn_id").isNotNull()).groupBy("ns_name", "txn_id", "lsn").agg(F.any_value("txn_state").alias("txn_state"), F.any_value("hlc").alias("hlc"))
    out = rows.groupBy("ns_name", "txn_id").agg(
        F.max(F.col("txn_state") == "Commit").alias("committed"),
        F.count_if(F.col("txn_state") == "Prepare").alias("n_prepared"),
        F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.min("hlc").alias("first_ms"), F.max("hlc").alias("last_ms"),
    )
    return out.withColumn("status", F.when(F.col("committed"), "committed").otherwise("open")).drop("committed")


def stale(txns: DataFrame, now_ms: Column, idle_ms: int = 120_000, age_ms: int = 900_000) -> DataFrame:
    """Open transactions without a record for idle_ms, or begun age_ms ago."""
    idle = (now_ms - F.col("last_ms") >= idle_ms) | (now_ms - F.col("first_ms") >= age_ms)
    return txns.where((F.col("status") == "open") & idle)


def namespace_settings(relays: DataFrame, namespaces: str, setting: str, default) -> tuple[DataFrame, DataFrame]:
    """relays with lists of namespaces as (ns_name, setting), and the namespaces named more than once, which is an error.
    A null setting takes the default."""
    flat = relays.select(F.explode(namespaces).alias("ns_name"), F.coalesce(F.col(setting), F.lit(default)).alias(setting))
    twice = flat.groupBy("ns_name").agg(F.count("*").alias("n")).where("n > 1").select("ns_name")
    return flat, twice


def members(rows: DataFrame, key: str, tags: str, namespace: str) -> DataFrame:
    """Members of a namespace, each once: those whose tags, a list of names, have it."""
    return rows.where(F.array_contains(tags, namespace)).dropDuplicates([key])


def relayed(batches: DataFrame) -> DataFrame:
    """Per (consumer_id, ns_name, batch_id): records, first and last lsn, and whether they follow each other
    without a gap, whatever their order in the batch."""
    flat = batches.select("consumer_id", "ns_name", "batch_id", F.explode("records.lsn").alias("lsn")).distinct()
    out = flat.groupBy("consumer_id", "ns_name", "batch_id").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))
    return out.withColumn("is_contiguous", F.col("last_lsn") - F.col("first_lsn") + 1 == F.col("n"))


#: Batches of a stream are followed in blocks of this many numbers.
BATCHES = 4096


def relay_checks(batches: DataFrame) -> DataFrame:
    """(consumer_id, ns_name, batch_id, n, first_lsn, last_lsn, prev_lsn, n_breaks, delay_ms): each batch as it came, in the order of its records:
    how many of them don't follow the record before by one, the first being compared with the last of the batch before; and the
    milliseconds from when any consumer was first sent a batch that ends with the same lsn of the namespace until this one was sent. Records without
    an lsn are left out; batches without any don't appear. prev_lsn is null for a consumer's first batch.

    Only one row for each batch is ordered, in blocks of batch_id, whose ends are compared in a second step.
    """
    lsns = F.filter(F.transform("records", lambda r: r["lsn"]), lambda x: x.isNotNull())
    own = batches.select("consumer_id", "ns_name", "batch_id", "server_ts", lsns.alias("l")).where(F.size("l") > 0)
    inner = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l", i) != F.get("l", i - 1) + 1), lambda x: x))
    flat = own.select(
        "consumer_id", "ns_name", "batch_id", "server_ts", F.size("l").cast("bigint").alias("n"), F.get("l", F.lit(0)).alias("first_lsn"), F.element_at("l", -1).alias("last_lsn"),
        F.when(F.size("l") > 1, inner).otherwise(0).cast("bigint").alias("n_inner"), F.floor(F.col("batch_id") / BATCHES).alias("_block"),
    )
    who = ["consumer_id", "ns_name"]
    inside = W.partitionBy(*who, "_block").orderBy("batch_id")
    ends = flat.groupBy(*who, "_block").agg(F.max_by("last_lsn", "batch_id").alias("_end"))
    ends = ends.select(*[F.col(c).alias(f"e_{c}") for c in who], F.col("_block").alias("e_block"), F.lag("_end").over(W.partitionBy(*who).orderBy("_block")).alias("_before"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in who)) & (F.col("_block") == F.col("e_block"))
    out = flat.withColumn("_lag", F.lag("last_lsn").over(inside)).join(ends, same).withColumn("prev_lsn", F.coalesce("_lag", "_before"))
    breaks = F.col("n_inner") + F.when(F.col("first_lsn") != F.col("prev_lsn") + 1, 1).otherwise(0)
    first_sent = flat.groupBy(F.col("ns_name").alias("f_ns"), F.col("last_lsn").alias("f_lsn")).agg(F.min("server_ts").alias("_first"))
    out = out.join(first_sent, F.col("ns_name").eqNullSafe(F.col("f_ns")) & (F.col("last_lsn") == F.col("f_lsn")))
    delay = ((F.unix_micros(F.col("server_ts").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 1000).cast("bigint")
    return out.select(*who, "batch_id", "n", "first_lsn", "last_lsn", "prev_lsn", breaks.alias("n_breaks"), delay.alias("delay_ms"))


def position_checks(received: DataFrame, log: DataFrame) -> DataFrame:
    """received (ns_name, lsn, segment_id, seg_offset) with status: same where the follower's own log has the record at that position,
    elsewhere where it has it at another, absent where it hasn't got it. Null positions are elsewhere."""
    own = segments.positions(log).select(F.col("ns_name").alias("_ns"), F.col("lsn").alias("_lsn"), F.col("segment_id").alias("_seg"), F.col("seg_offset").alias("_off"), F.lit(True).alias("_has"))
    joined = received.join(own, F.col("ns_name").eqNullSafe(F.col("_ns")) & (F.col("lsn") == F.col("_lsn")), "left")
    same = F.coalesce((F.col("segment_id") == F.col("_seg")) & (F.col("seg_offset") == F.col("_off")), F.lit(False))
    return joined.select(*received.columns, F.when(F.col("_has").isNull(), "absent").when(same, "same").otherwise("elsewhere").alias("status"))


def cluster_stats(servers: DataFrame, is_voter: Column, is_leader: Column) -> DataFrame:
    """(n_servers, n_voters, n_leaders) of a cluster's servers."""
    return servers.agg(F.count("*").alias("n_servers"), F.count_if(is_voter).alias("n_voters"), F.count_if(is_leader).alias("n_leaders"))
