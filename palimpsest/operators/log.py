"""The change log: kv_log(slot, key, value, is_removed, commit_ts, seq), `seq` ascending.

Snapshots, trash and merges are aggregates over it, combined before the shuffle,
so a key with a third of all versions costs no task more than others. `versions`
numbers all versions of a key, and so has to sort one key's in one task, which
Spark does on disk; `commit_crc` gathers one transaction's entries, whose bytes
the CRC is defined over in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["slot", "key"]


def as_of(log: DataFrame, commit_ts: int | None = None, seq: int | None = None) -> DataFrame:
    """What a snapshot sees: entries up to a commit time, or before a sequence number."""
    log = log if commit_ts is None else log.where(F.col("commit_ts") <= commit_ts)
    return log if seq is None else log.where(F.col("seq") < seq)


def last(log: DataFrame) -> DataFrame:
    """The last version of each key, removals included: what a merge keeps."""
    return log.groupBy(*KEY).agg(F.max_by(F.struct("value", "is_removed", "commit_ts", "seq"), "seq").alias("v")).select(*KEY, "v.*")


def latest(log: DataFrame) -> DataFrame:
    """Keys and their visible values; removed keys have none."""
    return last(log).where("not is_removed")


def unremoved(log: DataFrame) -> DataFrame:
    """The last value of each key that isn't a removal: what the trash still holds."""
    return last(log.where("not is_removed"))


def keys(log: DataFrame, slot: int) -> DataFrame:
    return latest(log.where(F.col("slot") == slot)).select("key")


def versions(log: DataFrame) -> DataFrame:
    """Every version with its number, from 1, oldest first."""
    return log.withColumn("version_no", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")).cast("long"))


def version(log: DataFrame, number: int) -> DataFrame:
    """The given version of each key; a removal has a null value."""
    return versions(log).where(F.col("version_no") == number).withColumn("value", F.when(~F.col("is_removed"), F.col("value")))


def last_updated(log: DataFrame) -> DataFrame:
    return log.agg(F.max("commit_ts").alias("last_updated"))


def latest_version(log: DataFrame) -> DataFrame:
    """(slot, key, ts): when each key last changed."""
    return log.groupBy(*KEY).agg(F.max("commit_ts").alias("ts"))


def merge(log: DataFrame) -> DataFrame:
    """Compaction: one version per key. A final removal stays, so the key stays removed, but its trash goes."""
    return last(log).withColumn("value", F.when(~F.col("is_removed"), F.col("value")))


def stage(log: DataFrame, writes: DataFrame, commit_ts: int, first_seq: int) -> DataFrame:
    """The log with a transaction's writes (slot, key, value, is_removed, n) appended: the last write of a key wins, all get one time."""
    won = writes.groupBy(*KEY).agg(F.max_by(F.struct("value", "is_removed", "n"), "n").alias("w")).select(*KEY, "w.*")
    return log.unionByName(won.select(*KEY, "value", "is_removed", F.lit(commit_ts).cast("long").alias("commit_ts"), (F.lit(first_seq) + F.col("n")).cast("long").alias("seq")))


def conflicts(transactions: DataFrame, log: DataFrame) -> DataFrame:
    """(tx_id, conflict) for reads (tx_id, slot, key, seq): whether a key that was read has changed at or after the snapshot's boundary.

    Blind writes aren't among the reads, so they never conflict; nor do transactions that only read, which don't commit.
    """
    newest = log.groupBy(*KEY).agg(F.max("seq").alias("newest"))
    return transactions.join(newest, KEY, "left").groupBy("tx_id").agg(F.bool_or(F.coalesce(F.col("newest") >= F.col("seq"), F.lit(False))).alias("conflict"))


def monotonic(log: DataFrame, time: str = "commit_ts", chunk: int = 1 << 16) -> DataFrame:
    """The log with `monotonic_ts`, the largest time so far.

    A running maximum in two levels: over the maxima of chunks of `seq`, then
    within each chunk, so no task sees more than one chunk of rows.
    """
    dealt = log.withColumn("chunk", F.expr(f"seq div {chunk}"))
    tops = dealt.groupBy("chunk").agg(F.max(time).alias("top"))
    before = tops.withColumn("before", F.max("top").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).select("chunk", "before")
    within = Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("own", F.max(time).over(within)).join(before, "chunk").withColumn("monotonic_ts", F.greatest("own", F.coalesce("before", "own"))).drop("chunk", "own", "before")


def commit_crc(entries: DataFrame) -> DataFrame:
    """(tx_id, crc): the CRC-32 of each transaction's entries (tx_id, seq, bytes) in order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "bytes"))), lambda e: F.hex(e["bytes"])), "")
    return entries.groupBy("tx_id").agg(F.crc32(F.unhex(joined)).alias("crc"))


def recover(entries: DataFrame) -> DataFrame:
    """Entries (tx_id, seq, bytes, crc) of the transactions before the first whose CRC is wrong."""
    said = entries.groupBy("tx_id").agg(F.max("crc").alias("said"))
    bad = commit_crc(entries).join(said, "tx_id").where("crc <> said").agg(F.min("tx_id").alias("bad"))
    return entries.crossJoin(F.broadcast(bad)).where("bad is null or tx_id < bad").drop("bad")  # one row


def size(log: DataFrame) -> DataFrame:
    """Entries and bytes of the values."""
    return log.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n_bytes"))
