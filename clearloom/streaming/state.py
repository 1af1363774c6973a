"""Streams with kept state in RocksDB: a dedup gate, batches that answer once, a priority queue, and a fetch limit by domain. All go on after a restart where their checkpoint ends.

Each needs spark.sql.streaming.stateStore.providerClass set to RocksDB's; session() does it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clearloom.config import DEFAULT
from clearloom.operators import dedup

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# ---- dedup gate
#: Bands of a 64-bit SimHash. Hashes at most 3 bits apart agree in one of 4.
BANDS = 4
LEADER = "asset_id string, seq long, track string, asset_hash string, simhash long, status string, matched_source string"


class KnownLeaders(StatefulProcessor):
    """For a key (content hash, or track and band of the SimHash): the leaders recorded under it. Asked rows get the first that fits."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("leaders", "asset_id string", "seq long, asset_hash string, simhash long, status string, matched_source string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        asked = []
        for pdf in rows:
            for r in pdf.itertuples():
                if r.record:
                    if not self.known.containsKey((r.asset_id,)):
                        self.known.updateValue((r.asset_id,), (int(r.seq), r.asset_hash, int(r.simhash), r.status, r.matched_source))
                else:
                    asked.append(r)
        if asked:
            leaders = sorted((v[0], k[0], *v[1:]) for k, v in self.known.iterator())
            found = []
            for r in asked:
                exact = key[0].startswith("=")
                for seq, leader, digest, simhash, status, source in leaders:
                    if digest == r.asset_hash if exact else bin((simhash ^ int(r.simhash)) & (1 << 64) - 1).count("1") <= self.most:
                        found.append((r.asset_id, int(r.seq), exact, leader, seq, status, source))
                        break
            if found:
                yield pd.DataFrame(found, columns=["asset_id", "seq", "exact", "leader", "leader_seq", "leader_status", "leader_source"])


def _keys(rows: DataFrame) -> DataFrame:
    """A row for each key that an asset is known by: track and content hash, and for text, code and images the bands of a SimHash or perceptual hash that isn't 0."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.concat_ws(":", "track", i.cast("string"), F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("simhash"), (F.lit(48) - 16 * i).cast("int")), F.lit(48)).cast("string")))
    near = F.when(F.col("track").isin("TEXT", "CODE", "IMAGE") & (F.col("simhash") != 0), bands).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("key", F.explode(F.concat(F.array(F.concat(F.lit("="), "track", F.lit(":"), "asset_hash")), near)))


def _leading(rows: DataFrame) -> DataFrame:
    """key, l_simhash, l of leaders, for a join with _keys()."""
    return _keys(rows).select("key", F.col("simhash").alias("l_simhash"), F.struct(F.col("seq").alias("leader_seq"), F.col("asset_id").alias("leader"), F.col("status").alias("leader_status"), F.col("matched_source").alias("leader_source")).alias("l"))


def dedup_gate(assets: DataFrame, folder: str, most: int = DEFAULT.simhash_distance, once: bool = True):
    """Starts a stream that decides which assets of LEADER's columns (status: what evaluation says of the asset itself) repeat an earlier one.

    An asset repeats the first recorded one of its track with its content hash, or else (text, code, images) with a SimHash or perceptual hash at most `most` bits away; it then takes that one's status and source, and isn't recorded. Others are recorded if they passed or were blocked and are text, image or code: reviews, errors, audio and video never enter the state. Order is by seq, which differs from row to row; simhash holds the perceptual hash of an image.

    folder/decisions gets asset_id, seq, leader (itself, if new), is_duplicate, status, matched_source; folder/leaders what was recorded. Recorded leaders come back as input: state is kept by key, and a new leader has several. What this run recorded (for its first batch: all that was recorded, as a batch that failed runs again with the input it had) is looked up in folder/leaders, since it may not have come back yet. A batch that runs again overwrites its own parts. Rows of one batch that repeat each other are settled in it, in order of seq.
    """
    spark = assets.sparkSession
    session(spark)
    leaders, decisions = f"{folder}/leaders", f"{folder}/decisions"
    path = spark._jvm.org.apache.hadoop.fs.Path(leaders)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
    back = spark.readStream.schema(LEADER).option("recursiveFileLookup", "true").parquet(leaders).withColumn("record", F.lit(True))
    names = [x.split()[0] for x in LEADER.split(", ")]
    asked = assets.select(*names).withColumn("record", F.lit(False))
    rows = _keys(back.select(*names, "record").unionByName(asked)).repartition("key")
    met = rows.groupBy("key").transformWithStateInPandas(KnownLeaders(most), "asset_id string, seq long, exact boolean, leader string, leader_seq long, leader_status string, leader_source string", "append", "none")
    # The stateful operator names earlier leaders; the rows themselves go along, so that new ones are seen too.
    both = met.select("*", *(F.lit(None).cast(t).alias(f"own_{n}") for n, t in (x.split() for x in LEADER.split(", ")))).unionByName(
        asked.select("asset_id", "seq", *(F.lit(None).cast(t).alias(n) for n, t in (("exact", "boolean"), ("leader", "string"), ("leader_seq", "long"), ("leader_status", "string"), ("leader_source", "string"))), *(F.col(n).alias(f"own_{n}") for n in names))
    )

    done: list[int] = []

    def fits(l: str) -> Column:
        return F.col("key").startswith("=") | (F.bit_count(F.col("simhash").bitwiseXOR(F.col(l))) <= most)

    def settle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        own = batch.filter(F.col("own_asset_id").isNotNull()).select(*(F.col(f"own_{n}").alias(n) for n in names))
        recent = spark.read.schema(f"{LEADER}, batch int").parquet(leaders)
        recent = _leading(recent.filter(F.col("batch").isin(done) if done else F.col("batch") < number))
        late = _keys(own).join(recent, "key").filter(fits("l_simhash")).select("asset_id", "seq", F.col("key").startswith("=").alias("exact"), "l.*")
        earlier = batch.filter(F.col("leader").isNotNull()).select(late.columns).unionByName(late)
        earlier = earlier.groupBy("asset_id", "seq").agg(F.min(F.struct((~F.col("exact")).alias("late"), "leader_seq", "leader", "leader_status", "leader_source")).alias("e"))
        rows = own.join(earlier, ["asset_id", "seq"], "left")
        fresh = rows.filter(F.col("e").isNull()).drop("e")
        # Among new ones: leaders are those that can be recorded, in order of seq.
        can = fresh.filter(F.col("status").isin("PASSED", "BLOCKED") & F.col("track").isin("TEXT", "IMAGE", "CODE"))
        chosen = dedup.elect_leaders(can.select("seq", "asset_hash", "track", F.col("simhash").alias("s")), "seq", "asset_hash", "s", most, ("track",)).filter(F.col("seq") == F.col("leader")).select("seq")
        new = can.join(chosen, "seq", "left_semi").persist()
        again = _keys(fresh).join(_leading(new), "key").filter((F.col("l.leader_seq") < F.col("seq")) & fits("l_simhash"))
        again = again.groupBy("asset_id", "seq").agg(F.min(F.struct((~F.col("key").startswith("=")).alias("late"), "l")).alias("n"))
        out = rows.join(again, ["asset_id", "seq"], "left")
        leader = F.coalesce("e.leader", "n.l.leader")
        status = F.coalesce("e.leader_status", "n.l.leader_status", "status")
        source = F.when(leader.isNotNull(), F.coalesce("e.leader_source", "n.l.leader_source")).otherwise(F.col("matched_source"))
        out = out.select("asset_id", "seq", F.coalesce(leader, F.col("asset_id")).alias("leader"), leader.isNotNull().alias("is_duplicate"), status.alias("status"), source.alias("matched_source"))
        out.write.mode("overwrite").parquet(f"{decisions}/batch={number}")
        new.select(*names).write.mode("overwrite").parquet(f"{leaders}/batch={number}")
        done.append(number)
        new.unpersist()
        batch.unpersist()

    writer = both.writeStream.foreachBatch(settle).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---- batches that answer once
class FirstAnswer(StatefulProcessor):
    """Of a batch key: the first submission's results, returned again for later ones. Submissions are told apart by `submission`, the smallest is first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("results", "asset_id string, verdict string")
        self.first = handle.getValueState("first", "submission string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["submission", "asset_id"], kind="stable")
        fresh = not self.first.exists()
        if fresh:
            first = str(pdf["submission"].iloc[0])
            mine = pdf[pdf["submission"] == first]
            self.kept.put([(a, v) for a, v in zip(mine["asset_id"], mine["verdict"])])
            self.first.update((first,))
        first, results = self.first.get()[0], list(self.kept.get())
        count = lambda v: sum(r[1] == v for r in results)
        out = [(key[0], s, len(results), count("PASSED"), count("BLOCKED"), count("REVIEW"), s != first or not fresh, ",".join(f"{a}={v}" for a, v in results)) for s in pdf["submission"].unique()]
        yield pd.DataFrame(out, columns=["batch_key", "submission", "total_assets", "passed_count", "blocked_count", "review_count", "idempotent_cached", "results"])


ANSWER = "batch_key string, submission string, total_assets long, passed_count long, blocked_count long, review_count long, idempotent_cached boolean, results string"


def idempotent_batches(results: DataFrame) -> DataFrame:
    """A row of ANSWER for each submission in a stream of results (batch_key, submission, asset_id, verdict). A submission arrives whole, in one micro-batch; a batch has at most 10,000 assets (see assets.batches), which bounds the state of a key."""
    session(results.sparkSession)
    return results.groupBy("batch_key").transformWithStateInPandas(FirstAnswer(), ANSWER, "append", "none")


# ---- priority queue
class PriorityQueue(StatefulProcessor):
    """Of a queue: waiting items, by (priority, order of arrival). Each trigger with input releases at most `most`; failed ones come back `step` lower, up to `retries` times, then they are dead."""

    def __init__(self, most: int, retries: int, step: int):
        self.most, self.retries, self.step = most, retries, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "item_id string", "priority long, place long, failures long")
        self.out = handle.getMapState("released", "item_id string", "priority long, failures long")
        self.place = handle.getValueState("place", "place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        place = self.place.get()[0] if self.place.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            item = (r.item_id,)
            if r.kind == "enqueue":
                place += 1
                self.waiting.updateValue(item, (int(r.priority), place, 0))
            elif r.kind in ("failed", "done") and self.out.containsKey(item):
                priority, failures = self.out.getValue(item)
                self.out.removeKey(item)
                if r.kind == "failed" and failures + 1 > self.retries:
                    out.append((key[0], r.item_id, "dead", priority, failures + 1))
                elif r.kind == "failed":
                    place += 1
                    self.waiting.updateValue(item, (priority + self.step, place, failures + 1))
        self.place.update((place,))
        for priority, _, failures, item in heapq.nsmallest(self.most, ((v[0], v[1], v[2], k[0]) for k, v in self.waiting.iterator())):
            self.waiting.removeKey((item,))
            self.out.updateValue((item,), (priority, failures))
            out.append((key[0], item, "released", priority, failures))
        if out:
            yield pd.DataFrame(out, columns=["queue", "item_id", "event", "priority", "failures"])


def priority_queue(events: DataFrame, most: int, retries: int = DEFAULT.queue_retries, step: int = 5) -> DataFrame:
    """queue, item_id, event (released, dead), priority, failures of a stream of events: queue, seq, kind (enqueue, failed, done, tick), item_id, priority. Failures requeue behind what has their new priority already. A queue is one key, its depth is bounded by backpressure (queue.metrics); many queues spread."""
    session(events.sparkSession)
    return events.groupBy("queue").transformWithStateInPandas(PriorityQueue(most, retries, step), "queue string, item_id string, event string, priority long, failures long", "append", "none")


# ---- fetch limit by domain
class TokenBucket(StatefulProcessor):
    """Of a part of a domain: URLs wait in order; `most` are let go in each interval of event time."""

    def __init__(self, most: int, interval_ms: int):
        self.most, self.interval = most, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "slot long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        slot, used = self.next.get() if self.next.exists() else (-1, 0)
        for pdf in rows:
            due = []
            for at in (pdf["due_ms"] // self.interval).astype("int64"):
                if at > slot:
                    slot, used = int(at), 0
                if used == self.most:
                    slot, used = slot + 1, 0
                used += 1
                due.append(slot * self.interval)
            yield pd.DataFrame({"domain": key[0], "url": pdf["url"], "due_ms": pdf["due_ms"], "fetch_ms": due})
        self.next.update((slot, used))


def rate_limited(urls: DataFrame, most: int = 3, interval_ms: int = 1000) -> DataFrame:
    """domain, url, due_ms, fetch_ms of a stream of due URLs (domain, url, due_ms): the start of the first interval, not before due_ms's, in which fewer than `most` of the domain are let go. Only the place in time is kept for a domain, not its URLs, so a hot domain is spread in time and costs two numbers; its rows pass through one task, in Arrow batches, as one counter has to see them."""
    session(urls.sparkSession)
    return urls.groupBy("domain").transformWithStateInPandas(TokenBucket(most, interval_ms), "domain string, url string, due_ms long, fetch_ms long", "append", "none")
