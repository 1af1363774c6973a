"""The ledger of certificates: each sealing is a hash trie over its entries, and a short chain of blocks holds one root for each sealing.

An entry's leaf is the SHA-256 of `certificate_id:asset_hash`. Leaves with the same first digits are a bucket, whose node hashes its sorted leaves; a node above hashes its up to 16 children. Which digits are taken follows from the number of entries, so a bucket has some hundred leaves at any size, no task sees more than a bucket or 16 children, and the root depends on the entries alone, not on their order or on partitions.

Nulls: an entry without certificate_id or asset_hash isn't sealed. Repeated entries count once.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaves of a bucket, on average at most.
BUCKET = 256
GENESIS = {"index": 0, "timestamp": "2026-01-01T00:00:00Z", "previous_hash": "0" * 64, "transactions": [{"type": "GENESIS", "message": "Ledger anchor"}], "merkle_root": hashlib.sha256(b"genesis").hexdigest()}
NODE = "epoch, prefix, hash, n, members"


def block_hash(block: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in block.items() if k != "block_hash"}, sort_keys=True).encode()).hexdigest()


def leaf(certificate_id: Column, asset_hash: Column) -> Column:
    return F.sha2(F.concat(certificate_id.cast("string"), F.lit(":"), asset_hash), 256)


def joined_hash(members: Column) -> Column:
    return F.sha2(F.array_join(members, ","), 256)


def depth(entries: int, bucket: int = BUCKET) -> int:
    """Digits of a bucket's prefix."""
    return max(1, math.ceil(math.log(max(1, entries) / bucket, 16) - 1e-9))


def leaves(entries: DataFrame) -> DataFrame:
    """epoch, certificate_id, asset_hash, leaf of entries (epoch: the number of their sealing)."""
    rows = entries.filter(F.col("certificate_id").isNotNull() & F.col("asset_hash").isNotNull())
    return rows.select("epoch", "certificate_id", "asset_hash", leaf(F.col("certificate_id"), F.col("asset_hash")).alias("leaf")).distinct()


def nodes(leaf_rows: DataFrame, digits: int) -> DataFrame:
    """epoch, prefix, hash, n (leaves below), members of each node: a bucket's sorted leaves, or `digit:hash` of children. The root's prefix is empty."""
    members = F.sort_array(F.collect_list("leaf")).alias("members")  # a bucket
    now = leaf_rows.groupBy("epoch", F.substring("leaf", 1, digits).alias("prefix")).agg(members, F.count("*").alias("n"))
    now = now.select("epoch", "prefix", joined_hash(F.col("members")).alias("hash"), "n", "members")
    out = now
    for _ in range(digits):
        child = F.concat(F.right("prefix", F.lit(1)), F.lit(":"), "hash")
        now = now.groupBy("epoch", F.expr("left(prefix, length(prefix) - 1)").alias("prefix")).agg(F.sort_array(F.collect_list(child)).alias("members"), F.sum("n").alias("n"))  # 16 at most
        now = now.select("epoch", "prefix", joined_hash(F.col("members")).alias("hash"), "n", "members")
        out = out.unionByName(now)
    return out


def chain(spark: SparkSession, roots: list[tuple[int, str, str, int]], head: dict | None = None) -> DataFrame:
    """index, timestamp, previous_hash, merkle_root, n, block, block_hash: a block for each sealing (epoch, timestamp, root, n), in order, after `head` (or the first block). One row for each sealing: what the driver holds."""
    previous, out = head or GENESIS | {"block_hash": block_hash(GENESIS)}, []
    for _, at, root, n in sorted(roots):
        b = {"index": previous["index"] + 1, "timestamp": at, "previous_hash": previous["block_hash"], "merkle_root": root, "n": n}
        previous = b | {"block_hash": block_hash(b)}
        out.append((b["index"], at, b["previous_hash"], root, n, json.dumps(b, sort_keys=True), previous["block_hash"]))
    return spark.createDataFrame(out, "index long, timestamp string, previous_hash string, merkle_root string, n long, block string, block_hash string")


def seal(entries: DataFrame, at: str, head: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, blocks) of entries (epoch, certificate_id, asset_hash). The tries are checkpointed; one row for each epoch goes to the driver."""
    spark = entries.sparkSession
    kept = leaves(entries).checkpoint()
    most = kept.groupBy("epoch").count().agg(F.max("count")).first()[0] or 0
    trie = nodes(kept, depth(most)).checkpoint()
    roots = trie.filter("prefix = ''").select("epoch", "hash", "n").collect()
    return kept, trie, chain(spark, [(r.epoch, at, r.hash, r.n) for r in roots], head)


def tampered(leaf_rows: DataFrame, trie: DataFrame, blocks: DataFrame) -> DataFrame:
    """kind, epoch or index, prefix of all that doesn't hash to what is stored: leaves, nodes, blocks and links between them. blocks: as many as sealings."""
    bad_leaf = leaf_rows.filter(F.col("leaf") != leaf(F.col("certificate_id"), F.col("asset_hash"))).select(F.lit("leaf").alias("kind"), "epoch", F.col("leaf").alias("prefix"))
    bad_node = trie.filter(F.col("hash") != joined_hash(F.col("members"))).select(F.lit("node"), "epoch", "prefix")
    digits = trie.agg(F.max(F.length("prefix"))).first()[0] or 1
    again = nodes(leaf_rows.withColumn("leaf", leaf(F.col("certificate_id"), F.col("asset_hash"))), digits).select("epoch", "prefix", F.col("hash").alias("now"))
    other = trie.join(again, ["epoch", "prefix"], "full").filter(~F.col("hash").eqNullSafe(F.col("now"))).select(F.lit("content"), "epoch", "prefix")
    before, bad = block_hash(GENESIS), []
    for r in sorted(blocks.collect(), key=lambda r: r["index"]):  # a row for each sealing
        fields = {"index": r["index"], "timestamp": r.timestamp, "previous_hash": r.previous_hash, "merkle_root": r.merkle_root, "n": r.n}
        if block_hash(fields) != r.block_hash or r.previous_hash != before:
            bad.append(("block", int(r["index"]), None))
        before = r.block_hash
    bad_block = leaf_rows.sparkSession.createDataFrame(bad, "kind string, epoch long, prefix string")
    return bad_leaf.unionAll(bad_node).unionAll(other).distinct().unionAll(bad_block)


def proofs(claims: DataFrame, leaf_rows: DataFrame, trie: DataFrame) -> DataFrame:
    """certificate_id, asset_hash, epoch, leaf, path: what somebody needs to check a claim against a block's root alone: the members of each node from the bucket to the root. Claims that aren't sealed have no row."""
    digits = trie.agg(F.max(F.length("prefix"))).first()[0] or 1
    found = claims.select("certificate_id", "asset_hash").join(leaf_rows, ["certificate_id", "asset_hash"])
    steps = found.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.lit(digits)), lambda k: F.substring("leaf", F.lit(1), k))))
    step = F.struct((-F.length("prefix")).alias("at"), "members")
    path = steps.join(trie.select("epoch", "prefix", "members"), ["epoch", "prefix"]).groupBy("certificate_id", "asset_hash", "epoch", "leaf").agg(F.sort_array(F.collect_list(step)).alias("p"))
    return path.select("certificate_id", "asset_hash", "epoch", "leaf", F.col("p.members").alias("path"))


def proof_holds(certificate_id: str, asset_hash: str, path: list[list[str]], root: str) -> bool:
    """Whether a path proves that the certificate is under the root. Plain Python, for whoever gets a proof."""
    now = hashlib.sha256(f"{certificate_id}:{asset_hash}".encode()).hexdigest()
    digits = now[: len(path) - 1]
    for k, members in enumerate(path):
        want = now if k == 0 else f"{digits[len(path) - 1 - k]}:{now}"
        if want not in members:
            return False
        now = hashlib.sha256(",".join(members).encode()).hexdigest()
    return now == root


def on_chain(claims: DataFrame, leaf_rows: DataFrame, trie: DataFrame, blocks: DataFrame) -> DataFrame:
    """claims (certificate_id, asset_hash) with verified and reason; block_index where verified. The path up to the root is recomputed for the claims' leaves. Of several entries of a certificate the fitting one counts."""
    held = leaf_rows.select("certificate_id", F.col("asset_hash").alias("held"), "epoch", "leaf")
    met = claims.select("certificate_id", "asset_hash").distinct().join(held, "certificate_id", "left")
    met = met.groupBy("certificate_id", "asset_hash").agg(F.max(F.struct((F.col("held") == F.col("asset_hash")).alias("same"), "epoch", "leaf")).alias("m"))
    digits = trie.agg(F.max(F.length("prefix"))).first()[0] or 1
    good = trie.select("epoch", "prefix", "hash", "members", (joined_hash(F.col("members")) == F.col("hash")).alias("ok"))
    path = met.filter("m.same").select("certificate_id", "asset_hash", "m.epoch", "m.leaf")
    path = path.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.lit(digits)), lambda k: F.substring("leaf", F.lit(1), k)))).join(good, ["epoch", "prefix"])
    bucket = F.length("prefix") == digits
    step = F.struct(F.length("prefix").alias("k"), F.col("hash"), (F.col("ok") & (~bucket | F.array_contains("members", F.col("leaf")))).alias("ok"), F.col("members"))
    steps = path.groupBy("certificate_id", "asset_hash", "epoch", "leaf").agg(F.sort_array(F.collect_list(step)).alias("s"))
    linked = F.forall(F.sequence(F.lit(1), F.lit(digits)), lambda k: F.array_contains(F.col("s")[k - 1]["members"], F.concat(F.substring("leaf", k, F.lit(1)), F.lit(":"), F.col("s")[k]["hash"])))
    steps = steps.select("certificate_id", "asset_hash", "epoch", (F.forall("s", lambda x: x.ok) & linked & (F.size("s") == digits + 1)).alias("whole"), F.col("s")[0]["hash"].alias("merkle_root"))
    heads = blocks.select("merkle_root", F.col("index").alias("block_index"))
    steps = steps.join(F.broadcast(heads), "merkle_root", "left")  # a row for each sealing
    out = met.join(steps, ["certificate_id", "asset_hash"], "left")
    reason = F.when(F.col("m.leaf").isNull(), "Certificate not found on ledger").when(~F.col("m.same"), "Asset hash does not match on-chain record").when(~F.coalesce("whole", F.lit(False)) | F.col("block_index").isNull(), "Block hash corrupted")
    return out.select("certificate_id", "asset_hash", reason.isNull().alias("verified"), reason.alias("reason"), F.when(reason.isNull(), F.col("block_index")).alias("block_index"))
