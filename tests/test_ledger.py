"""The ledger: roots that depend on the entries alone, proofs, and whatever is tampered with."""

import pytest
from pyspark.sql import functions as F

from clearloom.operators import ledger

ENTRIES = [(i % 3, f"c{i}", f"h{i * 7}") for i in range(700)]


@pytest.fixture(scope="module")
def sealed(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    old, ledger.BUCKET = ledger.BUCKET, 2
    ledger.depth.__defaults__ = (2,)
    yield ledger.seal(rows(spark, ENTRIES + ENTRIES[:9] + [(0, None, "h"), (1, "c", None)]), "now")
    ledger.BUCKET, ledger.depth.__defaults__ = old, (old,)


def rows(spark, entries):
    return spark.createDataFrame(entries, "epoch long, certificate_id string, asset_hash string")


def test_roots_depend_on_entries_alone(spark, sealed):
    leaves, trie, blocks = sealed
    again = ledger.seal(rows(spark, ENTRIES[::-1]).repartition(7), "now")[2]
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in blocks.collect()] and leaves.count() == len(ENTRIES)
    other = ledger.seal(rows(spark, [*ENTRIES[1:], (0, "c0", "changed")]), "now")[2]
    assert [a.merkle_root != b.merkle_root for a, b in zip(other.orderBy("index").collect(), blocks.orderBy("index").collect())] == [True, False, False]
    assert trie.agg(F.max(F.size("members"))).first()[0] <= 16 and trie.agg(F.max(F.length("prefix"))).first()[0] == ledger.depth(234) == 2


def test_blocks_are_linked_over_sealings(spark, sealed):
    last = sealed[2].orderBy(F.desc("index")).first().asDict()
    more = ledger.chain(spark, [(0, "later", "root", 5)], last).first()
    assert (more["index"], more.previous_hash) == (4, last["block_hash"])


def test_a_proof_verifies_one_certificate(spark, sealed):
    leaves, trie, blocks = sealed
    root = {r["index"] - 1: r.merkle_root for r in blocks.collect()}
    claims = spark.createDataFrame([("c5", "h35"), ("c5", "h36"), ("c699", "h4893"), ("no", "h")], "certificate_id string, asset_hash string")
    got = {r.certificate_id: r for r in ledger.proofs(claims, leaves, trie).collect()}
    assert got.keys() == {"c5", "c699"}
    for r in got.values():
        assert ledger.proof_holds(r.certificate_id, r.asset_hash, r.path, root[r.epoch])
        assert not ledger.proof_holds(r.certificate_id, "other", r.path, root[r.epoch]) and not ledger.proof_holds(r.certificate_id, r.asset_hash, r.path, root[(r.epoch + 1) % 3])
        assert not ledger.proof_holds(r.certificate_id, r.asset_hash, [[*r.path[0], "00"], *r.path[1:]], root[r.epoch])


def reasons(spark, claims, parts):
    return {r.certificate_id: (r.verified, r.reason, r.block_index) for r in ledger.on_chain(spark.createDataFrame(claims, "certificate_id string, asset_hash string"), *parts).collect()}


def test_claims(spark, sealed):
    got = reasons(spark, [("c5", "h35"), ("c6", "other"), ("no", "h"), ("c7", "h49"), ("c7", "h49")], sealed)
    assert got == {"c5": (True, None, 3), "c6": (False, "Asset hash does not match on-chain record", None), "no": (False, "Certificate not found on ledger", None), "c7": (True, None, 2)}


def test_tampering_is_found(spark, sealed):
    leaves, trie, blocks = sealed
    assert ledger.tampered(leaves, trie, blocks).count() == 0
    kinds = lambda *parts: {(r.kind, r.epoch) for r in ledger.tampered(*parts).collect()}
    changed = leaves.withColumn("asset_hash", F.when(F.col("certificate_id") == "c5", "forged").otherwise(F.col("asset_hash")))
    assert ("leaf", 2) in kinds(changed, trie, blocks) and ("content", 2) in kinds(changed, trie, blocks)
    gone = leaves.filter("certificate_id <> 'c5'")
    assert {k for k, _ in kinds(gone, trie, blocks)} == {"content"}
    prefix = leaves.filter("certificate_id = 'c5'").first().leaf[:1]
    broken = trie.withColumn("hash", F.when((F.col("epoch") == 2) & (F.col("prefix") == prefix), "00").otherwise(F.col("hash")))
    assert ("node", 2) in kinds(leaves, broken, blocks)
    assert reasons(spark, [("c5", "h35"), ("c6", "h42")], (leaves, broken, blocks)) == {"c5": (False, "Block hash corrupted", None), "c6": (True, None, 1)}
    assert kinds(leaves, trie, blocks.withColumn("n", F.when(F.col("index") == 2, 1).otherwise(F.col("n")))) == {("block", 2)}
    assert kinds(leaves, trie, blocks.filter("index <> 2")) == {("block", 3)}
