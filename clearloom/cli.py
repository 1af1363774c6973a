"""Command line: scan a folder against an index, make keys, verify a certificate.

python -m clearloom.cli scan PATH --index DIR [--out FILE] [--tier TIER] [--key FILE]: 2 if anything is blocked, 1 for a bad path, else 0.
python -m clearloom.cli generate-keys DIR
python -m clearloom.cli verify-cert FILE --public FILE: 0 if the signature holds, else 1.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clearloom.operators import decision, evaluation
from clearloom.operators.provenance import Signer
from clearloom.sources import assets


def scan(spark: SparkSession, path: str, index: str, out: str | None, tier: str, key: str | None) -> int:
    if not os.path.exists(path) or not os.path.isdir(index):
        print(f"no such path: {path if not os.path.exists(path) else index}", file=sys.stderr)
        return 1
    found = evaluation.evaluate(assets.described_for_evaluation(spark, path, tier), assets.indexes(spark, index)).cache()
    total = decision.summary(found, "outcome").first().asDict()
    if out:
        found.orderBy("asset_id").write.mode("overwrite").json(out)
        if key:
            signer = Signer.from_pem(spark, open(f"{key}.pub").read(), open(key).read())
            evaluation.certificates(found, signer, F.current_timestamp()).write.mode("overwrite").json(f"{out}.certificates")
    found.unpersist()
    print(json.dumps(total))
    return 2 if total["blocked_count"] else 0


def generate_keys(spark: SparkSession, folder: str) -> int:
    signer = Signer(spark)
    os.makedirs(folder, exist_ok=True)
    with open(os.open(f"{folder}/signer.pem", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        f.write(signer.private_pem())
    with open(f"{folder}/signer.pem.pub", "w") as f:
        f.write(signer.public_pem())
    print(signer.fingerprint())
    return 0


def verify_cert(spark: SparkSession, path: str, public: str) -> int:
    records = evaluation.verified(spark.read.json(path), [Signer.from_pem(spark, open(public).read())])
    bad = records.filter(F.col("reason") != "SIGNATURE_VALID").groupBy("reason").count().collect()  # one row for each reason
    print(json.dumps({r["reason"]: r["count"] for r in bad} or {"SIGNATURE_VALID": True}))
    return 1 if bad else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="clearloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("scan")
    a.add_argument("path")
    a.add_argument("--index", required=True)
    a.add_argument("--out")
    a.add_argument("--tier", default="public-web-unknown")
    a.add_argument("--key")
    a = sub.add_parser("generate-keys")
    a.add_argument("folder")
    a = sub.add_parser("verify-cert")
    a.add_argument("path")
    a.add_argument("--public", required=True)
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("clearloom").getOrCreate()
    if args.command == "scan":
        return scan(spark, args.path, args.index, args.out, args.tier, args.key)
    return generate_keys(spark, args.folder) if args.command == "generate-keys" else verify_cert(spark, args.path, args.public)


if __name__ == "__main__":
    sys.exit(main())
