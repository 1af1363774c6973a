"""Lineage documents and graph, and certificates."""

from __future__ import annotations

import base64
import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearloom.functions.text import source_domain

NS = "urn:clearloom"
ENGINE = "0.1.0"


def prov_document(rows: DataFrame) -> DataFrame:
    """asset_id, prov (JSON-LD) of rows with asset_id, asset_hash, track, status, score, matched_source, certificate_id, mime_type, size_bytes, started_at, ended_at, source_url, trust_tier, jurisdiction. Keys without a value are left out."""
    opt = lambda c: F.col(c)  # noqa: E731  nulls are dropped by to_json
    activity = F.struct(
        F.concat(F.lit(f"{NS}:activity:scan:"), F.regexp_replace("asset_hash", ":", "_")).alias("@id"), F.lit("prov:Activity").alias("@type"),
        opt("started_at").alias("prov:startedAtTime"), opt("ended_at").alias("prov:endedAtTime"),
        F.struct(F.lit("prov:Agent").alias("@type"), F.lit(f"{NS}:agent:gateway-v{ENGINE}").alias("@id"), F.col("track").alias("cl:track")).alias("prov:wasAssociatedWith"),
        F.col("status").alias("cl:resolutionStatus"), opt("score").alias("cl:similarityScore"), opt("matched_source").alias("cl:matchedSource"), opt("certificate_id").alias("cl:certificateId"),
        opt("source_url").alias("prov:source_url"), opt("trust_tier").alias("cl:source_trust_tier"), opt("jurisdiction").alias("cl:jurisdiction"),
    )
    derived = F.struct(F.lit("prov:Entity").alias("@type"), F.concat(F.lit(f"{NS}:file:"), F.col("asset_id").cast("string")).alias("@id"), F.col("mime_type").alias("cl:mimeType"), F.col("size_bytes").alias("cl:byteSize"), opt("source_url").alias("prov:atLocation"))
    doc = F.struct(
        F.struct(F.lit("http://www.w3.org/ns/prov#").alias("prov"), F.lit("http://www.w3.org/2001/XMLSchema#").alias("xsd")).alias("@context"),
        F.concat(F.lit(f"{NS}:asset:"), F.col("asset_hash")).alias("@id"), F.lit("prov:Entity").alias("@type"), derived.alias("prov:wasDerivedFrom"), activity.alias("prov:wasGeneratedBy"),
    )
    return rows.select("asset_id", F.to_json(doc, {"ignoreNullFields": "true"}).alias("prov"))


def graph_nodes(rows: DataFrame) -> DataFrame:
    """id, kind, label, domain: entity, activity, agent and certificate nodes of rows (asset_id, asset_hash, source_uri, certificate_id), one for each id."""
    asset, act = F.concat(F.lit(f"{NS}:asset:"), F.col("asset_hash")), F.concat(F.lit(f"{NS}:activity:scan:"), F.col("asset_id").cast("string"))
    node = lambda i, kind, label, dom: F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), dom.alias("domain"))
    none = F.lit(None).cast("string")
    nodes = F.array(
        node(asset, "Entity", F.col("asset_id").cast("string"), source_domain(F.col("source_uri"))), node(act, "Activity", F.lit("scan"), none),
        node(F.lit(f"{NS}:agent:engine:v{ENGINE}"), "Agent", F.lit(f"engine v{ENGINE}"), none), node(F.concat(F.lit(f"{NS}:certificate:"), F.col("certificate_id")), "Certificate", F.col("certificate_id"), none),
    )
    flat = rows.select(F.inline(nodes)).filter(F.col("id").isNotNull())
    return flat.groupBy("id").agg(F.max("kind").alias("kind"), F.max("label").alias("label"), F.max("domain").alias("domain"))


def graph_edges(rows: DataFrame) -> DataFrame:
    """src, rel, dst of the same rows, one for each fact."""
    asset, act = F.concat(F.lit(f"{NS}:asset:"), F.col("asset_hash")), F.concat(F.lit(f"{NS}:activity:scan:"), F.col("asset_id").cast("string"))
    edge = lambda a, r, b: F.struct(a.alias("src"), F.lit(r).alias("rel"), b.alias("dst"))
    return rows.select(F.inline(F.array(edge(asset, "wasGeneratedBy", act), edge(act, "wasAssociatedWith", F.lit(f"{NS}:agent:engine:v{ENGINE}"))))).distinct()


def by_domain(nodes: DataFrame, domain: str) -> DataFrame:
    return nodes.filter((F.col("kind") == "Entity") & (F.col("domain") == domain))


def catch_up(audit: DataFrame, nodes: DataFrame) -> DataFrame:
    """Audit rows whose asset has no node yet."""
    rows = audit.withColumn("id", F.concat(F.lit(f"{NS}:asset:"), F.col("asset_hash")))
    return rows.join(nodes.select("id"), "id", "left_anti").drop("id")


def certificate_id(asset_id: Column, asset_hash: Column) -> Column:
    """A repeatable id, in the form of a UUID."""
    h = F.sha2(F.concat_ws("|", asset_id.cast("string"), asset_hash), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def canonical_json(**fields: Column) -> Column:
    """Sorted keys, no spaces, of string fields."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


class Signer:
    """RSA-PSS (SHA-256, longest salt). Keys are made by the JVM; executors sign and verify by RFC 8017 with Python integers."""

    def __init__(self, spark: SparkSession, private: bytes | None = None, public: bytes | None = None, bits: int = 2048, issuer: str = "clearloom"):
        """private, public: DER encodings (PKCS8, SubjectPublicKeyInfo); without them a new pair."""
        self.spark, self.issuer, self.bits = spark, issuer, bits
        if public is None:
            jvm = spark._jvm
            gen, factory = jvm.java.security.KeyPairGenerator.getInstance("RSA"), jvm.java.security.KeyFactory.getInstance("RSA")
            gen.initialize(bits)
            pair, kind = gen.generateKeyPair(), lambda name: jvm.java.lang.Class.forName(f"java.security.spec.{name}EncodedKeySpec")
            private = bytes(factory.getKeySpec(pair.getPrivate(), kind("PKCS8")).getEncoded())
            public = bytes(factory.getKeySpec(pair.getPublic(), kind("X509")).getEncoded())
        self.private, self.public = private, public

    @staticmethod
    def _pem(der: bytes, name: str) -> str:
        text = base64.b64encode(der).decode()
        body = "\n".join(text[i : i + 64] for i in range(0, len(text), 64))
        return f"-----BEGIN {name}-----\n{body}\n-----END {name}-----\n"

    def public_pem(self) -> str:
        return self._pem(self.public, "PUBLIC KEY")

    def private_pem(self) -> str:
        return self._pem(self.private, "PRIVATE KEY")

    @classmethod
    def from_pem(cls, spark: SparkSession, public: str, private: str | None = None) -> "Signer":
        der = lambda pem: base64.b64decode("".join(x for x in pem.splitlines() if not x.startswith("-----")))
        return cls(spark, der(private) if private else None, der(public))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.public).hexdigest()

    def numbers(self) -> tuple[int, int, int | None]:
        n, e = _integers(self.public)[:2]
        return n, e, _integers(self.private)[2] if self.private is not None else None

    def sign(self, df: DataFrame, message: str, out: str = "signature_b64") -> DataFrame:
        n, _, d = self.numbers()
        primes = _integers(self.private)[3:8]

        @F.pandas_udf("string")
        def run(m: pd.Series) -> pd.Series:
            known = {x: base64.b64encode(pss_sign(x.encode(), n, d, primes)).decode() for x in m.unique()}  # equal messages are signed alike
            return m.map(known)

        return df.withColumn(out, run(message))

    def verify(self, df: DataFrame, message: str, signature: str, out: str = "signature_valid") -> DataFrame:
        n, e, _ = self.numbers()

        @F.pandas_udf("boolean")
        def run(m: pd.Series, s: pd.Series) -> pd.Series:
            return pd.Series([pss_verify(x.encode(), y, n, e) for x, y in zip(m, s)])

        return df.withColumn(out, run(message, signature))


def _integers(der: bytes) -> list[int]:
    """The key's numbers (modulus, exponents, ...) of a DER-encoded RSA key: the integers of the innermost sequence, without version numbers."""

    def items(raw: bytes):
        at = 0
        while at < len(raw):
            tag, size, at = raw[at], raw[at + 1], at + 2
            if size & 0x80:
                size, at = int.from_bytes(raw[at : at + (size & 0x7F)], "big"), at + (size & 0x7F)
            yield tag, raw[at : at + size]
            at += size

    (_, body), = items(der)
    inner = [(t, v) for t, v in items(body) if t in (3, 4)][0]
    (_, numbers), = items(inner[1][1:] if inner[0] == 3 else inner[1])
    return [x for x in (int.from_bytes(v, "big") for t, v in items(numbers) if t == 2) if x]


def _mask(seed: bytes, n: int) -> bytes:
    return b"".join(hashlib.sha256(seed + i.to_bytes(4, "big")).digest() for i in range(-(-n // 32)))[:n]


def _private_power(x: int, n: int, d: int, primes: list[int]) -> int:
    """x to the d-th power modulo n; with p, q, d mod p - 1, d mod q - 1 and the inverse of q mod p by two powers of half the size (RFC 8017, 5.1.2)."""
    if len(primes) != 5 or primes[0] * primes[1] != n:
        return pow(x, d, n)
    p, q, dp, dq, inverse = primes
    b = pow(x % q, dq, q)
    return b + q * ((pow(x % p, dp, p) - b) * inverse % p)


def pss_sign(message: bytes, n: int, d: int, primes: list[int] = ()) -> bytes:
    """The salt is derived from key and message, so a repeated task signs alike."""
    size = n.bit_length()
    em_len = -(-(size - 1) // 8)
    digest = hashlib.sha256(message).digest()
    salt = _mask(digest + d.to_bytes(-(-size // 8), "big"), em_len - 34)
    h = hashlib.sha256(bytes(8) + digest + salt).digest()
    db = b"\x01" + salt
    masked = bytearray(a ^ b for a, b in zip(db, _mask(h, len(db))))
    masked[0] &= 0xFF >> (8 * em_len - (size - 1))
    return _private_power(int.from_bytes(bytes(masked) + h + b"\xbc", "big"), n, d, primes).to_bytes(-(-size // 8), "big")


def pss_verify(message: bytes, signature_b64: str, n: int, e: int) -> bool:
    try:
        raw = base64.b64decode(signature_b64, validate=True)
    except Exception:
        return False
    size = n.bit_length()
    em_len = -(-(size - 1) // 8)
    number = int.from_bytes(raw, "big")
    if len(raw) != -(-size // 8) or number >= n:
        return False
    value = pow(number, e, n)
    if value.bit_length() > 8 * em_len:
        return False
    em = value.to_bytes(em_len, "big")
    h, masked = em[-33:-1], em[:-33]
    db = bytearray(a ^ b for a, b in zip(masked, _mask(h, len(masked))))
    db[0] &= 0xFF >> (8 * em_len - (size - 1))
    at = db.find(1)
    if em[-1] != 0xBC or at < 0 or any(db[:at]):
        return False
    return hashlib.sha256(bytes(8) + hashlib.sha256(message).digest() + bytes(db[at + 1 :])).digest() == h


def verify_reason(rows: DataFrame, signature_valid: str, claimed: str, actual: str) -> DataFrame:
    """Reason codes in order: HASH_MISMATCH, SIGNATURE_INVALID, SIGNATURE_VALID."""
    return rows.withColumn("reason", F.when(F.col(claimed) != F.col(actual), "HASH_MISMATCH").when(~F.col(signature_valid), "SIGNATURE_INVALID").otherwise("SIGNATURE_VALID"))


def fresh_id() -> str:
    return str(uuid.uuid4())
