"""Assets: discovery, byte sniffing, text reading and index loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearloom import config
from clearloom.functions import fingerprint as fp
from clearloom.functions import image
from clearloom.functions import text as tx

HEADER = 4096


def sniff(content: Column, name: Column) -> Column:
    """Struct (track, mime) of content and file name: byte rules first, then code suffixes, then text without NUL bytes, then media suffixes."""
    head = F.substring(content, 1, HEADER)
    at = lambda a, n: F.hex(F.substring(content, a, n))
    is_ = lambda raw, a=1: at(a, len(raw)) == raw.hex().upper()
    kind = lambda track, mime: F.struct(F.lit(track).alias("track"), (mime if isinstance(mime, Column) else F.lit(mime)).alias("mime"))
    riff = is_(b"RIFF")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    out = (
        F.when(is_(b"\x89PNG\r\n\x1a\n"), kind("IMAGE", "image/png")).when(is_(b"\xff\xd8\xff"), kind("IMAGE", "image/jpeg"))
        .when(is_(b"GIF87a") | is_(b"GIF89a"), kind("IMAGE", "image/gif")).when(riff & is_(b"WEBP", 9), kind("IMAGE", "image/webp"))
        .when(is_(b"BM"), kind("IMAGE", "image/bmp")).when(is_(b"II*\x00") | is_(b"MM\x00*"), kind("IMAGE", "image/tiff"))
        .when(riff & is_(b"WAVE", 9), kind("AUDIO", "audio/wav")).when(is_(b"ID3") | is_(b"\xff\xfb") | is_(b"\xff\xf3"), kind("AUDIO", "audio/mpeg"))
        .when(is_(b"fLaC"), kind("AUDIO", "audio/flac")).when(is_(b"OggS"), kind("AUDIO", "audio/ogg"))
        .when(is_(b"ftyp", 5), kind("VIDEO", "video/mp4")).when(is_(b"\x1a\x45\xdf\xa3"), kind("VIDEO", "video/x-matroska")).when(riff & is_(b"AVI ", 9), kind("VIDEO", "video/x-msvideo"))
    )
    for s, mime in config.CODE_SUFFIXES.items():
        out = out.when(suffix == s, kind("CODE", mime))
    has_nul = F.locate("\x00", F.decode(head, "ISO-8859-1")) > 0
    text = F.decode(head, "ISO-8859-1")  # the keywords are ASCII, so this finds them in any UTF-8
    out = out.when(~has_nul & tx.is_code(text), kind("CODE", "text/x-code")).when(~has_nul, kind("TEXT", "text/plain"))
    bare = F.substring(suffix, 2, 9)
    for track, names in (("IMAGE", config.IMAGE_SUFFIXES), ("AUDIO", config.AUDIO_SUFFIXES), ("VIDEO", config.VIDEO_SUFFIXES)):
        out = out.when(bare.isin(*names), kind(track, F.concat(F.lit(track.lower() + "/"), bare)))
    return out.when(bare.isin("txt", "md", "json", "csv", "log"), kind("TEXT", "text/plain")).otherwise(kind("UNSUPPORTED", "application/octet-stream"))


def described(files: DataFrame) -> DataFrame:
    """asset_id (path), track, mime_type, size_bytes, asset_hash, content of rows with path and content; unsupported ones go."""
    rows = files.withColumn("kind", sniff(F.col("content"), F.col("path")))
    rows = rows.select(F.col("path").alias("asset_id"), F.col("kind.track").alias("track"), F.col("kind.mime").alias("mime_type"), F.length("content").cast("long").alias("size_bytes"), fp.sha256_prefixed(F.col("content")).alias("asset_hash"), "content")
    return rows.filter(F.col("track") != "UNSUPPORTED")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Assets of a file or a folder and all below it, by path. A missing path is an error; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    return described(files).orderBy("asset_id")


def text_of(content: Column) -> Column:
    """Decoded UTF-8 (what is malformed is replaced) with universal newlines."""
    return tx.newlines(F.make_valid_utf8(content.cast("string")))


def text_index(spark: SparkSession, path: str) -> DataFrame:
    """item_id, title, text: the works that metadata.json names; only if it yields none, every .txt below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), text_of(F.col("content")).alias("text"))
    try:
        meta = spark.read.option("multiLine", "true").json(f"{path}/metadata.json").select(F.inline("texts"))
        named = meta.join(files, "file").select(F.col("id").alias("item_id"), F.col("source").alias("title"), "text")
        if not named.isEmpty():
            return named
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return files.select(F.col("file").alias("item_id"), F.concat(F.lit("© Work: "), F.regexp_replace("file", r"\.txt$", "")).alias("title"), "text")


def code_index(spark: SparkSession, path: str) -> DataFrame:
    """item_id, title, license, text of code files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,js,ts,go,rs,cpp,c,java}").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("item_id"), text_of(F.col("content")).alias("text"))
    stem = F.regexp_replace("item_id", r"\.[^.]+$", "")
    return rows.select("item_id", tx.code_title(F.col("text"), stem).alias("title"), tx.license_class(F.col("text")).alias("license"), "text")


def media_index(spark: SparkSession, path: str, glob: str = "*.{mp3,wav,ogg}", label: str = "Audio Master") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return files.select(F.col("path").alias("item_id"), F.concat(F.lit(f"RefCorpus: {label} ["), stem, F.lit("]")).alias("title"), "content")


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """item_id, title, phash of images below path, turned upright as their files say."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*").withColumnRenamed("origin", "item_id")
    stem = F.regexp_replace(F.element_at(F.split("item_id", "/"), -1), r"\.[^.]+$", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(path_key(F.col("path")).alias("__path"), "content")
    rows = rows.withColumn("__path", path_key(F.col("item_id"))).join(files, "__path", "left").drop("__path")
    return image.image_phash(rows, "item_id").withColumn("title", F.concat(F.lit("© Visual Work: "), stem))


def path_key(path: Column) -> Column:
    """Local paths as readers name them differently: file:/x and file:///x are one."""
    return F.regexp_replace(path, "^file:/+", "/")


def described_for_evaluation(spark: SparkSession, path: str, tier: str, jurisdiction: str = "GLOBAL") -> DataFrame:
    """The assets of a folder with what evaluation.evaluate() needs of each track: decoded text, bytes, perceptual hash (null where an image can't be decoded). Videos come without frames, which need a decoder."""
    rows = discover(spark, path)
    hashes = image_index(spark, path).select(path_key(F.col("item_id")).alias("__path"), "phash")
    text = F.when(F.col("track").isin("TEXT", "CODE"), text_of(F.col("content")))
    rows = rows.withColumn("__path", path_key(F.col("asset_id"))).join(hashes, "__path", "left")
    return rows.select("asset_id", "asset_hash", "track", text.alias("text"), F.when(F.col("track") == "AUDIO", F.col("content")).alias("content"), "phash", F.lit(tier).alias("tier"), F.lit(jurisdiction).alias("jurisdiction"), F.lit(False).alias("opted_out"))


def indexes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The indexed works below path by track; a track of which nothing is there has an empty index. Videos are compared with images."""
    images = image_index(spark, path)
    return {"TEXT": text_index(spark, path), "CODE": code_index(spark, path), "IMAGE": images, "AUDIO": media_index(spark, path), "VIDEO": images}


def index_metadata(works: DataFrame) -> DataFrame:
    return works.select("item_id", F.length("text").alias("char_count"), F.size(tx.split_ws(F.col("text"))).alias("word_count"))


def staged_name(url: Column, digest: Column) -> Column:
    """File name of fetched content: 12 characters of its hash and the last part of the URL's path."""
    base = F.regexp_extract(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"([^/]+)/?$", 1)
    return F.concat(F.substring(digest, 1, 12), F.lit("_"), F.when(base == "", "asset").otherwise(base))


def s3_events(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """bucket, key, action of bucket notifications (JSON)."""
    kind = "struct<Records:array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>>"
    return payloads.select(F.inline(F.from_json(col, kind).getField("Records"))).select(F.col("s3.bucket.name").alias("bucket"), F.col("s3.object.key").alias("key"), F.lit("QUEUED_FOR_SCAN").alias("action"))


def intake(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """requests (asset_id, source_uri) with content: that of the named file, else the bytes of the URI itself."""
    c = contents.select("source_uri", "content")
    return requests.join(c, "source_uri", "left").withColumn("content", F.coalesce("content", F.encode("source_uri", "UTF-8")))


#: Assets that a batch may have.
BATCH = (1, 10_000)


def invalid(cfg=config.DEFAULT) -> Column:
    """The first field that isn't as the schema asks (asset_id, batch_id, mime_type, score, asset_hash); null if all are."""
    rules = {
        "asset_id": F.length("asset_id").between(1, 256), "batch_id": F.length("batch_id").between(3, 128), "mime_type": F.col("mime_type").isin(*cfg.mime_types),
        "score": F.col("score").between(0, 1), "asset_hash": F.col("asset_hash").rlike(r"\Asha256:[0-9a-f]{64}\z"),
    }
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def validated(rows: DataFrame) -> DataFrame:
    """rows with `valid`: id and batch lengths, MIME type, score and hash as the schema asks."""
    return rows.withColumn("valid", invalid().isNull())


def batches(rows: DataFrame, bounds: tuple[int, int] = BATCH) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of batches (batch_id, asset_id, mime_type, score, asset_hash). quarantined has `reason`: the first field that is wrong, or batch_size for all rows of a batch with too many. A batch is counted by a partial aggregate, so a large one is no hot group."""
    size = rows.groupBy("batch_id").agg(F.count("*").alias("__size"))
    right = size.withColumnRenamed("batch_id", "__batch")
    judged = rows.join(right, F.col("batch_id").eqNullSafe(F.col("__batch")), "left").withColumn("reason", F.when(~F.col("__size").between(*bounds), "batch_size").otherwise(invalid())).drop("__size", "__batch")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def staged(fetched: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, cache) of fetched content: url, content, etag, last_modified, fetched_at, source_id, license_hint, tdm_opted_out; sources: source_id, trust_tier.

    assets: named by hash and URL, sniffed, with what lineage and routing need to know of their origin. cache: what the next conditional fetch asks with, for commits.upsert(); of several fetches of a URL the last.
    """
    digest = F.sha2(F.col("content"), 256)
    kind = sniff(F.col("content"), F.col("url"))
    rows = fetched.join(sources.select("source_id", "trust_tier"), "source_id", "left").withColumns({"__digest": digest, "__kind": kind})
    assets = rows.select(
        staged_name(F.col("url"), F.col("__digest")).alias("asset_id"), F.col("__kind.track").alias("track"), F.col("__kind.mime").alias("mime_type"), F.length("content").cast("long").alias("size_bytes"), F.concat(F.lit("sha256:"), "__digest").alias("asset_hash"),
        F.col("url").alias("source_url"), tx.source_domain(F.col("url")).alias("domain"), "source_id", F.col("trust_tier").alias("source_trust_tier"), "license_hint", "tdm_opted_out", F.col("fetched_at").alias("crawl_timestamp"), "etag", "last_modified", "content",
    )
    last = F.max_by(F.struct("etag", "last_modified", F.concat(F.lit("sha256:"), "__digest").alias("sha256_hash"), "fetched_at"), F.struct("fetched_at", "__digest"))
    return assets, rows.groupBy("url").agg(last.alias("l")).select("url", "l.*")
