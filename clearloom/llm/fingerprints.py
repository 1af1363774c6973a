"""Document fingerprints as invertible Bloom lookup sketches. DataFrame operations only.

A document is a set of paragraph digests (lines, and sentences within lines). Each digest goes into one cell of each of three sub-tables; a cell holds a signed count, the xor of its digests and the xor of their checksums. Sketches of two versions subtract cell by cell; peeling then recovers the digests that only one of them holds: a cell with count +1 or -1 and a fitting checksum holds one digest, which leaves its other cells too. Sub-tables take turns, so no digest is recovered twice. What doesn't empty is tried again with twice the cells and other hash functions, until it does.

fingerprints() gives each sketch as a short digest. sketches() gives the sketch itself, cells of a size that the caller fixes: two stored ones subtract (subtracted()), and what differs is recovered from them alone.

Nulls: a null text is an empty one, whose set is empty; two empty sets are alike (1.0). A null doc_id sorts first (the least long counts as null). A very long text is one row, whose cells are counted within its task. Repeated paragraphs count once. Repeated doc_ids are separate rows. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, stage, table

PARAGRAPH = r"[\n\r]+|(?<=[.!?])\s+"
#: Steps of peeling, by turns in each sub-table; each is an aggregate of the same tasks, which hold memory together. What needs more is tried again with more cells.
ROUNDS = 9
#: Attempts after which it is an error that a sketch doesn't empty; each has twice the cells of the one before.
ATTEMPTS = 16
KNOTS = 16
#: Stands for a null key, so that the rows that move have the same columns for all that is made of them, and move once.
NO_KEY = -(1 << 63)
#: Tasks for each of Spark's shuffle partitions: the sketch cells of a task's documents stay in memory.
FINER = 4


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs that hold anything."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p != ""), lambda p: F.xxhash64(p)))


def ordered_buckets(key: Column, docs: DataFrame, name: str, fine: int) -> Column:
    """A bucket number that rises with the key: quantile knots, and equal steps between two knots."""
    probs = [i / KNOTS for i in range(KNOTS + 1)]
    knots = docs.select(F.percentile_approx(name, F.array(*map(F.lit, probs)), 1000)).first()[0] or [0]
    knots = sorted(set(knots))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            a, b = knots[lo], knots[min(lo + 1, len(knots) - 1)]
            step = F.floor((key - a) / F.lit(float(b - a + 1)) * fine).cast("long")
            return F.lit(lo * fine).cast("long") + F.greatest(F.lit(0).cast("long"), F.least(F.lit(fine - 1).cast("long"), step))
        mid = (lo + hi + 1) // 2
        return F.when(key >= knots[mid], tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return F.when(key < knots[0], F.lit(-1).cast("long")).otherwise(tree(0, len(knots) - 1))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, rid, k, text, dig, next_text, next_dig: each row with the next by key (the last with the first).

    The rows go to ordered buckets in one shuffle. The first row of each bucket also goes to the bucket before it, so windows within buckets see every neighbour.
    """
    spark = docs.sparkSession
    tasks = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = max(4, -(-tasks // KNOTS) * 8)
    k = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), k.alias("k"))
    rows = rows.withColumn("bucket", ordered_buckets(F.col("k"), docs, key, fine))
    firsts = sorted((r.bucket, r.low) for r in rows.groupBy("bucket").agg(F.min("k").alias("low")).collect())  # at most KNOTS * fine + 2 rows
    if not firsts:
        firsts = [(0, 0)]
    before = [(b, low, firsts[i - 1][0]) for i, (b, low) in enumerate(firsts)]
    table_of = F.broadcast(spark.createDataFrame(before, "bucket long, low long, before long"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))
    rows = rows.join(table_of, "bucket").withColumn("to", F.explode(F.when(F.col("k") == F.col("low"), F.array(own, also)).otherwise(F.array(own))))
    rows = rows.select(F.col("to.bucket").alias("bucket"), F.col("to.copy").alias("copy"), "k", "text").repartition(tasks, "bucket")
    w = Window.partitionBy("bucket").orderBy("copy", "k", "text")
    rows = rows.withColumn("dig", digests(F.col("text")))
    rows = rows.select("bucket", "copy", "k", "text", "dig", F.row_number().over(w).alias("rid"), F.lead("k").over(w).alias("next_k"), F.lead("text").over(w).alias("next_text"), F.lead("dig").over(w).alias("next_dig"))
    return rows.filter(~F.col("copy")).drop("copy")


def edited(text: Column, next_text: Column) -> Column:
    """The text whose last floor(n/2) code points are replaced by the first as many of the next one."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def third(n: Column, scale: int = 1) -> Column:
    """Cells in a sub-table for n digests. Only cells that hold something are kept, so a thin table costs no more and fails less."""
    return ((n * 2 + 32) * scale).cast("int")


def cell(key: Column, table_no: int, size: Column, seed: int) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(seed * 3 + table_no)), size.cast("long")) + size * table_no).cast("int")


def check(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed * 3 - 7))


def cells(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """rows: by, size, sign, key (a digest each) -> by, size, cell, n, key, chk: the sketch, without empty cells. by starts with the column that rows are dealt by, so nothing moves."""
    spread = rows.withColumn("cell", F.explode(F.array(*(cell(F.col("key"), t, F.col("size"), seed) for t in range(3)))))
    return summed(spread.select(*by, "size", "cell", F.col("sign").alias("n"), "key", check(F.col("key"), seed).alias("chk")), by)


def summed(rows: DataFrame, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by, "size", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return out.filter((F.col("n") != 0) | (F.col("key") != 0) | (F.col("cell") < 0))


def peel(sketch: DataFrame, by: list[str], seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Per group: only_a, only_b (recovered digests of either side) and left (cells that didn't empty)."""
    zero = F.lit(0).cast("long")
    row = lambda c, n, key, chk: F.struct(c.cast("int").alias("cell"), n.cast("long").alias("n"), key.alias("key"), chk.alias("chk"))
    for i in range(rounds):
        mine = F.floor(F.col("cell") / F.col("size")) == i % 3
        pure = (F.col("cell") >= 0) & mine & (F.abs("n") == 1) & (F.col("chk") == check(F.col("key"), seed))
        others = [cell(F.col("key"), t, F.col("size"), seed) for t in range(3) if t != i % 3]
        found = row(F.when(F.col("n") > 0, -1).otherwise(-2), F.lit(1), zero, zero)
        gone = [row(c, -F.col("n"), F.col("key"), F.col("chk")) for c in others]
        same = row(F.col("cell"), F.col("n"), F.col("key"), F.col("chk"))
        sketch = sketch.select(*by, "size", F.inline(F.when(pure, F.array(found, *gone)).otherwise(F.array(same))))
        sketch = summed(sketch, by)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), zero)
    return sketch.groupBy(*by).agg(of(-1).alias("only_a"), of(-2).alias("only_b"), F.count_if(F.col("cell") >= 0).alias("left"))


def pairs(rows: DataFrame, left: str, rights: list[str], by: list[str], seed: int, scale: int) -> DataFrame:
    """by, pair, only_a, only_b, left for the set in `left` against each of `rights` (columns of digests; pair is the place in the list)."""
    options = [F.struct(F.lit(i).alias("pair"), third(F.size(left) + F.size(col), scale).alias("size"), F.col(left).alias("a"), F.col(col).alias("b")) for i, col in enumerate(rights)]
    sides = rows.select(*by, F.inline(F.array(*options)))
    signs = F.concat(F.transform("a", lambda d: F.struct(d.alias("key"), F.lit(1).cast("long").alias("sign"))), F.transform("b", lambda d: F.struct(d.alias("key"), F.lit(-1).cast("long").alias("sign"))))
    flat = sides.select(*by, "pair", "size", F.inline(signs))
    return peel(cells(flat, [*by, "pair"], seed), [*by, "pair"], seed)


def fingerprint_text(rows: DataFrame, cols: dict[str, str], by: list[str]) -> DataFrame:
    """by and, for each name -> column of digests, the fingerprint: cells in a sub-table, and two 64-bit sums over the cells of the sketch."""
    options = [F.struct(F.lit(i).alias("of"), third(F.size(col)).alias("size"), F.col(col).alias("a")) for i, col in enumerate(cols.values())]
    flat = rows.select(*by, F.inline(F.array(*options))).select(*by, "of", "size", F.explode("a").alias("key")).withColumn("sign", F.lit(1).cast("long"))
    word = F.xxhash64("cell", "n", "key", "chk")
    sums = cells(flat, [*by, "of"], 1).groupBy(*by, "of", "size").agg(F.bit_xor(word).alias("x"), F.bit_xor(F.xxhash64(word, F.lit(99))).alias("y"))
    form = F.concat(F.lit("iblt-"), F.col("size").cast("string"), F.lit("-"), F.lower(F.lpad(F.hex("x"), 16, "0")), F.lower(F.lpad(F.hex("y"), 16, "0")))
    return sums.groupBy(*by).agg(*(F.max(F.when(F.col("of") == i, form)).alias(name) for i, name in enumerate(cols)))


def sketches(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """key, size, cells (place, n, key, chk) of each document's sketch with `size` cells in a sub-table: what may be stored. Keys are distinct."""
    rows = docs.select(key, F.lit(size).alias("size"), F.explode_outer(digests(F.coalesce(F.col(text), F.lit("")))).alias("key"), F.lit(1).cast("long").alias("sign"))
    full = cells(rows.filter(F.col("key").isNotNull()), [key], seed).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cell", "n", "key", "chk"))).alias("cells"))
    none = F.array().cast(full.schema["cells"].dataType)
    return docs.select(key).join(full, key, "left").select(key, F.lit(size).alias("size"), F.coalesce("cells", none).alias("cells"))


def subtracted(a: DataFrame, b: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """key, only_a, only_b (numbers of recovered digests that one side alone holds), left (cells that didn't empty: sketch again, larger) of keys that both tables of stored sketches have in one size."""
    both = a.select(key, "size", F.col("cells").alias("x")).join(b.select(key, "size", F.col("cells").alias("y")), [key, "size"])
    minus = F.transform("y", lambda c: F.struct(c.cell.alias("cell"), (-c.n).alias("n"), c.key.alias("key"), c.chk.alias("chk")))
    marker = F.array(F.struct(F.lit(-3).alias("cell"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk")))  # so that equal sketches have a row
    flat = both.select(key, "size", F.inline(F.concat("x", minus, marker)))
    return peel(summed(flat, [key]), [key], seed)


EMPTY = "iblt-32-" + "0" * 32


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Jaccard similarity of sets of a and b digests that differ in diff of them."""
    return F.when(a + b == 0, 1.0).otherwise((a + b - diff) / (a + b + diff))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the sizes and differences that were recovered."""
    by, pairs_of = ["bucket", "rid"], {"edited": "dig_edited", "next": "next_dig"}
    found = [f"{c}_{p}" for p in pairs_of for c in ("only_a", "only_b", "left")]

    def versions(rows: DataFrame) -> DataFrame:
        rows = with_next(rows, key, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
        return rows.withColumn("dig_edited", digests(F.col("edited")))

    def recovered(wide: DataFrame, attempt: int) -> DataFrame:
        d = pairs(wide, "dig", list(pairs_of.values()), by, 1 + attempt, 1 << attempt)
        of = lambda i, c: F.max(F.when(F.col("pair") == i, F.col(c)))
        return d.groupBy(*by).agg(*(of(i, c).alias(f"{c}_{p}") for i, p in enumerate(pairs_of) for c in ("only_a", "only_b", "left")))

    base = versions(docs)
    attrs = base.select(*by, F.when(F.col("k") != NO_KEY, F.col("k")).alias(key), "k", "next_k", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.size("dig").alias("n_own"), F.size("dig_edited").alias("n_edited"), F.size("next_dig").alias("n_next"))
    wide = base.select(*by, "dig", "dig_edited", "next_dig")
    prints = fingerprint_text(wide, {"fingerprint": "dig", "edited_fingerprint": "dig_edited"}, by)
    facts = stage(attrs.join(prints, by, "left").join(recovered(wide, 0), by, "left").na.fill(0, found).drop(*by), "fingerprints")
    for attempt in range(1, ATTEMPTS + 1):
        failed = facts.filter((F.col("left_edited") > 0) | (F.col("left_next") > 0))
        if failed.isEmpty():
            break
        if attempt == ATTEMPTS:
            raise RuntimeError("sketches that don't empty")
        # The failed documents and their next ones, by themselves: neighbours stay neighbours.
        again_k = few(failed.select(F.explode(F.array("k", "next_k")).alias("k")).distinct())
        again = versions(docs.withColumn("k", F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))).join(again_k, "k", "left_semi").select(key, text))
        more = again.select(*by, "k", F.sha2("edited", 256).alias("edited_sha256")).join(recovered(again.select(*by, "dig", "dig_edited", "next_dig"), attempt), by, "left").na.fill(0, found).drop(*by)
        fixed = failed.drop(*found).join(more.dropDuplicates(["k", "edited_sha256"]), ["k", "edited_sha256"]).select(facts.columns)
        facts = stage(facts.filter((F.col("left_edited") == 0) & (F.col("left_next") == 0)).unionByName(fixed), "fingerprints")
    d = lambda p: F.col(f"only_a_{p}") + F.col(f"only_b_{p}")
    return facts.select(
        key, "n_chars", "edited_sha256",
        F.coalesce("fingerprint", F.lit(EMPTY)).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit(EMPTY)).alias("edited_fingerprint"),
        likeness(F.col("n_own"), F.col("n_edited"), d("edited")).alias("near_edited"), likeness(F.col("n_own"), F.col("n_next"), d("next")).alias("near_next"),
        "n_own", "n_edited", "n_next", d("edited").alias("n_diff_edited"), d("next").alias("n_diff_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
