"""Similarity joins of assets with an index of protected works. Joins are equi-joins on tokens, n-grams, bands or hashes; nothing is compared pair by pair that shares nothing.

Index sides are broadcast only where their size was checked (small()), else shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from clearloom.config import DEFAULT
from clearloom.functions import fingerprint as fp
from clearloom.functions import text as tx

from . import seqjoin

#: Rows, and bytes of their values, up to which an index side is broadcast.
SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20
#: Differing bits up to which hashes meet in two bands at once: ten pairs of about 26 bits for three.
PAIRED = 4


def _bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take."""
    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            size = F.octet_length(c)
        elif f.dataType.typeName() == "array":
            size = F.octet_length(F.array_join(c, " ")) if f.dataType.elementType.typeName() == "string" else 16 * F.greatest(F.size(c), F.lit(0))
        else:
            size = F.lit(16)
        out = out + F.coalesce(size, F.lit(0)).cast("long")
    return out


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether df has at most `rows` rows of at most `size` bytes together. To know that, a job reads it, as far as `rows` + 1 rows."""
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(_bytes(df)).alias("bytes")).first()
    return got.n <= rows and (got.bytes or 0) <= size


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """df, to be broadcast if it is_small."""
    return F.broadcast(df) if is_small(df, rows, size) else df


#: Pairs of a text's word and a work, and cells of texts by works, that are counted at once.
TOGETHER = 1 << 20


def _shared(docs: DataFrame, posts: pa.Table, item: DataType, least: float) -> DataFrame:
    """doc_id, nd, item_id, nw, k (shared words) of the pairs that may score above `least`. docs: doc_id, d (distinct words); posts: item_id, nw, tok of a small index, which all tasks get. Words of a text are looked up together and counted by work in place, so neither words nor pairs below `least` are shuffled."""
    tok = posts["tok"].combine_chunks().dictionary_encode()
    order = np.argsort(tok.indices.to_numpy(), kind="stable")
    kinds = pa.table({"item_id": posts["item_id"], "nw": posts["nw"]}).combine_chunks()
    both = kinds.append_column("at", pa.array(np.arange(len(kinds)))).group_by(["item_id", "nw"]).aggregate([("at", "list")])  # one for each work
    number = np.empty(len(kinds), np.int64)
    number[both["at_list"].combine_chunks().flatten().to_numpy()] = np.repeat(np.arange(len(both)), pc.list_value_length(both["at_list"]).to_numpy())
    often = np.bincount(tok.indices.to_numpy(), minlength=len(tok.dictionary))
    index = docs.sparkSession.sparkContext.broadcast((tok.dictionary, often, np.cumsum(often) - often, number[order], both["item_id"].combine_chunks(), both["nw"].to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often, first, works, items, sizes = index.value
        for batch in batches:
            nd = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(nd)), nd)[at >= 0]
            at = at[at >= 0]
            met = np.bincount(doc, weights=often[at], minlength=len(nd)).astype(np.int64)  # pairs of each text
            ends, end = np.cumsum(met), np.searchsorted(doc, np.arange(len(nd) + 1))
            i = 0
            while i < len(nd):
                j = int(np.searchsorted(ends, ends[i] - met[i] + TOGETHER, side="right"))
                j = min(max(j, i + 1), i + max(1, TOGETHER // max(1, len(sizes))), len(nd))
                a = at[end[i] : end[j]]
                n = often[a]
                place = np.repeat(first[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
                k = np.bincount(np.repeat(doc[end[i] : end[j]] - i, n) * len(sizes) + works[place], minlength=(j - i) * len(sizes))
                cell = np.flatnonzero(k)
                d, w, k = cell // len(sizes) + i, cell % len(sizes), k[cell]
                may = np.maximum(1.5 * (k / (nd[d] + sizes[w] - k)), k / sizes[w]) > least
                d, w, k = d[may], w[may], k[may]
                if len(d):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(nd[d].astype(np.int32)), items.take(pa.array(w)), pa.array(sizes[w].astype(np.int32)), pa.array(k.astype(np.int64))], names=["doc_id", "nd", "item_id", "nw", "k"])
                i = j

    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("nd", IntegerType()), StructField("item_id", item), StructField("nw", IntegerType()), StructField("k", LongType())]
    return docs.select("doc_id", "d").mapInArrow(run, StructType(fields))


def text_scores(docs: DataFrame, works: DataFrame, least: float = DEFAULT.candidate_least) -> DataFrame:
    """doc_id, item_id, containment, jaccard, score of pairs with score above `least`. docs: doc_id, text; works: item_id, text.

    score = least(0.98, greatest(1.5 x Jaccard, shared / size of the work)). A small index goes to all tasks, which count shared words text by text; else these are counted by an equi-join on words, and the sizes travel with them, so no set moves and none is compared again. Rows of a repeated doc_id count together.
    """
    d = docs.select("doc_id", F.array_distinct(tx.words(F.trim("text"))).alias("d"))
    w = works.select("item_id", F.array_distinct(tx.words(F.col("text"))).alias("w"))
    index = w.select("item_id", F.size("w").alias("nw"), F.explode("w").alias("tok"))

    def joined(d: DataFrame) -> DataFrame:
        d = d.select("doc_id", F.size("d").alias("nd"), F.explode("d").alias("tok"))
        return d.join(index, "tok").groupBy("doc_id", "nd", "item_id", "nw").agg(F.count("*").alias("k"))

    if docs.isStreaming or not is_small(index):
        both = joined(d)
    else:
        twice = docs.groupBy("doc_id").count().filter(F.col("count") > 1).select("doc_id")
        again = not twice.isEmpty()
        both = _shared(d.join(twice, "doc_id", "left_anti") if again else d, index.toArrow(), works.schema["item_id"].dataType, least)
        both = both.unionByName(joined(d.join(twice, "doc_id", "left_semi"))) if again else both
    both = both.withColumns({"containment": F.col("k") / F.col("nw"), "jaccard": F.col("k") / (F.col("nd") + F.col("nw") - F.col("k"))})
    both = both.withColumn("score", F.least(F.lit(0.98), F.greatest(1.5 * F.col("jaccard"), F.col("containment"))))
    return both.filter(F.col("score") > least).select("doc_id", "item_id", "containment", "jaccard", "score")


def recall(docs: DataFrame, works: DataFrame) -> DataFrame:
    """doc_id, item_id, containment of the work's words in the text (white-space words), for all pairs that share one."""
    d = docs.select("doc_id", F.explode(F.array_distinct(tx.split_ws(F.lower("text")))).alias("tok"))
    w = works.select("item_id", F.array_distinct(tx.split_ws(F.lower("text"))).alias("w")).withColumn("n", F.size("w"))
    index = small(w.select("item_id", "n", F.explode("w").alias("tok")))
    return d.join(index, "tok").groupBy("doc_id", "item_id").agg((F.count("*") / F.greatest(F.max("n"), F.lit(1))).alias("containment"))


def top_k(scores: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key, with rank from 1; ties go to the smaller `tie`."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def two_stage(docs: DataFrame, works: DataFrame, cfg=DEFAULT) -> DataFrame:
    """doc_id, best_recall, score, matched: texts that pass the recall gate are compared chunk by chunk with their top candidates (Jaccard of words)."""
    pairs = recall(docs, works)
    best = pairs.groupBy("doc_id").agg(F.max("containment").alias("best_recall"))
    gated = best.filter(F.col("best_recall") >= cfg.recall_gate)
    tops = top_k(pairs.filter(F.col("containment") > cfg.recall_least).join(gated.select("doc_id"), "doc_id", "left_semi"), "doc_id", "containment", "item_id", cfg.recall_top_k)
    chunk = docs.join(gated.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.inline(tx.chunks(F.col("text"), cfg.chunk_size, cfg.chunk_overlap)))
    chunk = chunk.select("doc_id", "chunk_idx", F.array_distinct(tx.split_ws(F.lower("chunk_text"))).alias("c"))
    w = works.select("item_id", F.array_distinct(tx.split_ws(F.lower("text"))).alias("w"))
    scored = chunk.join(tops.select("doc_id", "item_id", "rank"), "doc_id").join(small(w), "item_id")
    jac = F.size(F.array_intersect("c", "w")) / F.greatest(F.size(F.array_union("c", "w")), F.lit(1))
    scored = scored.select("doc_id", "item_id", "rank", "chunk_idx", jac.alias("j"))
    first = scored.groupBy("doc_id").agg(F.max("j").alias("score"), F.max_by("item_id", F.struct("j", -F.col("chunk_idx"), -F.col("rank"))).alias("matched"))
    out = docs.select("doc_id").join(best, "doc_id", "left").join(first, "doc_id", "left")
    return out.select("doc_id", F.coalesce("best_recall", F.lit(0.0)).alias("best_recall"), F.coalesce("score", F.lit(0.0)).alias("score"), "matched")


def hamming_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str, lhash: str, rhash: str, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """lkey, rkey, dist of pairs of 64-bit hashes at most `most` bits apart, equal in the columns of `by`. Of most + 1 bands one is equal, of most + 2 two are (pigeonhole), so bands are joined: pairs of them where hashes may differ in a few bits, as a single band of 16 bits has few values, and a table's pairs would grow with its square."""
    bands = most + 2 if most <= PAIRED else most + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    ranges = list(zip(cuts, cuts[1:]))

    def banded(df: DataFrame, key: str, col: str) -> DataFrame:
        part = lambda a, b: F.shiftrightunsigned(F.shiftleft(F.col(col), 64 - b), 64 - (b - a))
        if most <= PAIRED:
            parts = [F.shiftleft(part(*x), y[1] - y[0]).bitwiseOR(part(*y)) for x, y in itertools.combinations(ranges, 2)]
        else:
            parts = [part(*x) for x in ranges]
        band = F.array(*(F.struct(F.lit(i).alias("no"), p.alias("part")) for i, p in enumerate(parts)))
        return df.select(F.col(key), F.col(col), *by, F.explode(band).alias("band"))

    a, b = banded(left, lkey, lhash), banded(right, rkey, rhash)
    pairs = a.join(b, ["band", *by]).withColumn("dist", fp.hamming(F.col(lhash), F.col(rhash))).filter(F.col("dist") <= most)
    return pairs.select(lkey, rkey, "dist").distinct()


def hash_classes(hashes: DataFrame, key: str, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """first (smallest key), copies, h (and the columns of `by`) of each value that occurs; 0 takes no part."""
    return hashes.filter(F.col(col) != 0).groupBy(F.col(col).alias("h"), *by).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def near_pairs(hashes: DataFrame, key: str, col: str, most: int = DEFAULT.simhash_distance, by: tuple[str, ...] = ()) -> DataFrame:
    """a < b, dist of classes of equal hashes (and equal columns of `by`) that are 1 to `most` bits apart; a and b are the classes' smallest keys. Members of a class aren't paired: hash_classes has their number."""
    kinds = hash_classes(hashes, key, col, by)
    one, other = (kinds.select(F.col("first").alias(x), F.col("h").alias(f"h{x}"), *by) for x in ("a", "b"))
    return hamming_join(one, other, "a", "b", "ha", "hb", most, by).filter(F.col("a") < F.col("b"))


def set_jaccard(left: DataFrame, right: DataFrame, lkey: str, rkey: str, lset: str, rset: str, least: float) -> DataFrame:
    """lkey, rkey, jaccard (at least `least`) of pairs of arrays of distinct values; keys are unique. Two such sets share one of those values that a set can't do without (prefix filter: the rarest of the right side first), so only these are joined, and what meets is compared as a whole."""
    often = right.select(F.explode(rset).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    spare = lambda c: F.size(c) - F.ceil(F.lit(least) * F.size(c) - 1e-9) + 1

    def rare(rows: DataFrame, key: str, col: str, how: str) -> DataFrame:
        values = rows.select(key, spare(col).alias("k"), F.explode(col).alias("x")).join(often, "x", how)
        w = Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "x")
        return values.withColumn("r", F.row_number().over(w)).filter("r <= k").select(key, "x")

    met = rare(left, lkey, lset, "left").join(rare(right, rkey, rset, "inner"), "x").select(lkey, rkey).distinct()
    both = met.join(left.select(lkey, lset), lkey).join(right.select(rkey, rset), rkey)
    k = F.size(F.array_intersect(lset, rset))
    return both.select(lkey, rkey, (k / (F.size(lset) + F.size(rset) - k)).alias("jaccard")).filter(F.col("jaccard") >= least)


def ngram_hits(outputs: DataFrame, protected: DataFrame, key: str, n: int = DEFAULT.leakage_window) -> DataFrame:
    """key, pos, snippet: the first window of n words that also occurs in a protected text.

    Words are hashed once and windows are hashes of their words' hashes, so no window is built as a string but those that meet a protected one by hash; these are then compared as strings.
    """
    def hashed(words: Column) -> Column:
        return tx.let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(tx.windows(h, n, "bigint"), lambda w: F.xxhash64(w)))

    words = lambda c: tx.words(F.col(c), tx.WORD)
    known = protected.select(F.explode(F.arrays_zip(tx.joined_windows(words("text"), n).alias("known"), hashed(words("text")).alias("h"))).alias("x")).select("x.*").distinct()
    known = small(known)
    seen = outputs.select(key, F.posexplode(hashed(words("text"))).alias("pos", "h"))
    met = seen.join(known, "h", "left_semi").groupBy(key).agg(F.collect_set("pos").alias("at"))  # places of one text
    found = outputs.select(key, "text").join(met, key).select(key, F.inline(tx.let(words("text"), lambda w: F.transform("at", lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("g"))))))
    hits = found.join(known, F.col("g") == F.col("known"), "left_semi")
    return hits.groupBy(key).agg(F.min("pos").alias("pos"), F.min_by("g", "pos").alias("snippet"))


#: White space that ends of texts lose.
_WHITE = " \t\n\r\f\v"


def difflib_join(left: DataFrame, right: DataFrame, by: list[str], least: float, l: str = "l_text", r: str = "r_text") -> DataFrame:
    """left joined with right on `by`, with ratio, where difflib's ratio of the lower-cased texts is at least `least`; see seqjoin. No pair is made on `by` alone."""
    pairs = seqjoin.ratio_pairs(left, right, least, l, r)
    rows = left.withColumn("l_id", seqjoin.text_id(l)).join(pairs, "l_id")
    return rows.join(right.withColumn("r_id", seqjoin.text_id(r)), ["r_id", *by]).drop("l_id", "r_id")


def full_text_pairs(docs: DataFrame, works: DataFrame, cfg=DEFAULT, least: float = 0.55) -> DataFrame:
    """doc_id, item_id, score: token score or difflib ratio, whichever is greater, at most 0.98. All pairs that score `least` or more are there with their score; of others those with a token score above candidate_least, with that."""
    tokens = text_scores(docs, works, cfg.candidate_least).select("doc_id", "item_id", "score")
    d = docs.select("doc_id", F.btrim("text", F.lit(_WHITE)).alias("l_text"))
    w = works.filter(F.size(tx.words(F.col("text"))) > 0).select("item_id", F.col("text").alias("r_text"))
    ratio = difflib_join(d, w, [], least).select("doc_id", "item_id", F.least(F.lit(0.98), "ratio").alias("score"))
    return tokens.unionByName(ratio).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def full_text_match(docs: DataFrame, works: DataFrame, cfg=DEFAULT, least: float = 0.55) -> DataFrame:
    """doc_id, matched, score, exact: the best work of each text (ties: smaller item_id) by token score or difflib ratio, whichever is greater.

    Where no work scores `least` or more, exact is false, and score and matched are null: the best of such ratios isn't worked out. `least` is the lowest threshold of any band, so no outcome depends on it.
    """
    top = top_k(full_text_pairs(docs, works, cfg, least).filter(F.col("score") >= least), "doc_id", "score", "item_id", 1)
    out = docs.select("doc_id").join(top, "doc_id", "left")
    return out.select("doc_id", F.col("item_id").alias("matched"), F.round("score", 4).alias("score"), F.col("score").isNotNull().alias("exact"))


def code_match(code: DataFrame, index: DataFrame, least: float = 0.4, best: int | None = None) -> DataFrame:
    """doc_id, item_id, structure, tokens, score (above `least`), stage for code texts against indexed code; best: only so many of each text (ties: smaller item_id).

    Texts of one structure, one number of tokens and the same tokens that occur in the index score alike with all indexed code: they are one kind, and pairs are between kinds and indexed code until the best are chosen.

    score = structure ratio r, or 0.7 r + 0.3 x Jaccard of tokens if that is more; where four fifths of the query's tokens are in the indexed code, 0.75 + 0.12 r at least. A pair scores above `least` only if r or the Jaccard is above it or the tokens are contained, so candidates come from the ratio join of structures and from shared rare tokens: those that the overlap can't do without (prefix filter over tokens, the rarest of the index first). What all code shares, like `def`, is never such a token.
    """
    toks = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    blank = F.col("text").isNull() | (F.btrim("text", F.lit(_WHITE)) == "")
    a = code.filter(~blank).select("doc_id", fp.code_structure_udf("text").alias("l_text"), toks(F.col("text")).alias("a"))
    b = index.filter(F.col("text").isNotNull()).select("item_id", fp.code_structure_udf("text").alias("r_text"), toks(F.col("text")).alias("b"))
    posts = b.select("item_id", F.explode("b").alias("tok"))
    often = posts.groupBy("tok").agg(F.count("*").alias("n"))
    mine = a.select("doc_id", "l_text", F.size("a").alias("na"), F.explode_outer("a").alias("tok")).join(small(often), "tok", "left")
    mine = mine.groupBy("doc_id", "l_text", "na").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.col("tok")))).alias("a"))
    kind = F.sha2(F.concat_ws("|", seqjoin.text_id("l_text"), F.col("na").cast("string"), F.array_join("a", "|")).cast("binary"), 256)
    mine = mine.withColumn("kind", kind).persist()
    a = mine.select("kind", "l_text", "na", "a").dropDuplicates(["kind"]).persist()
    shapes = seqjoin.ratio_pairs(a, b, least, lower=False)
    left, right = a.withColumn("l_id", seqjoin.text_id("l_text")), b.withColumn("r_id", seqjoin.text_id("r_text"))
    by_shape = left.select("kind", "l_id").join(shapes, "l_id").join(right.select("item_id", "r_id"), "r_id").select("kind", "item_id")
    need = F.ceil(F.least(F.lit(0.8), F.lit(least)) * F.col("na") - 1e-9)
    known = a.select("kind", (F.size("a") - need + 1).alias("k"), F.explode("a").alias("tok")).join(small(often), "tok")  # tokens that the index lacks are rarer, and meet nothing
    rare = known.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("n", "tok"))).filter(F.col("r") <= F.col("k"))
    by_token = rare.select("kind", "tok").join(small(posts), "tok").select("kind", "item_id").distinct()
    pairs = by_shape.unionByName(by_token).distinct().join(left, "kind").join(right, "item_id")
    shared = F.size(F.array_intersect("a", "b"))
    pairs = pairs.withColumns({"tokens": shared / F.greatest(F.col("na") + F.size("b") - shared, F.lit(1)), "inside": shared / F.greatest("na", F.lit(1))})
    known = pairs.join(shapes, ["l_id", "r_id"], "left")
    # Structures below `least` count where tokens speak for the pair.
    known = known.filter(F.col("ratio").isNotNull() | (F.col("tokens") > least) | (F.col("inside") >= 0.8))
    kinds = known.filter(F.col("ratio").isNull()).select("l_id", "r_id", "l_text", "r_text").dropDuplicates(["l_id", "r_id"])
    other = kinds.select("l_id", "r_id", fp.difflib_ratio("l_text", "r_text").alias("low"))
    rows = known.join(other, ["l_id", "r_id"], "left").withColumn("structure", F.coalesce("ratio", "low"))
    s = F.greatest(F.col("structure"), 0.7 * F.col("structure") + 0.3 * F.col("tokens"))
    s = F.when(F.col("inside") >= 0.8, F.greatest(s, 0.75 + 0.12 * F.col("structure"))).otherwise(s)
    rows = rows.select("kind", "item_id", "structure", "tokens", s.alias("score")).filter(F.col("score") > least).withColumn("score", F.round("score", 4))
    rows = top_k(rows, "kind", "score", "item_id", best).drop("rank") if best else rows
    rows = mine.select("doc_id", "kind").join(rows, "kind").select("doc_id", "item_id", "structure", "tokens", "score")
    return rows.withColumn("stage", F.when(F.col("structure") > 0.85, "ast_structure").otherwise("token_overlap"))


def audio_match(assets: DataFrame, index: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score (above `least`) by acoustic fingerprints: equal ones 1.0, else 0.7 x ratio + 0.3 x shorter / longer. assets, index: id and content.

    Equal fingerprints meet by an equi-join; others by the ratio join, as (least - 0.3) / 0.7 is the least ratio that can do. Fingerprints are short strings of few characters: at 0.5 much of the product passes, at the track's threshold little.
    """
    a = assets.select("doc_id", fp.acoustic_fingerprint(F.col("content")).alias("l_text"), F.length("content").alias("la"))
    b = index.select("item_id", fp.acoustic_fingerprint(F.col("content")).alias("r_text"), F.length("content").alias("lb"))
    same = a.join(b, F.col("l_text") == F.col("r_text")).select("doc_id", "item_id", F.lit(1.0).alias("score"))
    size = F.least("la", "lb") / F.greatest("la", "lb", F.lit(1))
    near = difflib_join(a, b, [], max(0.01, (least - 0.3) / 0.7)).filter(F.col("l_text") != F.col("r_text"))
    near = near.select("doc_id", "item_id", (0.7 * F.col("ratio") + 0.3 * size).alias("score")).filter(F.col("score") > least)
    return same.filter(F.lit(1.0) > least).unionByName(near.withColumn("score", F.round("score", 4)))
