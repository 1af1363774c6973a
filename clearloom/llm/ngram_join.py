"""Similarity join of documents on word n-gram sets (Jaccard), with token-combination prefixes.

Sets are hashed n-grams. Equal sets are one class, so copies are never paired. All classes order their n-grams in one way: those that are known to be frequent last, then by hash. Two sets of Jaccard similarity J overlap in at least J times the larger size, so they share at least COMBINE n-grams among the first n - ceil(J n) + COMBINE of each. The index holds these prefixes: an n-gram of at most FREQUENT classes by itself, more frequent ones in combinations of COMBINE (similar sets that share no rarer n-gram share such a combination), but again by themselves where near copies would have too many of these (combined). Sets above LONG n-grams have too many pairs; they combine each n-gram of a longer prefix with the next one: two linked sets are at most d n-grams apart, each of which parts two neighbours at most, so among the first 3 d + 2 of each some neighbours stay together. Sizes between LONG and LONG / J do both.

In each bucket of the index all members are compared with its lead, the class of most copies. Buckets that links then connect are done. Of others, the small ones compare their pairs of different components; the large ones go on with each member's differences from the lead instead of its n-grams (based_on): a member that isn't linked to the lead can be linked only to members that share several of its differences, so new buckets of those are far smaller. That goes on, with more pairs compared in each round, until all buckets are done: no link between components is missed, and a group of n near copies costs about n comparisons, not n squared.

A comparison first looks at bitmaps with about one bit for each n-gram, which bound how far two sets are apart from below, and then at whole sets.

Nulls: a null text is an empty one; a document without words has no n-gram and no link. Null and repeated doc_ids are rows of their own; a component's id is its smallest doc_id. Fewer words than the n-gram length count as one n-gram. A very long text is one step of numpy, with about 100 bytes for each of its own. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, few, lean, mix, signed, slices, stage, table, text_buffers, word_hashes

COMBINE = 2
#: Classes up to which an n-gram is indexed by itself; n-grams of a set from which neighbours are combined instead of all pairs.
FREQUENT, LONG = 128, 200
#: Combinations for each class from which a frequent n-gram is indexed by itself, so that they don't grow with the square of the n-grams that a group of near copies shares.
CROWDED = 4
#: Pairs for each member up to which all pairs of a bucket are compared, in the first round; in each later one this times as many.
FEW, MORE = 64, 8
#: N-grams counted before the join: this share of the hash range; more frequent than TOP_COUNT comes last in the order; at most TOP_MOST of them are known.
SHARE, TOP_COUNT, TOP_MOST = 0.2, 32, 400_000


def gram_sets(offsets: np.ndarray, raw: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document."""
    words, doc = word_hashes(offsets, raw)
    docs = len(offsets) - 1
    count = np.bincount(doc, minlength=docs)
    begin = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        full = words[: max(0, len(words) - n + 1)].copy()
        for i in range(1, n):
            full = mix(full) * np.uint64(3) + words[i : len(words) - n + 1 + i]
        full = mix(full)
    out = []
    for i in range(docs):
        a, c = begin[i], count[i]
        if c >= n:
            out.append(np.unique(full[a : a + c - n + 1]))
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in words[a : a + c]:
                    h = mix(np.array([h]) * np.uint64(5) + w)[0]
            out.append(np.array([h]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(col: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first document, its and the following documents' sets), slice by slice."""
    offsets, raw = text_buffers(col)
    for i, j in slices(offsets):
        yield i, gram_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], n)


def top_grams(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of frequent n-grams; at most TOP_MOST. Which are known changes the work, not the result."""
    bar = np.uint64(int(SHARE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [s[s < bar] for _, sets in sets_of(batch.column(0), n) for s in sets]
            g, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *low]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(c.astype(np.int64))], names=["g", "c"])

    counts = texts.mapInArrow(lean(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).filter(F.col("c") > TOP_COUNT)
    top = counts.orderBy(F.desc("c"), "g").limit(TOP_MOST).select("g").toArrow()["g"].to_numpy()
    return np.sort(top.view(np.uint64))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + COMBINE


def most_apart(n, percent: int):
    """The most n-grams that only one of two linked sets has, where one of them has n."""
    return n * (100 - percent) // percent


def in_order(s: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set's n-grams in the order of the join, in two parts: those that aren't known to be frequent, and those that are."""
    if not len(top):
        return s, s[:0]
    is_top = top[np.minimum(np.searchsorted(top, s), len(top) - 1)] == s
    return s[~is_top], s[is_top]


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two of bits, about one for each n-gram: the parity of the n-grams that fall on each. Two sets differ in at least as many n-grams as bits."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    at = (mix(s ^ np.uint64(0x7ABCDEF)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def classed(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, Broadcast]:
    """(rows: doc_id, t, n, s1, s2; classes: node, n, copies, prefix, bits; the known frequent n-grams)."""
    top = docs.sparkSession.sparkContext.broadcast(top_grams(docs.select("text"), n))  # at most TOP_MOST hashes
    schema = "doc_id long, t long, n int, s1 long, s2 long, prefix array<long>, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in sets_of(batch.column(2), n):
                size, s1, s2, prefix, bits = [], [], [], [], []
                for s in sets:
                    size.append(len(s))
                    with np.errstate(over="ignore"):
                        s1.append(int(signed(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))])))[0]))
                        s2.append(int(signed(np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0x1234567)))]))[0]) if len(s) else 0)
                    first, then = in_order(s, top.value)
                    take = prefix_size(len(s), percent) if most_apart(len(s), percent) else 0  # 0: no other set is similar enough
                    prefix.append(signed(np.concatenate([first[:take], then[: max(0, take - len(first))]])))
                    bits.append(parity(s) if take else np.zeros(0, np.int64))
                cols = [pa.array(size, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(sets)) for c in batch.columns[:2]), *cols], names=["doc_id", "t", "n", "s1", "s2", "prefix", "bits"])

    rows = stage(docs.select("doc_id", "t", "text").mapInArrow(lean(run), schema), "ngram-rows")
    classes = rows.filter(F.col("n") > 0).groupBy("s1", "s2", "n").agg(F.min("t").alias("node"), F.count("*").alias("copies"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"))
    return rows.select("doc_id", "t", "n", "s1", "s2"), stage(classes, "ngram-classes"), top


def sets_for(docs: DataFrame, nodes: DataFrame, n: int, keys=None) -> DataFrame:
    """t, s: the whole sets of the texts with these hashes (column t). With keys, a function of a set: t, key for each of what it gives; both in one pass, as each Python pass in a task is a worker of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in sets_of(batch.column(1), n):
                t = batch.column(0).slice(i, len(sets))
                if keys is None:
                    yield pa.RecordBatch.from_arrays([t, pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], names=["t", "s"])
                else:
                    found = [keys(s) for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.to_numpy(), [len(k) for k in found])), pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *found])))], names=["t", "key"])

    rows = docs.join(few(nodes), "t", "left_semi").dropDuplicates(["t"]).select("t", "text")
    return rows.mapInArrow(lean(run), "t long, s array<long>" if keys is None else "t long, key long")


def combined(lists: DataFrame) -> DataFrame:
    """key, node, n, copies of the combinations of frequent n-grams (column gs, ascending). A pair belongs to its smaller n-gram. One that would be combined with CROWDED others or more in each of its classes is a bucket by itself instead: two classes that share any of its pairs share it too."""
    names = ["node", "n", "copies"]
    each = lists.select(*names, F.posexplode("gs").alias("i", "g"), F.size("gs").alias("of"))
    crowded = each.groupBy("g").agg(F.sum(F.col("of") - 1 - F.col("i")).alias("pairs"), F.count("*").alias("size")).filter(F.col("pairs") >= CROWDED * F.col("size"))
    crowded = few(stage(crowded.select("g", F.lit(True).alias("crowded")), "ngram-crowded"))
    marked = each.select(*names, "g").join(crowded, "g", "left")
    open_ = F.struct("g", F.col("crowded").isNull().alias("open"))
    sets = marked.groupBy(*names).agg(F.array_sort(F.collect_list(open_)).alias("gs"))  # a prefix at most
    pairs = F.transform("gs", lambda x, i: F.when(x.open, F.transform(F.slice("gs", i + 2, F.size("gs")), lambda y: F.xxhash64(x.g, y.g))).otherwise(F.array().cast("array<bigint>")))
    return marked.filter("crowded").select(F.col("g").alias("key"), *names).unionByName(sets.select(F.explode(F.flatten(pairs)).alias("key"), *names))


def index(classes: DataFrame, docs: DataFrame, top: Broadcast, n: int, percent: int) -> DataFrame:
    """key, node, n, copies: the members of each bucket."""
    posts = classes.filter(F.size("prefix") > 0).select("node", "n", "copies", F.explode("prefix").alias("g"))
    df = posts.groupBy("g").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    posts = stage(posts.join(df.hint("shuffle_hash"), "g"), "ngram-posts")  # one row for each n-gram, far fewer than posts: hashed, so posts aren't sorted
    names = ["key", "node", "n", "copies"]
    rare = posts.filter(F.col("df") <= FREQUENT).select(F.col("g").alias("key"), *names[1:])
    lists = posts.filter(F.col("df") > FREQUENT).groupBy("node", "n", "copies").agg(F.array_sort(F.collect_list("g")).alias("gs")).filter(F.size("gs") >= COMBINE)  # a prefix at most
    lists = stage(lists, "ngram-frequent")
    out = rare.unionByName(combined(lists.filter(F.col("n") * percent <= LONG * 100)))
    wide = lists.filter(F.col("n") > LONG).select(F.col("node").alias("t"), "n", "copies")
    if not wide.isEmpty():

        def neighbours(s: np.ndarray) -> np.ndarray:
            s = np.concatenate(in_order(s, top.value))[: 3 * most_apart(len(s), percent) + 2]
            with np.errstate(over="ignore"):
                return mix(mix(s[:-1]) * np.uint64(3) + s[1:])

        keys = sets_for(docs, wide.select("t"), n, neighbours)
        out = out.unionByName(keys.join(wide, "t").select("key", F.col("t").alias("node"), "n", "copies"))
    return stage(out.distinct(), "ngram-index")


def sized(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def linkable(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow the similarity."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"b_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(sized("n_a", "n_b", percent))

    def halved(mine: str, other: str) -> Column:
        """A bitmap, folded once where the other one is shorter: sizes that may be linked are less than a factor of 2 apart."""
        half = F.size(mine) / 2
        return F.when(F.size(mine) > F.size(other), F.zip_with(F.slice(mine, F.lit(1), half.cast("int")), F.slice(mine, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(mine))

    apart = F.aggregate(F.zip_with(halved("b_a", "b_b"), halved("b_b", "b_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return rows.filter(apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    near = stage(linkable(pairs, classes, percent), "ngram-near")
    nodes = near.select(F.col("a").alias("t")).union(near.select("b")).distinct()
    sets = stage(sets_for(docs, nodes, n), "ngram-sets")
    side = lambda x: sets.select(F.col("t").alias(x), F.col("s").alias(f"s_{x}"))
    both = near.join(side("b"), "b").join(side("a"), "a").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    out = stage(both.filter(100 * F.col("common") >= percent * (F.size("s_a") + F.size("s_b") - F.col("common"))).select("a", "b"), "ngram-links")
    discard(near, sets)
    return out


def based_on(lead: np.ndarray, s: np.ndarray, top: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """A set as its differences from a lead's: (n-grams that only one of the two has, in an order common to all sets; how many of them to index if the set isn't linked to the lead, 0 if it is; how many in any case).

    Sets A and B differ from each other as their differences D(A) and D(B) do. If they are linked and A isn't linked to the lead, D(A) and D(B) overlap in more than half of D(B) (but for sizes), and in all of either but what A and B may be apart. So they share one of the first few of each. What the lead lacks comes first: many sets lack the same n-grams of a lead, few add the same.
    """
    added, lost = np.setdiff1d(s, lead, assume_unique=True), np.setdiff1d(lead, s, assume_unique=True)
    d, apart = len(added) + len(lost), int(most_apart(len(s), percent))
    order = np.concatenate([*in_order(added, top), *in_order(lost, top)])
    far = d * (100 + percent) > (100 - percent) * (len(s) + len(lead))
    share = max(1, d - apart, (d * (100 + percent) + (100 - percent) * (len(lead) - len(s))) // (2 * (100 + percent)) + 1)
    return order, d - max(1, d - apart) + 1 if far else 0, max(0, d - share + 1)


def rebased(groups: DataFrame, docs: DataFrame, top: Broadcast, n: int, percent: int) -> DataFrame:
    """From pairs (lead, node; n, copies of the node): key, node, n, copies, far, near of the buckets of each lead's members by their differences from it (a pair needs a look if one of the two is far in the bucket and the other near); and, marked as link, the pairs that are linked, with the lead as key."""
    sets = stage(sets_for(docs, groups.select(F.col("lead").alias("t")).union(groups.select("node")).distinct(), n), "ngram-sets")
    both = groups.join(sets.select(F.col("t").alias("node"), F.col("s").alias("s_node")), "node").join(sets.select(F.col("t").alias("lead"), F.col("s").alias("s_lead")), "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.slice(at, 256), ([], [], [], [], [], [], [])
                for lead, node, size, copies, a, b in zip(*(part.column(c).to_pylist() for c in ("lead", "node", "n", "copies")), part.column("s_lead"), part.column("s_node")):
                    order, far, near = based_on(np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64), top.value, percent)
                    m, own = max(far, near), np.array([lead]).view(np.uint64)
                    with np.errstate(over="ignore"):
                        out[0].append(np.concatenate([mix(order[:m] ^ mix(own)), own[: not far]]))
                    for x, value, kind in zip(out[1:4], (node, size, copies), (np.int64, np.int32, np.int64)):
                        x.append(np.full(m + (not far), value, kind))
                    out[4].append(np.arange(m + (not far)) < far)
                    out[5].append(np.arange(m + (not far)) < near)
                    out[6].append(np.arange(m + (not far)) == m)
                key, *rest = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *map(pa.array, rest)], names=["key", "node", "n", "copies", "far", "near", "link"])

    out = stage(both.select("lead", "node", "n", "copies", "s_lead", "s_node").mapInArrow(lean(run), "key long, node long, n int, copies long, far boolean, near boolean, link boolean"), "ngram-rebased")
    discard(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, label of the nodes of undirected edges (a, b): label is the smallest node of the component. Labels go along edges, then jump to their labels' labels."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = stage(labels, "labels")
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("heard"))
        step = labels.join(heard, F.col("node") == F.col("b")).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = stage(step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = not step.filter(F.col("old") != F.col("label")).isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels


def joined(edges: DataFrame | None, labels: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with more of them, and the labels of their components."""
    if edges is None:
        return more, components(more)
    if more.isEmpty():
        return edges, labels
    edges = stage(edges.union(more), "ngram-edges")
    return edges, components(edges)


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their component as `own`, of buckets that hold more than one component."""
    known = members.join(labels, "node", "left").withColumn("own", F.coalesce("label", "node")).drop("label")
    several = known.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least < most").select("key")
    return known.join(several, "key", "left_semi")


def linked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, label (of the component, stable for a corpus), class (s1, s2: equal sets) of each row of docs (doc_id, text)."""
    if not 67 <= percent <= 100:
        raise ValueError("similarity from 67 to 100 percent: below, small sets may share fewer n-grams than are combined")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    rows, classes, top = classed(docs, n, percent)
    members = index(classes, docs, top, n, percent).withColumns({"far": F.lit(True), "near": F.lit(True)})
    edges, labels, first, most = None, None, True, FEW
    while True:
        lead = F.max(F.struct("copies", "node", "n"))
        heads = members.groupBy("key").agg(lead.alias("lead"), F.count("*").alias("size"), F.sum(F.col("far").cast("long")).alias("fars"), F.sum(F.col("near").cast("long")).alias("nears")).filter("size > 1 and fars > 0")
        heads = heads.select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.copies").alias("lead_copies"), (F.col("fars") * F.col("nears") > most * F.col("size")).alias("large"))
        members = stage(members.join(heads, "key"), "ngram-members")
        # All are compared with the lead; in small buckets of later rounds that is left to the comparison of pairs.
        stars = members.filter((F.col("node") != F.col("lead")) & (F.col("large") | F.lit(first)) & sized("n", "lead_n", percent)).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        edges, labels = joined(edges, labels, verified(stars, docs, classes, n, percent))
        live = apart(members, labels).filter(~F.col("large"))
        live = live.filter(F.col("node") != F.col("lead")) if first else live
        one, other = (live.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("own").alias(f"own_{x}"), F.col(role)) for x, role in (("x", "far"), ("y", "near")))
        met = one.filter("far").join(other.filter("near"), "key").filter((F.col("own_x") != F.col("own_y")) & sized("n_x", "n_y", percent))
        edges, labels = joined(edges, labels, verified(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), docs, classes, n, percent))
        large = members.filter("large")
        if first:
            large = large.withColumn("home", F.max(F.struct("lead_copies", "lead")).over(Window.partitionBy("node")))
        large = apart(large, labels)
        if first:  # all buckets of a group of copies take the same class, whether they hold it or not: of the leads that their members have in any bucket, the one of most copies
            large = large.drop("lead").join(large.groupBy("key").agg(F.max("home").alias("base")).select("key", F.col("base.lead").alias("lead")), "key")
        groups = stage(large.filter(F.col("node") != F.col("lead")).select("lead", "node", "n", "copies").distinct(), "ngram-groups")
        if groups.isEmpty():
            break
        found = rebased(groups, docs, top, n, percent)
        edges, labels = joined(edges, labels, found.filter("link").select(F.col("key").alias("a"), F.col("node").alias("b")))
        members = found.filter("not link").drop("link")
        first, most = False, most * MORE
    nodes = classes.select("s1", "s2", "n", "node").join(labels, "node", "left").select("s1", "s2", "n", F.coalesce("label", "node").alias("label"))
    out = stage(rows.join(nodes, ["s1", "s2", "n"], "left"), "ngram-out")
    least = out.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = out.join(least, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label", "t")


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (null last), of rows with that id the one with the smallest text hash, of equal rows any one. Documents without words stay. Other columns pass through, whatever their names."""
    names = docs.columns
    aside = {c: f"__kept_{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    docs = docs.withColumnsRenamed(aside)
    found = stage(linked(docs.select("doc_id", "text"), n, percent).select("doc_id", "t", "label"), "ngram-found")
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("t"))
    first = found.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min_by("doc_id", order).alias("first_id"), F.min_by("t", order).alias("first_t"))
    gone = found.join(first, "label").filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t"))))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct()
    rows = docs.withColumn("gone_by", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(gone, (F.col("gone_by") == F.col("gone_t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")), "left_anti")
    if not found.filter(F.col("label").isNotNull()).groupBy("doc_id", "t").count().filter(F.col("count") > 1).isEmpty():
        single = rows.filter(F.col("text").isNotNull()).dropDuplicates(["doc_id", "gone_by"])
        rows = single.unionByName(rows.filter(F.col("text").isNull()))
    return rows.select(*(F.col(aside.get(c, c)).alias(c) for c in names))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
