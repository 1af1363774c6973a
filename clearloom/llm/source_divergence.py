"""How the sources of each language differ in their words: a chi-square-like divergence of every source from every other one and of its words from the language's.

Heavy-light split. With S sources and V kept terms a pair of sources sums over V terms. Terms in more than a quarter of the sources (heavy) fill dense numpy tiles, terms by sources. The others (light) are absent from most sources: absent from both, a term gives a pair the same summand f0, so a pair begins with f0 for every light term, each posting adds what its source changes against sources without the term (equal postings at once, by their number), and terms that both sources hold add the rest by a correction of the two postings. All sums are of whole numbers, so the parts add up exactly.

Words are counted within tasks first, then by (language, term); a source or language that holds a third of the rows adds no more rows than its terms. Tiles hold a bounded number of cells, and take sources in strips of STRIP. A term's postings (one for each source that has it) and a language's list of sources are together in one task; the answer holds the square of that list.

p = 1 + floor(SCALE * (count + 1) / (N + V)), f = floor((p - q)^2 / q). Nulls: a null text, lang or source is the empty string. Texts without a term, empty ones too, count only as rows of their group. Repeated rows count each. Very long texts are processed whole, in pieces. Ties go to the smaller item by UTF-8 bytes. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, lean, stage, table

SCALE = 1_000_000_000
#: A term is kept if so many documents of the language have it.
LEAST_DOCS = 3
#: Terms that a report names for each group.
TOP_TERMS = 200
#: A term is heavy if it is in more than this part of the sources.
HEAVY = 0.25
#: Cells of a dense tile, postings of a sparse one (both on average), and sources that a strip of sums has.
TILE_CELLS, TILE_POSTINGS, STRIP = 1 << 18, 1 << 16, 64
#: Counts that a task holds before it passes them on, and bytes of text that are split into terms at once.
HELD, PIECE = 300_000, 1 << 24
#: Bytes of terms: letters, and all bytes of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _terms(data: bytes) -> Counter:
    """Terms of a text, A-Z lower-cased. Long texts are split between terms."""
    if len(data) <= PIECE:
        return Counter(TERM.findall(data.lower()))
    out, at = Counter(), 0
    low = data.lower()
    while at < len(low):
        end = min(at + PIECE, len(low))
        while end < len(low) and TERM.match(low, end, end + 1):
            end += 1
        out.update(TERM.findall(low, at, end))
        at = end
    return out


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): sums within tasks, to be added up."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        d: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                terms = list(counts)
                docs = d[lang, source]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])
            n.clear()
            d.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = _terms(text.as_buffer().to_pybytes())
                n[lang, source].update(found)
                d[lang, source].update(found.keys())
            if sum(map(len, n.values())) > HELD:
                yield from out()
        yield from out()

    return rows.mapInArrow(lean(run), "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, tid (a number), total, posts (source and n of each source that has it): terms in at least `least` documents of the language. Written to the shared folder."""
    parts = counted(docs).repartition("lang", "term")
    each = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = each.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return stage(terms.filter(F.col("d") >= least).drop("d").withColumn("tid", F.monotonically_increasing_id()), "terms")


def scaled(count: Column, total: Column) -> Column:
    """p of a count; exact beyond 64 bits."""
    return F.call_function("div", (count + 1).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(27,0)")) + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x = p - q
    return x * x // q


def _dense(tids: np.ndarray, gids: np.ndarray, ps: np.ndarray, zeros: np.ndarray, strip: range) -> Iterator[tuple[int, np.ndarray]]:
    """(g, sums with each h) of a tile of terms by sources."""
    terms, row = np.unique(tids, return_inverse=True)
    tile = np.tile(zeros, (len(terms), 1))
    tile[row, gids] = ps
    for g in strip:
        yield g, _f(tile[:, g : g + 1], tile).sum(0)


def _sparse(tids: np.ndarray, gids: np.ndarray, ps: np.ndarray, zeros: np.ndarray, strip: range) -> tuple[np.ndarray, np.ndarray]:
    """What postings change in the sums from the strip's sources to all (rows: strip), and from all to the strip's."""
    to, back = np.zeros((len(strip), len(zeros)), np.int64), np.zeros((len(strip), len(zeros)), np.int64)
    order = np.argsort(tids, kind="stable")
    tids, gids, ps = tids[order], gids[order], ps[order]
    # A posting against sources without the term; equal ones are counted.
    mine = (gids >= strip.start) & (gids < strip.stop)
    if mine.any():
        kinds, copies = np.unique(np.stack([gids[mine], ps[mine]]), axis=1, return_counts=True)
        step = max(1, TILE_CELLS // len(zeros))
        for a in range(0, len(copies), step):
            g, p, c = kinds[0, a : a + step], kinds[1, a : a + step][:, None], copies[a : a + step][:, None]
            z = zeros[g][:, None]
            np.add.at(to, g - strip.start, c * (_f(p, zeros) - _f(z, zeros)))
            np.add.at(back, g - strip.start, c * (_f(zeros, p) - _f(zeros, z)))
    # Two postings of one term: neighbours at each distance, while terms have so many.
    for s in range(1, len(tids)):
        same = np.flatnonzero(tids[s:] == tids[:-s])
        if not len(same):
            break
        for x, y in ((same, same + s), (same + s, same)):
            x, y = x[k := mine[x]], y[k]
            g, h, p, q = gids[x], gids[y], ps[x], ps[y]
            np.add.at(to, (g - strip.start, h), _f(p, q) - _f(p, zeros[h]) - _f(zeros[g], q) + _f(zeros[g], zeros[h]))
    return to, back


def pair_sums(tiles: DataFrame) -> DataFrame:
    """lang, g, h, value: partial sums of tiles. tiles: lang, kind (base, light, heavy), terms (of a base), zeros (p of an absent term by source), strip, posts (tid, gid, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, kind, terms, at = (batch.column(c)[i].as_py() for c in (0, 1, 2, 4))
                zeros = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                posts = batch.column(5)[i].values
                tids, gids, ps = (posts.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
                strip = range(at * STRIP, min((at + 1) * STRIP, len(zeros)))
                every = np.arange(len(zeros))

                def out(g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
                    live = (g != h) & ((value != 0) | (kind == "base"))
                    return pa.RecordBatch.from_arrays([pa.array([lang] * int(live.sum()), pa.string()), pa.array(g[live]), pa.array(h[live]), pa.array(value[live])], names=["lang", "g", "h", "value"])

                if kind == "light":
                    to, back = _sparse(tids, gids, ps, zeros, strip)
                    for g in strip:
                        yield out(np.full_like(every, g), every, to[g - strip.start])
                        yield out(every, np.full_like(every, g), back[g - strip.start])
                else:
                    sums = _dense(tids, gids, ps, zeros, strip) if kind == "heavy" else ((g, terms * _f(zeros[g], zeros)) for g in strip)
                    for g, value in sums:
                        yield out(np.full_like(every, g), every, value)

    return tiles.mapInArrow(lean(run), "lang string, g long, h long, value long")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms) of documents (lang, source, text). pairs: lang, source, item (another source), value, rank. terms: lang, source, item (a term that is commoner there than in the language), value, rank up to top_terms."""
    terms = kept_terms(docs, least)
    held = terms.select("lang", F.explode("posts").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    by_lang = Window.partitionBy("lang")  # sources of a language
    groups = groups.join(held, ["lang", "source"], "left").join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    groups = groups.withColumns({"all_n": F.sum("n").over(by_lang), "s": F.count("*").over(by_lang), "gid": (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long")})
    groups = stage(groups.withColumn("zero", F.when(F.col("v") > 0, scaled(F.lit(0).cast("long"), F.col("n") + F.col("v"))).otherwise(1)), "groups")
    small = few(groups)

    posts = terms.select("lang", "term", "tid", "total", F.size("posts").alias("k"), F.inline("posts")).withColumnRenamed("n", "count")
    posts = posts.join(small, ["lang", "source"]).withColumn("p", scaled(F.col("count"), F.col("n") + F.col("v")))
    q = scaled(F.col("total"), F.col("all_n") + F.col("v"))
    found = posts.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).filter(F.col("p") > F.col("q"))
    found = found.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    heavy = F.col("k") > HEAVY * F.col("s")
    sized = terms.select("lang", F.size("posts").alias("k")).join(few(groups.groupBy("lang").agg(F.first("s").alias("s"))), "lang")
    work = sized.groupBy("lang").agg(F.count_if(~heavy).alias("light_terms"), F.ceil(F.sum(F.when(heavy, F.col("s")).otherwise(0)) / TILE_CELLS).alias("dense"), F.ceil(F.sum(F.when(heavy, 0).otherwise(F.col("k"))) / TILE_POSTINGS).alias("sparse"))
    zeros = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gid", "zero"))).alias("z"), F.first("s").alias("s")).select("lang", "s", F.col("z.zero").alias("zeros"))
    langs = stage(zeros.join(work, "lang", "left"), "languages")
    tile = F.pmod(F.hash("tid"), F.greatest(F.when(heavy, F.col("dense")).otherwise(F.col("sparse")), F.lit(1)).cast("int"))
    dealt = posts.select("lang", "tid", "gid", "p", "k", "s").join(few(langs.select("lang", "dense", "sparse")), "lang").select("lang", F.when(heavy, "heavy").otherwise("light").alias("kind"), tile.alias("tile"), "tid", "gid", "p")
    tiles = dealt.groupBy("lang", "kind", "tile").agg(F.collect_list(F.struct("tid", "gid", "p")).alias("posts")).drop("tile")
    tiles = tiles.join(few(langs.select("lang", "zeros", "s")), "lang").withColumn("terms", F.lit(0).cast("long"))
    base = langs.select("lang", F.lit("base").alias("kind"), F.coalesce("light_terms", F.lit(0)).cast("long").alias("terms"), "zeros", "s", F.array().cast("array<struct<tid:bigint,gid:bigint,p:bigint>>").alias("posts"))
    strips = F.explode(F.sequence(F.lit(0), F.floor((F.col("s") - 1) / STRIP).cast("int"))).alias("strip")
    sums = pair_sums(tiles.unionByName(base).select("lang", "kind", "terms", "zeros", strips, "posts")).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    name = lambda g, c: few(groups.select("lang", F.col("gid").alias(g), F.col("source").alias(c)))
    pairs = sums.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select("lang", "source", "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)), top


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, terms = divergence(table(spark, sf_dir, "documents"))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
cell AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
         FROM gn JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM cell WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
