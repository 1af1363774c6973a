"""The engine's queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it.

documents stand for assets, benchmark for protected works, pages for crawled pages, conversations for model outputs and chat, embeddings for the vector index, events for telemetry, queue and audit, labels for calibration truth. What the tables lack is derived alike on both sides: trust tier from doc_id % 3, jurisdiction from doc_id % 4, opt-out from doc_id % 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearloom import config
from clearloom.functions import fingerprint as fp
from clearloom.functions import text as tx
from clearloom.operators import decision, dedup, evaluation, governance, ledger, numbering, provenance, simjoin, sinks, vector
from clearloom.sources import assets, web
from clearloom.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def pick(col: str, n: int, values: list[str | None]) -> Column:
    out = F.lit(values[-1])
    for i, v in list(enumerate(values[:-1]))[::-1]:
        out = F.when(F.pmod(F.col(col), F.lit(n)) == i, F.lit(v)).otherwise(out)
    return out


TIER = "CASE doc_id % 3 WHEN 0 THEN 'licensed-partner' WHEN 1 THEN 'public-web-unknown' ELSE 'high-risk-domain' END"
JURISDICTION = "CASE doc_id % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' WHEN 2 THEN 'GLOBAL' ELSE 'EU' END"


def attributes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "track": F.lit("TEXT"), "tier": pick("doc_id", 3, ["licensed-partner", "public-web-unknown", "high-risk-domain"]),
        "jurisdiction": pick("doc_id", 4, ["EU", "US", "GLOBAL", "EU"]), "opted_out": F.pmod("doc_id", F.lit(5)) == 0,
    })


# ---- SQL pieces that several oracles use
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{3,}}'))"
_WS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_DW = f"d AS (SELECT doc_id, {_WORDS.format('trim(text)')} AS dt FROM documents)"
_WW = f"w AS (SELECT item_id, {_WORDS.format('text')} AS wt FROM benchmark)"
_SCORES = f"""{_DW}, {_WW},
du AS (SELECT doc_id, len(dt) AS nd, unnest(dt) AS tok FROM d), wu AS (SELECT item_id, len(wt) AS nw, unnest(wt) AS tok FROM w),
k AS (SELECT doc_id, item_id, count(*) AS k, any_value(nd) AS nd, any_value(nw) AS nw FROM du JOIN wu USING (tok) GROUP BY ALL),
s AS (SELECT doc_id, item_id, k / nw AS containment, k / (nd + nw - k) AS jaccard, least(0.98::DOUBLE, greatest(1.5::DOUBLE * (k / (nd + nw - k)), k / nw)) AS score FROM k),
c AS (SELECT * FROM s WHERE score > 0.3::DOUBLE),
b AS (SELECT doc_id, item_id AS matched, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM c) WHERE r = 1),
best AS (SELECT documents.doc_id, matched, round(coalesce(score, 0.0::DOUBLE), 4) AS score FROM documents LEFT JOIN b USING (doc_id))"""
_LOW = f"(0.70::DOUBLE + CASE {TIER} WHEN 'high-risk-domain' THEN -0.15::DOUBLE WHEN 'licensed-partner' THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END)"
_BAND = f"CASE WHEN score >= 0.85::DOUBLE THEN 'BLOCKED' WHEN score >= {_LOW} THEN 'HUMAN_REVIEW' ELSE 'CLEAR' END"
_STATUS = f"CASE WHEN {_BAND} = 'CLEAR' THEN 'PASSED' ELSE {_BAND} END"
_ROUTED = f"{_SCORES}, routed AS (SELECT *, {TIER} AS tier, {_BAND} AS band, {_STATUS} AS status FROM best)"


def best_token_match(spark: SparkSession, d: str) -> DataFrame:
    docs, works = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark")
    top = simjoin.top_k(simjoin.text_scores(docs, works), "doc_id", "score", "item_id", 1)
    out = docs.select("doc_id").join(top, "doc_id", "left")
    return out.select("doc_id", F.col("item_id").alias("matched"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    rows = attributes(best_token_match(spark, d))
    band = decision.band(F.col("score"), F.col("track"), F.col("tier"))
    return rows.withColumn("band", band).withColumn("status", decision.status_of_band(F.col("band")))


@query(f"WITH {_ROUTED} SELECT doc_id, matched, score, status FROM routed")
def text_clearance_token(spark, d):
    """Words of each text against protected works: best work, score, status. Without the sequence ratio (text_clearance_full)."""
    return routed(spark, d).select("doc_id", "matched", "score", "status")


@query()
def text_clearance_full(spark, d):
    """Words or sequence ratio of each text against protected works, whichever is more; null where no work reaches the lowest threshold of any band."""
    return simjoin.full_text_match(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"))


@query(f"WITH {_SCORES} SELECT doc_id, item_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM c) WHERE rank <= 5")
def text_candidates_top5(spark, d):
    rows = simjoin.text_scores(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"))
    return simjoin.top_k(rows, "doc_id", "score", "item_id", 5).select("doc_id", "item_id", "rank", F.round("score", 4).alias("score"))


@query(f"WITH {_ROUTED} SELECT doc_id, score, tier, band, status FROM routed")
def band_routing(spark, d):
    return routed(spark, d).select("doc_id", "score", "tier", "band", "status")


@query(f"WITH {_ROUTED} SELECT doc_id, score, tier, matched FROM routed WHERE band = 'HUMAN_REVIEW'")
def review_queue(spark, d):
    rows = routed(spark, d).filter(F.col("band") == "HUMAN_REVIEW").withColumns({"status": F.lit("PENDING"), "asset_id": F.col("doc_id")})
    return decision.review_queue(rows).select("doc_id", "score", "tier", "matched")


_RULE = f"""CASE WHEN {JURISDICTION} = 'EU' AND score BETWEEN 0.75::DOUBLE AND 0.90::DOUBLE AND doc_id % 5 = 0 THEN 1 WHEN {JURISDICTION} = 'US' AND score BETWEEN 0.75::DOUBLE AND 0.88::DOUBLE AND doc_id % 5 <> 0 THEN 2
WHEN tier = 'high-risk-domain' AND score BETWEEN 0.70::DOUBLE AND 0.85::DOUBLE THEN 3 END"""


@query(f"""WITH {_ROUTED}, r AS (SELECT *, {_RULE} AS rule FROM routed)
SELECT doc_id, {JURISDICTION} AS jurisdiction, CASE rule WHEN 1 THEN 'EU_TDM_RESERVATION_BLOCK' WHEN 2 THEN 'US_FAIR_USE_MID_BAND' WHEN 3 THEN 'HIGH_RISK_DOMAIN_SENSITIVITY' END AS rule_id,
CASE rule WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'HUMAN_REVIEW' WHEN 3 THEN 'HUMAN_REVIEW' ELSE status END AS outcome FROM r""")
def jurisdiction_outcome(spark, d):
    rows = decision.apply_rules(routed(spark, d), decision.rules_table(spark), "doc_id", "score", "jurisdiction", "opted_out", "tier", "status")
    return rows.select("doc_id", "jurisdiction", "rule_id", "outcome")


_OUTCOME = "CASE rule WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'HUMAN_REVIEW' WHEN 3 THEN 'HUMAN_REVIEW' ELSE status END"
_CERT = "sha256(asset_id::VARCHAR || '|sha256:' || h)"


# Code texts are made from ids: documents hold none. ~ stands for a name of its own in each text, so those of one template differ in all their names.
CODE_TEMPLATES = [
    "def ~_f(~_a, ~_b):\n    ~_c = ~_a + ~_b\n    return ~_c\n",
    "class ~_k:\n    def ~_m(self, ~_x):\n        for ~_i in ~_x:\n            print(~_i)\n        return len(~_x)\n",
    "import os\n\nfor ~_i in range(10):\n    if ~_i % 2:\n        print(os.path.join('a', str(~_i)))\n",
    "function ~_f(~_a) { return ~_a + 1; }\n",
]
# Scores of texts of a template against indexed ones of the first two, worked out by hand with ast and difflib; lower ones than 0.4 don't count.
_CODE_SCORES = "cs(t, w, code_score, stage) AS (VALUES (0, 0, 1.0::DOUBLE, 'ast_structure'), (0, 1, 0.7256::DOUBLE, 'token_overlap'), (1, 0, 0.7256::DOUBLE, 'token_overlap'), (1, 1, 1.0::DOUBLE, 'ast_structure'), (2, 1, 0.522::DOUBLE, 'token_overlap'))"
_CODE_BEST = f"""{_CODE_SCORES}, ci AS (SELECT item_id % 2 AS w, min(item_id) AS item_id FROM benchmark GROUP BY 1),
cb AS (SELECT doc_id, item_id, code_score, stage FROM (SELECT doc_id, item_id, code_score, stage, row_number() OVER (PARTITION BY doc_id ORDER BY code_score DESC, item_id) AS k FROM documents JOIN cs ON doc_id % 4 = t JOIN ci USING (w)) WHERE k = 1)"""


def _code_text(key: str, name: str, kinds: int) -> Column:
    return F.replace(pick(key, kinds, CODE_TEMPLATES[:kinds]), F.lit("~"), F.concat(F.lit(name), F.col(key).cast("string")))


def _code_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    code = table(spark, d, "documents", "doc_id").withColumn("text", _code_text("doc_id", "v", 4))
    return code, table(spark, d, "benchmark", "item_id").withColumn("text", _code_text("item_id", "w", 2))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_CODE_SQL = "replace(CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(CODE_TEMPLATES)) + " END, '~', 'v' || doc_id)"
_EVERY_LOW = _LOW.replace("0.70::DOUBLE", "CASE track WHEN 'TEXT' THEN 0.70::DOUBLE ELSE 0.75::DOUBLE END")
_EVERY_BAND = f"CASE WHEN score >= 0.85::DOUBLE THEN 'BLOCKED' WHEN score >= {_EVERY_LOW} THEN 'HUMAN_REVIEW' ELSE 'PASSED' END"


@query(f"""WITH {_SCORES}, {_CODE_BEST},
e AS (SELECT doc_id AS asset_id, doc_id, 'TEXT' AS track, sha256(text) AS h, matched, score FROM documents JOIN best USING (doc_id)
UNION ALL SELECT -1 - doc_id, doc_id, 'CODE', sha256({_CODE_SQL}), item_id, coalesce(code_score, 0.0::DOUBLE) FROM documents LEFT JOIN cb USING (doc_id)),
f AS (SELECT *, {TIER} AS tier, {_EVERY_BAND} AS status, asset_id <> min(asset_id) OVER (PARTITION BY track, h) AS is_duplicate FROM e), r AS (SELECT *, {_RULE} AS rule FROM f)
SELECT asset_id, track, 'sha256:' || h AS asset_hash, is_duplicate, true AS compared, matched::VARCHAR AS matched, score, status, CASE rule WHEN 1 THEN 'EU_TDM_RESERVATION_BLOCK' WHEN 2 THEN 'US_FAIR_USE_MID_BAND' WHEN 3 THEN 'HIGH_RISK_DOMAIN_SENSITIVITY' END AS rule_id, {_OUTCOME} AS outcome,
CASE WHEN {_OUTCOME} = 'PASSED' THEN {_CERT}[1:8] || '-' || {_CERT}[9:12] || '-' || {_CERT}[13:16] || '-' || {_CERT}[17:20] || '-' || {_CERT}[21:32] END AS certificate_id FROM r""")
def full_evaluation(spark, d):
    """Hash, duplicates, score, routing, rules and certificate of every text (by words) and of code made from every id, each against its own index, in one plan."""
    texts = attributes(table(spark, d, "documents", "doc_id", "text")).withColumn("asset_id", F.col("doc_id"))
    code, works = _code_tables(spark, d)
    rows = texts.unionByName(attributes(code).withColumns({"asset_id": -1 - F.col("doc_id"), "track": F.lit("CODE")})).drop("doc_id")
    scorers = {"TEXT": evaluation.TOKENS, "CODE": evaluation.SCORERS["CODE"]}
    return evaluation.evaluate(rows, {"TEXT": table(spark, d, "benchmark"), "CODE": works}, scorers=scorers).drop("tier", "jurisdiction")


_SUMMARY = "count(*) AS total_assets, count_if(status = 'PASSED') AS passed_count, count_if(status = 'BLOCKED') AS blocked_count, count_if(status IN ('HUMAN_REVIEW', 'REVIEW')) AS review_count, count_if(status = 'ERROR') AS error_count, 100.0::DOUBLE * count_if(status = 'BLOCKED') / count(*) AS block_rate"


@query(f"WITH {_ROUTED} SELECT {_SUMMARY} FROM routed")
def scan_summary(spark, d):
    return decision.summary(routed(spark, d))


@query(f"WITH {_ROUTED} SELECT doc_id // 100 AS batch, {_SUMMARY} FROM routed GROUP BY 1")
def batch_summary(spark, d):
    return decision.summary(routed(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 100)), by=["batch"])


@query(f"WITH {_ROUTED} SELECT tier, count(*) AS assets, round(avg(CASE WHEN status = 'PASSED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS clean_rate FROM routed GROUP BY 1")
def trust_tier_clean_rate(spark, d):
    return routed(spark, d).groupBy("tier").agg(F.count("*").alias("assets"), F.round(F.avg(F.when(F.col("status") == "PASSED", 1.0).otherwise(0.0)), 6).alias("clean_rate"))


_HINT = "CASE WHEN contains(text, 'GNU General Public License') OR contains(text, 'GPL') THEN 'GPL-3.0' WHEN contains(text, 'AGPL') OR contains(text, 'Affero') THEN 'AGPL-3.0' WHEN contains(text, 'MIT') OR contains(text, 'Apache') THEN 'Permissive' ELSE 'Proprietary' END"


@query(f"WITH {_ROUTED}, l AS (SELECT doc_id, {_HINT} AS license FROM documents) SELECT status, license, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM routed JOIN l USING (doc_id) GROUP BY 1, 2")
def dataset_card_stats(spark, d):
    lic = table(spark, d, "documents").select("doc_id", tx.license_class(F.col("text")).alias("license_hint"))
    return governance.card_stats(routed(spark, d).join(lic, "doc_id")).withColumn("pct", F.round("pct", 6))


THRESHOLDS = [0.30, 0.45, 0.60, 0.75, 0.80, 0.85, 0.90, 0.95]
_VALUES = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)


@query(f"""WITH {_SCORES}, l AS (SELECT toxic AS label, score FROM labels JOIN best USING (doc_id)), t(threshold) AS (VALUES {_VALUES})
SELECT threshold, coalesce(count_if(label = 1 AND score >= threshold) / nullif(count_if(label = 1), 0), 0.0::DOUBLE) AS catch_rate, coalesce(count_if(label = 0 AND score >= threshold) / nullif(count_if(label = 0), 0), 0.0::DOUBLE) AS false_positive_rate FROM l, t GROUP BY 1""")
def calibration_sweep(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return decision.calibration(best_token_match(spark, d).join(labels, "doc_id"), THRESHOLDS)


# ---- sources, projections
@query("SELECT doc_id, 'sha256:' || sha256(text) AS asset_hash, octet_length(encode(text)) AS size_bytes FROM documents")
def asset_manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", fp.sha256_prefixed(F.col("text").cast("binary")).alias("asset_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


@query()
def asset_sniff(spark, d):
    """Track and type by content of every text, from its first 4096 bytes (SQL can't cut UTF-8 at a byte)."""
    return _sniffed(table(spark, d, "documents"))


def _sniffed(rows: DataFrame) -> DataFrame:
    kind = assets.sniff(F.col("text").cast("binary"), F.lit("x.public_domain"))
    return rows.select("doc_id", kind.alias("k")).select("doc_id", "k.track", "k.mime")


@query(f"SELECT item_id, length(text) AS char_count, len({_WS.format('text')}) AS word_count FROM benchmark")
def index_metadata(spark, d):
    return assets.index_metadata(table(spark, d, "benchmark"))


@query(f"""WITH t AS (SELECT doc_id, text, {_WS.format('text')} AS w FROM documents), n AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 50) / 206.0) AS INTEGER) END AS c FROM t WHERE len(w) > 0),
x AS (SELECT *, unnest(range(c)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, CAST(i * 206 AS INTEGER) AS start_token, CAST(least(i * 206 + 256, n) AS INTEGER) AS end_token, md5(CASE WHEN n <= 256 THEN text ELSE array_to_string(w[i * 206 + 1 : i * 206 + 256], ' ') END) AS chunk_md5 FROM x""")
def chunk_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.inline(tx.chunks(F.col("text"))))
    return rows.select("doc_id", "chunk_idx", "start_token", "end_token", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(f"SELECT doc_id, {_HINT} AS license FROM documents")
def license_class(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.license_class(F.col("text")).alias("license"))


_DOMAIN = "CASE WHEN contains(url, '://') THEN CASE WHEN regexp_extract(url, '://([^/?#]*)', 1) = '' THEN 'unknown' ELSE regexp_extract(url, '://([^/?#]*)', 1) END ELSE 'local-filesystem' END"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def page_domain_counts(spark, d):
    return table(spark, d, "pages", "url").groupBy(tx.source_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


_MARKED = "SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN '<meta name=\"tdm-reservation\" content=\"1\">' WHEN page_id % 7 = 1 THEN '<meta name=\"license\" content=\"CC-BY-4.0\">' WHEN page_id % 7 = 2 THEN '<a href=\"https://creativecommons.org/x\">' ELSE '' END || html AS html, CASE WHEN page_id % 5 = 0 THEN 'MIT' END AS license_header, CASE WHEN page_id % 11 = 0 THEN ' true ' WHEN page_id % 11 = 1 THEN 'TRUE' END AS tdm_header, CASE WHEN page_id % 13 = 0 THEN 'User-agent: *\nDisallow: /x' END AS ai_txt FROM pages"


def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with markup, headers and ai.txt that the table lacks, by page_id."""
    mark = F.lit("")
    for i, m in ((0, '<meta name="tdm-reservation" content="1">'), (1, '<meta name="license" content="CC-BY-4.0">'), (2, '<a href="https://creativecommons.org/x">')):
        mark = F.when(F.col("page_id") % 7 == i, m).otherwise(mark)
    when = lambda n, i, v: F.when(F.col("page_id") % n == i, v)
    return table(spark, d, "pages").withColumns({
        "html": F.concat(mark, "html"), "license_header": when(5, 0, "MIT"), "tdm_header": when(11, 0, " true ").when(F.col("page_id") % 11 == 1, "TRUE"), "ai_txt": when(13, 0, "User-agent: *\nDisallow: /x"),
    })


_PAGE_TDM = r"regexp_matches(html[1:4097], '(?i)<meta[^>]+name=[\"'']tdm-reservation[\"''][^>]+content=[\"''](1|true)[\"'']')"
_PAGE_LIC = r"regexp_extract(html, '(?i)<meta[^>]+name=[\"'']license[\"''][^>]+content=[\"'']([^\"'']+)[\"'']', 1)"


@query(f"""WITH p AS ({_MARKED}), r AS (SELECT *, CASE WHEN coalesce(contains(ai_txt, 'Disallow: /'), false) THEN 'ai.txt' WHEN coalesce(trim(tdm_header) IN ('1', 'true', 'yes'), false) THEN 'tdm-reservation header' WHEN {_PAGE_TDM} THEN 'tdm-reservation meta' END AS skip_reason FROM p)
SELECT page_id, skip_reason IS NULL AS allowed, skip_reason IS NOT NULL AS tdm_opted_out, CASE WHEN {_PAGE_LIC} <> '' THEN {_PAGE_LIC} WHEN contains(html, 'creativecommons.org') THEN 'Creative Commons' ELSE license_header END AS license_hint, skip_reason FROM r""")
def page_prefilter(spark, d):
    rows = web.prefilter(marked_pages(spark, d).withColumn("robots_ok", F.lit(True)))
    return rows.select("page_id", "allowed", "tdm_opted_out", "license_hint", "skip_reason")


#: What origins say to robots, by a sum over the origin's characters; None: no file.
ROBOTS = ["User-agent: *\nDisallow: /", None, "User-agent: *\nDisallow: /*/\nAllow: /\n\nUser-agent: otherbot\nDisallow: /", "User-agent: clearloom-bot\nDisallow: /p\n\nUser-agent: *\nDisallow: /", "", "# open\nUser-agent: *\nCrawl-delay: 5\nAllow: /"]


def robots_kind(origin: str) -> int:
    return sum(map(ord, origin)) % len(ROBOTS)


@query()
def robots_filter(spark, d):
    """robots.txt by origin: files that forbid all, a path, other robots or nothing, and origins without one."""
    urls = table(spark, d, "pages", "page_id", "url")
    origins = urls.select(F.regexp_extract("url", r"^([^:]+://[^/]*)", 1).alias("origin")).distinct()
    total = F.aggregate(F.transform(F.split("origin", ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c))), F.lit(0), lambda a, x: a + x)
    robots = origins.withColumn("robots_txt", F.element_at(F.array(*(F.lit(t) for t in ROBOTS)), F.pmod(total, F.lit(len(ROBOTS))) + 1))
    return web.robots_allowed(urls, robots)


@query("SELECT page_id, sha256(html)[1:12] || '_' || CASE WHEN regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]+)/?$', 1) = '' THEN 'asset' ELSE regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]+)/?$', 1) END AS staged_name FROM pages")
def staged_assets(spark, d):
    return table(spark, d, "pages").select("page_id", assets.staged_name(F.col("url"), F.sha2(F.col("html").cast("binary"), 256)).alias("staged_name"))


_LIST = lambda xs: " OR ".join(f"contains(lower(text), '{x}')" for x in xs)
_CONTENT = "CASE " + " ".join(f"WHEN starts_with(lower(text), '{p}') THEN trim(text[{len(p) + 1}:])" for p in config.SCAN_PREFIXES) + " ELSE text END"
_CHATCODE = " OR ".join(f"contains({_CONTENT}, '{w}')" for w in config.CHAT_CODE_WORDS)


@query(f"SELECT conv_id, turn, ({_LIST(config.SCAN_WORDS)} OR length(text) > 60) AS wants_scan, md5({_CONTENT}) AS content_md5, ({_CHATCODE} OR contains(lower(text), 'codebase')) AS is_code FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Scan this: ' || text ELSE text END AS text FROM conversations)")
def chat_scan_intent(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Scan this: "), "text")).otherwise(F.col("text")))
    t = F.col("text")
    return rows.select("conv_id", "turn", tx.scan_intent(t).alias("wants_scan"), F.md5(tx.scan_content(t).cast("binary")).alias("content_md5"), tx.chat_is_code(t).alias("is_code"))


# ---- recall and two-stage text matching
_RECALL = f"""dd AS (SELECT doc_id, unnest(list_distinct({_WS.format('lower(text)')})) AS tok FROM documents), ww AS (SELECT item_id, list_distinct({_WS.format('lower(text)')}) AS w FROM benchmark), wx AS (SELECT item_id, len(w) AS n, unnest(w) AS tok FROM ww),
rc AS (SELECT doc_id, item_id, count(*) / greatest(any_value(n), 1) AS containment FROM dd JOIN wx USING (tok) GROUP BY ALL)"""


@query(f"WITH {_RECALL} SELECT doc_id, item_id, round(containment, 6) AS containment FROM rc WHERE containment > 0.15::DOUBLE")
def recall_containment(spark, d):
    rows = simjoin.recall(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"))
    return rows.filter(F.col("containment") > 0.15).withColumn("containment", F.round("containment", 6))


@query(f"WITH {_RECALL} SELECT doc_id, item_id, rank, round(containment, 6) AS containment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, item_id) AS rank FROM rc WHERE containment > 0.15::DOUBLE) WHERE rank <= 5")
def recall_topk5(spark, d):
    rows = simjoin.recall(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark")).filter(F.col("containment") > 0.15)
    return simjoin.top_k(rows, "doc_id", "containment", "item_id", 5).select("doc_id", "item_id", "rank", F.round("containment", 6).alias("containment"))


@query(f"WITH {_RECALL}, m AS (SELECT doc_id, max(containment) AS b FROM rc GROUP BY 1) SELECT doc_id, round(coalesce(b, 0), 6) AS best_recall, coalesce(b, 0) >= 0.5::DOUBLE AS goes_on FROM documents LEFT JOIN m USING (doc_id)")
def early_exit_gate(spark, d):
    best = simjoin.recall(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark")).groupBy("doc_id").agg(F.max("containment").alias("b"))
    b = F.coalesce("b", F.lit(0.0))
    return table(spark, d, "documents", "doc_id").join(best, "doc_id", "left").select("doc_id", F.round(b, 6).alias("best_recall"), (b >= 0.5).alias("goes_on"))


@query(f"""WITH {_RECALL}, m AS (SELECT doc_id, max(containment) AS b FROM rc GROUP BY 1), g AS (SELECT doc_id FROM m WHERE b >= 0.5::DOUBLE),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, item_id) AS rank FROM rc JOIN g USING (doc_id) WHERE containment > 0.15::DOUBLE) WHERE rank <= 5),
t AS (SELECT doc_id, text, {_WS.format('text')} AS w FROM documents JOIN g USING (doc_id)), n AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 50) / 206.0) AS INTEGER) END AS c FROM t),
x AS (SELECT *, unnest(range(c)) AS i FROM n), ch AS (SELECT doc_id, i, list_distinct(list_transform(CASE WHEN n <= 256 THEN w ELSE w[i * 206 + 1 : i * 206 + 256] END, lambda z: lower(z))) AS cw FROM x),
j AS (SELECT doc_id, i, rank, item_id, len(list_intersect(cw, ww.w)) / greatest(len(cw) + len(ww.w) - len(list_intersect(cw, ww.w)), 1) AS jac FROM ch JOIN tops USING (doc_id) JOIN ww USING (item_id)),
f AS (SELECT doc_id, item_id AS matched, jac FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jac DESC, i, rank) AS r FROM j) WHERE r = 1)
SELECT doc_id, matched, round(coalesce(jac, 0.0::DOUBLE), 6) AS score, CASE WHEN coalesce(jac, 0) >= 0.85::DOUBLE THEN 'BLOCKED' WHEN coalesce(jac, 0) >= 0.70::DOUBLE THEN 'REVIEW' ELSE 'PASSED' END AS verdict FROM documents LEFT JOIN f USING (doc_id)""")
def two_stage_verdict(spark, d):
    rows = simjoin.two_stage(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"))
    return rows.select("doc_id", "matched", F.round("score", 6).alias("score"), decision.verdict(decision.clamp(F.col("score"))).alias("verdict"))


# ---- fingerprints and dedup
_SIM = """sw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}')) AS w FROM documents), sc AS (SELECT doc_id, w, count(*) AS c FROM sw GROUP BY ALL),
sh AS (SELECT doc_id, c, ('0x' || md5(w)[17:24])::BIGINT AS hi, ('0x' || md5(w)[25:32])::BIGINT AS lo FROM sc),
sb AS (SELECT doc_id, unnest(range(64)) AS b, c, hi, lo FROM sh),
ss AS (SELECT doc_id, b, sum(CASE WHEN (CASE WHEN b < 32 THEN lo >> b ELSE hi >> (b - 32) END) & 1 = 1 THEN c ELSE -c END) AS v FROM sb GROUP BY ALL),
sx AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CASE WHEN b < 63 THEN (1::HUGEINT << CAST(b AS INTEGER)) ELSE -(1::HUGEINT << 63) END ELSE 0 END)::BIGINT AS h FROM ss GROUP BY 1),
sim AS (SELECT documents.doc_id, coalesce(h, 0) AS simhash FROM documents LEFT JOIN sx USING (doc_id))"""


@query(f"WITH {_SIM} SELECT doc_id, simhash FROM sim")
def simhash_fingerprint(spark, d):
    return fp.simhash(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(f"WITH {_SIM} , k AS (SELECT simhash, min(doc_id) AS first FROM sim WHERE simhash <> 0 GROUP BY 1) SELECT x.first AS a, y.first AS b, bit_count(xor(x.simhash, y.simhash))::INTEGER AS dist FROM k x JOIN k y ON x.first < y.first AND bit_count(xor(x.simhash, y.simhash)) <= 3")
def near_duplicate_pairs(spark, d):
    """Pairs of classes of equal SimHashes, by their first documents; simhash_classes has the members."""
    return simjoin.near_pairs(fp.simhash(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id", "simhash").select("a", "b", F.col("dist").cast("int").alias("dist"))


@query(f"WITH {_SIM} SELECT min(doc_id) OVER (PARTITION BY simhash) AS first, doc_id, count(*) OVER (PARTITION BY simhash) AS copies FROM sim WHERE simhash <> 0")
def simhash_classes(spark, d):
    h = fp.simhash(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return h.filter("simhash <> 0").join(simjoin.hash_classes(h, "doc_id", "simhash"), F.col("simhash") == F.col("h")).select("first", "doc_id", "copies")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter(F.col("copies") > 1)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS leader, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def first_seen(spark, d):
    return dedup.first_seen(table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), "doc_id", "h")


def _checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp())


@query()
def dedup_leaders(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    _checkpoints(spark)
    rows = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).join(fp.simhash(docs, "doc_id", "text"), "doc_id").checkpoint()  # read several times
    return dedup.elect_leaders(rows, "doc_id", "h", "simhash")


@query(f"WITH {_ROUTED}, hh AS (SELECT doc_id, sha256(text) AS hash FROM documents), st AS (SELECT hash, min(doc_id) AS first_id FROM hh WHERE doc_id % 2 = 0 GROUP BY 1), pp AS (SELECT st.hash, status, matched, true AS known FROM st JOIN routed ON first_id = doc_id WHERE status IN ('PASSED', 'BLOCKED')) SELECT doc_id AS asset_id, known IS NOT NULL AS is_duplicate, status, CASE WHEN status = 'BLOCKED' THEN matched END AS matched_source FROM hh LEFT JOIN pp USING (hash) WHERE doc_id % 2 = 1")
def dedup_fast_path(spark, d):
    """Odd assets against the state that even ones left."""
    h = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.sha2(F.col("text").cast("binary"), 256).alias("asset_hash"))
    done = routed(spark, d).select(F.col("doc_id").alias("asset_id"), "status", "track", F.col("matched").alias("matched_source"))
    state = h.filter("asset_id % 2 = 0").groupBy("asset_hash").agg(F.min("asset_id").alias("asset_id")).join(done, "asset_id")
    return dedup.fast_path(h.filter("asset_id % 2 = 1"), dedup.recorded(state)).select("asset_id", "is_duplicate", "status", "matched_source")


_SIG = "(SELECT {k}, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}') AS w FROM {t})"
_SIGL = "list_sort(list_distinct(list_transform(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, least(len(w) - 2, 64) + 1), lambda i: array_to_string(w[i : i + 2], ' ')) END, lambda s: sha256(s || 'cross-org-v1')[1:16])))"


@query(f"SELECT doc_id, array_to_string({_SIGL}, ',') AS signature, len({_SIGL}) AS fingerprint_count FROM {_SIG.format(k='doc_id', t='documents')}")
def privacy_signature(spark, d):
    s = fp.privacy_signature(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.array_join("s", ",").alias("signature"), F.size("s").alias("fingerprint_count"))


@query(f"""WITH q AS (SELECT doc_id AS query_id, {_SIGL} AS sig FROM {_SIG.format(k='doc_id', t='documents')}), e AS (SELECT query_id, len(sig) AS n, unnest(sig) AS x FROM q), w AS (SELECT * FROM e),
j AS (SELECT e.query_id, w.query_id AS work_id, count(*) / (any_value(e.n) + any_value(w.n) - count(*)) AS jaccard FROM e JOIN w USING (x) GROUP BY ALL HAVING count(*) / (any_value(e.n) + any_value(w.n) - count(*)) >= 0.6::DOUBLE)
SELECT query_id, work_id, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, work_id) AS r FROM j) WHERE r = 1""")
def cross_org_match(spark, d):
    """Signals of all documents, as one organisation exports them, against all texts."""
    return _signal_matches(spark, d)


def _signal_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("title", F.col("doc_id").cast("string"))
    signals = governance.export_signals(docs, "org-alpha", "doc_id")
    found = governance.match_signals(docs.select(F.col("doc_id").alias("query_id"), fp.privacy_signature(F.col("text")).alias("sig")), signals)
    return found.withColumn("jaccard", F.round("jaccard", 6))


# ---- governance
_NG = "list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i : i + 6], ' '))"


@query(f"""WITH p AS (SELECT DISTINCT unnest({_NG}) AS g FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark) WHERE len(w) >= 7),
o AS (SELECT doc_id, unnest({_NG}) AS g, unnest(range(len(w) - 6)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents) WHERE len(w) >= 7)
SELECT doc_id, min(pos)::INTEGER AS pos, arg_min(g, pos) AS snippet FROM o SEMI JOIN p USING (g) GROUP BY 1""")
def leakage_hits(spark, d):
    return simjoin.ngram_hits(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"), "doc_id")


@query()
def leakage_redact(spark, d):
    return governance.leakage_gate(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"), "doc_id")


@query(f"""WITH p AS (SELECT DISTINCT unnest({_NG}) AS g FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark) WHERE len(w) >= 7),
o AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_NG}) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents) WHERE len(w) >= 7) SEMI JOIN p USING (g))
SELECT 'model-1' AS model_id, 'run-1' AS training_run_id, count(*) AS leakage_incidents_detected, true AS emission_suppressed, CASE WHEN count(*) > 0 THEN 'LEAKAGE_DETECTED' ELSE 'CLEARED' END AS status FROM o""")
def model_clearance_record(spark, d):
    hits = simjoin.ngram_hits(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"), "doc_id")
    return governance.clearance_record(hits.withColumn("leaked", F.lit(True)), "model-1", "run-1")


_REG = "m AS (SELECT doc_id AS asset_id, sha256(text) AS h FROM documents), reg AS (SELECT h, CASE WHEN min(asset_id) % 6 = 0 THEN 'BLOCKED' ELSE 'PASSED' END AS status FROM m WHERE asset_id % 4 <> 0 GROUP BY 1), g AS (SELECT asset_id, coalesce(status, 'UNAUDITED') AS status, coalesce(status, 'UNAUDITED') <> 'PASSED' AS offends FROM m LEFT JOIN reg USING (h))"


def gated(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.sha2(F.col("text").cast("binary"), 256).alias("asset_hash"))
    reg = m.filter("asset_id % 4 <> 0").groupBy("asset_hash").agg(F.when(F.min("asset_id") % 6 == 0, "BLOCKED").otherwise("PASSED").alias("status"))
    return governance.gate_rows(m, reg)


@query(f"WITH {_REG} SELECT count(*) AS total_assets, count_if(NOT offends) AS cleared_assets, count_if(offends) AS unresolved_assets, CASE WHEN count_if(offends) = 0 THEN 'PASS' ELSE 'FAIL' END AS gate_status FROM g")
def manifest_gate(spark, d):
    return governance.gate_result(gated(spark, d))


@query(f"WITH {_REG} SELECT asset_id, status FROM g WHERE offends")
def gate_offenders(spark, d):
    return gated(spark, d).filter("offends").select("asset_id", "status")


def _cleared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.lit("TEXT").alias("track"), F.col("text").alias("text_content"), (F.col("doc_id") % 5 + 1).alias("checked_index_version"))
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("notice_id"), F.lit("TEXT").alias("track"), F.col("text").alias("sample_content"), (F.col("item_id") % 6 + 1).alias("index_version"))
    return a, t


@query("SELECT notice_id, count(*) AS candidates FROM (SELECT doc_id FROM documents WHERE doc_id % 5 + 1 <= 2 AND length(text) > 0), (SELECT item_id AS notice_id FROM benchmark WHERE item_id % 6 + 1 > 2 AND item_id % 6 + 1 <= 4 AND length(text) > 0) GROUP BY 1")
def delta_candidates(spark, d):
    """How many cleared assets each later takedown asks for again: a count on either side of the track, not the pairs."""
    a, t = governance.delta_candidates(*_cleared(spark, d), 2, 4)
    n = a.groupBy("track").agg(F.count("*").alias("candidates"))
    return t.join(F.broadcast(n), "track").select("notice_id", "candidates")  # one row for each track


@query()
def delta_flagged(spark, d):
    """Cleared assets (all texts, and all protected works without their first tenth) against takedowns of works that came later."""
    cleared, takedowns = _cleared(spark, d)
    cut = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("asset_id"), F.lit("TEXT").alias("track"), F.substring("text", F.length("text") / 10 + F.lit(1), F.length("text")).alias("text_content"), F.lit(1).cast("long").alias("checked_index_version"))
    return governance.delta_flagged(cleared.unionByName(cut), takedowns, 2, 4)


@query("SELECT coalesce(max(item_id % 6 + 1), 1) AS index_version FROM benchmark")
def current_index_version(spark, d):
    return governance.index_version(_cleared(spark, d)[1])


@query("SELECT doc_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) SEMI JOIN (SELECT sha256(text) AS h FROM documents WHERE doc_id % 10 = 3 AND doc_id % 20 <> 3) USING (h)")
def fingerprint_registered(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint_hash"))
    return governance.registered(h, h.filter("doc_id % 10 = 3").withColumn("revoked", F.col("doc_id") % 20 == 3)).select("doc_id")


# ---- vectors, telemetry, queue, audit
@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS e FROM v),
s AS (SELECT q.vec_id AS query_id, n.vec_id, list_dot_product(q.e, n.e) AS score FROM n q, n WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 5) AS score FROM r WHERE rank <= 5""")
def vector_topk5(spark, d):
    """The five nearest of every 20th vector."""
    return _top5(spark, d, "vec_id % 20 = 0")


def _top5(spark: SparkSession, d: str, asked: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    rows = vector.top_k(v, v.filter(asked).withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding")
    return rows.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def telemetry_p95(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


@query("SELECT event_id, (user_id % 3) * 10 AS priority, row_number() OVER (ORDER BY (user_id % 3) * 10, event_id) AS position FROM events")
def queue_order(spark, d):
    """All items in the order of the queue; positions are worked out in each range of (priority, arrival) and moved by the ranges before it."""
    rows = _queued(table(spark, d, "events"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _checkpoints(spark)
    ranges = rows.repartitionByRange(parts, "priority", "seq").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = sorted(ranges.groupBy("part").count().collect())  # one row for each range
    before = spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, n) in enumerate(sizes)], "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("priority", "seq"))
    return ranges.withColumn("within", within).join(F.broadcast(before), "part").select("event_id", "priority", (F.col("before") + F.col("within")).alias("position"))


def _queued(events: DataFrame) -> DataFrame:
    return events.select("event_id", ((F.col("user_id") % 3) * 10).alias("priority"), F.col("event_id").alias("seq"))


@query("SELECT user_id AS item_id, count(*) AS retry_count, 10 + 5 * least(count(*), 3) AS priority, count(*) > 3 AS dead, 'Attempt 1: ' || arg_min(event_type, event_id) AS first_error FROM events GROUP BY 1")
def retry_dlq(spark, d):
    return _retries(table(spark, d, "events"))


def _retries(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("error"))
    return queue.retried(rows).select("item_id", "retry_count", "priority", "dead", F.element_at("error_log", 1).alias("first_error"))


@query("SELECT count_if(event_id % 4 = 0) AS queue_depth, count_if(event_id % 4 = 3) AS dlq_depth, count(*) AS total_enqueued, count_if(event_id % 4 IN (1, 2)) AS total_processed, count_if(event_id % 4 = 0) >= 1000 AS backpressure_active FROM events")
def queue_metrics(spark, d):
    return queue.metrics(table(spark, d, "events").withColumn("state", pick("event_id", 4, ["queued", "done", "done", "dead"])))


@query("SELECT strftime(ts, '%Y-%m') AS ym, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def audit_monthly(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("ym"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newest FROM events")
def audit_by_asset(spark, d):
    return _newest_first(table(spark, d, "events"))


def _newest_first(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events.select("user_id", "event_id", F.row_number().over(w).alias("newest"))


@query("SELECT user_id AS url, arg_max(event_id, event_id) AS seq, arg_max(value, event_id) AS etag FROM events GROUP BY 1")
def url_cache_latest(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), F.col("value").alias("etag"))
    return dedup.latest(rows, "url", "seq")


@query("SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 500 WHEN page_id % 9 = 1 THEN 404 WHEN page_id % 2 = 0 THEN 304 ELSE 200 END AS status_code, page_id % 9 > 1 AND page_id % 2 = 1 AS is_modified, CASE WHEN page_id % 9 = 0 THEN 'HTTP 500' WHEN page_id % 9 = 1 THEN 'HTTP 404' END AS error FROM pages")
def incremental_skip(spark, d):
    """Conditional fetches from recorded responses: even pages are unchanged, some fail."""
    p = table(spark, d, "pages", "page_id").withColumn("url", F.col("page_id").cast("string"))
    tag = F.md5(F.col("url").cast("binary"))
    responses = p.filter("page_id % 9 <> 0").select("url", tag.alias("etag"), F.when(F.col("page_id") % 9 == 1, 404).otherwise(200).alias("status_code"))
    rows = web.conditional_fetch(p.select("url"), p.filter("page_id % 2 = 0").select("url", tag.alias("etag")), responses)
    return rows.select(F.col("url").cast("long").alias("page_id"), "status_code", "is_modified", "error")


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 0")
def checkpoint_remaining(spark, d):
    """Targets that a job's checkpoint lacks. A checkpoint is kept in parts, each a JSON list."""
    p = table(spark, d, "pages").withColumn("url", F.concat("url", F.lit("#"), "page_id"))
    done = p.filter("page_id % 3 = 0").groupBy((F.col("page_id") % 8).alias("part")).agg(F.to_json(F.collect_list("url")).alias("crawled_urls"))
    rows = web.remaining(p.select("url", F.col("page_id").alias("pos")), done)
    return rows.select(F.col("pos").alias("page_id"), F.regexp_replace("url", r"#\d+$", "").alias("url"))


@query(f"WITH s AS (SELECT {_DOMAIN} AS source_id, min(page_id) AS m FROM pages GROUP BY 1) SELECT source_id, CASE WHEN m % 3 <> 0 THEN m END AS last_crawled_at, row_number() OVER (ORDER BY CASE WHEN m % 3 <> 0 THEN m END NULLS FIRST, source_id) AS position FROM s WHERE m % 5 <> 0")
def due_sources(spark, d):
    s = table(spark, d, "pages").groupBy(tx.source_domain(F.col("url")).alias("source_id")).agg(F.min("page_id").alias("m"))
    s = s.select("source_id", (F.col("m") % 5 != 0).alias("active"), F.when(F.col("m") % 3 != 0, F.col("m")).alias("last_crawled_at"))
    _checkpoints(spark)
    rows = numbering.numbered(s.filter("active"), "position", F.asc_nulls_first("last_crawled_at"), "source_id")
    return rows.select("source_id", "last_crawled_at", F.col("position").cast("int").alias("position"))


# ---- lineage and certificates
def _lineage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.col("page_id").alias("asset_id"), F.sha2(F.col("html").cast("binary"), 256).alias("asset_hash"), F.col("url").alias("source_uri"))
    return p.withColumn("certificate_id", F.when(F.col("asset_id") % 2 == 0, F.concat(F.lit("c"), "asset_id")))


_A, _X = "'urn:clearloom:asset:' || sha256(html)", "'urn:clearloom:activity:scan:' || page_id"
_AGENT = "'urn:clearloom:agent:engine:v0.1.0'"


@query(f"""WITH n AS (SELECT {_A} AS id, 'Entity' AS kind, {_DOMAIN} AS domain FROM pages UNION ALL SELECT {_X}, 'Activity', NULL FROM pages UNION ALL SELECT {_AGENT}, 'Agent', NULL FROM pages UNION ALL SELECT 'urn:clearloom:certificate:c' || page_id, 'Certificate', NULL FROM pages WHERE page_id % 2 = 0)
SELECT id, max(kind) AS kind, max(domain) AS domain FROM n GROUP BY 1""")
def lineage_nodes(spark, d):
    return provenance.graph_nodes(_lineage(spark, d)).select("id", "kind", "domain")


@query(f"SELECT DISTINCT {_A} AS src, 'wasGeneratedBy' AS rel, {_X} AS dst FROM pages UNION SELECT DISTINCT {_X}, 'wasAssociatedWith', {_AGENT} FROM pages")
def lineage_edges(spark, d):
    return provenance.graph_edges(_lineage(spark, d))


@query(f"SELECT {_DOMAIN} AS domain, count(DISTINCT sha256(html)) AS assets FROM pages GROUP BY 1")
def assets_by_domain(spark, d):
    nodes = provenance.graph_nodes(_lineage(spark, d))
    # A shared asset belongs to the greatest of its domains in the graph; here every page counts.
    rows = _lineage(spark, d).select(tx.source_domain(F.col("source_uri")).alias("domain"), F.concat(F.lit("urn:clearloom:asset:"), "asset_hash").alias("id")).distinct()
    return rows.join(nodes.filter("kind = 'Entity'").select("id"), "id").groupBy("domain").agg(F.count("*").alias("assets"))


@query("SELECT page_id AS asset_id FROM (SELECT page_id, sha256(html) AS h FROM pages) ANTI JOIN (SELECT sha256(html) AS h FROM pages WHERE page_id % 3 = 0) USING (h)")
def graph_catch_up(spark, d):
    rows = _lineage(spark, d)
    return provenance.catch_up(rows, provenance.graph_nodes(rows.filter("asset_id % 3 = 0"))).select("asset_id")


@query("SELECT page_id AS asset_id, CASE WHEN page_id % 7 = 0 THEN 'HASH_MISMATCH' WHEN page_id % 11 = 0 THEN 'SIGNATURE_INVALID' ELSE 'SIGNATURE_VALID' END AS reason FROM pages")
def certificate_verify(spark, d):
    """Signs certificates of all pages and verifies them; some come with another hash, some with a signature of something else."""
    return _verified(spark, _lineage(spark, d))


def _verified(spark: SparkSession, lineage: DataFrame) -> DataFrame:
    signer = provenance.Signer(spark)
    rows = lineage.withColumn("claimed", F.when(F.col("asset_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("asset_hash")))
    other = F.when(F.col("asset_id") % 11 == 0, F.concat(F.lit("x"), "asset_hash")).otherwise(F.col("asset_hash"))
    signed = signer.sign(rows.withColumn("signed_hash", other), "signed_hash")
    return provenance.verify_reason(signer.verify(signed, "asset_hash", "signature_b64"), "signature_valid", "claimed", "asset_hash").select("asset_id", "reason")


_SEALED_AT = "2026-01-01T00:00:00Z"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT page_id % 4 AS epoch, sha256('c' || page_id || ':' || sha256(html)) AS leaf FROM pages),
g AS (SELECT CAST(greatest(1, ceil(ln(max(c) / 256.0) / ln(16) - 1e-9)) AS INTEGER) AS digits FROM (SELECT count(*) AS c FROM e GROUP BY epoch)),
lv AS (SELECT epoch, leaf[1:digits] AS prefix, sha256(string_agg(leaf, ',' ORDER BY leaf)) AS hash, count(*)::BIGINT AS n FROM e, g GROUP BY 1, 2
UNION ALL SELECT epoch, prefix[1:len(prefix) - 1], sha256(string_agg(right(prefix, 1) || ':' || hash, ',' ORDER BY prefix)), sum(n)::BIGINT FROM lv WHERE len(prefix) > 0 GROUP BY 1, 2),
ch AS (SELECT 0::BIGINT AS index, ''::VARCHAR AS previous_hash, ''::VARCHAR AS merkle_root, 0::BIGINT AS n, '{ledger.block_hash(ledger.GENESIS)}'::VARCHAR AS block_hash
UNION ALL SELECT index + 1, ch.block_hash, lv.hash, lv.n, sha256('{{"index": ' || (index + 1) || ', "merkle_root": "' || lv.hash || '", "n": ' || lv.n || ', "previous_hash": "' || ch.block_hash || '", "timestamp": "{_SEALED_AT}"}}') FROM ch JOIN lv ON lv.prefix = '' AND lv.epoch = ch.index)
SELECT * FROM ch WHERE index > 0""")
def ledger_chain(spark, d):
    """The certificates of all pages, sealed in four sittings: the blocks over their roots."""
    _checkpoints(spark)
    return ledger.seal(_entries(spark, d), _SEALED_AT)[2].drop("timestamp", "block")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select((F.col("page_id") % 4).alias("epoch"), F.concat(F.lit("c"), "page_id").alias("certificate_id"), F.sha2(F.col("html").cast("binary"), 256).alias("asset_hash"))


@query("""SELECT 'c' || page_id AS certificate_id, page_id % 5 <> 0 AND page_id % 7 <> 0 AS verified, CASE WHEN page_id % 5 = 0 THEN 'Certificate not found on ledger' WHEN page_id % 7 = 0 THEN 'Asset hash does not match on-chain record' END AS reason,
CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 THEN page_id % 4 + 1 END AS block_index FROM pages""")
def certificate_on_ledger(spark, d):
    """Claims for all pages against the ledger: some were never sealed, some come with another hash."""
    _checkpoints(spark)
    every = _entries(spark, d)
    number = F.substring("certificate_id", 2, 20).cast("long")
    leaves, trie, blocks = ledger.seal(every.filter(number % 5 != 0), _SEALED_AT)
    claims = every.select("certificate_id", F.when(number % 7 == 0, F.lit("0" * 64)).otherwise(F.col("asset_hash")).alias("asset_hash"))
    return ledger.on_chain(claims, leaves, trie, blocks).drop("asset_hash")


@query("SELECT doc_id, left(h, 2) || '/' || h AS vault FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def evidence_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", sinks.vault_path(fp.sha256_prefixed(F.col("text").cast("binary"))).alias("vault"))


@query(f"WITH {_CODE_BEST} SELECT doc_id, item_id, code_score AS score, stage FROM cb")
def code_match(spark, d):
    """Code made from every id against indexed code, by structure and tokens: the best indexed one of each."""
    return simjoin.code_match(*_code_tables(spark, d), best=1).select("doc_id", "item_id", "score", "stage")


@query("""WITH f AS (SELECT doc_id, encode(text) AS b FROM documents), g AS (SELECT doc_id, b, unnest(range(least(16, CAST(ceil(octet_length(b) / 2048.0) AS INTEGER)))) AS i FROM f WHERE octet_length(b) > 0),
m AS (SELECT doc_id, i, md5(b[i * 2048 + 1 : i * 2048 + 2048]) AS h FROM g), p AS (SELECT doc_id, i, (((('0x' || h[1:8])::BIGINT % 100) * 96 * 96 * 96 + (('0x' || h[9:16])::BIGINT % 100) * 96 * 96 + (('0x' || h[17:24])::BIGINT % 100) * 96 + (('0x' || h[25:32])::BIGINT % 100)) % 100) AS v FROM m)
SELECT doc_id, string_agg(v::VARCHAR, '-' ORDER BY i) AS fingerprint FROM p GROUP BY 1""")
def acoustic_fingerprints(spark, d):
    """The byte-frame fingerprint of the audio track, over the bytes of texts."""
    return table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", fp.acoustic_fingerprint(F.col("text").cast("binary")).alias("fingerprint"))


@query()
def audio_match(spark, d):
    """The bytes of texts as audio, by their fingerprints, against those of protected works."""
    docs, works = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), table(spark, d, "benchmark").select("item_id", F.col("text").cast("binary").alias("content"))
    return simjoin.audio_match(docs.filter(F.length("content") > 0), works.filter(F.length("content") > 0))


@query("SELECT x.vec_id AS asset_id, y.vec_id AS item_id, bit_count(xor(x.h, y.h))::INTEGER AS dist FROM (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << CAST(i - 1 AS INTEGER) ELSE 0::BIGINT END))::BIGINT AS h FROM embeddings) x JOIN (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << CAST(i - 1 AS INTEGER) ELSE 0::BIGINT END))::BIGINT AS h FROM embeddings) y ON bit_count(xor(x.h, y.h)) < 8")
def phash_match(spark, d):
    """64-bit hashes (here signs of vector components) against an index, fewer than 8 bits apart."""
    v = _signs(spark, d)
    return _near_hashes(v, v)


def _signs(spark: SparkSession, d: str) -> DataFrame:
    h = F.lit(0).cast("long")
    for i in range(63):
        h = h.bitwiseOR(F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return table(spark, d, "embeddings").select("vec_id", h.alias("h"))


def _near_hashes(v: DataFrame, index: DataFrame) -> DataFrame:
    index = index.select(F.col("vec_id").alias("item_id"), F.col("h").alias("i_hash"))
    return simjoin.hamming_join(v.select(F.col("vec_id").alias("asset_id"), F.col("h").alias("a_hash")), index, "asset_id", "item_id", "a_hash", "i_hash", config.DEFAULT.phash_distance - 1).withColumn("dist", F.col("dist").cast("int"))


@query(f"SELECT count(*) AS assets, count_if(again) AS skipped, round(100.0::DOUBLE * count_if(again) / count(*), 6) AS skipped_pct, round({config.DEFAULT.hours_per_skip}::DOUBLE * count_if(again), 6) AS hours_saved FROM (SELECT doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS again FROM documents)")
def dedup_savings(spark, d):
    """Assets whose content was seen before, and the compute hours that not scoring them again saves."""
    h = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return decision.savings(dedup.first_seen(h, "doc_id", "h"))


# ---- intake, dispatch by MIME type, cards
_MIMES = ["text/plain", "application/pdf", "image/png", "video/mp4", "text/plain"]
_MIME = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MIMES)) + " END"


def _image_hash(number: Column) -> Column:
    return F.conv(F.substring(F.md5(number.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


@query(f"""WITH t AS (SELECT * FROM ({ORACLES["two_stage_verdict"]})), a AS (SELECT doc_id, {_MIME} AS mime, ('0x' || md5((doc_id % 100)::VARCHAR)[1:15])::BIGINT AS h FROM documents),
i AS (SELECT item_id, ('0x' || md5(item_id::VARCHAR)[1:15])::BIGINT AS h FROM benchmark),
n AS (SELECT doc_id, item_id, 1 - dist / 64.0::DOUBLE AS s FROM (SELECT doc_id, item_id, dist, row_number() OVER (PARTITION BY doc_id ORDER BY dist, item_id) AS r FROM (SELECT doc_id, item_id, bit_count(xor(a.h, i.h)) AS dist FROM a JOIN i ON a.mime = 'image/png' AND bit_count(xor(a.h, i.h)) < 8)) WHERE r = 1)
SELECT a.doc_id AS asset_id, CASE WHEN mime = 'image/png' THEN 'IMAGE' ELSE 'TEXT' END AS track, CASE WHEN mime IN ('text/plain', 'application/pdf') THEN t.matched::VARCHAR WHEN round(n.s, 4) >= 0.9::DOUBLE THEN n.item_id::VARCHAR END AS matched,
CASE WHEN mime IN ('text/plain', 'application/pdf') THEN t.score WHEN mime = 'image/png' THEN coalesce(round(n.s, 4), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS score,
CASE WHEN mime IN ('text/plain', 'application/pdf') THEN t.verdict WHEN mime = 'image/png' AND round(n.s, 4) >= 0.9::DOUBLE THEN 'BLOCKED' WHEN mime = 'image/png' AND round(n.s, 4) >= 0.7::DOUBLE THEN 'REVIEW' ELSE 'PASSED' END AS verdict
FROM a JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)""")
def mime_dispatch(spark, d):
    """Every document by a MIME type: as text, as image (by a hash made from its id) or as neither."""
    rows = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("asset_id"), pick("doc_id", 5, _MIMES).alias("mime_type"), "text", _image_hash(F.col("doc_id") % 100).alias("phash"))
    works = table(spark, d, "benchmark")
    return decision.dispatch(rows, works, works.select("item_id", _image_hash(F.col("item_id")).alias("phash"))).withColumn("score", F.round("score", 6))


_REASON = "CASE WHEN doc_id % 17 = 0 THEN 'batch_id' WHEN doc_id % 11 = 0 THEN 'mime_type' WHEN doc_id % 19 = 0 THEN 'score' WHEN doc_id % 13 = 0 THEN 'asset_hash' END"


@query(f"SELECT batch_id, CASE WHEN n > 26 THEN 'batch_size' ELSE r END AS reason, count(*) AS assets FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN 'b' ELSE 'batch-' || doc_id // 25 + doc_id // 500 % 2 END AS batch_id, {_REASON} AS r FROM documents)) GROUP BY 1, 2")
def batch_quarantine(spark, d):
    """Documents in batches of up to 26: how many rows of each are accepted (no reason), and why others are not."""
    i = F.col("doc_id")
    name = F.when(i % 17 == 0, "b").otherwise(F.concat(F.lit("batch-"), (F.floor(i / 25) + F.floor(i / 500) % 2).cast("long").cast("string")))
    rows = table(spark, d, "documents").select(i.cast("string").alias("asset_id"), name.alias("batch_id"), F.when(i % 11 == 0, "text/html").otherwise("text/plain").alias("mime_type"), F.when(i % 19 == 0, 1.5).otherwise(0.5).alias("score"), F.when(i % 13 == 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise(fp.sha256_prefixed(F.coalesce("text", F.lit("")).cast("binary"))).alias("asset_hash"))
    accepted, bad = assets.batches(rows, (1, 26))
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("batch_id", "reason").agg(F.count("*").alias("assets"))


def _fetched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "pages").select("url", F.col("html").cast("binary").alias("content"), F.concat(F.lit('"'), "page_id", F.lit('"')).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("page_id").alias("fetched_at"), (F.col("page_id") % 4).alias("source_id"), web.license_hint(F.col("html"), F.lit(None).cast("string")).alias("license_hint"), web.page_reserves(F.col("html")).alias("tdm_opted_out"))
    return p, spark.range(3).select(F.col("id").alias("source_id"), pick("id", 3, ["licensed-partner", "public-web-unknown", "high-risk-domain"]).alias("trust_tier"))


@query(f"SELECT sha256(html)[1:12] || '_' || CASE WHEN regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]+)/?$', 1) = '' THEN 'asset' ELSE regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]+)/?$', 1) END AS asset_id, octet_length(encode(html)) AS size_bytes, 'sha256:' || sha256(html) AS asset_hash, url AS source_url, {_DOMAIN} AS domain, CASE page_id % 4 WHEN 0 THEN 'licensed-partner' WHEN 1 THEN 'public-web-unknown' WHEN 2 THEN 'high-risk-domain' END AS source_trust_tier, '\"' || page_id || '\"' AS etag, page_id AS crawl_timestamp FROM pages")
def staged_fetches(spark, d):
    """Assets made of all fetched pages, with what is known of their origin."""
    return assets.staged(*_fetched(spark, d))[0].select("asset_id", "size_bytes", "asset_hash", "source_url", "domain", "source_trust_tier", "etag", "crawl_timestamp")


@query("SELECT url, arg_max('\"' || page_id || '\"', page_id) AS etag, 'sha256:' || arg_max(sha256(html), page_id) AS sha256_hash, max(page_id) AS fetched_at FROM pages GROUP BY 1")
def fetch_cache(spark, d):
    """What the next conditional fetch of each URL asks with."""
    return assets.staged(*_fetched(spark, d))[1].select("url", "etag", "sha256_hash", "fetched_at")


@query(f"""WITH {_ROUTED}, issued AS (SELECT doc_id, status, CASE WHEN status = 'PASSED' THEN sha256(doc_id || '|' || sha256(text))[1:16] END AS cert FROM routed JOIN documents USING (doc_id))
SELECT count(*) AS total, count_if(status = 'PASSED') AS passed, round(100.0::DOUBLE * count_if(status = 'PASSED') / count(*), 6) AS passed_pct, count(cert) AS certificates, (SELECT string_agg(cert, ', ' ORDER BY doc_id) FROM (SELECT doc_id, cert FROM issued WHERE cert IS NOT NULL ORDER BY doc_id LIMIT 5)) AS first_certificates FROM issued""")
def dataset_card(spark, d):
    """What heads a dataset card: how much passed, how many certificates, and the first five."""
    h = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    rows = routed(spark, d).join(h, "doc_id").select(F.col("doc_id").alias("asset_id"), "status", F.when(F.col("status") == "PASSED", F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), "h"), 256), 1, 16)).alias("certificate_id"))
    return governance.card_summary(rows).withColumn("passed_pct", F.round("passed_pct", 6))
