"""Registered queries: rule-based deals and their streams."""

from __future__ import annotations

import re
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import deals, rule_index
from bazaarlens.plans.fixtures import VIEWS
from bazaarlens.plans.registry import Inputs, query
from bazaarlens.sources.rules import RuleConfig, parse_rule_config
from bazaarlens.streaming import jobs

RAM = parse_rule_config(
    {
        "name": "ram_ddr4",
        "exclude_words": ["sodimm", "server", "ddr3"],
        "required_groups": [["DDR4"], ["ram", "memoria", "ram"], ["32gb", "16 gb", "8gb"]],
        "distractor_words": ["scheda madre", "pc"],
        "budget": {"default": 143.0, "configurations": {"standard": 100.0, "32gb": 143.0}},
        "unit_budget_rules": [
            {"name": "32gb_per_stick", "match": ["32gb", "32 gb"], "max_price_per_unit": 143, "unit": "banco", "unit_aliases": ["banco", "moduli"]},
            {"name": "16gb_per_stick", "match": ["16gb", "16 gb"], "max_unit_price": "66", "unit": "banco"},
            {"name": "broken", "match": [], "max_price_per_unit": 1},
        ],
        "config_patterns": {"32gb": ["32gb", "32 gb"], "16gb": ["16gb", "16 gb"]},
        "reject_patterns": ["difettoso", "notebook"],
        "premium_brands": ["corsair", "kingston"],
        "positive_keywords": {"3200mhz": 5, "cl16": 4, "corsair": 3},
        "negative_keywords": ["scheda madre"],
    }
)
WIDGETS = parse_rule_config(
    {
        "name": "widgets",
        "required_words": ["widget", "bolt"],
        "distractor_words": ["red"],
        "context_check_enabled": False,
        "budget": 120,
        "premium_brands": ["brand#2"],
        "negative_keywords": ["cold"],
    }
)


def term_sql(t: str, term: str, kits: bool = True) -> str:
    word = term.lower().strip()
    compact = word.replace(" ", "")
    if m := re.fullmatch(r"(\d+)(gb|tb|mb|g|t|m)", compact):
        return f"regexp_matches({t}, '(^|[^0-9]){m[1]}\\s*{m[2]}($|[^a-z0-9])')"
    return f"(contains(replace({t}, ' ', ''), '{compact}') OR contains({t}, '{word}'))"


def any_sql(t: str, terms) -> str:
    return "(" + (" OR ".join(term_sql(t, x) for x in terms) or "false") + ")"


def quantity_sql(t: str, term: str, aliases) -> str:
    found = []
    for word in (term, *aliases):
        body = "\\s*".join(word.lower().split())
        for p in (
            f"(?:^|[^a-z0-9])([0-9]{{1,3}})\\s*[x×]\\s*{body}(?:$|[^a-z0-9])",
            f"(?:^|[^a-z0-9]){body}\\s*[x×]\\s*([0-9]{{1,3}})(?:$|[^a-z0-9])",
            f"(?:^|[^a-z0-9])([0-9]{{1,3}})\\s+{body}(?:$|[^a-z0-9])",
        ):
            found.append(f"nullif(TRY_CAST(regexp_extract({t}, '{p}', 1) AS INTEGER), 0)")
    return f"coalesce({', '.join(found)})"


def decide_sql(config: RuleConfig, source: str = "offers_v", judged: bool = False) -> str:
    """CTEs ending in dec_<name>: one decision per offer; judged: the source has verdicts and seen."""
    t, n = "full_text", config.name
    rules = [f"WHEN {any_sql(t, config.exclude_words)} THEN 'rules'"] if config.exclude_words else []
    rules += [f"WHEN NOT {any_sql(t, g)} THEN 'rules'" for g in config.required_groups]
    if config.required_words and not config.required_groups:
        rules.append(f"WHEN NOT {any_sql(t, config.required_words)} THEN 'rules'")
    if not config.context_check:
        rules.append(f"WHEN {any_sql(t, config.distractor_words)} THEN 'rules'")
    pattern = "".join(f" WHEN contains({t}, '{p}') THEN 'RIGETTATO'" for p in config.reject_patterns)
    for name, ps in config.config_patterns.items():
        pattern += "".join(f" WHEN contains({t}, '{p}') THEN '{name}'" for p in ps)
    pattern = f"CASE {pattern} ELSE 'standard' END" if pattern else "'standard'"
    units = []
    for i, r in enumerate(config.unit_rules):
        hits = [term_sql(t, x, False) for x in r.match]
        count = " + ".join(f"CAST({h} AS INTEGER)" for h in hits)
        qty = ", ".join(f"CASE WHEN {h} THEN {quantity_sql(t, x, r.unit_aliases)} END" for h, x in zip(hits, r.match, strict=True))
        q = f"list_max([{qty}])"
        units.append(
            f"CASE WHEN {' OR '.join(hits)} THEN {{'e': CAST({q} IS NOT NULL AS INTEGER), 'n': {count}, "
            f"'t': -(coalesce(CASE WHEN {q} IS NOT NULL THEN least({q}, 999) END, 1) * {r.max_price_per_unit}::DOUBLE), 'p': -{i}}} END"
        )
    unit = f"list_max([{', '.join(units)}]).t" if units else "NULL::DOUBLE"
    fallback = config.budget.get("standard", max(config.budget.values()))
    budget = "CASE " + " ".join(f"WHEN pattern = '{k}' THEN {v}::DOUBLE" for k, v in config.budget.items())
    budget += " " + " ".join(f"WHEN contains(pattern, '{k}') THEN {v}::DOUBLE" for k, v in config.budget.items()) + f" ELSE {fallback}::DOUBLE END"
    title = "lower(trim(title))"
    score = "70"
    if config.premium_brands:
        score += " + CASE WHEN " + " OR ".join(f"contains({title}, '{b}')" for b in config.premium_brands) + " THEN 5 ELSE 0 END"
    score += "".join(f" + CASE WHEN contains({title}, '{k}') THEN {b} ELSE 0 END" for k, b in config.positive_keywords.items())
    score += "".join(f" - CASE WHEN contains({title}, '{k}') THEN 20 ELSE 0 END" for k in config.negative_keywords)
    score += " + CASE WHEN budget <= 0 THEN 0 WHEN price / budget <= 0.5 THEN 10 WHEN price / budget <= 0.7 THEN 5 WHEN price / budget <= 0.9 THEN 2 WHEN price / budget >= 1.0 THEN -15 ELSE 0 END"
    choose = "pattern AS cfg, price AS asked"
    late = "false"
    first, last = "", ""
    if judged:
        choose = """CASE WHEN context_ok AND context_config <> 'standard' THEN context_config WHEN pattern = 'RIGETTATO' THEN 'standard' ELSE pattern END AS cfg,
  CASE WHEN context_ok AND context_price <> 0 THEN context_price ELSE price END AS asked"""
        first = "WHEN seen THEN 'seen'"
        late = "NOT context_ok"
        last = "WHEN image_url <> '' AND NOT image_ok THEN 'vision'"
    budget, score = budget.replace("pattern", "cfg"), score.replace("price / budget", "asked / budget")
    return f"""a_{n} AS (SELECT *, lower(trim(title || chr(10) || description)) AS full_text FROM {source}),
b_{n} AS (SELECT *, CASE {' '.join(rules)} ELSE 'ok' END AS rule_step, {pattern} AS pattern, -({unit}) AS unit_total FROM a_{n}),
e_{n} AS (SELECT *, {choose} FROM b_{n}),
c_{n} AS (SELECT *, coalesce(unit_total, {budget}) AS budget FROM e_{n}),
d_{n} AS (SELECT *, greatest(0, least(100, {score})) AS raw_score FROM c_{n}),
dec_{n} AS (SELECT *, CASE {first} WHEN rule_step = 'rules' THEN 'rules' WHEN {late} THEN 'context' WHEN pattern = 'RIGETTATO' THEN 'pattern' WHEN asked > budget THEN 'budget'
  WHEN raw_score < 40 THEN 'score' {last} ELSE 'accept' END AS step FROM d_{n})"""


DECISION_COLUMNS = ["listing_id", "rules", "status", "step", "score", "config", "budget", "price"]


def decision_select(config: RuleConfig) -> str:
    return f"""SELECT listing_id, '{config.name}' AS rules, CASE step WHEN 'accept' THEN 'ACCEPT' WHEN 'seen' THEN 'SKIP' ELSE 'REJECT' END AS status, step,
  CAST(CASE WHEN step IN ('score', 'vision', 'accept') THEN raw_score ELSE 0 END AS INTEGER) AS score,
  CASE WHEN step IN ('score', 'vision', 'accept', 'budget') THEN cfg ELSE 'standard' END AS config, budget, asked AS price FROM dec_{config.name}"""


@query(
    "rule_filter",
    ["offers_v"],
    f"WITH {decide_sql(RAM)} SELECT listing_id, rule_step = 'ok' AS accept FROM dec_ram_ddr4",
)
def rule_filter(v: Inputs) -> DataFrame:
    rows = deals.apply_rules(deals.rule_hits(deals.full_text(v("offers_v")), RAM), RAM)
    return rows.select("listing_id", F.col("rule_reject").isNull().alias("accept"))


@query(
    "reject_or_variant",
    ["offers_v"],
    f"WITH {decide_sql(RAM)} SELECT listing_id, pattern AS variant FROM dec_ram_ddr4",
)
def reject_or_variant(v: Inputs) -> DataFrame:
    rows = deals.full_text(v("offers_v"))
    return rows.select("listing_id", deals.reject_or_variant(F.col("_full"), RAM).alias("variant"))


@query(
    "effective_budget",
    ["offers_v"],
    f"WITH {decide_sql(RAM)} SELECT listing_id, budget FROM dec_ram_ddr4",
)
def effective_budget(v: Inputs) -> DataFrame:
    rows = deals.unit_budget(deals.rule_hits(deals.full_text(v("offers_v")), RAM), RAM)
    rows = rows.withColumn("variant", deals.reject_or_variant(F.col("_full"), RAM))
    named = deals.named_budget(F.col("variant"), RAM.budget)
    return rows.select("listing_id", F.coalesce("unit_total", named).alias("budget"))


@query(
    "deal_score",
    ["offers_v"],
    f"WITH {decide_sql(WIDGETS)} SELECT listing_id, CAST(raw_score AS INTEGER) AS score FROM dec_widgets",
)
def deal_score(v: Inputs) -> DataFrame:
    rows = deals.full_text(v("offers_v"))
    score = deals.deal_score(F.col("_title"), F.col("price"), F.lit(120.0), WIDGETS)
    return rows.select("listing_id", score.alias("score"))


@query(
    "decide_listings",
    ["offers_v"],
    f"WITH {decide_sql(RAM)}, {decide_sql(WIDGETS)} {decision_select(RAM)} UNION ALL {decision_select(WIDGETS)}",
)
def decide_listings(v: Inputs) -> DataFrame:
    return rule_index.decide_many(v("offers_v"), [RAM, WIDGETS]).select(*DECISION_COLUMNS)


JUDGED_SQL = """verdicts AS (SELECT DISTINCT listing_id, l_orderkey % 5 <> 0 AS context_ok, CASE WHEN l_orderkey % 7 = 0 THEN '16gb' END AS context_config,
  CASE WHEN l_orderkey % 11 = 0 THEN 50.0::DOUBLE END AS context_price, l_partkey % 9 <> 0 AS image_ok FROM offers_v WHERE l_orderkey % 3 <> 0),
seen_ids AS (SELECT DISTINCT listing_id, true AS was_seen FROM offers_v WHERE l_linenumber = 7),
judged AS (SELECT o.*, v.context_ok, v.context_config, v.context_price, v.image_ok, coalesce(s.was_seen, false) AS seen
  FROM offers_v o LEFT JOIN verdicts v USING (listing_id) LEFT JOIN seen_ids s USING (listing_id))"""


@query(
    "decide_with_verdicts",
    ["offers_v"],
    f"WITH {JUDGED_SQL}, {decide_sql(RAM, 'judged', True)}, {decide_sql(WIDGETS, 'judged', True).replace('NOT context_ok', 'false').replace('context_ok AND', 'false AND')} "
    f"{decision_select(RAM)} UNION ALL {decision_select(WIDGETS)}",
)
def decide_with_verdicts(v: Inputs) -> DataFrame:
    """Two rule sets at once; the second asks for no context."""
    offers = v("offers_v")
    verdicts = offers.where("l_orderkey % 3 <> 0").select(
        "listing_id",
        (F.col("l_orderkey") % 5 != 0).alias("context_ok"),
        F.when(F.col("l_orderkey") % 7 == 0, "16gb").alias("context_config"),
        F.when(F.col("l_orderkey") % 11 == 0, 50.0).alias("context_price"),
        (F.col("l_partkey") % 9 != 0).alias("image_ok"),
    ).dropDuplicates(["listing_id"])
    seen = offers.where("l_linenumber = 7").select("listing_id")
    return rule_index.decide_many(offers, [RAM, WIDGETS], verdicts, seen).select(*DECISION_COLUMNS)


@query(
    "decision_evidence",
    ["offers_v"],
    f"""WITH {decide_sql(RAM)} SELECT step, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'rules' AS step FROM dec_ram_ddr4 UNION ALL SELECT 'decision' FROM dec_ram_ddr4
UNION ALL SELECT 'pattern' FROM dec_ram_ddr4 WHERE step <> 'rules' UNION ALL SELECT 'budget' FROM dec_ram_ddr4 WHERE step NOT IN ('rules', 'pattern')
UNION ALL SELECT 'score' FROM dec_ram_ddr4 WHERE step IN ('score', 'accept')) GROUP BY step""",
)
def decision_evidence(v: Inputs) -> DataFrame:
    decisions = deals.decide_listings(v("offers_v"), RAM)
    items = decisions.select(F.explode("evidence").alias("e")).where("e.status NOT IN ('MATCH', 'DISTRACTOR')")
    return items.groupBy(F.col("e.step").alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_stats",
    ["offers_v"],
    f"""WITH {decide_sql(RAM)} SELECT 'ram_ddr4' AS rules, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (step = 'accept') AS BIGINT) AS notified,
  CAST(count(*) FILTER (step <> 'accept') AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS skipped FROM dec_ram_ddr4""",
)
def run_stats(v: Inputs) -> DataFrame:
    return deals.run_stats(deals.decide_listings(v("offers_v"), RAM))


@query(
    "alert_rows",
    ["offers_v"],
    f"""WITH {decide_sql(RAM)} SELECT 'ram_ddr4' AS rules, listing_id, platform, title, price, cfg AS config, budget, CAST(raw_score AS INTEGER) AS score, '' AS url
FROM dec_ram_ddr4 WHERE step = 'accept'""",
)
def alert_rows(v: Inputs) -> DataFrame:
    return deals.alert_rows(deals.decide_listings(v("offers_v"), RAM))


@query(
    "bounded_history",
    ["offers_v"],
    """SELECT platform, listing_id, price, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY seen_on DESC, listing_id DESC, price DESC) AS place FROM offers_v) WHERE place <= 200""",
)
def bounded_history(v: Inputs) -> DataFrame:
    return deals.newest_per_key(v("offers_v"), ["platform"], ["seen_on", "listing_id", "price"], 200).select(
        "platform", "listing_id", "price", "place"
    )


@query(
    "cap_per_keyword",
    ["offers_v"],
    """SELECT l_partkey, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY seen_on, listing_id) AS n FROM offers_v) WHERE n <= 10""",
)
def cap_per_keyword(v: Inputs) -> DataFrame:
    return deals.cap_per_key(v("offers_v"), ["l_partkey"], ["seen_on", "listing_id"], 10).select("l_partkey", "listing_id")


@query(
    "first_wins",
    ["offers_v"],
    """SELECT title, arg_min(listing_id, seen_on || '#' || listing_id) AS listing_id FROM offers_v GROUP BY title""",
)
def first_wins(v: Inputs) -> DataFrame:
    return deals.first_per_key(v("offers_v"), ["title"], ["seen_on", "listing_id"]).select("title", "listing_id")


# Streams ---------------------------------------------------------------------------------------


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; a temporary one only in local tests."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")


def _stream(v: Inputs, table: str) -> DataFrame:
    return jobs.read_new_files(v.spark, v.folder, v(table).schema, f"{table}.parquet")


@query("stream_seen_dedupe", [], "SELECT DISTINCT user_id, event_type FROM events")
def stream_seen_dedupe(v: Inputs) -> DataFrame:
    out = work_folder(v.spark)
    events = jobs.with_event_time(_stream(v, "events"), "ts")
    first = jobs.unseen(events, ["user_id", "event_type"], "event_time", "400 days")
    jobs.append_files(first.select("user_id", "event_type"), f"{out}/seen", f"{out}/checkpoint").awaitTermination()
    return v.spark.read.schema("user_id long, event_type string").parquet(f"{out}/seen")


@query(
    "stream_price_history",
    [],
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
FROM events WHERE event_type = 'purchase') WHERE place <= 5""",
)
def stream_price_history(v: Inputs) -> DataFrame:
    out = work_folder(v.spark)
    accepted = _stream(v, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    jobs.append_files(accepted, f"{out}/prices", f"{out}/checkpoint").awaitTermination()
    prices = v.spark.read.schema(accepted.schema).parquet(f"{out}/prices")
    return jobs.price_history(prices, ["user_id"], ["ts", "event_id"], 5).drop("ts")


def _offer_stream(v: Inputs) -> DataFrame:
    _, sql = VIEWS["offers_v"]
    return v.spark.sql(sql, lineitem=_stream(v, "lineitem"), parts_v=v("parts_v"))


@query(
    "decide_stream",
    ["offers_v"],
    f"WITH {decide_sql(RAM)} {decision_select(RAM)}",
)
def decide_stream(v: Inputs) -> DataFrame:
    out = work_folder(v.spark)
    jobs.decide_stream(_offer_stream(v), RAM, out, f"{out}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{out}/decisions").select(*DECISION_COLUMNS)


@query(
    "decide_stream_cycles",
    ["offers_v"],
    f"""WITH {decide_sql(RAM)}, decided AS ({decision_select(RAM)}),
turns AS (SELECT listing_id, row_number() OVER (ORDER BY l_partkey % 3, listing_id) - 1 AS n, CAST(ceil(count(*) OVER () / 5.0) AS BIGINT) AS cap FROM offers_v)
SELECT d.*, CAST(n // cap AS INTEGER) AS cycle FROM decided d JOIN turns USING (listing_id)""",
)
def decide_stream_cycles(v: Inputs) -> DataFrame:
    """Three runs over one checkpoint, each with new offers and all those of the run before again; a
    cycle decides a fifth of all offers, the oldest first, and what waits in the end is drained."""
    spark, out, offers = v.spark, work_folder(v.spark), v("offers_v")
    rules = replace(RAM, max_total_items=-(-offers.count() // 5))
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    # each run is one cycle, without another one for the state's sake
    spark.conf.set(setting, "false")
    try:
        for run in range(3):
            arrival = offers.where(F.expr(f"l_partkey % 3 IN ({run}, {run - 1})"))
            arrival.write.mode("append").parquet(f"{out}/offers")
            stream = jobs.first_sightings(jobs.read_new_files(spark, f"{out}/offers", offers.schema))
            jobs.decide_stream(stream, rules, out, f"{out}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    jobs.drain(spark, rules, out)
    decided = spark.read.parquet(f"{out}/decisions")
    return decided.select(*DECISION_COLUMNS, (F.col("batch") + F.col("turn")).cast("int").alias("cycle"))


@query(
    "stream_listing_upsert",
    [],
    """SELECT CAST(l_partkey AS VARCHAR) AS fingerprint, CAST(min(l_shipdate) AS VARCHAR)[1:10] AS first_seen, CAST(max(l_shipdate) AS VARCHAR)[1:10] AS last_seen,
  CAST(count(*) AS BIGINT) AS seen_count FROM lineitem GROUP BY l_partkey""",
)
def stream_listing_upsert(v: Inputs) -> DataFrame:
    out = work_folder(v.spark)
    rows = _stream(v, "lineitem").select(
        F.col("l_partkey").cast("string").alias("fingerprint"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sighting_id"),
        F.col("l_shipdate").cast("date").cast("string").alias("seen_at"),
        F.col("l_extendedprice").alias("price"),
        F.lit("EUR").alias("currency"),
        F.lit("").alias("query"),
        F.lit("run").alias("run_id"),
    )
    run = jobs.snapshot_stream(rows, out, f"{out}/checkpoint")
    run.awaitTermination()
    return jobs.latest_snapshot(v.spark, out, jobs.last_batch(run)).select(
        "fingerprint", "first_seen", "last_seen", "seen_count"
    )


@query(
    "stream_listing_batches",
    [],
    """WITH s AS (SELECT *, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '#' || concat_ws('-', l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT)) AS moment FROM lineitem)
SELECT CAST(l_partkey AS VARCHAR) AS fingerprint, CAST(min(l_shipdate) AS VARCHAR)[1:10] AS first_seen, CAST(max(l_shipdate) AS VARCHAR)[1:10] AS last_seen,
  CAST(count(*) AS BIGINT) AS seen_count, arg_max(l_extendedprice, moment) AS price, arg_min(CAST(l_suppkey AS VARCHAR), moment) AS seller FROM s GROUP BY l_partkey""",
)
def stream_listing_batches(v: Inputs) -> DataFrame:
    """Three runs over one checkpoint, sightings in any order of time; the last ones are of a tenth of the listings."""
    out, rows = work_folder(v.spark), v("lineitem")
    day = F.col("l_shipdate").cast("date").cast("string")
    rows = rows.select(
        F.col("l_partkey").cast("string").alias("fingerprint"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long")).alias("sighting_id"),
        day.alias("seen_at"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_suppkey").cast("string").alias("seller"),
        F.lit("EUR").alias("currency"),
        F.lit("").alias("query"),
        F.lit("run").alias("run_id"),
        F.when((F.col("l_partkey") % 10 == 0) & (F.month("l_shipdate") < 5), 2).otherwise(F.dayofmonth("l_shipdate") % 2).alias("part"),
    )
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{out}/sightings")
        stream = jobs.read_new_files(v.spark, f"{out}/sightings", rows.drop("part").schema)
        run = jobs.snapshot_stream(stream, out, f"{out}/checkpoint")
        run.awaitTermination()
    return jobs.latest_snapshot(v.spark, out, jobs.last_batch(run)).select(
        "fingerprint", "first_seen", "last_seen", "seen_count", "price", "seller"
    )
