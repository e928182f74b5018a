"""An analysis of all stores in one pass: tables in, every result as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions import periods as P
from ..functions.redaction import sanitize_text
from ..operators import anomaly, facts, health, insights, kpis, profitability, quality, rootcause, series
from ..schemas import StoreTables
from ..sources import scratch


def kept(build: Callable[[Analysis], DataFrame]) -> cached_property:
    """A result of at most a few rows per store and period, written once it is asked for.

    Read back it is a plain scan: what builds on it is planned without its
    whole history, and a lost executor costs no more than its own tasks.
    """

    def written(self: Analysis) -> DataFrame:
        out = build(self)
        path = scratch.new_path(out.sparkSession, build.__name__)
        out.write.parquet(path)
        return out.sparkSession.read.schema(out.schema).parquet(path)

    return cached_property(written)


class Analysis:
    """Each result is computed when it is first asked for, and shared by what needs it."""

    def __init__(self, tables: StoreTables, cfg: AnalyticsConfig = AnalyticsConfig(), measures: set[str] | None = None):
        """With ``measures`` only those of the facts are right, and only their tables are read for them."""
        self.tables, self.cfg, self.measures = tables, cfg, measures

    def prepare(self, *names: str) -> Analysis:
        """Start the named results at once: they read the tables independently, so their jobs fill the cluster together."""
        first = [n for n in ("facts", "periods") if n not in self.__dict__]
        for wave in (first, [n for n in names if n not in ("facts", "periods") and n not in self.__dict__]):
            with ThreadPoolExecutor(4) as pool:
                list(pool.map(lambda n: getattr(self, n), wave))
        return self

    @kept
    def facts(self) -> DataFrame:
        return facts.period_facts(self.tables, self.cfg.grain, self.measures)

    @kept
    def periods(self) -> DataFrame:
        return series.store_periods(facts.latest_day(self.tables), self.cfg)

    @cached_property
    def current(self) -> DataFrame:
        """Facts of each store's last complete period; a store without rows in it has zeros."""
        wide = self.periods.select("store_id", "period_start").join(self.facts, ["store_id", "period_start"], "left")
        return wide.fillna(0, [c for c in self.facts.columns[2:] if c not in facts.UNKNOWN])

    @cached_property
    def series(self) -> DataFrame:
        return series.series(self.facts, self.periods, self.cfg)

    @cached_property
    def comparisons(self) -> DataFrame:
        return series.comparisons(self.facts, self.periods, self.cfg)

    @kept
    def anomalies(self) -> DataFrame:
        return anomaly.detect(self.series, self.cfg)

    @kept
    def factors(self) -> DataFrame:
        return rootcause.factors(self.facts, self.periods, self.cfg)

    @kept
    def campaigns(self) -> DataFrame:
        return rootcause.campaign_contributors(self.tables, self.periods, self.cfg)

    @kept
    def contributors(self) -> DataFrame:
        return rootcause.product_contributors(self.tables, self.periods, self.facts, self.cfg)

    @kept
    def products(self) -> DataFrame:
        """Product performance of the current period."""
        lines = self.tables.order_lines.withColumn("period_start", P.period_start(F.col("created_at"), self.cfg.grain))
        lines = lines.join(self.periods.select("store_id", "period_start"), ["store_id", "period_start"], "left_semi")
        return facts.product_performance(replace(self.tables, order_lines=lines), ["period_start"])

    @kept
    def basis(self) -> DataFrame:
        return profitability.refund_basis(self.tables, self.cfg)

    @kept
    def profit(self) -> DataFrame:
        return profitability.profitability(self.current, self.basis, self.cfg)

    @kept
    def issues(self) -> DataFrame:
        """What reading the tables found, and what they say when they are held against each other."""
        negative = series.negative_periods(self.facts, self.periods, self.cfg)
        return self.tables.issues.unionByName(quality.consistency_issues(self.tables, self.cfg, negative))

    @cached_property
    def kpis(self) -> DataFrame:
        return kpis.kpis_wide(self.current)

    @kept
    def field_quality(self) -> DataFrame:
        return quality.field_quality(self.tables, self.cfg)

    @kept
    def dimensions(self) -> DataFrame:
        margins = health.product_margin(self.products, self.cfg)
        return health.dimensions(self.periods, self.comparisons, self.profit, self.kpis, margins, self.field_quality, self.cfg)

    @cached_property
    def score(self) -> DataFrame:
        return health.health_score(self.dimensions)

    @cached_property
    def declines(self) -> DataFrame:
        """The findings that recommendations are made from; they need no more than the series."""
        return insights.declines(self.anomalies, self.factors, rootcause.primary_factor(self.factors))

    @kept
    def findings(self) -> DataFrame:
        primary = rootcause.primary_factor(self.factors)
        found = insights.findings(self.anomalies, self.factors, primary, self.profit, self.products, self.kpis, self.campaigns, self.cfg)
        return insights.ranked(found)

    @kept
    def evidence(self) -> DataFrame:
        return insights.evidence(self.findings, self.anomalies)

    @cached_property
    def recommendations(self) -> DataFrame:
        return insights.recommendations(self.declines, self.campaigns)

    @cached_property
    def limitations(self) -> DataFrame:
        return insights.limitations(self.profit, self.factors, self.dimensions, self.issues, self.periods)

    def report(self) -> DataFrame:
        """X-26: one JSON document per store; X-30's summary columns beside it.

        Every section gives its items as (store, section, place, JSON) rows.
        They are gathered once, by store: a few hundred small rows each.
        """
        self.prepare("products", "contributors", "campaigns", "basis", "issues", "field_quality", "anomalies", "factors")
        grain = self.cfg.grain

        def items(df: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
            kinds = dict(df.dtypes)
            place = [F.lpad(F.col(c).cast("string"), 9, "0") if kinds[c] in ("int", "bigint") else F.col(c).cast("string") for c in order]
            return df.select("store_id", F.lit(name).alias("section"), F.concat_ws("|", *place).alias("place"), F.to_json(F.struct(*columns)).alias("body"))

        listed = {
            "series": items(self.series.withColumn("period", P.label(F.col("period_start"), grain)), "series", ["metric", "period_start"], ["metric", "period", "value"]),
            "comparisons": items(self.comparisons, "comparisons", ["metric", "kind"], ["metric", "kind", "available", "current", "reference", "delta", "pct"]),
            "anomalies": items(self.anomalies, "anomalies", ["metric"], ["metric", "direction", "severity", "assessment", "value", "mean", "pct", "z"]),
            "root_cause": items(self.factors, "root_cause", ["rank"], ["factor", "contribution", "confidence", "pct"]),
            "product_contributors": items(self.contributors, "product_contributors", ["rank"], ["sku", "delta", "contribution"]),
            "campaign_contributors": items(self.campaigns.filter("rank <= 5"), "campaign_contributors", ["rank"], ["campaign_id", "name", "delta_conversions", "delta_cvr"]),
            "health_dimensions": items(self.dimensions, "health_dimensions", ["dimension"], ["dimension", "score", "weight"]),
            "insights": items(insights.with_evidence(self.findings, self.evidence), "insights", ["rank"], ["item_id", "kind", "subject", "severity", "confidence", "statement", "impact", "evidence"]),
            "recommendations": items(self.recommendations, "recommendations", ["factor"], ["factor", "recommendation"]),
            "hypotheses": items(insights.hypotheses(self.factors), "hypotheses", ["statement"], ["statement", "supports"]),
            "top_customers": items(insights.top_customers(self.tables.orders), "top_customers", ["rank"], ["customer", "revenue", "orders"]),
            "data_quality": items(self.field_quality, "data_quality", ["field"], ["field", "coverage", "status"]),
            "issues": items(quality.issue_counts(self.issues), "issues", ["kind"], ["source", "kind", "severity", "message", "count"]),
        }
        head = self.periods.join(self.current.select("store_id", (F.col("orders") + F.col("ad_rows") > 0).alias("has_rows")), "store_id")
        head = head.withColumns({"period": P.label(F.col("period_start"), grain), "status": F.when(F.col("has_rows"), "ok").otherwise("insufficient_data")})
        summary = insights.executive_summary(self.kpis, self.score, self.findings)
        single = {
            "period": items(head, "period", [], ["status", "period", "period_start", "latest_day"]),
            "kpis": items(self.kpis, "kpis", [], self.kpis.columns[2:]),
            "profitability": items(self.profit, "profitability", [], [c for c in self.profit.columns if c not in ("store_id", "period_start")]),
            "health": items(self.score, "health", [], ["health_score", "interpretation"]),
            "limitations": items(self.limitations, "limitations", [], ["limitations"]),
            "summary": items(summary, "summary", [], ["summary"]),
        }
        rows = reduce(DataFrame.unionByName, [*single.values(), *listed.values()])
        by = rows.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("section", "place", "body"))).alias("rows"))
        of = lambda name: F.transform(F.filter("rows", lambda r: r["section"] == name), lambda r: r["body"])
        parts = [F.concat(F.lit(f'"{n}":'), F.coalesce(F.get(of(n), F.lit(0)), F.lit("null"))) for n in single]
        parts += [F.concat(F.lit(f'"{n}":['), F.array_join(of(n), ","), F.lit("]")) for n in listed]
        document = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        first = lambda section, field: F.get_json_object(F.get(of(section), F.lit(0)), f"$.{field}")
        return by.select(
            "store_id", first("period", "status").alias("status"), first("health", "health_score").cast("long").alias("health_score"), first("period", "period").alias("period"), document.alias("report")
        )


#: Most items of each list of an evidence pack, in order of priority; the most characters of an item, and the most bytes of a pack.
PACK_LIMITS = {"unavailable": 20, "facts": 25, "findings": 15, "recommendations": 10, "evidence": 30, "hypotheses": 10, "limitations": 15, "contributors": 5}
PACK_CHARS, PACK_BYTES = 400, 64_000
#: Bytes of a pack without items: names, brackets and commas.
_FRAME = len("{}") + sum(len(f'"{n}":[],') for n in PACK_LIMITS)


def packed(items: DataFrame, budget: int = PACK_BYTES) -> DataFrame:
    """X-27: from (store_id, section, place, text), one JSON pack per store of at most ``budget`` bytes.

    Texts are sanitised and cut. Items are taken place by place, sections by
    priority at each place, while the bytes they take as JSON fit the budget;
    the first that does not fit ends the pack.
    """
    order = F.array(*[F.lit(n) for n in PACK_LIMITS])
    most = F.create_map(*[F.lit(x) for pair in PACK_LIMITS.items() for x in pair])
    body = F.to_json(F.array("clean"))
    of_section = W.partitionBy("store_id", "section").orderBy("place", "text")
    rows = items.withColumn("nth", F.row_number().over(of_section))
    totals = rows.groupBy("store_id", "section").agg(F.count(F.lit(1)).alias("total"))
    rows = rows.filter(F.col("nth") <= most[F.col("section")]).withColumn("clean", sanitize_text(F.col("text"), PACK_CHARS))
    rows = rows.withColumn("body", F.substring(body, F.lit(2), F.char_length(body) - 2)).withColumn("priority", F.array_position(order, F.col("section")))
    # as JSON, with the comma after it
    running = F.sum(F.octet_length("body") + 1).over(W.partitionBy("store_id").orderBy("nth", "priority"))
    taken = rows.withColumn("upto", running).filter(F.col("upto") + _FRAME <= budget)
    by = taken.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("section", "nth", "body"))).alias("rows"))
    counts = totals.groupBy("store_id").agg(*[F.coalesce(F.sum(F.when(F.col("section") == n, F.col("total"))), F.lit(0)).alias(f"{n}_total") for n in PACK_LIMITS])
    out = counts.join(by, "store_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<section: string, nth: int, body: string>>")))
    of = lambda n: F.transform(F.filter("rows", lambda r: r["section"] == n), lambda r: r["body"])
    pack = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":['), F.array_join(of(n), ","), F.lit("]")) for n in PACK_LIMITS]), F.lit("}"))
    return out.select("store_id", *[f"{n}_total" for n in PACK_LIMITS], *[F.size(of(n)).alias(f"{n}_included") for n in PACK_LIMITS], pack.alias("pack"))


def pack_items(a: Analysis) -> DataFrame:
    """What an evidence pack may hold: (store_id, section, place, text)."""
    c, text = F.col, lambda *parts: F.concat_ws(" ", *[p.cast("string") for p in parts])
    item = lambda df, name, place, said: df.select("store_id", F.lit(name).alias("section"), (F.lpad(c(place).cast("string"), 9, "0") if dict(df.dtypes)[place] in ("int", "bigint") else c(place)).alias("place"), said.alias("text"))
    metrics = a.kpis.select("store_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).alias("value")) for m in a.kpis.columns[2:]])))
    limits = a.limitations.select("store_id", F.posexplode("limitations").alias("place", "text"))
    return reduce(DataFrame.unionByName, [
        item(metrics.filter("value is null"), "unavailable", "metric", c("metric")),
        item(metrics.filter("value is not null"), "facts", "metric", text(c("metric"), F.round("value", 4))),
        item(a.findings, "findings", "rank", text(c("item_id"), c("statement"))),
        item(a.recommendations, "recommendations", "factor", c("recommendation")),
        item(a.anomalies, "evidence", "metric", text(F.concat(F.lit("anomaly-"), c("metric")), c("direction"), c("severity"))),
        item(insights.hypotheses(a.factors), "hypotheses", "statement", text(c("statement"), c("supports"))),
        item(limits, "limitations", "place", c("text")),
        item(a.contributors, "contributors", "rank", c("sku")),
    ])


def evidence_pack(a: Analysis) -> DataFrame:
    """X-27: bounded lists with total and included counts; unknown metrics apart from facts."""
    return packed(pack_items(a))
