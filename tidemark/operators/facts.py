"""Reported facts: selection, coverage and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fiscal, text
from tidemark.staging import written

#: Concept, its tags in order of priority, duration or instant, unit, required.
CONCEPTS = (
    ("Revenues", ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"), "duration", "USD", True),
    ("CostOfRevenue", ("CostOfRevenue", "CostOfGoodsAndServicesSold"), "duration", "USD", False),
    ("GrossProfit", ("GrossProfit",), "duration", "USD", False),
    ("OperatingIncomeLoss", ("OperatingIncomeLoss",), "duration", "USD", True),
    ("NetIncomeLoss", ("NetIncomeLoss",), "duration", "USD", True),
    ("ResearchAndDevelopmentExpense", ("ResearchAndDevelopmentExpense",), "duration", "USD", False),
    ("SellingGeneralAndAdministrativeExpense", ("SellingGeneralAndAdministrativeExpense",), "duration", "USD", False),
    ("OperatingExpenses", ("OperatingExpenses", "CostsAndExpenses"), "duration", "USD", False),
    ("EarningsPerShareBasic", ("EarningsPerShareBasic",), "duration", "USD/shares", True),
    ("EarningsPerShareDiluted", ("EarningsPerShareDiluted",), "duration", "USD/shares", True),
    ("WeightedAverageNumberOfSharesOutstandingBasic", ("WeightedAverageNumberOfSharesOutstandingBasic",), "duration", "shares", True),
    ("WeightedAverageNumberOfDilutedSharesOutstanding", ("WeightedAverageNumberOfDilutedSharesOutstanding",), "duration", "shares", True),
    ("CashAndCashEquivalentsAtCarryingValue", ("CashAndCashEquivalentsAtCarryingValue",), "instant", "USD", True),
    ("Assets", ("Assets",), "instant", "USD", True),
    ("Liabilities", ("Liabilities",), "instant", "USD", False),
    ("StockholdersEquity", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), "instant", "USD", True),
)

#: Names of metrics by the concept they stand for.
ALIASES = {
    "Revenues": (
        "revenue", "revenues", "total_revenue", "net_revenue", "revenue_growth_yoy", "revenue_growth_qoq", "revenue_yoy", "revenue_qoq",
        "total_revenue_growth_yoy", "total_revenue_yoy_growth", "total_revenue_growth_yoy_constant_currency", "revenue_growth_cc",
        "revenue_yoy_growth", "revenue_growth_sequential", "revenue_growth_sequential_absolute", "revenue_growth_seq", "revenue_cc",
        "revenue_growth_yoy_cc",
    ),
    "CostOfRevenue": ("cost_of_revenue", "cogs", "cost_of_goods_sold"),
    "GrossProfit": (
        "gross_profit", "gross_margin", "gross_margin_dollars", "gross_margin_dollars_growth_cc", "gross_margin_dollars_growth",
        "gross_margin_pct_change", "gross_margin_growth_cc", "gross_margin_qoq_change", "gross_margin_pct",
    ),
    "OperatingIncomeLoss": (
        "operating_income", "operating_income_loss", "operating_margin", "operating_income_growth_cc", "operating_income_growth",
        "operating_income_growth_yoy",
    ),
    "OperatingExpenses": ("operating_expenses", "operating_expenses_growth_cc", "operating_expenses_growth", "operating_expenses_yoy_growth"),
    "NetIncomeLoss": ("net_income", "net_income_loss", "net_margin", "net_profit"),
    "EarningsPerShareDiluted": (
        "eps", "eps_diluted", "earnings_per_share", "earnings_per_share_diluted", "eps_diluted_yoy_growth", "eps_diluted_growth_yoy",
    ),
    "EarningsPerShareBasic": ("eps_basic", "earnings_per_share_basic"),
    "ResearchAndDevelopmentExpense": ("r_and_d", "research_and_development", "rd_expense"),
    "SellingGeneralAndAdministrativeExpense": ("sga", "selling_general_administrative", "sg_and_a"),
    "CashAndCashEquivalentsAtCarryingValue": ("cash", "cash_and_equivalents"),
    "Assets": ("total_assets", "assets"),
    "Liabilities": ("total_liabilities", "liabilities"),
    "StockholdersEquity": ("stockholders_equity", "equity", "shareholders_equity"),
    "WeightedAverageNumberOfSharesOutstandingBasic": ("shares_outstanding",),
    "WeightedAverageNumberOfDilutedSharesOutstanding": ("diluted_shares",),
}

#: Metrics that filings do not report, by category.
UNSUPPORTED = {
    "segment_kpi": (
        "azure_other_cloud_services_revenue_growth_cc", "azure_other_cloud_services_revenue", "on_premises_server_revenue_growth_cc",
        "on_premises_server_revenue", "intelligent_cloud_revenue", "more_personal_computing_revenue", "productivity_business_revenue",
        "segment_gross_margin_dollars_growth_cc", "segment_gross_margin_dollars", "segment_gross_margin", "data_center_revenue",
        "gaming_revenue", "professional_visualization_revenue", "automotive_revenue", "search_advertising_revenue", "youtube_revenue",
        "google_services_revenue", "google_cloud_revenue",
    ),
    "product_kpi": (
        "iphone_revenue", "mac_revenue", "ipad_revenue", "services_revenue", "services_revenue_yoy_growth", "services_revenue_growth_yoy",
        "wearables_revenue", "blackwell_rubin_visible_revenue", "blackwell_revenue", "hopper_revenue",
    ),
    "operational_kpi": (
        "annual_ai_infrastructure_build", "ai_infrastructure_build", "family_daily_active_people", "dap", "bookings", "arr", "rpo",
        "commercial_cloud_bookings", "remaining_performance_obligation", "office_365_seats", "github_users", "xbox_mau", "copilot_users",
    ),
}

#: Parts of names of unsupported metrics, by category, in the order they are tried.
PARTS = (
    ("segment_kpi", (
        "azure_", "intelligent_cloud", "more_personal_computing", "productivity_business", "windows_oem", "search_advertising",
        "gaming_revenue", "xbox_", "office_", "google_cloud", "google_services", "youtube_", "waymo_", "iphone_", "mac_", "ipad_",
        "wearables_", "services_gross_margin", "blackwell_", "hopper_", "data_center_revenue", "automotive_revenue",
        "professional_visualization", "reality_labs_",
    )),
    ("operational_kpi", (
        "pull_forward", "pull_ahead", "tariff_", "upgrade_record", "features_count", "infrastructure_build", "launch_impact", "employees",
        "employee_", "headcount", "primary_factors", "guidance_low", "guidance_high", "_guidance", "oire_guidance", "tax_rate_guidance",
    )),
    ("derived_financial", (
        "free_cash_flow", "capital_expenditures", "capex", "share_repurchases", "buyback", "dividends_paid", "cash_dividend",
        "cash_and_marketable", "operating_cash_flow", "adjusted_net_income", "adjusted_eps", "net_income_excluding",
        "eps_diluted_excluding", "tax_rate", "interest_and_other", "total_expenses", "expense_growth", "debt", "gross_margin_pct",
        "products_revenue", "products_gross_margin", "services_gross_margin", "company_gross_margin",
    )),
)

#: Metrics by formula.
MARGIN = ("gross_margin", "operating_margin", "net_margin", "gross_margin_pct")
MARGIN_CHANGE = ("gross_margin_pct_change", "gross_margin_qoq_change")
YOY = (
    "revenue_growth_yoy", "revenue_yoy", "revenue_growth_cc", "revenue_cc", "revenue_growth_yoy_cc", "gross_margin_dollars_growth_cc",
    "gross_margin_dollars_growth", "gross_margin_growth_cc", "operating_income_growth_cc", "operating_income_growth",
    "operating_income_growth_yoy", "operating_expenses_growth_cc", "operating_expenses_growth",
)
QOQ = ("revenue_growth_qoq", "revenue_qoq", "revenue_growth_sequential", "revenue_growth_sequential_absolute", "revenue_growth_seq")


def concept_tags(spark: SparkSession) -> DataFrame:
    rows = [(c, t, k, kind, unit, req) for c, tags, kind, unit, req in CONCEPTS for k, t in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, tag string, priority int, period_type string, unit string, required boolean")


def select_facts(entries: DataFrame) -> DataFrame:
    """Of each filing and concept the value of the first alias tag that has a fitting entry: the latest duration that suits the form, or the latest instant.

    Entries: ``accession, form, tag, unit, start_day, end_day, value, position``; of equal ends the first in source order counts.
    """
    tags = F.broadcast(concept_tags(entries.sparkSession))
    rows = entries.join(tags, ["tag", "unit"])
    fits = F.when(F.col("period_type") == "instant", F.col("start_day").isNull() & F.col("end_day").isNotNull())
    fits = fits.otherwise(F.coalesce(fiscal.duration_fits(F.col("form"), F.col("start_day"), F.col("end_day")), F.lit(False)))
    first = Window.partitionBy("accession", "concept").orderBy("priority", F.desc("end_day"), "position")
    rows = rows.where(fits).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("accession", "form", "concept", "tag", "value", "unit", F.col("start_day").alias("period_start"), F.col("end_day").alias("period_end"))


def coverage_report(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """Per filing the missing required and optional concepts, sorted, and whether none required is missing."""
    concepts = F.broadcast(concept_tags(filings.sparkSession).select("concept", "required").distinct())
    expected = filings.select("accession").distinct().crossJoin(concepts)  # a fixed number of concepts per filing
    have = facts.select("accession", "concept").distinct().withColumn("have", F.lit(True))
    rows = expected.join(have, ["accession", "concept"], "left").withColumn("gone", F.col("have").isNull())
    names = lambda flag: F.array_join(F.array_sort(F.collect_list(F.when(F.col("gone") & (F.col("required") == flag), F.col("concept")))), ",")
    return rows.groupBy("accession").agg(names(True).alias("missing_required"), names(False).alias("missing_optional"), F.coalesce(~F.bool_or(F.col("gone") & F.col("required")), F.lit(True)).alias("complete"))


def latest_facts(facts: DataFrame) -> DataFrame:
    """The fact with the latest end of each company, label and concept; then the latest start, then the larger accession."""
    best = F.max_by(F.struct("value", "unit", "period_end"), F.struct("period_end", F.coalesce(F.col("period_start"), F.lit("1000-01-01").cast("date")), "accession"))
    return facts.groupBy("ticker", "fiscal_label", "concept").agg(best.alias("b")).select("ticker", "fiscal_label", "concept", "b.value", "b.unit", "b.period_end")


def unsupported_category(metric: Column) -> Column:
    """Category of a metric that filings do not report, null for others; exact names first, then parts of names in order."""
    out = F.lit(None).cast("string")
    for category, parts in reversed(PARTS):
        out = F.when(metric.rlike("|".join(parts)), category).otherwise(out)
    for category, names in UNSUPPORTED.items():
        out = F.when(metric.isin(*names), category).otherwise(out)
    return out


def concept_of(metric: Column) -> Column:
    out = F.lit(None).cast("string")
    for concept, names in ALIASES.items():
        out = F.when(metric.isin(*names), concept).otherwise(out)
    return out


def formula_of(metric: Column) -> Column:
    """margin, margin_change, yoy, cc, qoq or value, in this order of precedence."""
    return (
        F.when(metric.isin(*MARGIN), "margin")
        .when(metric.isin(*MARGIN_CHANGE), "margin_change")
        .when(metric.isin(*YOY) | (metric.contains("yoy") & ~metric.contains("cc")), "yoy")
        .when(metric.endswith("_cc"), "cc")
        .when(metric.isin(*QOQ) | metric.contains("qoq"), "qoq")
        .otherwise("value")
    )


def classify_metrics(requests: DataFrame, column: str = "metric") -> DataFrame:
    """Append ``normalized``, ``category`` (of unsupported ones, or unknown), ``concept`` and ``formula``."""
    rows = requests.withColumn("normalized", text.normalize_metric(F.col(column)))
    rows = rows.withColumn("category", unsupported_category(F.col("normalized")))
    rows = rows.withColumn("concept", F.when(F.col("category").isNull(), concept_of(F.col("normalized"))))
    rows = rows.withColumn("category", F.when(F.col("category").isNull() & F.col("concept").isNull(), "unknown").otherwise(F.col("category")))
    return rows.withColumn("formula", F.when(F.col("concept").isNotNull(), formula_of(F.col("normalized"))))


def calculate_metrics(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Values for requests ``(ticker, fiscal_label, metric, prior_label)`` from latest facts: append ``value``, ``unit`` and ``error``.

    The facts of a period, one per concept, become one row of a table in the shared folder, so that
    requests join twice whatever the formula, with the current and with the prior period, and facts are read once.
    """
    rows = classify_metrics(requests)
    fact = F.struct("concept", F.struct("value", "unit"))
    periods = written(latest_facts(facts).groupBy("ticker", "fiscal_label").agg(F.map_from_entries(F.collect_list(fact)).alias("_facts")), "periods")
    rows = rows.join(periods.withColumnRenamed("_facts", "_cur"), ["ticker", "fiscal_label"], "left")
    rows = rows.join(periods.toDF("ticker", "prior_label", "_prior"), ["ticker", "prior_label"], "left")
    of = lambda period, concept: F.try_element_at(period, concept)
    revenue = F.lit("Revenues")
    rows = rows.withColumns(
        {
            "cur": of(F.col("_cur"), F.col("concept"))["value"],
            "cur_unit": of(F.col("_cur"), F.col("concept"))["unit"],
            "prior": of(F.col("_prior"), F.col("concept"))["value"],
            "rev": of(F.col("_cur"), revenue)["value"],
            "prior_rev": of(F.col("_prior"), revenue)["value"],
        }
    )
    cur, prior, rev, prior_rev, formula = (F.col(c) for c in ("cur", "prior", "rev", "prior_rev", "formula"))
    margin = lambda v, r: F.when((r.isNotNull()) & (r != 0), v / r * 100)
    growth = F.when(prior.isNotNull() & (prior != 0), (cur - prior) / F.abs(prior) * 100)
    value = (
        F.when(formula == "margin", margin(cur, rev))
        .when(formula == "margin_change", margin(cur, rev) - margin(prior, prior_rev))
        .when(formula.isin("yoy", "cc", "qoq"), growth)
        .otherwise(cur)
    )
    unit = F.when(formula == "margin_change", "pp").when(formula.isin("margin", "yoy", "cc", "qoq"), "%").otherwise(F.col("cur_unit"))
    error = (
        F.when(F.col("category") == "unknown", "unknown metric")
        .when(F.col("category").isNotNull(), F.concat(F.lit("not reported: "), F.col("category")))
        .when(cur.isNull(), "no fact for the period")
        .when(value.isNull() & formula.isin("margin"), "no revenue for the period")
        .when(value.isNull(), "no prior value")
    )
    return rows.select(*requests.columns, "normalized", "concept", "formula", F.round(value, 4).alias("value"), F.when(value.isNotNull(), unit).alias("unit"), error.alias("error"))
