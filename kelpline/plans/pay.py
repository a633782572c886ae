"""Queries on pay that texts state: cases, each with what is expected, and amounts of the order lines in many forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.money import pay
from kelpline.plans.decisions import _list, _pick
from kelpline.sources.tables import spread, table

_AREA = "For candidates located in {}, the starting base pay for this position ranges from $15 to $25 per hour. For candidates outside of {}, compensation may fall outside the listed range."
_STATES = "California, New York, Washington, and Colorado"
#: pay field, text: then currency, low, high, period, confidence, qualifier, basis, scope, display.
CASES = (
    ("", "Pay Rate: $13/hour\nFlexible schedule.", "USD", 13.0, 13.0, "hour", "parsed", None, None, None, "$13/시간"),
    ("", "근무 조건 급여: 시급 10,320원 (주휴수당 포함 월 2,157,000원 선)", "KRW", 10320.0, 10320.0, "hour", "parsed", None, None, None, "₩10,320/시간"),
    ("", "월급 2,330,000원~2,800,000원", "KRW", 2330000.0, 2800000.0, "month", "parsed", None, None, None, "₩2,330,000–₩2,800,000/월"),
    ("", "연봉 3,000만원 이상", "KRW", 30000000.0, 30000000.0, "year", "parsed", "minimum", None, None, "최소 ₩30,000,000/년"),
    ("", "Rate: 22.95 USD/hour", "USD", 22.95, 22.95, "hour", "parsed", None, None, None, "$22.95/시간"),
    ("USD 74000 hourly", "", "USD", 74000.0, 74000.0, "hour", "suspicious", None, None, None, "USD 74000 hourly · 단위 확인 필요"),
    ("$35,3k- $52k", None, "USD", 35300.0, 52000.0, None, "partial", None, None, None, "$35,300–$52,000 · 주기 확인 필요"),
    ("€75–90k", "", "EUR", 75000.0, 90000.0, None, "partial", None, None, None, "€75,000–€90,000 · 주기 확인 필요"),
    ("", "Competitive compensation package. Customizable benefits package, 28 days of vacation.", None, None, None, None, "none", None, None, None, ""),
    ("", "Benefits include wellness support. Pay €23 yourself for the optional upgrade.", None, None, None, None, "none", None, None, None, ""),
    ("", "Compensation: 40-120 EUR/gross per episode.", "EUR", 40.0, 120.0, "episode", "parsed", None, None, None, "€40–€120/에피소드"),
    ("", "Pay: Up to 10 USD/hour.", "USD", 10.0, 10.0, "hour", "parsed", "maximum", None, None, "최대 $10/시간"),
    ("", "Salary: Paid per job – approximately $11.5 per hour.", "USD", 11.5, 11.5, "hour", "parsed", "approximate", "per_task_equivalent", None, "약 $11.5/시간 · 건당 지급 환산"),
    ("", "Pay Rate: $13/hour. Are you passionate about language, technology, and data quality?", "USD", 13.0, 13.0, "hour", "parsed", None, None, None, "$13/시간"),
    ("", _AREA.format(_STATES, _STATES), "USD", 15.0, 25.0, "hour", "regional_only", None, None, "regional_only", "미국 일부 주 기준 $15–$25/시간 · 기타 지역 단가 확인"),
    ("", _AREA.format("Seoul and Busan", "Seoul and Busan"), "USD", 15.0, 25.0, "hour", "regional_only", None, None, "regional_only", "Seoul and Busan 기준 $15–$25/시간 · 기타 지역 단가 확인"),
    ("", "We offer a pay range of $6 to $65 per hour, with the exact rate determined after evaluating your experience, expertise, and geographic location. Final offer amounts may vary from the pay range listed above.", "USD", 6.0, 65.0, "hour",
     "parsed", None, None, "geography_dependent", "$6–$65/시간"),
    ("", "Rate: 10 USD per hour (rates vary per country. If you are based elsewhere, the rates will be different).", "USD", 10.0, 10.0, "hour", "parsed", None, None, "geography_dependent", "$10/시간"),
    ("", "Compensation is calculated at a fixed hourly rate. The amount depends on language and location.", None, None, None, "hour", "basis_only", None, "fixed_hourly", None, "금액 비공개 · 시간당 고정 단가"),
    ("", "Compensation is paid per completed set of reviewed and matched text.", None, None, None, "set", "basis_only", None, "per_completed_set", None, "금액 비공개 · 완료 세트당 지급"),
    ("", "We offer competitive task-based compensation with a flexible workload.", None, None, None, "task", "basis_only", None, "per_task", None, "금액 비공개 · 건별 지급"),
    ("negotiable", "Salary: $5 per hour", None, None, None, None, "raw", None, None, None, "negotiable · 통화/주기 확인 필요"),
    ("", "You pay $40 per month for the gym. Salary: CHF 90k a year.", "CHF", 90000.0, 90000.0, "year", "parsed", None, None, None, "CHF 90,000/년"),
    ("", "We sold 3,000 USD per day; remuneration 1.5k-2k PLN weekly", "PLN", 1500.0, 2000.0, "week", "parsed", None, None, None, "PLN 1,500–PLN 2,000/주"),
    (None, None, None, None, None, None, "none", None, None, None, ""),
)
FIELDS = ("currency", "low", "high", "period", "confidence", "qualifier", "payment_basis", "scope", "display")
REGIONS = {"california|new york|washington|colorado": "미국 일부 주"}


def pay_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as postings that state their pay in one of the cases."""
    k = F.col("o_orderkey")
    p = pay(_pick(tuple(c[0] for c in CASES), k), _pick(tuple(c[1] for c in CASES), k), REGIONS)
    return table(spark, sf, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", *[F.col(f"p.{f}").alias(f) for f in FIELDS])


def pay_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the order lines, written in eight forms, as they are read back."""
    t = spread(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").withColumn("a", F.round("l_extendedprice", 2)).withColumn("b", F.col("a") + F.col("l_quantity").cast("double"))
    shown = lambda c: F.format_number(c, 2)
    whole = lambda c: F.format_number(F.floor(c), 0)
    forms = [
        F.concat(F.lit("Salary: $"), shown(F.col("a")), F.lit(" - "), shown(F.col("b")), F.lit(" per year.")), F.concat(F.lit("We pay "), shown(F.col("a")), F.lit(" EUR monthly. Apply by 2026.")),
        F.concat(F.lit("Lunch costs 4 USD. Remuneration GBP "), shown(F.col("a")), F.lit(" to GBP "), shown(F.col("b")), F.lit("/week")), F.concat(F.lit("연봉 "), whole(F.col("a")), F.lit("만원 이하")),
        F.concat(F.lit("It is "), shown(F.col("a")), F.lit(" USD per day")), F.concat(F.lit("It is "), shown(F.col("a")), F.lit(" USD in all")), F.concat(F.lit("Compensation up to "), whole(F.col("a")), F.lit("k-"), whole(F.col("b")), F.lit("k INR a month")),
        F.concat(F.lit("Pay "), shown(F.col("a")), F.lit(" per hour")),
    ]
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = reduce(lambda c, k: c.when(form == k, forms[k]), range(1, 8), F.when(form == 0, forms[0]))
    p = t.select("l_orderkey", "l_linenumber", pay(F.lit(None).cast("string"), text, shown=None).alias("p"))
    return p.groupBy("p.currency", "p.period", "p.confidence", "p.qualifier").agg(F.count("*").alias("n"), F.round(F.sum("p.low"), 0).alias("low"), F.round(F.sum("p.high"), 0).alias("high"))


QUERIES = {f.__name__: f for f in (pay_cases, pay_of_lines)}


def _at(n: int) -> str:
    values = [c[n + 2] for c in CASES]
    listed = f"CAST({_list(values)} AS VARCHAR[])" if n not in (1, 2) else f"CAST([{', '.join('NULL' if v is None else str(v) for v in values)}] AS DOUBLE[])"
    return f"({listed})[o_orderkey % {len(CASES)} + 1] AS {FIELDS[n]}"


SQL = {
    "pay_cases": f"SELECT o_orderkey, {', '.join(_at(n) for n in range(len(FIELDS)))} FROM orders",
    "pay_of_lines": """
        WITH t AS (SELECT (l_orderkey + l_linenumber) % 8 AS f, round(l_extendedprice::DOUBLE, 2) AS a, round(l_extendedprice::DOUBLE, 2) + l_quantity::DOUBLE AS b FROM lineitem),
        p AS (SELECT CASE f WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'KRW' WHEN 4 THEN 'USD' WHEN 6 THEN 'INR' END AS currency,
            CASE f WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'week' WHEN 3 THEN 'year' WHEN 4 THEN 'day' WHEN 6 THEN 'month' WHEN 7 THEN 'hour' END AS period,
            CASE WHEN f = 0 AND b < 1000 THEN 'suspicious' WHEN f < 5 OR f = 6 THEN 'parsed' WHEN f = 7 THEN 'raw' ELSE 'none' END AS confidence, CASE WHEN f IN (3, 6) THEN 'maximum' END AS qualifier,
            CASE f WHEN 3 THEN floor(a) * 10000 WHEN 5 THEN NULL WHEN 7 THEN NULL WHEN 6 THEN floor(a) * 1000 ELSE a END AS low,
            CASE f WHEN 3 THEN floor(a) * 10000 WHEN 5 THEN NULL WHEN 7 THEN NULL WHEN 6 THEN floor(b) * 1000 WHEN 0 THEN b WHEN 2 THEN b ELSE a END AS high FROM t)
        SELECT currency, period, confidence, qualifier, count(*) AS n, round(sum(low), 0) AS low, round(sum(high), 0) AS high FROM p GROUP BY 1, 2, 3, 4""",
}
