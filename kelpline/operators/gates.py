"""Gates and labels of listings: recommendation, review, levels and modes, places, pay, gaps of a collection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import collapse
from kelpline.operators.rules import first_match, reasons

#: Statuses that no recommendation has.
BLOCKED = ("expired", "stale", "source_error", "archived_missing", "talent_pool")
#: A level and the course levels that it takes: a wide course holds for each level that it spans.
LEVELS = {
    "beginner": ("beginner", "all levels", "beginner to advanced"),
    "elementary": ("beginner", "elementary", "all levels", "beginner to advanced"),
    "intermediate": ("intermediate", "all levels", "beginner to advanced"),
    "advanced": ("advanced", "all levels"),
}
#: Filters that a market starts with.
DEFAULT_FILTERS = {
    "remote": {"market": "remote", "state": "open", "age": "30", "score": "20"},
    "domestic": {"market": "domestic", "state": "open", "age": "14", "workplace": "onsite"},
    "all": {"state": "open"},
}


def default_filters(market: str, **own: str) -> dict[str, str]:
    """A market's filters, with the caller's own in their place; an empty own value takes a filter away."""
    return {k: v for k, v in {**DEFAULT_FILTERS.get(market, DEFAULT_FILTERS["all"]), **own}.items() if v != ""}


def role_fit(version: int = 3) -> Column:
    """From role_basis, role_evidence, keywords (array) and category: whether the role is known to fit.

    A public body's row needs a keyword or a category; others need evidence, which policies before 3 took for granted.
    """
    public = (F.coalesce("role_evidence", F.lit(True))) & ((F.size("keywords") > 0) | F.coalesce(~F.col("category").isin("", "other"), F.lit(False)))
    return F.when(F.col("role_basis") == "public_institution", public).otherwise(F.coalesce(F.col("role_evidence"), F.lit(version < 3)))


def recommended(version: int = 3) -> Column:
    """From the columns of role_fit, eligible, score, eligibility, requirements, status and fit: what a feed shows first.

    From policy 5 on a row whose profile fit fails is none.
    """
    ok = F.coalesce("eligible", F.lit(True)) & role_fit(version) & (F.coalesce("score", F.lit(0)) >= 20)
    ok = ok & F.coalesce(F.col("eligibility").isin("korea", "worldwide"), F.lit(False))
    ok = ok & (F.coalesce("requirements", F.lit("clear")) != "hard_check") & ~F.coalesce(F.col("status").isin(*BLOCKED), F.lit(False))
    return ok if version < 5 else ok & (F.coalesce("fit", F.lit("check")) != "fail")


def with_source_metrics(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """df (source, official, list_state, role_evidence, requirements) with its source's tier, state and success rate and
    why it is not recommended.  metrics (source, tier, state, success_rate): one row a source, few."""
    t = df.join(metrics, "source", "left")
    t = t.withColumn("tier", F.coalesce("tier", F.when(F.col("official"), "strong").otherwise("mixed")))
    t = t.withColumn("state", F.coalesce("state", F.when(F.col("official"), "reliable").otherwise("observed")))
    gate = first_match([
        (F.col("list_state").isin("public_rss", "public_rss_cached_detail"), "list_only"), (F.col("state").isin("degraded", "unstable"), "source_fails"), (F.col("tier") == "weak", "source_noisy"),
    ], "")
    role = F.when(F.coalesce("role_evidence", F.lit(False)), "").otherwise("no_role_evidence")
    t = t.withColumn("source_gate", gate).withColumn("role_gate", role)
    return t.withColumn("eligible", (F.col("source_gate") == "") & (F.col("role_gate") == "") & ~F.col("requirements").eqNullSafe(F.lit("hard_check")))


def review_candidate() -> Column:
    """From collected, manual, eligibility, language_fit, fit and status: rows that a person should look at."""
    no = lambda c, *values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    seen = F.col("collected").eqNullSafe(F.lit("seen")) & ~F.coalesce("manual", F.lit(False))
    return seen & no("eligibility", "restricted") & no("language_fit", "mismatch") & no("fit", "fail") & no("status", *BLOCKED)


def level_matches(level: Column, wanted: str, levels: Mapping[str, Sequence[str]] = LEVELS) -> Column:
    """A level holds for the courses that its row of the table names; one that is not in the table for those that contain it."""
    return F.lit(True) if not wanted else level.isin(*levels[wanted]) if wanted in levels else F.contains(level, F.lit(wanted))


def mode_matches(mode: Column, wanted: str) -> Column:
    """hybrid holds for online and for offline."""
    return F.lit(True) if not wanted else mode.isin(wanted, "hybrid") if wanted in ("online", "offline") else mode == wanted


def without_source(df: DataFrame, name: str, source: str = "source", sources: str = "sources") -> DataFrame:
    """df without the rows of a source that is not configured, be it their own or one of those merged into them."""
    own, merged = F.col(source).eqNullSafe(F.lit(name)), F.coalesce(F.array_contains(sources, name), F.lit(False))
    return df.where(~own & ~merged)


def host_source(url: Column, original: Column, domains: Mapping[str, str], default: str = "Manual") -> Column:
    """The source of a page by its host's domain, else the stated one, else the host without www."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = [((host == d) | F.endswith(host, F.lit("." + d)), name) for d, name in domains.items()]
    return first_match(known, F.coalesce(F.nullif(original, F.lit("")), F.regexp_replace(host, r"^www\.", ""), F.lit(default)))


def stable_description(source: Column, text: Column, footers: Mapping[str, str]) -> Column:
    """The text without the footer that a source changes on each visit."""
    out = collapse(text)
    for name, pattern in footers.items():
        out = F.when(source == name, F.trim(F.regexp_replace(out, pattern, ""))).otherwise(out)
    return out


def address_key(c: Column) -> Column:
    """Road and number, else lot and number, of a Korean address: lower case, no spaces; empty if it has none."""
    plain = collapse(F.regexp_replace(F.regexp_replace(c, r"^\s*\d{5}\s+", ""), r"\([^)]*\)", " "))
    road, lot = (F.regexp_extract(plain, rf"([가-힣0-9·.-]+(?:{ends})\s*\d+(?:-\d+)?)", 1) for ends in ("대로|로|길", "읍|면|동|가|리"))
    return F.coalesce(F.lower(F.regexp_replace(F.coalesce(F.nullif(road, F.lit("")), lot), r"\s+", "")), F.lit(""))


def location_key(c: Column) -> Column:
    """Letters and digits of a place in lower case; what only says remote, or nothing, is "remote"."""
    out = F.regexp_replace(F.lower(c), r"\b(remote|work from home|homeoffice)\b", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(out, "[^a-z0-9가-힣]+", " ")), F.lit("")), F.lit("remote"))


def domestic_key(admin: Sequence[Column], address: Column, location: Column, on_site: Column) -> Column:
    """Administrative names and the address of a place of work; the location's key if none is known; empty for remote work."""
    parts = F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in (*admin, address)]))
    return F.when(~on_site, "").when(F.size(parts) > 0, F.array_join(parts, "|")).otherwise(location_key(location))


def short_city(c: Column) -> Column:
    """A place without the suffix of its kind, unless that is all of it."""
    c = F.trim(c)
    return F.coalesce(F.nullif(F.regexp_replace(c, "(특별시|광역시|특별자치시|특별자치도|시|군|구)$", ""), F.lit("")), c)


def location_text(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def pay_summary(value: Column, low: Column, high: Column, period: Column, confidence: Column, qualifier: Column, basis: Column, conflict: Column, suppressed: Column) -> Column:
    """A struct (value, note, has_amount, period, basis, confidence, limited, unknown) that says how far a pay can be trusted."""
    has = low.isNotNull() | high.isNotNull()
    unknown = F.coalesce(value, F.lit("")) == ""
    how = first_match([(confidence == "regional_only", "one region only"), (confidence == "basis_only", "basis only"), (qualifier == "maximum", "upper limit"), (qualifier == "approximate", "approximate")], "")
    flaw = first_match([(conflict, "text and board differ"), (suppressed, "board amount unverified")], "")
    rest = reasons([("per task, as an hour", basis == "per_task_equivalent"), ("check the original", unknown)])
    notes = F.array_distinct(F.filter(F.concat(F.array(how, flaw), rest), lambda x: x != ""))
    doubt = ~has | F.coalesce(confidence == "regional_only", F.lit(False)) | F.coalesce(conflict, F.lit(False)) | F.coalesce(suppressed, F.lit(False))
    return F.struct(
        F.when(unknown, "undisclosed").otherwise(value).alias("value"), F.array_join(notes, "; ").alias("note"), has.alias("has_amount"), F.coalesce(period, F.lit("")).alias("period"),
        F.coalesce(basis, F.lit("")).alias("basis"), F.coalesce(confidence, F.lit("none")).alias("confidence"), (~unknown & doubt).alias("limited"), unknown.alias("unknown"),
    )


def pay_matches(summary: Column, wanted: str) -> Column:
    """One of six ways to ask for a pay; an empty one asks for nothing."""
    period, has = summary["period"], summary["has_amount"]
    return {
        "amount": has, "hour": has & (period == "hour"), "salary": has & period.isin("day", "week", "month", "year"),
        "piece": period.isin("project", "episode", "set") | summary["basis"].isin("per_task_equivalent", "per_completed_set"),
        "basis_only": summary["confidence"] == "basis_only", "undisclosed": ~has,
    }.get(wanted, F.lit(True))


def collection_health(runs: DataFrame) -> DataFrame:
    """runs (market, source, status, was, preserved) -> per market its failed, partial and recovered sources and preserved rows."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("source")))), ",")
    bad = F.col("status").isin("error", "source_error")
    return runs.groupBy("market").agg(
        names(bad).alias("failed"), names(F.col("status") == "partial").alias("partial"),
        names((F.col("status") == "ok") & F.col("was").isin("error", "partial")).alias("recovered"), F.sum(F.coalesce("preserved", F.lit(0))).cast("long").alias("preserved"),
    )


def collection_gaps(gaps: DataFrame, configured: Sequence[str], market: str) -> DataFrame:
    """gaps (source, status, markets): those of a market whose source the run does not collect after all."""
    return gaps.where(F.array_contains("markets", market) & ~F.col("source").isin(*configured))


def collapse_states(previous: DataFrame, found: DataFrame, key: str = "id", by: str = "source", least: int = 10, share: float = 0.5) -> DataFrame:
    """Per source: active rows before, rows found now, their overlap and both ratios, and whether the search collapsed:
    enough rows before, some found, but fewer than the share of them.  Low overlap alone is no collapse."""
    old = previous.where(~F.coalesce(F.col("status").isin("archived_missing", "expired", "talent_pool"), F.lit(False)))
    before = old.groupBy(by).agg(F.count("*").alias("reference"))
    now = found.select(by, key).where(F.col(key).isNotNull()).distinct()
    counts = now.groupBy(by).agg(F.count("*").alias("discovered"))
    both = now.join(old.select(by, key).distinct(), [by, key]).groupBy(by).agg(F.count("*").alias("overlap"))
    t = before.join(counts, by, "full").join(both, by, "left").na.fill(0, ["reference", "discovered", "overlap"])
    ratio = lambda c: F.when(F.col("reference") > 0, F.col(c) / F.col("reference"))
    suspected = (F.col("reference") >= least) & (F.col("discovered") > 0) & (F.col("discovered") < F.ceil(F.col("reference") * share))
    return t.withColumns({"ratio": ratio("discovered"), "overlap_ratio": ratio("overlap"), "suspected": suspected})


def detail_collapse(tried: Column, parsed: Column, least: int = 10, failed: int = 5, share: float = 0.5) -> Column:
    """Details collapsed: enough were tried, enough failed, and fewer than the share were read."""
    return (tried >= least) & (tried - parsed >= failed) & (parsed < tried * share)


def continuity_failed(probed: Column, failed: Column) -> Column:
    """Of known rows that were looked up again, at least three and half of them failed."""
    return (probed > 0) & (failed >= F.greatest(F.lit(3), F.ceil(probed * 0.5)))


def relative_day(day: Column, today: Column) -> Column:
    """today, yesterday, n days ago up to a week, else the date; dates to come and missing ones are told apart."""
    n = F.datediff(today, day)
    return (
        F.when(day.isNull(), "unknown").when(n < 0, F.concat(F.lit("in "), (-n).cast("string"), F.lit(" days"))).when(n == 0, "today").when(n == 1, "yesterday")
        .when(n <= 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
