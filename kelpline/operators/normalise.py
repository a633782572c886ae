"""The projection that turns raw postings into listings, driven by a profile of rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.functions import values as vl
from kelpline.operators import lifecycle as lc
from kelpline.operators import rules as ru


@dataclass(frozen=True)
class Requirement:
    """A pattern that counts within a clause unless the veto stands beside it; it caps the score."""

    name: str
    pattern: str
    veto: str = "(preferred|a plus|not required|optional)"
    hard: bool = False
    cap: int = 100


@dataclass(frozen=True)
class Profile:
    """Rule tables.  Phrases are matched as words in title and description; the first category with a phrase wins."""

    categories: Sequence[tuple[str, Sequence[str]]] = ()
    open_to: Sequence[tuple[str, Sequence[str]]] = ()
    closed_to: Sequence[str] = ()
    requirements: Sequence[Requirement] = ()
    weights: Sequence[tuple[str, int]] = ()
    official: Sequence[str] = ()
    legal_forms: Sequence[str] = ("inc", "ltd", "gmbh", "llc")
    url_params: Sequence[str] = ("id",)
    regions: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _any(low: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | tx.phrase_in(low, p)
    return out


def normalise(raw: DataFrame, profile: Profile, now: Column) -> DataFrame:
    """raw (id, source, title, company, location, remote, salary, url, posted, description) -> listings.

    Adds, in the order of what depends on what: cleaned texts, keys, region, category, eligibility, pay,
    dates, requirements with their status, score and its reasons, status and prints.  Null and
    empty fields count as missing and stay null.
    """
    clean = lambda c: F.nullif(tx.html_to_text(c), F.lit(""))
    t = raw.withColumns({c: clean(c) for c in ("title", "company", "location", "salary", "description")})
    # In lower case and in clauses once, as columns, not in each rule.
    t = t.withColumn("_words", F.lower(F.concat_ws(" \n ", "title", "description"))).withColumn("_clauses", tx.clauses("_words"))
    words = F.col("_words")
    t = t.withColumns({
        "company_key": F.nullif(tx.canonical_name("company", profile.legal_forms), F.lit("")),
        "title_key": F.nullif(tx.canonical_name(F.regexp_replace("title", r"[\(\[].*?[\)\]]", " ")), F.lit("")),
        "url_key": tx.url_canonical("url", profile.url_params),
        "workplace": ru.first_match([(F.coalesce(F.col("remote"), F.lit(False)), "remote"), (tx.has_phrase(F.concat_ws(" ", "title", "location"), "hybrid"), "hybrid"), (F.col("location").isNotNull(), "onsite")], "unknown"),
        "region": ru.exactly_one([(name, _any(F.lower(F.coalesce("location", F.lit(""))), aliases)) for name, aliases in profile.regions.items()]) if profile.regions else F.lit(None).cast("string"),
        "category": ru.first_match([(_any(words, phrases), name) for name, phrases in profile.categories], "other"),
    })
    closed = _any(words, profile.closed_to)
    t = t.withColumn("eligibility", ru.first_match([(closed, "restricted"), *[(_any(words, phrases), code) for code, phrases in profile.open_to]], "unknown"))
    t = t.withColumn("pay", vl.money_range(F.coalesce("salary", "description"))).withColumn("posted_at", vl.date_from("posted"))
    t = t.withColumn("age_days", F.datediff(now.cast("date"), "posted_at"))
    hit = {r.name: tx.clause_in("_clauses", r.pattern, r.veto) for r in profile.requirements}
    t = t.withColumn("needs", ru.reasons([(r.name, hit[r.name]) for r in profile.requirements]))
    hard = [F.array_contains("needs", r.name) for r in profile.requirements if r.hard]
    t = t.withColumn("requirement_status", F.when(_or(hard), "hard_check").when(F.size("needs") > 0, "routine_check").otherwise("clear"))
    known = {
        "category": F.col("category") != "other", "eligible": F.col("eligibility").isin(*[c for c, _ in profile.open_to]), "paid": F.col("pay.confidence") == "parsed",
        "remote": F.col("workplace") == "remote", "fresh": F.col("age_days") <= 14, "official": F.col("source").isin(*profile.official), "stale": F.col("age_days") > 45,
    }
    weights = [(known[name], weight) for name, weight in profile.weights]
    caps = [(F.array_contains("needs", r.name), r.cap) for r in profile.requirements if r.cap < 100] + [(F.col("eligibility") == "restricted", 19)]
    t = t.withColumn("score", ru.score(weights, caps=caps)).withColumn("score_reasons", ru.reasons([(name, known[name]) for name, _ in profile.weights]))
    t = t.withColumn("status", ru.first_match([(F.col("age_days") > 45, "stale"), (F.col("source").isin(*profile.official), "official_listed")], "current_feed"))
    content = ("title", "company", "location", "salary", "description")
    return t.withColumn("print", lc.content_print(content)).withColumn("field_prints", lc.field_prints(content)).withColumn(
        "listing_id", tx.stable_id("listing:", F.coalesce("url_key", F.concat_ws("/", "company_key", "title_key", "location")))
    ).drop("_words", "_clauses")


def _or(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def address_parts(c: Column | str) -> Column:
    """A struct (street, number, postcode, city) of "Street 12a, 12345 City"."""
    c = F.col(c) if isinstance(c, str) else c
    part = lambda k: F.nullif(F.trim(F.regexp_extract(c, r"^\s*([^,\d]+?)\s+(\d+[a-zA-Z]?)\s*,\s*(?:(\d{4,6})\s+)?([^,\d]+?)\s*$", k)), F.lit(""))
    return F.struct(part(1).alias("street"), part(2).alias("number"), part(3).alias("postcode"), part(4).alias("city"))


def translate(c: Column | str, exact: Mapping[str, str], templates: Sequence[tuple[str, str]]) -> Column:
    """The exact translation, else the first template whose pattern is the whole text, else the text."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    for pattern, target in reversed(templates):
        out = F.when(c.rlike(f"^{pattern}$"), F.regexp_replace(c, f"^{pattern}$", target)).otherwise(out)
    names = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]) if exact else None
    return out if names is None else F.coalesce(names[c], out)
