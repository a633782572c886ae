from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators.normalise import Profile, Requirement, address_parts, normalise, translate

PROFILE = Profile(
    categories=[("data", ["data engineer", "analytics"]), ("care", ["nurse"])],
    open_to=[("worldwide", ["work from anywhere"]), ("eu", ["europe"])],
    closed_to=["us citizens only"],
    requirements=[Requirement("german", "german", cap=50), Requirement("degree", "degree", hard=True, cap=30)],
    weights=[("category", 30), ("eligible", 30), ("paid", 20), ("remote", 10), ("fresh", 10), ("official", 15), ("stale", -40)],
    official=["gov"],
    regions={"north": ["kiel", "hamburg"], "south": ["munich"]},
)
SCHEMA = "id string, source string, title string, company string, location string, remote boolean, salary string, url string, posted string, description string"


def test_projection(spark):
    rows = [
        ("1", "gov", "<b>Data Engineer</b> (m/f)", "Acme, Inc.", "Kiel", True, "EUR 50-60k per year", "https://E.example.com/j/?id=1&utm=2", "2026-01-25", "Work from anywhere. German preferred."),
        ("2", "x", "Nurse", None, "Hamburg or Munich", False, None, None, "25.11.2025", "Degree required. German needed."),
        ("3", "x", None, "", None, None, None, None, None, None),
        ("4", "x", "Analytics hybrid", "Acme Ltd", "Munich", False, None, "bad url", "soon", "US citizens only; work from anywhere"),
    ]
    out = {r.id: r for r in normalise(spark.createDataFrame(rows, SCHEMA), PROFILE, F.lit("2026-01-31")).collect()}
    a, b, c, d = (out[k] for k in "1234")
    assert (a.company_key, a.title_key, a.url_key, a.region, a.category, a.eligibility) == ("acme", "data engineer", "https://e.example.com/j?id=1", "north", "data", "worldwide")
    assert (a.pay.low, a.pay.high, a.pay.period, a.score, a.needs, a.requirement_status, a.status) == (50000.0, 60000.0, "year", 100, [], "clear", "official_listed")
    assert (b.region, b.needs, b.requirement_status, b.score, b.status) == ("mixed", ["german", "degree"], "hard_check", 0, "stale")
    assert (c.title, c.company_key, c.workplace, c.category, c.pay.confidence, c.score, c.status) == (None, None, "unknown", "other", "none", 0, "current_feed")
    assert (d.eligibility, d.workplace, d.score, d.url_key, d.posted_at) == ("restricted", "hybrid", 19, "bad url", None)
    assert len({r.listing_id for r in out.values()}) == 4 and a.field_prints["title"] != b.field_prints["title"]


def test_a_change_of_one_field_changes_the_print(spark):
    row = ("1", "x", "T", "C", "L", True, "S", "https://e.example.com/1", "2026-01-25", "D")
    other = ("1", "x", "T", "C", "L", True, "S", "https://e.example.com/1", "2026-01-25", "D2")
    a, b = normalise(spark.createDataFrame([row, other], SCHEMA), PROFILE, F.lit("2026-01-31")).collect()
    assert a.print != b.print and a.listing_id == b.listing_id
    assert [k for k in a.field_prints if a.field_prints[k] != b.field_prints[k]] == ["description"]


def test_addresses_and_labels(spark):
    df = spark.createDataFrame([("Long Lane 12a, 12345 Old Town",), ("nowhere",), (None,)], "x string")
    assert [tuple(r.a) for r in df.select(address_parts("x").alias("a")).collect()] == [("Long Lane", "12a", "12345", "Old Town"), (None, None, None, None), (None, None, None, None)]
    t = spark.createDataFrame([("3 days ago",), ("new",), ("else",)], "x string").select(translate("x", {"new": "neu"}, [(r"(\d+) days ago", "vor $1 Tagen")]).alias("y"))
    assert [r.y for r in t.collect()] == ["vor 3 Tagen", "neu", "else"]
