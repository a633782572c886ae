"""Duplicates of postings: when two rows are one posting, within a board's names and across platforms, and their merge.

Rows have: pos (unique, the order they came in), url, source, kind, mode, remote, eligibility, place (key of the
location), domestic (key of a place of work, empty if none), province, district, neighborhood, precise (the address is known),
address, company, title, role, relaxed (keys of the title), category, type, pay, deadline, posted_day, local, keywords (array),
host, score, status.  Keys are empty where nothing is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators.resolve import greedy_clusters, staged, survivors
from kelpline.operators.rules import first_match

OFFICIAL = ("official_ats", "official_platform", "official_government")
RANK = {"official_ats": 5, "official_government": 4, "official_platform": 3, "board": 2, "aggregator": 1}


class Pair:
    """Columns of two aliases and what they have in common."""

    def __init__(self, h: str, r: str) -> None:
        self.h, self.r = h, r

    def of(self, name: str) -> tuple[Column, Column]:
        return F.col(f"{self.h}.{name}"), F.col(f"{self.r}.{name}")

    def same(self, name: str) -> Column:
        a, b = self.of(name)
        return a == b

    def known(self, name: str) -> Column:
        """Both are known and the same."""
        a, b = self.of(name)
        return F.coalesce((a == b) & (a != ""), F.lit(False))

    def both(self, name: str, *values: str) -> Column:
        a, b = self.of(name)
        return a.isin(*values) & b.isin(*values)

    def either(self, name: str, *values: str) -> Column:
        a, b = self.of(name)
        return a.isin(*values) | b.isin(*values)


def same_category(p: Pair) -> Column:
    return p.known("category") & (p.of("category")[0] != "other")


def country_mirrors(p: Pair) -> Column:
    """Both are remote rows of the one board that repeats a posting on its hosts of several countries."""
    own = lambda s, m, host: (s == "Arbeitnow") & (m == "remote") & host.rlike(r"(^|\.)arbeitnow\.[a-z.]+$")
    (s1, s2), (m1, m2), (h1, h2) = p.of("source"), p.of("mode"), p.of("host")
    return own(s1, m1, h1) & own(s2, m2, h2)


def remote_pair(p: Pair) -> Column:
    """One official posting that is listed for the world and for Korea."""
    (a, b), (e1, e2) = p.of("remote"), p.of("eligibility")
    world = ((e1 == "worldwide") & (e2 == "korea")) | ((e1 == "korea") & (e2 == "worldwide"))
    return a & b & p.same("source") & p.both("kind", "official_ats") & world


def same_work_place(p: Pair) -> Column:
    """Local rows with different places of work that are one posting all the same."""
    (l1, l2), (precise1, precise2), (a1, a2), (pay1, pay2) = p.of("local"), p.of("precise"), p.of("address"), p.of("pay")
    base = l1 & l2 & p.known("province") & p.known("company") & p.known("title") & same_category(p)
    address1, address2 = F.when(precise1, a1).otherwise(""), F.when(precise2, a2).otherwise("")
    near = p.known("district") | p.known("neighborhood")
    one = precise1 | precise2
    verdict = first_match([
        ((address1 != "") & (address2 != "") & (address1 != address2), p.known("pay") & p.known("deadline") & near),
        ((pay1 != "") & (pay2 != "") & (pay1 != pay2) & ~one, F.lit(False)),
    ], p.known("pay") | ((address1 != "") & (address1 == address2)) | one | (p.known("deadline") & p.known("posted_day")))
    return base & verdict


def same_posting(h: str, r: str) -> Column:
    """Rows of one company and title: the first rule that applies decides."""
    p = Pair(h, r)
    (d1, d2), (k1, k2), (e1, e2) = p.of("domestic"), p.of("kind"), p.of("eligibility")
    place = p.same("place") | p.either("place", "remote")
    official_world = ((k1.isin(*OFFICIAL)) & (e1 == "worldwide")) | ((k2.isin(*OFFICIAL)) & (e2 == "worldwide"))
    return first_match([
        (country_mirrors(p) | remote_pair(p), F.lit(True)), ((d1 != "") & (d2 != "") & (d1 != d2), same_work_place(p)), (p.same("url"), F.lit(True)), ((d1 != "") | (d2 != ""), d1 == d2),
        (p.both("kind", *OFFICIAL), (e1 == e2) & p.same("place")), ((e1 == e2) & e1.isin("korea", "worldwide"), F.lit(True)), ((e1 == e2) & (e1 != "unknown"), p.same("place")),
        ((e1 == "unknown") | (e2 == "unknown"), place), (p.either("kind", *OFFICIAL), official_world),
    ], F.lit(False))


def same_across_platforms(h: str, r: str) -> Column:
    """Rows of one company, address and category: one role; one role but for experience, with one deadline and type; or one
    pay with one title or two words of roles in common."""
    p = Pair(h, r)
    words = F.size(F.array_intersect(*p.of("keywords"))) >= 2
    return p.known("role") | (p.known("relaxed") & p.known("deadline") & p.same("type")) | (p.known("pay") & (p.same("title") | words))


def _merged(df: DataFrame, cluster: str) -> DataFrame:
    """One row a cluster: the best source, score and date first; sources and addresses united, counts added, open if one is open."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("kind")], F.lit(0))
    order = [-rank, -F.col("score"), -F.coalesce(F.unix_date(F.col("posted_day").try_cast("date")), F.lit(0)), F.col("pos")]
    t = df.withColumn("open", F.col("status") == "verified_open").withColumn("first_pos", F.col(cluster))
    out = survivors(t, cluster, order, unions=["sources", "urls"], counts=["copies"], any_of=["open"])
    return out.withColumn("status", F.when(F.col("open"), "verified_open").otherwise(F.col("status"))).drop("open", cluster)


def dedupe(postings: DataFrame) -> DataFrame:
    """postings -> one row for each posting, with sources, urls (arrays) and copies.

    First within company and title (the address where one is unknown), then across platforms within company,
    address and category; rows without such a key pass through.  Both are greedy in the order of arrival.
    """
    named = (F.col("company") != "") & (F.col("title") != "")
    t = postings.withColumn("block", F.when(named, F.concat_ws("::", "company", "title")).otherwise(F.col("url")))
    t = staged(t.withColumns({"sources": F.array("source"), "urls": F.array("url"), "copies": F.lit(1)}), "postings")
    first = greedy_clusters(t, "pos", ["block"], ["pos"], same_posting)
    blocks = t.groupBy("block").agg(F.min("pos").alias("block_pos"))
    merged = staged(_merged(t.join(first, "pos"), "cluster").join(blocks, "block"), "merged")
    keyed = F.col("local") & F.col("precise") & (F.col("address") != "") & (F.col("company") != "") & ~F.col("category").isin("", "other")
    work = merged.where(keyed).withColumn("block", F.concat_ws("::", "company", "address", "category"))
    second = greedy_clusters(work, "pos", ["block"], ["block_pos", "first_pos"], same_across_platforms)
    return _merged(work.join(second, "pos"), "cluster").unionByName(merged.where(~keyed)).drop("block", "block_pos", "first_pos")
