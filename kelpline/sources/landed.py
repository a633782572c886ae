"""Rows out of landed payloads: JSON boards, XML and RSS lists, HTML lists, JSON-LD, alert mails.

Nothing is fetched here: payloads are rows of a table (source, payload, ...) that something else
landed.  Broken payloads give no rows and can be counted with `decode_status`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import collapse, decode_references, html_to_text

POSTING = "struct<id:string,title:string,company:string,location:string,url:string,posted:string,pay:string,tags:array<string>>"


def json_board(landed: DataFrame, payload: str = "payload", row: str = POSTING, keys: Sequence[str] = ("jobs", "data", "results")) -> DataFrame:
    """The rows of boards that come as {"jobs": [...]}, {"data": [...]} and the like, or as an array,
    whose first element may be a note without an id.  Adds pos, the row's place in its payload."""
    wrapped = [F.from_json(payload, f"struct<{k}:array<{row}>>")[k] for k in keys]
    listed = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, f"array<{row}>")).otherwise(F.coalesce(*wrapped))
    rest = [c for c in landed.columns if c != payload]
    return landed.select(*rest, F.posexplode(listed).alias("pos", "r")).select(*rest, "pos", "r.*").where("id is not null")


def tag(block: Column, name: str) -> Column:
    """Text of the first such element, CDATA and references resolved; null if absent or blank."""
    raw = F.regexp_extract(block, rf"(?s)<{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.nullif(collapse(decode_references(raw)), F.lit(""))


def xml_rows(landed: DataFrame, payload: str, row_tag: str, fields: Mapping[str, str]) -> DataFrame:
    """A row for each row_tag element with the named child elements."""
    blocks = F.regexp_extract_all(F.col(payload), F.lit(rf"(?s)<{row_tag}(?:\s[^>]*)?>(.*?)</{row_tag}>"), F.lit(1))
    rest = [c for c in landed.columns if c != payload]
    each = landed.select(*rest, F.posexplode(blocks).alias("pos", "block"))
    return each.select(*rest, "pos", *[tag(F.col("block"), t).alias(n) for n, t in fields.items()])


def rss_items(landed: DataFrame, payload: str = "payload", most: int | None = None) -> DataFrame:
    """Items of feeds; "Company: Title" is split, the id is the head of the link's digest.

    most: items of each feed that count, from the first; None for all (20 in A16's feed alone)."""
    t = xml_rows(landed, payload, "item", {"title": "title", "url": "link", "posted": "pubDate", "summary": "description"})
    if most is not None:
        t = t.where(F.col("pos") < most)
    company = F.nullif(F.regexp_extract("title", r"^([^:]{1,80}):\s+\S", 1), F.lit(""))
    return t.withColumn("company", company).withColumn("title", F.regexp_replace("title", r"^[^:]{1,80}:\s+(?=\S)", "")).withColumn("id", F.substring(F.sha1(F.col("url").cast("binary")), 1, 16))


def html_rows(landed: DataFrame, payload: str, block: str, fields: Mapping[str, Sequence[str]], key: str = "id") -> DataFrame:
    """A row for each match of the block pattern; a field is the first of its patterns that finds text.

    Of rows with one key in a payload the first wins; rows without a key go.
    """
    rest = [c for c in landed.columns if c != payload]
    each = landed.select(*rest, F.posexplode(F.regexp_extract_all(F.col(payload), F.lit(block), F.lit(0))).alias("pos", "block"))
    found = {n: F.coalesce(*[F.nullif(html_to_text(F.regexp_extract("block", p, 1)), F.lit("")) for p in ps]) for n, ps in fields.items()}
    t = each.select(*rest, "pos", *[c.alias(n) for n, c in found.items()]).where(F.col(key).isNotNull())
    own = F.min_by(F.struct("pos", *[n for n in fields if n != key]), "pos")
    return t.groupBy(*rest, key).agg(own.alias("own")).select(*rest, key, "own.*")


def json_ld(landed: DataFrame, payload: str, kind: str, fields: Mapping[str, str]) -> DataFrame:
    """Objects of a type in the page's JSON-LD scripts: at the root, in an array or in @graph.

    fields: name -> JSON path.  Malformed scripts are passed over.
    """
    script = rf"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    rest = [c for c in landed.columns if c != payload]
    each = landed.select(*rest, F.explode(F.regexp_extract_all(F.col(payload), F.lit(script), F.lit(1))).alias("script"))
    v = each.select(*rest, F.try_parse_json("script").alias("v")).where("v is not null")
    listed = F.coalesce(
        F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", '$["@graph"]', "array<variant>"), F.array(F.col("v"))
    )
    objects = v.select(*rest, F.explode(listed).alias("o"))
    types = F.coalesce(F.try_variant_get("o", '$["@type"]', "array<string>"), F.array(F.try_variant_get("o", '$["@type"]', "string")))
    return objects.where(F.array_contains(types, kind)).select(*rest, *[F.try_variant_get("o", p, "string").alias(n) for n, p in fields.items()])


def alert_mail(landed: DataFrame, body: str = "payload", link: str = r"\[([^\]\n]{3,200})\]\((https?://[^)\s]+/(\d{4,})[^)\s]*)\)(?:\s*\n\s*([^\n\[]+))?") -> DataFrame:
    """Markdown links of alert mails with the line that follows: title, url, id and label; the first of an id wins."""
    rest = [c for c in landed.columns if c != body]
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(body), F.lit(link), F.lit(k)).alias(n) for k, n in enumerate(("title", "url", "id", "label"), 1)])
    each = landed.select(*rest, F.posexplode(parts).alias("pos", "m")).select(*rest, "pos", "m.*")
    own = F.min_by(F.struct("pos", "title", "url", "label"), "pos")
    out = each.groupBy(*rest, "id").agg(own.alias("own")).select(*rest, "id", "own.*")
    return out.withColumn("label", F.nullif(F.trim("label"), F.lit("")))


def decode_status(landed: DataFrame, rows: DataFrame, key: str = "source") -> DataFrame:
    """For each source its payloads, rows and status: ok, partial (some payload gave none) or error."""
    hit = rows.groupBy(key).agg(F.count("*").alias("rows"), F.countDistinct("payload_id").alias("hit"))
    t = landed.groupBy(key).agg(F.countDistinct("payload_id").alias("payloads")).join(hit, key, "left")
    t = t.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("hit", F.coalesce("hit", F.lit(0)))
    status = F.when(F.col("hit") == 0, "error").when(F.col("hit") < F.col("payloads"), "partial").otherwise("ok")
    return t.select(key, "payloads", "rows", status.alias("status"))


def union_sources(frames: Sequence[tuple[str, DataFrame]], order: str = "pos") -> DataFrame:
    """Union in declaration order, which the columns source_ord and row_ord carry."""
    out = None
    for k, (name, df) in enumerate(frames):
        df = df.withColumn("source", F.lit(name)).withColumn("source_ord", F.lit(k)).withColumnRenamed(order, "row_ord")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def cached_responses(saved: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Saved responses that are young enough, failures included; the newest for each request."""
    young = saved.where(F.unix_millis(now.cast("timestamp")) - F.unix_millis("saved_at") <= hours * 3_600_000)
    rest = [c for c in saved.columns if c != "request"]
    return young.groupBy("request").agg(F.max_by(F.struct(*rest), "saved_at").alias("own")).select("request", "own.*")
