"""Boards of several makes: nested JSON, embedded page data, dated feeds, pages of lists, details, curated rows, tours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import collapse, decode_references, html_to_text
from kelpline.operators.filters import first_reason
from kelpline.operators.rules import first_match
from kelpline.sources.landed import html_rows, tag, xml_rows

LEVER = "array<struct<id:string,text:string,hostedUrl:string,categories:struct<team:string,location:string,commitment:string,allLocations:array<string>>,lists:array<struct<text:string,content:string>>,descriptionPlain:string,country:string>>"
ASHBY = "struct<jobs:array<struct<id:string,title:string,isListed:boolean,isRemote:boolean,location:string,secondaryLocations:array<struct<location:string>>,jobUrl:string>>>"
GREENHOUSE = "struct<jobs:array<struct<id:long,title:string,content:string,absolute_url:string,location:struct<name:string>,metadata:array<struct<name:string,value:string>>>>>"
POSTS = "array<struct<id:long,link:string,title:struct<rendered:string>,content:struct<rendered:string>,_embedded:struct<`wp:term`:array<array<struct<taxonomy:string,name:string>>>>>>"


def _rows(landed: DataFrame, payload: str, rows: Column) -> DataFrame:
    rest = [c for c in landed.columns if c != payload]
    return landed.select(*rest, F.posexplode(rows).alias("pos", "r"))


def lever_board(landed: DataFrame, payload: str = "payload", eligible: Sequence[str] = ("korea", "worldwide", "unknown"), keep: Column | None = None) -> DataFrame:
    """Rows with their categories and lists flattened; kept if where they are open is eligible, and by the board's own
    condition (on id, title, team, location, commitment, details, open_to)."""
    r = F.col("r")
    t = _rows(landed, payload, F.from_json(payload, LEVER))
    places = F.array_compact(F.array_distinct(F.concat(F.array(r["categories"]["location"]), F.coalesce(r["categories"]["allLocations"], F.array().cast("array<string>")))))
    lists = F.array_join(F.transform(F.coalesce(r["lists"], F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws(": ", x["text"], html_to_text(x["content"]))), "\n")
    t = t.withColumn("places", places).select(
        *[c for c in t.columns if c != "r"], r["id"].alias("id"), r["text"].alias("title"), r["hostedUrl"].alias("url"), r["categories"]["team"].alias("team"), r["categories"]["commitment"].alias("commitment"),
        F.array_join("places", " / ").alias("location"), F.concat_ws("\n", F.nullif(r["descriptionPlain"], F.lit("")), F.nullif(lists, F.lit(""))).alias("details"),
        F.when(F.exists("places", lambda p: F.lower(p).rlike("korea|seoul")) | (r["country"] == "KR"), "korea").when(F.exists("places", lambda p: F.lower(p).rlike("worldwide|anywhere|global")), "worldwide")
        .when(F.size("places") == 0, "unknown").otherwise("elsewhere").alias("open_to"),
    )
    t = t.where(F.col("open_to").isin(*eligible))
    return t if keep is None else t.where(keep)


def ashby_board(landed: DataFrame, wanted: str, payload: str = "payload") -> DataFrame:
    """Listed rows with a place that matches the pattern, or remote ones; the label says the first such place and how many more there are."""
    r = F.col("r")
    t = _rows(landed, payload, F.from_json(payload, ASHBY)["jobs"]).where(F.coalesce(r["isListed"], F.lit(True)))
    places = F.array_compact(F.concat(F.array(r["location"]), F.coalesce(F.transform(r["secondaryLocations"], lambda s: s["location"]), F.array().cast("array<string>"))))
    t = t.withColumn("places", places).withColumn("hits", F.filter("places", lambda p: p.rlike(f"(?i){wanted}")))
    more = F.size("places") - 1
    label = F.when(F.size("hits") > 0, F.concat(F.get("hits", F.lit(0)), F.when(more > 0, F.concat(F.lit(" + "), more.cast("string"))).otherwise(F.lit("")))).when(r["isRemote"], "Remote")
    return t.where((F.size("hits") > 0) | F.coalesce(r["isRemote"], F.lit(False))).select(*[c for c in t.columns if c not in ("r", "places", "hits")], r["id"].alias("id"), r["title"].alias("title"), r["jobUrl"].alias("url"), label.alias("location"))


def greenhouse_board(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows with their content as text, whose markup is itself escaped, and their metadata as a map; of equal names the last counts."""
    r = F.col("r")
    t = _rows(landed, payload, F.from_json(payload, GREENHOUSE)["jobs"])
    pairs = F.filter(F.coalesce(r["metadata"], F.array().cast("array<struct<name:string,value:string>>")), lambda m: m["name"].isNotNull())
    last = F.filter(pairs, lambda m, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["name"] == m["name"]))
    return t.select(
        *[c for c in t.columns if c != "r"], r["id"].alias("id"), r["title"].alias("title"), r["absolute_url"].alias("url"), r["location"]["name"].alias("location"),
        html_to_text(decode_references(r["content"])).alias("text"), F.map_from_entries(last).alias("metadata"),
    )


def taxonomy_posts(landed: DataFrame, taxonomies: Sequence[str], payload: str = "payload") -> DataFrame:
    """Posts whose terms come in groups of groups: an array of names for each taxonomy, in their order."""
    r = F.col("r")
    t = _rows(landed, payload, F.from_json(payload, POSTS))
    terms = F.flatten(F.coalesce(r["_embedded"]["wp:term"], F.array().cast("array<array<struct<taxonomy:string,name:string>>>")))

    def names(kind: str) -> Column:
        return F.filter(F.transform(F.filter(terms, lambda x: x["taxonomy"] == kind), lambda x: collapse(x["name"])), lambda n: n != "").alias(kind)

    return t.select(*[c for c in t.columns if c != "r"], r["id"].alias("id"), r["link"].alias("url"), html_to_text(r["title"]["rendered"]).alias("title"), html_to_text(r["content"]["rendered"]).alias("text"), *[names(k) for k in taxonomies])


def post_place(countries: Column, tags: Column, text: Column) -> Column:
    """Where a post's work is: Worldwide by its tags, South Korea and how many countries more, its first three countries, or Remote."""
    worldwide, home = F.exists(tags, lambda x: x.rlike("(?i)worldwide")), F.exists(countries, lambda x: x.rlike("(?i)south korea|korea republic"))
    remote = F.exists(tags, lambda x: x.rlike("(?i)remote")) | text.rlike(r"(?i)\bremote\b|work from home")
    return (
        F.when(worldwide, "Worldwide").when(home & (F.size(countries) > 1), F.concat(F.lit("South Korea + "), (F.size(countries) - 1).cast("string"))).when(home, "South Korea")
        .when(F.size(countries) > 0, F.array_join(F.slice(countries, 1, 3), " / ")).when(remote, "Remote").otherwise("unknown")
    )


def embedded_rows(landed: DataFrame, keys: Sequence[str], fields: Mapping[str, str], payload: str = "payload", script: str = "__NEXT_DATA__") -> DataFrame:
    """Rows of every array, at any depth of the page's data script, whose first element has the keys.

    The tree is walked level by level until no level is left; malformed scripts give nothing.
    """
    raw = F.regexp_extract(F.col(payload), rf"""(?is)<script[^>]+id=["']{script}["'][^>]*>(.*?)</script>""", 1)
    rest = [c for c in landed.columns if c != payload]
    level, out = landed.select(*rest, F.try_parse_json(F.trim(raw)).alias("v")).where("v is not null"), None
    while True:
        arrays = level.select(*rest, F.try_variant_get("v", "$", "array<variant>").alias("a"), F.try_variant_get("v", "$", "map<string,variant>").alias("m"))
        has = F.lit(True)
        for k in keys:
            has = has & F.map_contains_key(F.try_variant_get(F.get("a", F.lit(0)), "$", "map<string,variant>"), k)
        found = arrays.where(F.col("a").isNotNull() & F.coalesce(has, F.lit(False))).select(*rest, F.explode("a").alias("o"))
        found = found.select(*rest, *[F.try_variant_get("o", path, "string").alias(n) for n, path in fields.items()])
        out = found if out is None else out.union(found)
        below = arrays.select(*rest, F.explode(F.coalesce("a", F.map_values("m"))).alias("v"))
        level = below.where("v is not null AND schema_of_variant(v) RLIKE '^(ARRAY|OBJECT)'")
        if level.isEmpty():
            return out


def union_slices(slices: Sequence[tuple[str, DataFrame]], url: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, counters) of the slices of one query: the first row of each address in the slices' order and their own, without
    expired ones (expires before now) and those without evidence of a place; per slice rows read, expired and kept."""
    every = None
    for k, (name, df) in enumerate(slices):
        df = df.withColumns({"slice": F.lit(name), "slice_ord": F.lit(k)})
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    every = every.withColumn("expired", F.coalesce(F.col("expires").cast("timestamp") < now.cast("timestamp"), F.lit(False)))
    good = every.where(~F.col("expired") & F.col("place").isNotNull())
    rest = [c for c in good.columns if c != url]
    kept = good.groupBy(url).agg(F.min_by(F.struct(*rest), F.struct("slice_ord", "pos")).alias("own")).select(url, "own.*").drop("expired")
    read = every.groupBy("slice").agg(F.count("*").alias("read"), F.count_if("expired").alias("expired"))
    return kept, read.join(kept.groupBy("slice").agg(F.count("*").alias("kept")), "slice", "left").na.fill(0, ["kept"])


def paged_rows(rows: DataFrame, source: str, key: str, size: int) -> DataFrame:
    """rows (source, page, pos, key, ...): pages after a source's first short one were not asked for; of rows with one key the last wins."""
    pages = rows.groupBy(source, "page").agg(F.count("*").alias("_n"))
    stop = pages.where(F.col("_n") < size).groupBy(source).agg(F.min("page").alias("_stop"))
    t = rows.join(stop, source, "left").where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_stop")
    rest = [c for c in t.columns if c not in (source, key)]
    return t.groupBy(source, key).agg(F.max_by(F.struct(*rest), F.struct("page", "pos")).alias("own")).select(source, key, "own.*")


#: Header of the one regional feed, and the places of it that count.
REGIONAL_TITLE = r"\[인크루트\]\s*채용정보\s*-\s*전북"
REGION = r"^(?:전북|전라북도|전북특별자치도)>(전주시(?:\s+(?:덕진구|완산구))?|완주군)$"
WEEKDAYS = "일월화수목금토"
HOUR = 3_600_000


def rss_deadline(label: Column, published: Column, posted: Column) -> Column:
    """A struct (type, date) of a "month/day(weekday)" label without a year: the one year about the feed's for which weekday,
    posting and feed agree; rolling for such labels; unknown otherwise.  published and posted: epoch milliseconds."""
    part = lambda k: F.regexp_extract(label, rf"^(\d{{1,2}})/(\d{{1,2}})\(([{WEEKDAYS}])\)$", k)
    year = F.year(F.timestamp_millis(published + 9 * HOUR))
    weekday = F.instr(F.lit(WEEKDAYS), part(3))

    def day(y: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd")

    def fits(d: Column) -> Column:
        closes = F.unix_date(d).cast("long") * 24 * HOUR - 9 * HOUR
        return d.isNotNull() & (F.dayofweek(d) == weekday) & (closes >= posted - 7 * 24 * HOUR) & closes.between(published - 90 * 24 * HOUR, published + 180 * 24 * HOUR)

    dates = F.filter(F.transform(F.sequence(year - 1, year + 1), day), fits)
    one = (part(1) != "") & (F.size(dates) == 1)
    return F.struct(F.when(label.isin("상시", "채용시"), "rolling").when(one, "fixed").otherwise("unknown").alias("type"), F.when(one, F.get(dates, F.lit(0))).alias("date"))


def regional_feed(landed: DataFrame, now: Column, payload: str = "payload", most: int = 20) -> DataFrame:
    """Items of a dated feed (source, payload): a known header, built within 48 hours; of its first `most` items, which is what
    this feed shows, those of exactly one wanted place, with a link, title, company and a date, each link once."""
    raw, at = F.col(payload), "d MMM yyyy HH:mm:ss Z"  # after the weekday
    millis = lambda c: F.unix_millis(F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, 0?", ""), F.lit(at)))
    now_ms, head = F.unix_millis(now.cast("timestamp")), F.split_part(raw, F.lit("<item>"), F.lit(1))
    feeds = landed.withColumn("published", millis(F.substring(tag(head, "lastBuildDate"), 1, 60)))
    known = raw.rlike(r"""^\s*<\?xml""") & raw.rlike(r"""(?i)<rss\b[^>]*version=["']2\.0["']""") & tag(head, "title").rlike(REGIONAL_TITLE)
    feeds = feeds.where(known & F.col("published").between(now_ms - 48 * HOUR, now_ms + HOUR))
    t = xml_rows(feeds, payload, "item", {"title": "title", "url": "link", "company": "author", "posted": "pubDate", "summary": "description"}).where(F.col("pos") < most)
    field = lambda name: collapse(F.regexp_extract("summary", rf"▨\s*{name}\s*:\s*([^<]*)", 1))
    places = F.filter(F.transform(F.split(field("지역"), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    t = t.withColumns({
        "id": F.regexp_extract("url", r"^https://job\.incruit\.com/jobdb_info/jobpost\.asp\?job=(\d+)$", 1), "title": F.trim(F.regexp_replace("title", r"^\[[^\]]{1,120}\]\s*", "")),
        "place": F.when(F.size(places) == 1, F.regexp_extract(F.get(places, F.lit(0)), REGION, 1)), "posted_ms": millis(F.col("posted")), "label": field("마감일"),
    })
    ok = (F.col("id") != "") & (F.coalesce("place", F.lit("")) != "") & (F.col("title") != "") & F.col("company").isNotNull() & (F.col("posted_ms") <= now_ms + HOUR)
    t = t.where(ok & ~F.col("title").rlike(r"(?i)인재\s*pool|인재풀|재택|원격|전국"))
    t = t.withColumn("deadline", rss_deadline(F.col("label"), F.col("published"), F.col("posted_ms")))
    own = F.min_by(F.struct("title", "company", "place", "url", F.col("deadline.type").alias("deadline_type"), F.col("deadline.date").alias("deadline")), "pos")
    rest = [c for c in landed.columns if c != payload]
    return t.groupBy(*rest, "id").agg(own.alias("own")).select(*rest, "id", "own.*")


def detail_rows(details: DataFrame, layers: Sequence[tuple[str, str]], rejections: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the posting of each detail page is the first of the layers (name, struct column) that has a title, and
    evidence says which; a page without any, or for which a check holds, is rejected with the first code that applies."""
    usable = [F.when(F.coalesce(F.col(f"{c}.title"), F.lit("")) != "", F.col(c)) for _, c in layers]
    basis = F.coalesce(*[F.when(u.isNotNull(), F.lit(name)) for u, (name, _) in zip(usable, layers, strict=True)])
    t = details.withColumns({"posting": F.coalesce(*usable), "evidence": basis})
    t = t.withColumn("reject", first_reason([("detail_structure", F.col("posting").isNull()), *rejections]))
    return t.where("reject IS NULL").drop("reject", *[c for _, c in layers]), t.where("reject IS NOT NULL").drop("posting", "evidence", *[c for _, c in layers])


def merged_candidates(candidates: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row a key: of each field the last value in the order that is not empty."""
    at = F.struct(*order)
    last = [F.max_by(F.nullif(F.col(f), F.lit("")), F.when(F.coalesce(F.col(f), F.lit("")) != "", at)).alias(f) for f in fields]
    return candidates.groupBy(key).agg(*last)


def with_list_fallback(details: DataFrame, listed: DataFrame, previous: DataFrame, key: str = "id", area: str = "area", fields: Sequence[str] = ("address", "pay")) -> DataFrame:
    """Detail rows, and list rows that no detail has, filled with the fields of the previous snapshot if that
    row lies in the same area; list rows without such a row before are left out."""
    p = previous.select(F.col(key).alias("_key"), F.col(area).alias("_area"), *[F.col(f).alias(f"_{f}") for f in fields])
    back = listed.join(details.select(key), key, "left_anti").join(p, (F.col(key) == F.col("_key")) & (F.col(area) == F.col("_area")))
    back = back.withColumns({f: F.coalesce(F.col(f), F.col(f"_{f}")) if f in listed.columns else F.col(f"_{f}") for f in fields}).drop("_key", "_area", *[f"_{f}" for f in fields])
    return details.withColumn("evidence", F.lit("detail")).unionByName(back.withColumn("evidence", F.lit("list_cached_detail")), allowMissingColumns=True)


def curated_rows(rows: DataFrame, now: Column, sources: Sequence[str], days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): hand-made rows (url, title, company, summary, source, workplace, reviewed_at, opening, deadline, withdrawn)
    that are whole, reviewed within the days and still open; a withdrawn row is a tombstone and is rejected as such."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("reviewed_at").cast("timestamp"))
    reject = first_reason([
        ("withdrawn", F.col("withdrawn")), ("source", ~F.coalesce(F.col("source").isin(*sources), F.lit(False))), ("url", ~F.coalesce(F.col("url").rlike(r"^https://[^/\s@]+\.[^/\s@]+"), F.lit(False))),
        ("fields", blank("title") | blank("company") | blank("summary")), ("workplace", ~F.coalesce(F.col("workplace").isin("remote", "onsite", "hybrid"), F.lit(False))),
        ("review", age.isNull() | (age < -5 * 60_000) | (age > days * 24 * HOUR)), ("opening", ~F.coalesce(F.col("opening").isin("listed", "unconfirmed"), F.lit(False))), ("deadline", F.col("deadline") < now.cast("date")),
    ])
    t = rows.withColumn("reject", reject)
    good = t.where("reject IS NULL").drop("reject", "withdrawn").withColumn("id", F.concat(F.lit("curated:"), F.substring(F.sha2("url", 256), 1, 20)))
    return good, t.where("reject IS NOT NULL")


TOUR = {
    "href": [r'href="([^"]+)"'], "title": [r'(?s)<strong class="pcal_tit">(.*?)</strong>'], "dates": [r'(?s)<span class="pcal_date">(.*?)</span>'], "place": [r'(?s)<span class="pcal_place">(.*?)</span>'],
    "start_date": [r'data-start="([^"]+)"'], "end_date": [r'data-end="([^"]+)"'],
}


def tour_list(landed: DataFrame, today: Column, payload: str = "payload") -> DataFrame:
    """Entries of a calendar that are not over, the first of each link."""
    t = html_rows(landed, payload, r'(?s)<li class="swiper-slide pcal_item"[^>]*>.*?</li>', TOUR, key="href")
    t = t.withColumns({c: F.try_to_date(c, "yyyy-MM-dd") for c in ("start_date", "end_date")})
    return t.where(F.coalesce("end_date", "start_date", F.lit("9999-12-31").cast("date")) >= today.cast("date"))


def tour_price(price: Column, free_mark: Column, text: Column) -> Column:
    """paid by an amount after a fee's name, free by a mark or word; both at once are unknown, as is neither."""
    paid = text.rlike(r"(?:입장료|참가비|수강료|체험비|이용료|관람료|참가\s*비용)[^0-9]{0,16}(?:\d{1,3}(?:,\d{3})+|\d{4,}|\d+\s*[만천])\s*원")
    paid = paid | F.coalesce(price.rlike(r"유료|\d[\d,]*\s*[만천]?\s*원|₩"), F.lit(False))
    free = F.coalesce(free_mark, F.lit(False)) | F.coalesce(price.rlike("무료"), F.lit(False))
    return F.when(paid & free, "unknown").when(paid, "paid").when(free, "free").when(price.rlike("[0-9]"), "paid").otherwise("unknown")


def tour_audience(text: Column) -> Column:
    """family, adult, child or anyone by what the text says; contradictions are unknown."""
    child, adult = text.rlike("어린이|초등|유아"), text.rlike("성인|어른")
    return F.when(text.rlike("가족"), "family").when(child & adult, "unknown").when(child, "child").when(adult, "adult").when(text.rlike(r"누구나|제한\s*없"), "anyone").otherwise("unknown")


# Words of an audience, by class, in the order in which classes are asked for; all patterns of a class must occur.
AUDIENCES = (
    ("with_children", (r"(어린이|유아|초등)\s*동반",)), ("anyone", (r"관광객|누구나|일반인|제한\s*없",)), ("adults", ("성인",)), ("families", ("가족",)), ("school_age_and_over", ("초등", "이상")), ("students", ("고등학생|중학생|청소년|학생",)),
    ("children", ("미취학|어린이|유아|초등",)), ("groups", ("기관|단체",)),
)
_AUDIENCE_LABEL = r"(?:참여\s*대상|모집\s*대상|참가\s*대상|교육\s*대상|대상)\s*[:：]?\s*([^。▶|]{1,60})"
NOT_FOR_ADULTS = ("children", "groups", "students", "with_children")


def audience_class(title: Column, text: Column) -> Column:
    """The first class whose words the title or the text behind an audience's label has, up to the next label; else not_stated."""
    stated = F.get(F.split(F.regexp_extract(collapse(F.coalesce(text, F.lit(""))), _AUDIENCE_LABEL, 1), "안내|문의|신청|일시|장소|비용|인원"), F.lit(0))
    signal = F.concat_ws(" ", title, stated)
    return first_match([(_all(signal, patterns), name) for name, patterns in AUDIENCES], "not_stated")


def _all(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & c.rlike(p)
    return out


def adults_can_join(audience: Column, title: Column) -> Column:
    """Neither the class nor, where no class says otherwise, a title that is for children keeps adults out."""
    childish = title.rlike(r"기관\s*단체|놀이터|어린이|유아|청소년|초등|학생") & ~title.rlike("가족|누구나|성인")
    return ~audience.isin(*NOT_FOR_ADULTS) & ~F.coalesce(childish, F.lit(False))


def price_status(price: Column, free_mark: Column, stated: Column) -> Column:
    """free, paid or unknown: a word or mark for free and one for a fee contradict each other, as does a stated status that the other one
    stands against; prices that vary or must be asked for are unknown; else what is stated, then what the price says."""
    value = F.trim(F.coalesce(price, F.lit("")))
    free = F.coalesce(free_mark, F.lit(False)) | value.rlike(r"^무료(?:\s|$)")
    paid = value.rlike(r"유료|(?:\d[\d,]*|\d+\s*[만천])\s*원|₩")
    rules = [((free & paid) | value.rlike(r"가격\s*변동|별도\s*문의|비용\s*문의"), "unknown"), ((stated == "free") & paid, "unknown"), ((stated == "paid") & free, "unknown"), (stated.isin("free", "paid", "unknown"), stated)]
    return first_match([*rules, (free, "free"), (paid, "paid")], "unknown")
