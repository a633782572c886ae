"""Evidence on a row: slots of labelled text, conflicting statements, badges, labels, adapters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import collapse


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slot(c: Column | str, label: str, stops: Sequence[str] = (), most: int | None = None) -> Column:
    """What follows a label up to the next of the stop labels or a line's end, cut to `most` characters; null if blank."""
    end = "|".join([r"\n", *stops, "$"])
    found = collapse(F.regexp_extract(_col(c), rf"(?s)(?:{label})\s*[:=]?\s*(.*?)(?:{end})", 1))
    return F.nullif(F.rtrim(F.substring(found, 1, most)) if most else found, F.lit(""))


def items(c: Column | str, separators: str = r"[,;/·]") -> Column:
    """Distinct parts of a list in a text; a separator inside parentheses does not part."""
    raw = F.split(_col(c), rf"{separators}(?![^()]*\))")
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""))


def contexts(c: Column | str, term: str, before: int = 40, after: int = 60) -> Column:
    """Each mention of a term with some characters around it, mentions near each other included."""
    low = F.lower(_col(c))
    pieces, found = F.split(low, term, -1), F.regexp_extract_all(low, F.lit(term), F.lit(0))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own")))
    zero = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<at:int,own:int>>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + x["gap"]
        return F.struct((at + x["own"]).alias("end"), F.array_append(acc["all"], F.struct(at.alias("at"), x["own"].alias("own"))).alias("all"))

    places = F.aggregate(lengths, zero, step)["all"]
    return F.transform(places, lambda p: F.substr(low, F.greatest(p["at"] - before, F.lit(1)), p["own"] + after + F.least(p["at"] - 1, F.lit(before))))


def requirement(c: Column | str, term: str, required: str, optional: str) -> Column:
    """required if a mention's context says so and does not say optional; optional, mentioned or none."""
    found = contexts(c, term)
    must = F.exists(found, lambda x: x.rlike(required) & ~x.rlike(optional))
    may = F.exists(found, lambda x: x.rlike(optional))
    return F.when(F.size(found) == 0, "none").when(must, "required").when(may, "optional").otherwise("mentioned")


def prefer_verified(text: Column, metadata: Column, verified: Column) -> Column:
    """A struct (value, basis, conflict): what the text says beats metadata that nothing verifies."""
    conflict = text.isNotNull() & metadata.isNotNull() & (text != metadata)
    trust = F.coalesce(verified, F.lit(False))
    basis = F.when(trust & metadata.isNotNull(), "metadata").when(text.isNotNull(), "text").when(metadata.isNotNull(), "metadata_unverified").otherwise("none")
    value = F.when(basis.isin("metadata", "metadata_unverified"), metadata).otherwise(text)
    return F.struct(value.alias("value"), basis.alias("basis"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def recent_badges(history: Column, now: Column, labels: Mapping[str, str], days: int = 7, most: int = 3) -> Column:
    """Labels of the events of the last days, newest first, each once, at most `most`."""
    start = now.cast("timestamp") - F.make_dt_interval(F.lit(days))
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    fresh = F.filter(history, lambda e: (e["at"] >= start) & names[e["event"]].isNotNull())
    ordered = F.reverse(F.array_sort(fresh))
    return F.slice(F.array_distinct(F.transform(ordered, lambda e: names[e["event"]])), 1, most)


def label_of(c: Column | str, labels: Mapping[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[_col(c)], F.lit(other))


def adapt(df: DataFrame, renames: Mapping[str, str], defaults: Mapping[str, object]) -> DataFrame:
    """Columns of another schema under this one's names, with constants for those it lacks."""
    return df.select(*[F.col(a).alias(b) for a, b in renames.items()], *[F.lit(v).alias(k) for k, v in defaults.items()])


def preserved_failure(df: DataFrame, failed: Column, penalty: int = 20) -> DataFrame:
    """Rows of a failed source become source_error; only the first failure costs score."""
    first = failed & (F.col("status") != "source_error")
    return df.withColumn("score", F.when(first, F.greatest(F.lit(0), F.col("score") - penalty)).otherwise(F.col("score"))).withColumn(
        "status", F.when(failed, "source_error").otherwise(F.col("status"))
    )


def with_fallback(fresh: DataFrame, previous: DataFrame, key: str, ok: bool, curated: str) -> DataFrame:
    """On a failed run previous rows that are not curated come back, marked; fresh rows win."""
    t = fresh.withColumn("verification", F.lit("current"))
    if ok:
        return t
    back = previous.where(~F.col(curated)).join(fresh.select(key), key, "left_anti").withColumn("verification", F.lit("source_error"))
    return t.unionByName(back)


def review_event(reviewed: Column, previous: Column, status: Column) -> Column:
    """Curated rows move by their review's date, not by the run's: a newer review confirms, an equal one says nothing."""
    return F.when(previous.isNull(), "first_seen").when(reviewed > previous, F.when(status == "closed", "status_changed").otherwise("review_confirmed"))


def migrate(values: Column, rewrites: Sequence[tuple[Mapping[str, str], Mapping[str, str]]]) -> Column:
    """A map of filter values that equals an old default becomes the new one; others stay."""
    out = values
    for old, new in reversed(rewrites):
        as_map = lambda m: F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv])
        same = F.array_sort(F.map_entries(values)) == F.array_sort(F.map_entries(as_map(old)))
        out = F.when(same, as_map(new)).otherwise(out)
    return out


def trie_pattern(names: Sequence[str]) -> str:
    """One pattern for all names, by their common beginnings, so that a scan looks at each character of a text a few times,
    however many names there are.  Of names that begin alike the longest is taken; letters and digits of ASCII bound a name."""
    root: dict = {}
    for name in names:
        node = root
        for ch in name.lower():
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        ways = [("\\s+" if ch == " " else ch if ch.isalnum() else "\\" + ch) + pattern(node[ch]) for ch in sorted(node) if ch]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 and not ends else "(?:" + "|".join(ways) + ")"
        return f"(?:{one})?" if ends else one

    return f"(?<![a-z0-9]){pattern(root)}(?![a-z0-9])"


def named_mentions(text: Column | str, names: Mapping[str, str], before: int = 90, after: int = 90) -> Column:
    """Structs (code, name, before, after) of all names that a text mentions, in their order, with the characters around them.

    names: name -> code.  The text is scanned once for all names; contexts may overlap, and are copied mention by mention.  Null is as empty."""
    low = F.translate(F.lower(F.coalesce(_col(text), F.lit(""))), "\x01\x02", "  ")
    one = trie_pattern(list(names))
    # A place where a name begins; what stands before it, up to the text's start; the name; what follows, which the scan does not use up.
    scan = rf"(?s)(?={one})(?<=(.{{{before}}})|^(.{{0,{before - 1}}}))({one})(?=(.{{0,{after}}}))"
    cut = F.split(F.regexp_replace(low, scan, "\x01$1$2\x02$3\x02$4\x01"), "\x01")
    codes = F.create_map(*[F.lit(x) for name, code in names.items() for x in (name.lower(), code)])

    def read(piece: Column) -> Column:
        part = F.split(piece, "\x02")
        name = F.regexp_replace(F.get(part, F.lit(1)), r"\s+", " ")
        return F.struct(codes[name].alias("code"), name.alias("name"), F.get(part, F.lit(0)).alias("before"), F.get(part, F.lit(2)).alias("after"))

    return F.transform(F.filter(cut, lambda piece: F.contains(piece, F.lit("\x02"))), read)


def languages_asked(heading: Column, body: Column, explicit: Column, names: Mapping[str, str], cue: str, heading_cue: str, role: Column, around: int = 65) -> Column:
    """Codes of the languages that a posting asks for, in alphabetical order: those of its own field for languages; those of its heading, if the
    role is one of languages or the heading has the cue; and those of the text that stand near the cue."""
    codes = lambda mentions: F.transform(mentions, lambda m: m["code"])
    near = F.filter(named_mentions(body, names, around, around), lambda m: F.concat_ws(" ", m["before"], m["name"], m["after"]).rlike(cue))
    titled = F.when(F.coalesce(role, F.lit(False)) | F.lower(F.coalesce(heading, F.lit(""))).rlike(heading_cue), codes(named_mentions(heading, names, 1, 1))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(codes(near), titled, codes(named_mentions(explicit, names, 1, 1)))))


def language_verdict(asked: Column, levels: Mapping[str, str], role: Column) -> Column:
    """A struct (status, because) from the codes asked for and one's own levels (code -> native, fluent, advanced, intermediate, beginner or
    unverified): mismatch for languages one lacks, or is a beginner in where the role is one of languages; unknown where a level is not
    known or a beginner's, or nothing is asked for; else match.  because: the codes that decide."""
    level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]) if levels else F.create_map().cast("map<string,string>")
    known = ("native", "fluent", "advanced", "intermediate", "beginner", "unverified")
    lacking = F.filter(asked, lambda c: ~F.coalesce(level[c].isin(*known), F.lit(False)))
    weak = F.filter(asked, lambda c: F.coalesce((level[c] == "beginner") & role, F.lit(False)))
    unsure = F.filter(asked, lambda c: F.coalesce(level[c].isin("unverified", "beginner"), F.lit(False)))
    bad = F.concat(lacking, weak)
    status = F.when(F.size(asked) == 0, "unknown").when(F.size(bad) > 0, "mismatch").when(F.size(unsure) > 0, "unknown").otherwise("match")
    return F.struct(status.alias("status"), F.when(F.size(bad) > 0, bad).when(F.size(unsure) > 0, unsure).otherwise(asked).alias("because"))
