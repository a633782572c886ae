"""Pay that a text states: all amounts with what stands around them, the best of which counts.

A text is cut once at its amounts.  Each candidate has the words before and after it in its clause: a label, a unit of
time, words that make it an expense, a bound or an estimate.  A labelled amount comes before one that has a currency and a
unit only, and of equals the first counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.functions.text import collapse, re_escape
from kelpline.functions.values import once, parse_amount

# Currencies, units of time, labels, and phrases of pay without an amount.
CURRENCY_CODES = ("AED", "AUD", "BRL", "CAD", "CHF", "EUR", "GBP", "HKD", "INR", "JPY", "KRW", "PLN", "SGD", "USD", "USDT")
CURRENCY_SIGNS = {"$": "USD", "£": "GBP", "¥": "JPY", "₩": "KRW", "€": "EUR"}
UNITS = {
    "annual": "year", "annually": "year", "annum": "year", "daily": "day", "day": "day", "episode": "episode", "hour": "hour", "hourly": "hour", "hr": "hour", "month": "month", "monthly": "month", "project": "project",
    "week": "week", "weekly": "week", "year": "year", "yearly": "year",
}
LABELS = ("base salary", "compensation", "hourly rate", "pay", "pay rate", "rate", "remuneration", "salary")
LOCAL_UNITS = {"시급": "hour", "연봉": "year", "월급": "month", "일급": "day", "주급": "week"}
LOCAL_BOUNDS = {"이상": "minimum", "이하": "maximum"}
UNSTATED = (("fixed hourly", "fixed_hourly", "hour"), ("per completed set", "per_completed_set", "set"), ("paid per item", "per_task", "task"), ("paid per job", "per_task", "task"), ("paid per task", "per_task", "task"), ("task based compensation", "per_task", "task"))
#: How a pay is shown; a caller may give words of another language.
SHOWN = {
    "hour": "/시간", "day": "/일", "week": "/주", "month": "/월", "year": "/년", "project": "/프로젝트", "episode": "/에피소드", "no_unit": " · 주기 확인 필요", "maximum": "최대 ", "minimum": "최소 ", "approximate": "약 ",
    "per_task_equivalent": " · 건당 지급 환산", "fixed_hourly": "금액 비공개 · 시간당 고정 단가", "per_completed_set": "금액 비공개 · 완료 세트당 지급", "per_task": "금액 비공개 · 건별 지급", "no_currency": " · 통화/주기 확인 필요",
    "no_amount": " · 형식 확인 필요", "suspicious": " · 단위 확인 필요", "region": " 기준 ", "elsewhere": " · 기타 지역 단가 확인", "some_region": "특정 지역",
}

#: The first letters are tried before the codes.
_CURRENCY = "(?:(?<![a-z])(?=[" + "".join(sorted({c[0] for c in CURRENCY_CODES})) + "])(?:" + "|".join(sorted(CURRENCY_CODES, key=lambda c: (-len(c), c))) + ")(?![a-z])|[" + "".join(CURRENCY_SIGNS) + "])"
_NUMBER = r"\d[\d,.]*(?:\s*[km](?![a-z]))?"
_TO = r"\s*(?:[-–—]|to)\s*"
_UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")(?![a-z])"
_LABEL = "(?<![a-z])(?:" + "|".join(sorted(map(re_escape, LABELS), key=lambda w: (-len(w), w))) + ")(?![a-z])"
#: Four forms: currency first, currency last, and, where no amount can be told, a rate or a range of thousands or millions without a currency.
AMOUNT = (
    rf"(?i)({_CURRENCY})\s*({_NUMBER})(?:{_TO}(?:{_CURRENCY}\s*)?({_NUMBER}))?(?:\s*{_CURRENCY})?"
    rf"|({_NUMBER})(?:{_TO}({_NUMBER}))?\s*({_CURRENCY})"
    rf"|{_NUMBER}(?:{_TO}{_NUMBER})?(?=\s*(?:/|per\s+|an?\s+){_UNIT})"
    r"|\d+(?:[.,]\d+)?\s*[km]\s*[-–—]\s*\d+(?:[.,]\d+)?\s*[km](?![a-z])"
)
_WON = r"([0-9][0-9.,]*)\s*(만?)\s*원"
#: A word for a unit of time, an amount, perhaps a second one behind a sign or word for a range, perhaps a bound.
LOCAL = f"({'|'.join(LOCAL_UNITS)})[\\s:]*{_WON}(?:\\s*(?:부터|[-–—~])\\s*{_WON})?\\s*({'|'.join(LOCAL_BOUNDS)})?"

#: Between the pieces of what is cut; no amount has it.
_MARK = "\ufdd0"
_KIND = "struct<raw:string,currency:string,low:double,high:double,period:string,qualifier:string,payment_basis:string>"


def _of(table: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _sentences(c: Column) -> Column:
    return F.split(c, r"[;\n]|[.!?](?=\s|$)")


def _money(raw: Column, currency: Column, first: Column, second: Column, period: Column, qualifier: Column, basis: Column) -> Column:
    """A unit that only one of two amounts has, as in 75-90k, holds for both."""
    strip = lambda x: F.regexp_replace(F.lower(x), r"[\s.,]+$", "")
    unit = lambda x: F.regexp_extract(x, "([km])$", 1)
    amounts = F.struct(strip(first).alias("a"), strip(F.coalesce(second, F.lit(""))).alias("b"))
    told = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), *[f(x[k]).alias(n + k) for k in "ab" for n, f in (("unit_", unit), ("of_", parse_amount))])

    def shared(x: Column, k: str, other: str) -> Column:
        bare = (x["b"] != "") & (x[f"unit_{k}"] == "") & (x[f"of_{k}"] < 1000)
        return F.when(bare & ~F.coalesce(x[f"unit_{other}"] == "", F.lit(False)), parse_amount(F.concat(x[k], x[f"unit_{other}"]))).otherwise(x[f"of_{k}"])

    range_of = lambda x: F.struct(shared(x, "a", "b").alias("low"), F.when(x["b"] != "", shared(x, "b", "a")).alias("high"))
    return once(amounts, told, range_of, lambda x: F.struct(
        raw.alias("raw"), currency.alias("currency"), F.least(x["low"], x["high"]).alias("low"), F.greatest(x["low"], x["high"]).alias("high"), period.alias("period"), qualifier.alias("qualifier"), basis.alias("payment_basis")
    ))


def local_pay(c: Column) -> Column:
    """The first amount in 원 behind a word for an hour's, day's, week's, month's or year's pay, or null; 만 is ten thousand."""

    def read(found: Column) -> Column:
        part = lambda k: F.regexp_extract(found, LOCAL, k)
        amount = lambda k: parse_amount(_some(part(k))) * F.when(part(k + 1) == "만", 10_000.0).otherwise(1.0)

        def money(x: Column) -> Column:
            return F.struct(
                found.alias("raw"), F.lit("KRW").alias("currency"), F.least(x["a"], x["b"]).alias("low"), F.greatest(x["a"], x["b"]).alias("high"), _of(LOCAL_UNITS, part(1)).alias("period"), _of(LOCAL_BOUNDS, part(6)).alias("qualifier"),
                F.lit(None).cast("string").alias("payment_basis"),
            ).cast(_KIND)

        return F.when(found != "", once(F.struct(amount(2).alias("a"), amount(4).alias("b")), money))

    return once(F.when(F.contains(c, F.lit("원")), F.regexp_extract(c, LOCAL, 0)).otherwise(""), read)


def candidates(text: Column, explicit: Column) -> Column:
    """The amounts of a text as structs (score, place, money), in their order; score 0 and no money for what is no pay.

    explicit: the text is a field for pay, in which each amount counts, whatever stands around it."""

    def around(item: Column) -> Column:
        head = F.regexp_extract(F.right(item["before"], F.lit(100)), r"([^;\n]*)$", 1)
        tail = F.regexp_extract(F.left(item["after"], F.lit(100)), r"^((?:[^;\n.]|\.(?!\s|$))*)", 1)
        parts = F.split(F.regexp_replace(item["amount"], rf"(?s)^.*?(?:{AMOUNT}).*$", _MARK.join(["", *[f"${k}" for k in range(1, 7)]])), _MARK, -1)
        return F.struct(item["amount"].alias("amount"), item["place"].alias("place"), head.alias("head"), tail.alias("tail"), parts.alias("parts"))

    def cut_up(x: Column) -> Column:
        parts = [_some(F.get(x["parts"], F.lit(k))).alias(f"p{k}") for k in range(1, 7)]
        return F.struct(*[x[n].alias(n) for n in ("amount", "place", "head", "tail")], *parts)

    def named(x: Column) -> Column:
        labelled = F.regexp_extract(x["head"], rf"(?i)({_LABEL}(?:(?!{_LABEL}).)*)$", 1)
        currency = F.coalesce(x["p1"], x["p6"])
        return F.struct(x.alias("x"), labelled.alias("labelled"), F.coalesce(_of(CURRENCY_SIGNS, currency), F.upper(currency)).alias("code"), F.when(explicit, x["head"]).otherwise(labelled).alias("about"))

    def timed(y: Column) -> Column:
        unit = F.regexp_extract(F.concat_ws(" ", y["about"], y["x"]["tail"]), rf"(?i)(?<![a-z])({_UNIT})", 1)
        return F.struct(y.alias("y"), _of(UNITS, F.lower(_some(unit))).alias("period"))

    def scored(z: Column) -> Column:
        y, x, period = z["y"], z["y"]["x"], z["period"]
        head, tail, about, code, has_label = x["head"], x["tail"], y["about"], y["code"], y["labelled"] != ""
        expense = tail.rlike(r"(?i)^.{0,40}\byourself\b") | F.concat(head, tail).rlike(r"(?i)\bout[- ]of[- ]pocket\b") | head.rlike(r"(?i)\b(you|employee|candidate)s?\s+(pay|contribute)\b[^.]*$")
        rate = tail.rlike(rf"(?i)^\s*(/|per\s+|an?\s+){_UNIT}")
        is_pay = explicit | ((has_label | (code.isNotNull() & rate)) & ~expense)
        score = F.when(is_pay, 1 + 4 * has_label.cast("int") + 2 * code.isNotNull().cast("int") + period.isNotNull().cast("int")).otherwise(0)
        qualifier = F.when(about.rlike(r"(?i)\bup to\b"), "maximum").when(head.rlike(r"(?i)\b(about|approximately|approx\.?|around)[^0-9a-z]{0,16}$"), "approximate")
        basis = F.when(about.rlike(r"(?i)\bpaid per (item|job|task)\b"), "per_task_equivalent")
        money = _money(F.concat(about, x["amount"], tail), code, F.coalesce(x["p2"], x["p4"]), F.coalesce(x["p3"], x["p5"]), period, qualifier, basis)
        return once(score, lambda n: F.struct(n.alias("score"), (-x["place"]).alias("place"), F.when(n > 0, money).alias("money")))

    def read(cut: Column) -> Column:
        item = lambda amount, k: F.struct(amount.alias("amount"), k.alias("place"), F.get(cut["gaps"], k).alias("before"), F.get(cut["gaps"], k + 1).alias("after"))
        return F.transform(F.transform(cut["found"], item), lambda x: once(x, around, cut_up, named, timed, scored))

    # Amounts are found in one pass, with a mark on both sides, and a text that has the mark itself in two.
    marked = lambda c: F.split(F.regexp_replace(c, AMOUNT, f"{_MARK}$0{_MARK}"), _MARK, -1)
    each = lambda c: once(marked(c), lambda x: F.struct(F.filter(x, lambda _, k: k % 2 == 1).alias("found"), F.filter(x, lambda _, k: k % 2 == 0).alias("gaps")))
    plain = lambda c: F.struct(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)).alias("found"), F.split(c, AMOUNT, -1).alias("gaps"))
    return once(F.when(text.rlike("[0-9]"), text).otherwise(""), lambda c: F.when(F.contains(c, F.lit(_MARK)), plain(c)).otherwise(each(c)), read)


def regional_scope(text: Column) -> Column:
    """The places for whose candidates alone a pay is stated, if the text says that it differs elsewhere; else null."""
    behind = F.regexp_extract(text, r"(?i)candidates located in\s+(.*)$", 1)
    named = F.get(F.split(behind, r"(?i)\s+pay\b"), F.lit(0))
    where = F.when(F.length(named) <= 160, _some(F.regexp_replace(named, r"(?i)(,?\s+(base|starting|the))+$", "")))
    differs = F.contains(F.lower(text), F.lit("candidates located in")) & F.exists(_sentences(text), lambda s: s.rlike(r"(?i)\b(elsewhere|other locations?|outside)\b") & s.rlike(r"(?i)\b(differ|fall outside|vary)\b"))
    return F.when(differs, F.regexp_replace(where, ",$", ""))


def varies_by_place(text: Column) -> Column:
    """Some sentence says that a rate differs or is set by country or location."""
    words = [r"(?i)\b(compensation|rates?)\b", r"(?i)\b(determined|differs?|different|var(y|ies))\b", r"(?i)\b(country|location)\b"]
    return text.rlike(words[2]) & F.exists(_sentences(text), lambda s: s.rlike(words[0]) & s.rlike(words[1]) & s.rlike(words[2]))


def pay(stated: Column, description: Column, regions: Mapping[str, str] | None = None, shown: Mapping[str, str] | None = SHOWN) -> Column:
    """A struct (raw, currency, low, high, period, qualifier, payment_basis, confidence, scope, display) of a posting's pay.

    stated: its field for pay, which comes first; description: its text.  confidence: parsed; partial (no unit of time); suspicious (an
    hour's pay over 1,000, a year's under 1,000); raw (a currency or an amount is missing); regional_only; basis_only (it says how it
    pays, not how much); none.  regions: pattern of places -> their name, for a pay that holds there alone.  shown: words for display; without
    them there is no display.  Null texts count as empty.
    """
    def take(c: Column) -> Column:
        field, text = c["field"], c["text"]
        plain = F.regexp_replace(F.lower(text), "[- ]+", " ")
        unstated = once(plain, lambda w: F.coalesce(*[F.when(F.contains(w, F.lit(p)), F.struct(F.lit(b).alias("basis"), F.lit(u).alias("unit"))) for p, b, u in UNSTATED]))
        best = F.array_max(F.filter(candidates(F.when(field != "", field).otherwise(text), field != ""), lambda x: x["score"] > 0))
        return F.struct(
            best["money"].alias("money"), local_pay(F.concat_ws(" ", field, text)).alias("local"), F.when(field == "", regional_scope(text)).alias("region"), unstated.alias("unstated"), field.alias("field"),
            varies_by_place(text).alias("varies"),
        )

    def decide(x: Column) -> Column:
        m = F.coalesce(x["local"], x["money"])
        regional = F.coalesce(x["region"].isNotNull() & x["local"].isNull() & m["currency"].isNotNull(), F.lit(False))
        no_amount = m.isNull() & (x["field"] == "")
        basis = F.when(no_amount, x["unstated"]["basis"]).otherwise(m["payment_basis"])
        odd = F.coalesce(((m["period"] == "hour") & (m["high"] > 1000)) | ((m["period"] == "year") & (m["high"] < 1000)), F.lit(False)) & x["local"].isNull()
        confidence = (
            F.when(no_amount & x["unstated"].isNotNull(), "basis_only").when(no_amount, "none").when(m["currency"].isNull() | m["low"].isNull(), "raw").when(odd, "suspicious").when(regional, "regional_only")
            .when(m["period"].isNull(), "partial").otherwise("parsed")
        )
        scope = F.when(regional, "regional_only").when(~no_amount & x["local"].isNull() & x["varies"] & ~confidence.isin("raw", "suspicious"), "geography_dependent")
        raw = F.coalesce(m["raw"], _some(x["field"]))
        period = F.when(no_amount, x["unstated"]["unit"]).otherwise(m["period"])
        out = F.struct(*[c.alias(n) for n, c in (("raw", raw), ("currency", m["currency"]), ("low", m["low"]), ("high", m["high"]), ("period", period), ("qualifier", m["qualifier"]), ("payment_basis", basis), ("confidence", confidence), ("scope", scope))])
        return F.struct(out.alias("pay"), x["region"].alias("region"), F.when(x["field"] != "", x["field"]).otherwise(raw).alias("written"))

    def finish(x: Column) -> Column:
        p, word = x["pay"], lambda k: F.lit(shown[k])
        sign = F.coalesce(_of({v: k for k, v in CURRENCY_SIGNS.items()}, p["currency"]), F.concat(p["currency"], F.lit(" ")))
        number = lambda n: F.regexp_replace(F.format_number(n, 2), r"\.?0{1,2}$", "")
        amount = F.concat(sign, number(p["low"]), F.when(p["high"] != p["low"], F.concat(F.lit("–"), sign, number(p["high"]))).otherwise(F.lit("")))
        unit = F.coalesce(_of({k: shown[k] for k in {*UNITS.values()}}, p["period"]), word("no_unit"))
        bound = F.coalesce(_of({k: shown[k] for k in ("maximum", "minimum", "approximate")}, p["qualifier"]), F.lit(""))
        task = F.when((p["payment_basis"] == "per_task_equivalent") & (p["period"] == "hour"), word("per_task_equivalent")).otherwise(F.lit(""))
        whole = F.concat(bound, amount, unit, task)
        named = F.coalesce(*[F.when(F.lower(x["region"]).rlike(k), F.lit(v)) for k, v in (regions or {}).items()], _some(x["region"]), word("some_region"))
        display = (
            F.when(p["confidence"] == "none", "").when(p["confidence"] == "basis_only", _of({b: shown[b] for _, b, _ in UNSTATED}, p["payment_basis"]))
            .when(p["confidence"] == "raw", F.concat(x["written"], F.when(p["currency"].isNull(), word("no_currency")).otherwise(word("no_amount"))))
            .when(p["confidence"] == "suspicious", F.concat(x["written"], word("suspicious"))).when(p["confidence"] == "regional_only", F.concat(named, word("region"), whole, word("elsewhere"))).otherwise(whole)
        )
        return p.withField("display", display)

    read = F.struct(collapse(F.coalesce(stated, F.lit(""))).alias("field"), collapse(F.coalesce(description, F.lit(""))).alias("text"))
    return once(read, take, decide, finish if shown else lambda x: x["pay"])
