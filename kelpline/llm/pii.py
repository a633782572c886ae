"""Private data: detected entities are replaced by keyed surrogates of the same form.

E-mail addresses, phone, card, account (IBAN) and social security numbers, IPv4 and IPv6 addresses, keys by their
prefix, secrets after a key name and personal names after a title are found by patterns, and names that a text gives
a title once are found in the rest of it.  An entity is known by its canonical form (case and separators do
not matter), so that it gets one surrogate everywhere; of a name each part is an entity, so that "Mr Smith" is still
the one whom the text called John Smith.  A surrogate is drawn from a keyed digest and keeps type and format: digits
stay digits in their places, check digits fit, an address keeps its case, a name keeps the gender of its title and
its script.  Two entities never share a surrogate, and no surrogate is itself an entity of the corpus: those that
collide are drawn again.

Only built-in functions run here.  Distinct entities are shuffled, and of the texts only those
that hold any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import drop_staged, prepare, stage

KEY = "surrogates-1"
DRAWS = 64

FEMALE = ("Anna", "Clara", "Elena", "Ines", "Julia", "Laura", "Marie", "Nora", "Paula", "Sophie")
MALE = ("Adam", "Bruno", "David", "Emil", "Hugo", "Jonas", "Karl", "Louis", "Pablo", "Tomas")
SURNAMES = ("Berg", "Blanc", "Costa", "Klein", "Lang", "Marin", "Morel", "Rios", "Roth", "Sala", "Serra", "Stone", "Vega", "Vidal", "Vogt", "Weber")
SYLLABLES = ("ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve")
FEMALE_CYRILLIC = ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга")
MALE_CYRILLIC = ("Антон", "Виктор", "Егор", "Иван", "Павел", "Юрий")
SURNAMES_CYRILLIC = ("Бажан", "Деркач", "Коваль", "Мороз", "Савич", "Ткач", "Шевчук", "Юрченко")
SYLLABLES_CYRILLIC = ("ба", "де", "ви", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве")

_NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}+"
_F, _M = r"Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra", r"Mr|Monsieur|Herr|Señor|Sr"
_F_CYRILLIC, _M_CYRILLIC = r"[Гг]оспожа", r"[Гг]осподин"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SECRET = r"(?:token|secret|api[_-]?key|password|passwd)"
_MARK = r"[\p{L}\p{N}._%+-]"
_CARD, _SSN = r"(?:[0-9]{4}[ -]?){3}[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_PREFIX = r"(?:(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj[-_])?|gh[opsur]_|xox[abpr]-|AKIA)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:"
#: kind -> (what comes before it, the entity itself, what may not follow); the first that matches at a place wins.
KINDS: dict[str, tuple[str, str, str]] = {
    "email": (rf"(?<!{_MARK})", rf"[\p{{L}}\p{{N}}]{_MARK}{{0,80}}+@[A-Za-z0-9][A-Za-z0-9-]{{0,62}}(?:\.[A-Za-z0-9-]{{1,62}}){{0,5}}\.[A-Za-z]{{2,24}}", ""),
    "key": (r"(?<![A-Za-z0-9_-])", rf"{_PREFIX}[A-Za-z0-9_-]{{16,200}}+", ""),
    "secret": (rf"(?i:{_SECRET} {{0,2}}[=:] {{0,2}}[\"'])", r"[A-Za-z0-9_+/=.-]{8,256}+", "(?!@)"),
    "ipv6": (r"(?<![0-9A-Za-z:.])", rf"(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{_IPV6})", r"(?![0-9A-Za-z:])"),
    "ip": (r"(?<![0-9.])", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"(?![0-9]|\.[0-9])"),
    "iban": (r"(?<![A-Za-z0-9])", rf"(?=(?:[A-Z]{{0,6}} ?[0-9]){{8}}){_IBAN}", r"(?![A-Za-z0-9])"),
    "card": (r"(?<![0-9])", _CARD, r"(?![0-9])"),
    "ssn": (r"(?<![0-9-])", _SSN, r"(?![0-9-])"),
    "phone": (r"(?<![0-9+])", _PHONE, r"(?![0-9])"),
    "female_cyrillic": (rf"{_F_CYRILLIC} ", _NAME, ""),
    "male_cyrillic": (rf"{_M_CYRILLIC} ", _NAME, ""),
    "female": (rf"\b(?:{_F})\.? ", _NAME, ""),
    "male": (rf"\b(?:{_M})\.? ", _NAME, ""),
}
NUMBERS = ("card", "ssn", "phone")
NAMES = ("female", "male", "female_cyrillic", "male_cyrillic")
ANY = "|".join(f"({before})({own}){after}" for before, own, after in KINDS.values())
#: Kinds that few texts hold, and a cheaper pattern for the rest: each alternative is tried at each place of a text.
RARE = ("key", "ipv6", "iban")
COMMON = "|".join(f"({before})({own}){after}" for kind, (before, own, after) in KINDS.items() if kind not in RARE)
RARE_MARK = rf"{_PREFIX}|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|:[0-9A-Fa-f]{{1,4}}:|[A-Z]{{2}}[0-9]{{2}}"
#: Characters and words without one of which a text holds no entity.
MARKS = ("@", "=", ":", "sk-", "pk-", "rk-", "sk_", "pk_", "rk_", "gh", "xox", "AKIA", *f"{_F}|{_M}".split("|"), _F_CYRILLIC[4:], _M_CYRILLIC[4:])


def may_hold() -> Column:
    """A cheap look at a text: plain searches and one for digits."""
    out = F.col("text").rlike("[0-9]")
    for mark in MARKS:
        out = out | F.contains("text", F.lit(mark))
    return F.coalesce(out, F.lit(False))


def kind_of(entity: Column, before: Column) -> Column:
    """The kind of a mention, from itself or from the end of what stands before it; null for a name without a title."""
    after = lambda pattern: before.rlike(f"{pattern}$")
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(after(rf"(?i:{_SECRET} {{0,2}}[=:] {{0,2}}[\"'])"), "secret")
        .when(entity.rlike(rf"^{_PREFIX}[A-Za-z0-9_-]{{16,}}$"), "key")
        .when(entity.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(entity.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(entity.rlike(f"^{_IBAN}$"), "iban")
        .when(entity.rlike(f"^{_CARD}$"), "card")
        .when(entity.rlike(f"^{_SSN}$"), "ssn")
        .when(entity.rlike(f"^{_PHONE}$"), "phone")
        .when(after(f"{_F_CYRILLIC} "), "female_cyrillic")
        .when(after(f"{_M_CYRILLIC} "), "male_cyrillic")
        .when(after(rf"\b(?:{_F})\.? "), "female")
        .when(after(rf"\b(?:{_M})\.? "), "male")
    )


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(entity)
    )


def _n(digest: Column, word: int) -> Column:
    """The word-th 32 bits of a digest in hex."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")


def _pick(names: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def _same_shape(seed: Column, value: Column, hexadecimal: bool = False) -> Column:
    """Digits become digits and letters ASCII letters of their case; the rest stays.  hexadecimal: digits and letters to f become such."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 8).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("#"), b.cast("string")), 256))

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substr(F.get(blocks, F.floor(i / 8).cast("int")), (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("long")
        if hexadecimal:
            return F.when(c.rlike("^[0-9a-f]$"), F.lower(F.hex(n % 16))).otherwise(c)
        digit, upper = F.char(n % 10 + 48), F.char(n % 26 + 65)
        return F.when(c.rlike("^[0-9]$"), digit).when(c.rlike(r"^\p{Lu}$"), upper).when(c.rlike(r"^\p{L}$"), F.lower(upper)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn(digits: Column) -> Column:
    """The sum that a valid card number has at a multiple of 10."""

    def one(c: Column, i: Column) -> Column:
        d = c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)  # i counts from the right
        return F.floor(d / 10) + d % 10

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0).cast("long"), lambda total, d: total + d)


def _valid_card(digits: Column, was: Column) -> Column:
    """With a last digit that fits, if that of the card it stands for does."""
    open_ = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    fits = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((10 - luhn(open_) % 10) % 10).cast("string"))
    return F.when(luhn(was) % 10 == 0, fits).otherwise(digits)


def _valid_iban(country: Column, rest: Column) -> Column:
    """Country, check digits of that rest, rest (ISO 7064: the whole is 1 modulo 97)."""
    text = F.concat(rest, country, F.lit("00"))
    digits = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    left = F.aggregate(F.split(digits, ""), F.lit(0), lambda r, c: (r * 10 + c.try_cast("int")) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def surrogate(key: str) -> Column:
    """From the columns kind, canon and draw."""
    kind, canon, draw = F.col("kind"), F.col("canon"), F.col("draw")
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string"))
    d = F.sha2(seed, 256)

    def name(listed, syllables):
        # The first draws take a listed name, the later ones make one of ever more syllables.
        made = F.concat(*[F.when(draw >= 2 + k, _pick(syllables, _n(d, 2 + k))).otherwise(F.lit("")) for k in range(6)])
        return F.when(draw < 2, _pick(listed, _n(d, 0))).otherwise(F.initcap(F.concat(_pick(syllables, _n(d, 0)), _pick(syllables, _n(d, 1)), made)))

    mail = F.concat(_same_shape(seed, F.substring_index(canon, "@", 1)), F.lit("@"), _same_shape(F.concat(seed, F.lit("@")), F.regexp_replace(F.substring_index(canon, "@", -1), r"[^.]*$", "")), F.lit("example"))
    # Reserved addresses first; where they are used up, any that no entity has.
    first = F.when(draw < 16, _n(d, 3) % 16 + 240).otherwise(_n(d, 3) % 256)
    ip = F.concat_ws(".", first.cast("string"), *[(_n(d, k) % 256).cast("string") for k in range(3)])
    prefix = F.regexp_extract(canon, f"^{_PREFIX}", 0)
    shape = _same_shape(seed, canon)
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", _same_shape(seed, canon, hexadecimal=True))
        .when(kind == "iban", _valid_iban(F.left(canon, F.lit(2)), F.substr(shape, F.lit(5))))
        .when(kind == "card", _valid_card(shape, canon))
        .when(kind == "key", F.concat(prefix, _same_shape(seed, F.substr(canon, F.length(prefix) + 1))))
        .when(kind == "given_female", name(FEMALE, SYLLABLES))
        .when(kind == "given_male", name(MALE, SYLLABLES))
        .when(kind == "surname", name(SURNAMES, SYLLABLES))
        .when(kind == "given_female_cyrillic", name(FEMALE_CYRILLIC, SYLLABLES_CYRILLIC))
        .when(kind == "given_male_cyrillic", name(MALE_CYRILLIC, SYLLABLES_CYRILLIC))
        .when(kind == "surname_cyrillic", name(SURNAMES_CYRILLIC, SYLLABLES_CYRILLIC))
        .otherwise(shape)
    )


def draw_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (kind, canon), distinct and staged -> kind, canon, surrogate.

    Each round draws for the entities without one.  A draw is lost if it is an entity, if it was
    given before, or if an entity with a lesser digest draws the same in this round.
    """
    open_, given = entities.withColumn("draw", F.lit(0)), None
    taken = entities.select(F.col("canon").alias("surrogate"))
    for draw in range(DRAWS):
        drawn = open_.withColumn("draw", F.lit(draw)).withColumn("surrogate", surrogate(key))
        free = drawn.join(taken, "surrogate", "left_anti")
        if given is not None:
            free = free.join(given.select("surrogate"), "surrogate", "left_anti")
        order = F.struct(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon"), 256), "kind", "canon")
        won = stage(free.groupBy("surrogate").agg(F.min_by(F.struct("kind", "canon"), order).alias("own")).select("own.*", "surrogate"), "surrogates")
        before = given
        given = won if before is None else stage(before.unionByName(won), "surrogates")
        if before is not None:
            drop_staged(before)
            drop_staged(won)
        then, open_ = open_, stage(open_.select("kind", "canon").join(given, ["kind", "canon"], "left_anti"), "open-entities")
        if draw:
            drop_staged(then)
        if open_.isEmpty():
            return given
    raise RuntimeError(f"entities still collide after {DRAWS} draws")


def rendered(kind: Column, entity: Column, surrogate_: Column) -> Column:
    """The surrogate in the form of this mention: its separators, country code and case."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    new = F.concat(F.substr(digits, F.lit(1), F.greatest(F.length(digits) - F.length(surrogate_), F.lit(0))), surrogate_)

    def spread(between: Column, chars: Column) -> Column:
        return F.array_join(F.zip_with(between, F.concat(F.split(chars, ""), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    same_case = F.when(entity == F.upper(entity), F.upper(surrogate_)).otherwise(surrogate_)
    return (
        F.when(kind.isin(*NUMBERS), spread(F.split(entity, "[0-9]", -1), new))
        .when(kind == "iban", spread(F.split(entity, "[A-Z0-9]", -1), surrogate_))
        .when(kind.isin("email", "ipv6"), same_case)
        .otherwise(surrogate_)
    )


def _only(kind: str):
    return lambda k: F.when(k == kind, k)


def _kinds(parts: Column) -> Column:
    """Of parts, which are text and mentions in turn, the kind of each mention and null for each text."""
    return F.transform(parts, lambda x, i: F.when(i % 2 == 1, kind_of(x, F.right(F.get(parts, i - 1), F.lit(32)))))


def _marked(held: DataFrame) -> DataFrame:
    """held (text, ...) with parts: the text cut into text and mentions in turn, by one pass of the patterns.

    Mentions stand between marks, which hold a digest of the text so that no text has its own.
    """
    mark = F.concat(F.lit("\x01"), F.lower(F.hex(F.xxhash64("text"))), F.lit("\x01"))

    def replaced(pattern: str, kinds: int) -> Column:
        # Of the groups, what comes before an entity and the entity in turn, those of one alternative hold something.
        before, own = ("".join(f"${k}" for k in range(start, 2 * kinds + 1, 2)) for start in (1, 2))
        return F.regexp_replace("text", F.lit(pattern), F.concat(F.lit(before), "mark", F.lit(own), "mark"))

    once = F.when(F.col("text").rlike(RARE_MARK), replaced(ANY, len(KINDS))).otherwise(replaced(COMMON, len(KINDS) - len(RARE)))
    return held.withColumn("mark", mark).withColumn("parts", F.split(once, F.col("mark"), -1))


def _with_names(seen: DataFrame) -> DataFrame:
    """Of texts with full names after a title, the parts with their other mentions as well."""
    full = F.filter(F.arrays_zip(F.col("parts").alias("name"), F.col("kinds").alias("kind")), lambda p: p["kind"].isin(*NAMES) & F.contains(p["name"], F.lit(" ")))
    seen = seen.withColumn("titled", full)
    names = F.array_sort(F.array_distinct(F.transform("titled", lambda p: p["name"])), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<![\p{L}\x01])(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    again = seen.where(F.size("titled") > 0)
    again = again.withColumn("marked", F.regexp_replace(F.expr("array_join(parts, mark)"), pattern, F.concat("mark", F.lit("$0"), "mark")))
    again = again.withColumn("parts", F.split("marked", F.col("mark"), -1)).drop("marked").withColumn("kinds", _kinds(F.col("parts")))
    known = lambda name: F.get(F.filter("titled", lambda p: p["name"] == name), F.lit(0))["kind"]
    again = again.withColumn("kinds", F.transform("kinds", lambda k, i: F.when(i % 2 == 1, F.coalesce(k, known(F.get("parts", i))))))
    return seen.where(F.size("titled") == 0).unionByName(again).drop("titled")


def _name_parts(seen: DataFrame) -> DataFrame:
    """Names cut into given names and surname, each a mention of its own kind; one name alone is a surname."""
    is_name = lambda i: F.coalesce(F.get("kinds", i).isin(*NAMES), F.lit(False))

    def cut(x: Column, i: Column) -> Column:
        words = F.split(x, " ")
        spaced = F.slice(F.flatten(F.transform(words, lambda w: F.array(w, F.lit(" ")))), F.lit(1), 2 * F.size(words) - 1)
        return F.when(is_name(i), spaced).otherwise(F.array(x))

    def cut_kind(k: Column, i: Column) -> Column:
        words = F.split(F.get("parts", i), " ")
        script = F.when(F.endswith(k, F.lit("_cyrillic")), "_cyrillic").otherwise("")
        own = F.transform(words, lambda w, n: F.when(n == F.size(words) - 1, F.concat(F.lit("surname"), script)).otherwise(F.concat(F.lit("given_"), k)))
        spaced = F.slice(F.flatten(F.transform(own, lambda w: F.array(w, F.lit(None).cast("string")))), F.lit(1), 2 * F.size(words) - 1)
        return F.when(is_name(i), spaced).otherwise(F.array(k))

    counts = [F.size(F.array_compact(F.transform("kinds", _only(kind)))).alias(f"n_{kind}") for kind in KINDS]
    total = F.size(F.array_compact(F.col("kinds"))).alias("n_entities")
    # One column after the other: a lambda in a select would see the new `parts`.
    seen = seen.select("doc_id", "row", "parts", "kinds", total, *counts).withColumn("own", F.flatten(F.transform("kinds", cut_kind)))
    return seen.withColumn("parts", F.flatten(F.transform("parts", cut))).drop("kinds").withColumnRenamed("own", "kinds")


def replace_private(docs: DataFrame, id_col: str = "doc_id", key: str = KEY) -> DataFrame:
    """docs (id_col, text) -> doc_id, text with surrogates, n_entities, and n_<kind> for each kind.

    Null texts stay null and empty ones empty; ids may be null or repeat, each row is treated by
    itself; texts are read whole, however long and however many mentions they hold; an empty table gives an
    empty result.  Texts without entities are as they were.  Other columns are not read and may have any name.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), "text")
    held = base.where(may_hold()).withColumn("row", F.monotonically_increasing_id())
    held = stage(_marked(held).select("doc_id", "row", "mark", "parts"), "private")
    seen = held.where(F.size("parts") > 1).withColumn("kinds", _kinds(F.col("parts")))
    seen = stage(_name_parts(_with_names(seen)), "private-parts")
    mentions = F.transform("parts", lambda x, i: F.when(F.get("kinds", i).isNotNull(), F.struct(i.alias("at"), F.get("kinds", i).alias("kind"), x.alias("entity"))))
    each = seen.select("row", F.explode(F.array_compact(mentions)).alias("m")).select("row", "m.*").withColumn("canon", canonical(F.col("kind"), F.col("entity")))
    entities = stage(each.select("kind", "canon").distinct(), "entities")
    given = draw_surrogates(entities, key)
    new = each.join(given, ["kind", "canon"]).select("row", "at", rendered(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("new"))
    news = new.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda n: n["new"]).alias("news"))
    # Text and mentions in turn: the n-th mention is part 2 n + 1.
    masked = F.array_join(F.transform("parts", lambda x, i: F.when(F.get("kinds", i).isNotNull(), F.get("news", F.floor(i / 2).cast("int"))).otherwise(x)), "")
    changed = seen.join(news, "row").select("doc_id", masked.alias("text"), "n_entities", *[f"n_{kind}" for kind in KINDS])
    none = [F.lit(0).alias(f"n_{kind}") for kind in KINDS]
    # The rows without entities are not shuffled: those that were looked into, and those that need not be.
    looked = held.where(F.size("parts") == 1).select("doc_id", F.get("parts", F.lit(0)).alias("text"), F.lit(0).alias("n_entities"), *none)
    clean = base.where(~may_hold()).select("doc_id", "text", F.lit(0).alias("n_entities"), *none)
    return changed.unionByName(looked).unionByName(clean)
