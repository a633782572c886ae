"""Column functions on text: markup, white space, names, addresses of pages, identifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers see it, which is no single space already; Java's \s lacks the no-break space and the byte order mark.
UNEVEN = r"[\t\n\x0B\f\r\x{00A0}\x{FEFF}][\s\x{00A0}\x{FEFF}]*| [\s\x{00A0}\x{FEFF}]+"

#: Named references that feeds use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or(c: Column | str, default: str) -> Column:
    """The trimmed text; null, empty and blank count as missing."""
    return F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit(default))


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), UNEVEN, " "))


def decode_entities(c: Column | str) -> Column:
    """Named references by replacement, the ampersand last, so that nothing is decoded twice."""
    out = _col(c)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


#: Letters with marks, by their reference.
LETTERS = {
    "agrave": "à", "aacute": "á", "acirc": "â", "auml": "ä", "aring": "å", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "iacute": "í", "icirc": "î", "iuml": "ï",
    "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "ouml": "ö", "uacute": "ú", "ucirc": "û", "uuml": "ü", "szlig": "ß", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•", "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™", "times": "×",
}


def decode_references(c: Column | str) -> Column:
    """All references once: numbers in decimal and hexadecimal, letters with marks, and the named ones of decode_entities.

    Where a text has only the last, they are replaced; else it is cut at its references, each is decoded by itself, and what is none stays.
    """
    c, pattern = _col(c), r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    named = F.create_map(*[F.lit(x) for k, v in {**{f"&{k};": v for k, v in LETTERS.items()}, **dict(ENTITIES)}.items() for x in (k, v)])

    def one(r: Column) -> Column:
        digits = F.regexp_extract(r, "^&#([0-9]+);$", 1)
        code = F.when(digits != "", digits.try_cast("long")).otherwise(F.conv(F.regexp_extract(r, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10).try_cast("long"))
        # A code point as UTF-32 in hexadecimal; surrogates and what lies beyond are no characters.
        char = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(named[r], F.when(r.startswith("&#"), char), r)

    pieces = F.split(c, pattern, -1)
    parts = F.zip_with(pieces, F.concat(F.transform(found, one), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    common = "|".join(name[1:] for name, _ in ENTITIES)
    other = c.rlike(rf"&(?!{common})(?:#|[A-Za-z]{{2,8}};)")
    return F.when(~F.contains(c, F.lit("&")), c).when(other, F.array_join(parts, "")).otherwise(decode_entities(c))


def html_to_text(c: Column | str) -> Column:
    """Visible text: scripts and styles go, tags become spaces, references are decoded, and tags that were written as references go too."""
    c = _col(c)
    out = F.regexp_replace(c, r"(?is)<(script|style|svg|iframe|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    out = F.when(F.contains(c, F.lit("<")), out).otherwise(c)  # the three passes are for texts with markup
    return collapse(F.regexp_replace(decode_references(out), r"</?[A-Za-z][^<>]*>", " "))


@F.pandas_udf(StringType())
def html_unescape(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All named and numeric references; for texts where decode_entities is not enough."""
    import html

    for s in it:
        yield s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def nfkc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, which Spark has no function for."""
    import unicodedata

    for s in it:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def repair_mojibake(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-8 that was read as Latin-1: read anew if it has such a mark and the result is valid."""

    def one(x: str | None) -> str | None:
        if x is None or not any("\x80" <= c <= "\xff" for c in x):
            return x
        try:
            return x.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return x

    for s in it:
        yield s.map(one)


@F.pandas_udf(StringType())
def decode_euc_kr(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bodies in a charset that Spark's decode does not have; bad bytes become U+FFFD."""
    for s in it:
        yield s.map(lambda x: None if x is None else bytes(x).decode("euc-kr", "replace"))


def snippet(c: Column | str, most: int) -> Column:
    c = collapse(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def canonical_name(c: Column | str, drop: Sequence[str] = ()) -> Column:
    """Lower case; whole words of `drop` (legal forms and the like) go; signs become single spaces."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for word in drop:
        out = F.regexp_replace(out, f"(?<= ){word}(?= )", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def url_canonical(c: Column | str, keep: Sequence[str] = ()) -> Column:
    """Lower-cased scheme, host and path without a closing slash; of the query only the parameters
    of `keep`, in that order; no fragment.  What cannot be parsed is returned trimmed in lower case."""
    c = F.trim(_col(c))
    host = F.try_parse_url(c, F.lit("HOST"))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/+$", "")
    scheme = F.try_parse_url(c, F.lit("PROTOCOL"))
    pairs = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), v)) for k in keep for v in [F.try_parse_url(c, F.lit("QUERY"), F.lit(k))]]
    query = F.array_join(F.array_compact(F.array(*pairs)), "&") if pairs else F.lit("")
    whole = F.concat(F.lower(F.concat(scheme, F.lit("://"), host, path)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host.isNull() | scheme.isNull(), F.lower(c)).otherwise(whole)


def safe_public_url(c: Column | str, tracking: str = r"^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid|ref_src)(=|$)", most: int = 2048) -> Column:
    """An https address of a public host, without tracking parameters and fragment, else null."""
    c = F.trim(_col(c))
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    local = host.rlike(r"^(localhost|.*\.local|.*\.internal|[0-9.]+|\[.*\])$") | ~F.contains(host, F.lit("."))
    query = F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("QUERY")), F.lit("")), "&"), lambda p: ~F.lower(p).rlike(tracking) & (p != ""))
    bare = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), r"\?.*$", "")
    out = F.concat(bare, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))
    ok = c.rlike("(?i)^https://") & host.isNotNull() & ~local & F.try_parse_url(c, F.lit("USERINFO")).isNull() & (F.length(out) <= most)
    return F.when(ok, out)


def has_phrase(haystack: Column | str, phrase: str) -> Column:
    """ASCII phrases match between non-alphanumerics with any white space inside; others anywhere."""
    return phrase_in(F.lower(_col(haystack)), phrase)


def phrase_in(low: Column | str, phrase: str) -> Column:
    """has_phrase on a text in lower case, for many phrases of one text.

    The pattern begins with the first word and looks back when it is found: an alternative in front would be tried at each character."""
    low = _col(low)
    if not phrase.isascii():
        return F.contains(low, F.lit(phrase.lower()))
    words = phrase.lower().split() or [""]
    first, *rest = [re_escape(w) for w in words]
    pattern = r"\s+".join([f"{first}(?<![a-z0-9]{first})", *rest]) + "(?![a-z0-9])"
    return F.contains(low, F.lit(max(words, key=len))) & low.rlike(pattern)


def re_escape(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def stable_id(prefix: str, *parts: Column | str, length: int = 16, bits: int = 1) -> Column:
    """prefix and the head of a digest (bits: 1 for SHA-1, 256 for SHA-256) of the parts, nulls as empty."""
    joined = F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    digest = F.sha1(joined.cast("binary")) if bits == 1 else F.sha2(joined, bits)
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def clauses(c: Column | str) -> Column:
    """Sentences and their parts, for rules whose negation holds within a clause only."""
    return F.filter(F.transform(F.split(F.lower(_col(c)), r"[.,;:!?\n]+"), F.trim), lambda x: x != "")


def clause_requires(c: Column | str, pattern: str, veto: str) -> Column:
    """Some clause has the pattern and not the veto beside it."""
    return clause_in(clauses(c), pattern, veto)


def clause_in(parts: Column | str, pattern: str, veto: str) -> Column:
    """clause_requires on the clauses, for many patterns of one text."""
    return F.exists(_col(parts), lambda x: x.rlike(pattern) & ~x.rlike(veto))


def marker_votes(c: Column | str, families: Sequence[str]) -> Column:
    """How many of the marker families occur."""
    low = F.lower(_col(c))
    votes = F.lit(0)
    for family in families:
        votes = votes + low.rlike(family).cast("int")
    return votes
