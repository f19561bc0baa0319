"""Format-preserving pseudonyms of personal numbers and dates, in native expressions only.

Candidates are found by one pattern, validated by kind, and replaced by an alternating Feistel
permutation of their kind's own domain, keyed with SHA-256: card numbers keep their length, separators
and check digit, telephone numbers their country code and punctuation, addresses stay addresses, dates
stay dates.  Equal values get equal pseudonyms in every document, and different values of one kind and
format different ones.  The local part of a mail address, which has no such domain, becomes 16 digits of
a keyed hash, so that different addresses differ but for a chance of 2**-64.

The key is a literal of the plan; spark.sql.redaction.string.regex keeps it out of plans that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.staging import column_or_null

#: A domain has at most 127 labels of 63 characters, so the pattern's depth is bounded too.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
_DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
_SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![A-Za-z0-9_.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
#: A group of digits in a longer number is not the start of another value.
_NO_OTHER = f"(?!{_EMAIL}|{_DATE}|{_SSN}|{_IP})"
_NO_LONG = "(?![ .-]?(?:[0-9][ -]?){12}[0-9])"
_PHONE_GROUP = f"[ .-]?{_NO_OTHER}[0-9]{{2,4}}"
#: After a phone: 8 to 15 digits back to its plus sign.
_PHONE_LENGTH = r"(?<=\+" + "[ .()-]{0,2}[0-9]" * 8 + "(?:[ .()-]{0,2}[0-9])?" * 7 + ")"
#: Patterns by kind, in the order in which they are tried at a place.  A phone with code +1 has ten more
#: digits; others have 8 to 15 digits in two or three groups, or pairs of digits, as many as fit.  The
#: card's pattern is a whole run of groups of digits, in which _cards finds the cards.
PATTERNS = {
    "email": _EMAIL,
    "phone": r"(?<![0-9+])\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:(?:[ .-]{_NO_OTHER}[0-9]{{2}}){{4,6}}|(?:{_PHONE_GROUP}){{2}}(?:{_NO_LONG}{_PHONE_GROUP})?)(?![0-9]){_PHONE_LENGTH})",
    "date": _DATE,
    "ssn": _SSN,
    "ip": _IP,
    "card": f"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -]{_NO_OTHER}[0-9]++)*+",
}
#: Country codes of one and of two digits; all others have three.
_COUNTRY_CODE = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|[0-9]{3}"
#: Cards in their usual groups are looked for first, then any 13 to 19 digits, the longest first.
_USUAL_CARDS = ("[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}")
_OTHER_CARDS = tuple(f"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1))
KINDS = tuple(PATTERNS)
_ANY = "|".join(PATTERNS.values())
ROUNDS = 10
#: 400 Gregorian years from 1800-01-01 have 146097 = 189 * 773 days.
_FIRST_DAY, _DATE_HIGH, _DATE_LOW = "1800-01-01", 189, 773


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _prf(key: str, tag: Column, i: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, a: Column, b: Column, tag: Column, key: str) -> Column:
    """A keyed permutation of the pairs (high, low) with 0 <= high < a and 0 <= low < b."""
    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(((s["h"] + _prf(key, tag, i, s["l"]) % a) % a).cast("long").alias("h"), s["l"].alias("l"))
        odd = F.struct(s["h"].alias("h"), ((s["l"] + _prf(key, tag, i, s["h"]) % b) % b).cast("long").alias("l"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _padded(number: Column, width: Column) -> Column:
    return F.substring(F.concat(F.lit("0" * 20), number.cast("string")), F.length(number.cast("string")) + 21 - width, width)


def _permuted_digits(digits: Column, tag: Column, key: str) -> Column:
    """Digits of the same number (2 to 18)."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = (F.length(digits) - u).cast("int")
    power = lambda n: F.element_at(F.array(*(F.lit(10**k) for k in range(1, 11))), n)
    moved = feistel(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, v).cast("long"), power(u), power(v), F.concat(tag, F.length(digits).cast("string")), key)
    return _let(moved, lambda m: F.concat(_padded(m["h"], u), _padded(m["l"], v)))


def _in_place(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one after the other."""
    return _let(digits, lambda d: _one_by_one(shape, d))


def _one_by_one(shape: Column, digits: Column) -> Column:
    one = lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("card"), key)
    # Of the ten possible check digits, one is right.
    checked = lambda b: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(b, c.cast("string"))), lambda n: F.call_function("luhn_check", n)), 1)
    return _in_place(value, _let(body, checked))


def _phone(value: Column, key: str) -> Column:
    """The country code is read from the digits, so that a number is the same however it is written."""
    digits = _digits(value)
    code = F.regexp_extract(digits, f"^({_COUNTRY_CODE})", 1)
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _in_place(value, F.concat(code, _permuted_digits(rest, F.lit("phone"), key)))


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    moved = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)
    octets = lambda m: (F.floor(m["h"] / 256), m["h"] % 256, F.floor(m["l"] / 256), m["l"] % 256)
    return _let(moved, lambda m: F.concat_ws(".", *(o.cast("string") for o in octets(m))))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    high = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = feistel(high, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    back = lambda m: F.concat_ws("-", _padded(m["h"] + F.when(m["h"] >= 665, 2).otherwise(1), F.lit(3)), _padded(F.floor(m["l"] / 9999) + 1, F.lit(2)), _padded(m["l"] % 9999 + 1, F.lit(4)))
    return _let(moved, back)


def _day(value: Column) -> Column:
    iso = F.when(value.contains("/"), F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))).otherwise(value)
    month_first = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2))
    found = iso.try_cast("date")
    return F.datediff(F.coalesce(found, F.when(value.contains("/"), month_first.try_cast("date"))), F.lit(_FIRST_DAY).cast("date"))


def _date(value: Column, key: str) -> Column:
    day = _day(value)
    moved = feistel(F.floor(day / _DATE_LOW), day % _DATE_LOW, F.lit(_DATE_HIGH), F.lit(_DATE_LOW), F.lit("date"), key)
    new = _let(moved, lambda m: F.date_add(F.lit(_FIRST_DAY).cast("date"), (m["h"] * _DATE_LOW + m["l"]).cast("int")).cast("string"))
    slashed = lambda n: F.concat_ws("/", F.substring(n, 9, 2), F.substring(n, 6, 2), F.substring(n, 1, 4))
    return _let(new, lambda n: F.when(value.contains("/"), slashed(n)).otherwise(n))


def _email(value: Column, key: str) -> Column:
    """The local part becomes as keyed and linked as the numbers, though not of its own length."""
    local = F.lower(value)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), local), 256), 1, 16), F.lit("@"), F.substring_index(value, "@", -1))


def kind_of(value: Column) -> Column:
    """The kind of a candidate that passes its kind's validation, else null; cards are found by _cards."""
    is_ = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    day = _day(value)
    return (
        F.when(is_("email"), "email")
        .when(is_("phone"), "phone")
        .when(is_("date") & (day >= 0) & (day < _DATE_HIGH * _DATE_LOW), "date")
        .when(is_("ssn"), "ssn")
        .when(is_("ip"), "ip")
    )


def _piece(value: Column, kind: Column) -> Column:
    return F.struct(value.alias("v"), kind.cast("string").alias("kind"))


def _cards(run: Column, patterns: tuple[str, ...]) -> Column:
    """A run of groups of digits as pieces (v, kind): the first group from which one of the patterns is a
    valid card, then the first after it, and so on, and what stands between them, of kind null."""
    groups = F.split(run, "(?<=[ -])")

    def card_at(own: Column) -> Column:
        """The card that starts with these groups, or null."""
        tried = F.array(*(F.regexp_extract(own, f"^({p})(?![0-9])", 1) for p in patterns))
        return F.try_element_at(F.filter(tried, lambda c: (c != "") & F.call_function("luhn_check", _digits(c))), F.lit(1))

    def step(state: Column, x: Column) -> Column:
        inside = state["skip"] > 0
        over = F.length(x["group"]) - state["skip"]
        after = F.when(over > 0, F.array(_piece(F.substring(x["group"], state["skip"] + 1, over), F.lit(None)))).otherwise(F.array().cast(_PIECES))
        here = F.when(inside, after).when(x["card"].isNotNull(), F.array(_piece(x["card"], F.lit("card")))).otherwise(F.array(_piece(x["group"], F.lit(None))))
        skip = F.when(inside, F.greatest(F.lit(0), -over)).when(x["card"].isNotNull(), F.greatest(F.lit(0), F.length(x["card"]) - F.length(x["group"]))).otherwise(0)
        # A card of one group leaves that group's separator.
        rest = F.when(~inside & x["card"].isNotNull() & (F.length(x["card"]) < F.length(x["group"])), F.array(_piece(F.substring(x["group"], -1, 1), F.lit(None)))).otherwise(F.array().cast(_PIECES))
        return F.struct(skip.cast("int").alias("skip"), F.concat(state["out"], here, rest).alias("out"))

    def scan(g: Column) -> Column:
        starts = F.transform(g, lambda group, i: F.struct(group.alias("group"), card_at(F.array_join(F.slice(g, i + 1, F.lit(19)), "")).alias("card")))
        return F.aggregate(starts, F.struct(F.lit(0).alias("skip"), F.array().cast(_PIECES).alias("out")), step, lambda s: s["out"])

    return _let(groups, scan)


_PIECES = "array<struct<v:string,kind:string>>"


def pieces(value: Column) -> Column:
    """A candidate as pieces (v, kind) that make it up: itself, or the cards of a run and the rest."""
    others = lambda p: F.when(p["kind"].isNull() & p["v"].rlike(PATTERNS["card"]), _cards(p["v"], _OTHER_CARDS)).otherwise(F.array(p))
    join = lambda run: F.flatten(F.transform(run, others))
    run = value.rlike(f"^(?:{PATTERNS['card']})$")
    # Groups between two usual cards are one run again.
    return _let(kind_of(value), lambda kind: F.when(kind.isNull() & run, join(_joined(_cards(value, _USUAL_CARDS)))).otherwise(F.array(_piece(value, kind))))


def _joined(run: Column) -> Column:
    """Pieces with neighbours of kind null made one."""
    def step(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        both = (F.size(out) > 0) & p["kind"].isNull() & last["kind"].isNull()
        return F.when(both, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(_piece(F.concat(last["v"], p["v"]), F.lit(None))))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(run, F.array().cast(_PIECES), step)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """What replaces a candidate of a kind; an unvalidated one stays as it is."""
    makers = {"email": _email, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}
    out = F.when(kind.isNull(), value)
    for name, make in makers.items():
        out = out.when(kind == name, make(value, key))
    return out


def pseudonymize(documents: DataFrame, key: str, counts: str = "n_") -> DataFrame:
    """documents with the personal numbers, dates and mail addresses of `text` replaced, and the columns
    n_<kind>: how many of each kind there were.

    Kinds: card (13 to 19 digits with a valid check digit), phone (+ and 8 to 15 digits), ssn, ip (dotted
    version 4), date (valid, 1800 to 2199; yyyy-mm-dd, or dd/mm/yyyy and else mm/dd/yyyy, written back as
    dd/mm/yyyy), email.  Candidates that fail their validation stay, and a value that stands next to other
    numbers is found all the same: cards start and end with a group of digits, and of several possible
    ones those in usual groups come first, then the earliest, then the longest.  Texts are processed whole; a null
    text stays null with counts 0, an empty one stays empty; repeated rows are treated alike; all other
    columns are kept (columns named n_<kind> are replaced); an empty table gives an empty result.
    """
    names = documents.columns
    frame = documents.toDF(*(f"c{k}" for k in range(len(names))))
    text = F.col(f"c{names.index('text')}").cast("string") if "text" in names else F.lit(None).cast("string")
    found = frame.withColumn("text", text).withColumn("matches", F.regexp_extract_all("text", F.lit(f"({_ANY})"), F.lit(0)))
    split = found.withColumn("pieces", F.transform("matches", pieces))
    kinds = split.withColumn("kinds", F.transform(F.flatten("pieces"), lambda p: p["kind"]))
    replaced = F.transform("pieces", lambda m: F.array_join(F.transform(m, lambda p: pseudonym(p["v"], p["kind"], key)), ""))
    between = F.split("text", _ANY, -1)
    joined = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size("matches")).alias("t"), replaced.alias("r")), lambda x: F.concat(x["t"], x["r"])), ""), F.element_at(between, -1))
    clean = F.when(F.size("matches") > 0, joined).otherwise(F.col("text"))
    of_kind = lambda kind: F.filter("kinds", lambda k: k == F.lit(kind))
    count = {f"{counts}{kind}": F.coalesce(F.size(of_kind(kind)), F.lit(0)) for kind in KINDS}
    count = {name: F.when(F.col("text").isNull(), 0).otherwise(c).cast("long") for name, c in count.items()}
    kept = [(clean if name == "text" else F.col(f"c{k}")).alias(name) for k, name in enumerate(names) if name not in count]
    return kinds.select(*kept, *(c.alias(name) for name, c in count.items()))
