"""Personal data replaced by format-preserving Feistel pseudonyms.

Values are found by pattern and validated: card numbers by their Luhn digit, IPv4 octets by range, dates by the calendar,
social security numbers by the ranges that are given out. Each is mapped by a keyed permutation of its own format, so a pseudonym
is again a valid value of that format, different values of a format stay different, and equal values have one pseudonym in all
documents, however they are spaced.

* Characters (e-mail local parts, digits of cards and of phone numbers abroad): a Feistel network over the two halves of the letters
  and digits; in each of `ROUNDS` rounds one half's characters move within their class (a-z, A-Z, 0-9) by a keyed hash of the
  other half. Signs and case stay. A card keeps its issuer (six digits), and its last digit is its new Luhn digit. A phone
  number keeps its country code and the next digit.
* Numbers: the same over two residues. Ten-digit phone numbers of the North American plan stay in it (800 area codes x
  8,000,000), social security numbers in theirs (898 areas x 99 groups, 9,999 serials). An IPv4 address stays in its block (private,
  loopback, link-local, multicast and above) or among all others.
* Dates are days of one 400-year cycle (189 x 773). Those of a written form (which part is the day; how many digits each has)
  are a subset of these, and the permutation is repeated until it meets the subset again, which keeps it one to one. Month-first
  dates are those whose second part is over 12; their pseudonyms' is, too. After `WALK` turns in vain (of a chance below
  1e-20) a value keeps the last one.

Values may stand beside other digits ("2 4111-1111-1111-1111", lists of phone numbers): card numbers of the usual groupings are
looked for at each group of digits, and only those with a right Luhn digit take part in the search with the other kinds, so a
run of digits that is no card hides nothing. Those that begin as issuers' numbers do come first. What is left between the
values is searched again for other numbers of these groupings, and then for 13 to 19 digits grouped in any way, where a run
is taken from its start only: a number of an unusual grouping right behind other digits isn't told from them, and stays.

Everything is DataFrame functions: the text is split at the values, values are mapped within the row, and the parts are
joined again; no shuffle.

Defined results: a null text stays null and counts 0; an empty text stays empty; values that fail validation stay; repeated
rows are treated each for itself; an empty table gives an empty result; a date that may be read both ways is day-first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_or_empty
from lexmill.llm.spans import let

ROUNDS = 8
WALK = 240
#: The digits of a card number that name its issuer.
ISSUER = 6
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-3]?[0-9]([./])[0-3]?[0-9]\1(?:1[89]|2[01])[0-9]{2}(?![0-9]|[./][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
NEAR_PHONE = r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: The groups of a far phone number stop before a card number; %s is for the card numbers of the text.
FAR_PHONE = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?%s\(?[0-9]{1,4}\)?){2,5}(?![0-9])"
PHONE = f"{NEAR_PHONE}|{FAR_PHONE % ''}"
KINDS = {"email": EMAIL, "ip": IPV4, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ssn": SSN, "card": CARD, "phone": PHONE}
#: The day-first pattern refers to its own group, which stays the first as no other has one.
ANY = "|".join(KINDS.values())
BEFORE_CARDS = "|".join(KINDS[k] for k in ("email", "ip", "iso_date", "day_date", "ssn"))
#: The digits from each beginning of a group on, one more at least than a card may have.
GROUP_STARTS = r"(?<![0-9])(?=([0-9](?:[ -]?[0-9]){12,24}))"
#: Usual groupings of card numbers, with one kind of sign between the groups; the first that is valid counts.
GROUPINGS = [[4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3], [4, 3, 3, 3], [6, 13], [8, 11]]
LONG = [4, 4, 4, 4, 3]
CARD_FORMS = [
    "6[0-9]{3}" + "|6[0-9]{3}".join("".join(f"{sign}[0-9]{{{n}}}" for n in LONG[1:]) for sign in " -"),
    *["|".join(sign.join(f"[0-9]{{{n}}}" for n in sizes) for sign in " -") for sizes in GROUPINGS],
    "[0-9]{13,19}",
]
#: How issuers' numbers begin; others are valid, too, but less sure beside other digits.
ISSUED = "^(?:[3-6]|2[2-7])"
#: Texts without any of these hold no value.
SOME = r"@|[0-9][0-9 ().+/-]{5}"
CYCLE = (189, 773)
# Special blocks of IPv4 addresses, as first address and bits that vary in it.
BLOCKS = (("0.0.0.0", 24), ("10.0.0.0", 24), ("127.0.0.0", 24), ("169.254.0.0", 16), ("172.16.0.0", 20), ("192.168.0.0", 16), ("224.0.0.0", 29))
# Country codes of one and of two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"


def _number(*parts: Column) -> Column:
    """A keyed hash as a number below 2**48."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long")


def permuted(left: Column, right: Column, a: int | Column, b: int | Column, key: str, name: str | Column) -> Column:
    """struct(l, r): a permutation of the pairs of residues (mod a, mod b)."""
    own = F.concat(F.lit(f"{key}|"), F.lit(name) if isinstance(name, str) else name)

    def turn(acc: Column, i: Column) -> Column:
        salt = lambda half: _number(own, i.cast("string"), half.cast("string"))
        return F.when(i % 2 == 0, F.struct(((acc["l"] + salt(acc["r"])) % a).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), ((acc["r"] + salt(acc["l"])) % b).alias("r"))
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def shifted(chars: Column, other: Column, i: Column, key: str) -> Column:
    """`chars` with each letter or digit moved within its class by the keyed hash of `other`."""
    salt = F.concat_ws("|", F.lit(key), i.cast("string"), F.length(chars).cast("string"), F.lower(other))
    stream = F.concat(F.sha2(salt, 256), F.sha2(F.concat(salt, F.lit("+")), 256))

    def move(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(stream, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        to = lambda first, n: F.char(F.lit(first) + (code - first + by) % n)
        return F.when(c.rlike("[0-9]"), to(48, 10)).when(c.rlike("[a-z]"), to(97, 26)).when(c.rlike("[A-Z]"), to(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(chars, ""), move), "")


def permuted_chars(value: Column, key: str) -> Column:
    """The Feistel network over the halves of a string of letters and digits; a single one moves by the key alone."""
    half = F.floor(F.length(value) / 2).cast("int")

    def turn(acc: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(acc["l"], acc["r"], i, key).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], acc["l"], i, key).alias("r")))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _refilled(shape: Column, chars: Column) -> Column:
    """`shape` with its letters and digits replaced in turn by those of `chars`."""
    place = lambda j: F.length(F.regexp_replace(F.substring(shape, F.lit(1), j + 1), "[^A-Za-z0-9]", ""))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, j: F.when(c.rlike("[A-Za-z0-9]"), F.substring(chars, place(j), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column, own_check: bool) -> Column:
    """The Luhn sum of a string of digits, the last being the check digit or, else, the one before it."""
    n = F.length(digits)

    def add(acc: Column, c: Column, j: Column) -> Column:
        d = c.cast("int")
        doubled = (n - j) % 2 == (0 if own_check else 1)
        return F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), lambda c, j: add(c, c, j)), F.lit(0), lambda acc, x: acc + x)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.concat(F.substring(digits, F.lit(1), F.lit(ISSUER)), permuted_chars(F.substring(digits, F.lit(ISSUER + 1), F.length(digits) - ISSUER - 1), f"{key}|card"))
    check = ((10 - luhn_sum(body, False) % 10) % 10).cast("string")
    return F.when(luhn_sum(digits, True) % 10 == 0, _refilled(m, F.concat(body, check))).otherwise(m)


def _valid_cards(found: Column) -> Column:
    """Those of an array of strings that have a right Luhn digit."""
    return F.filter(found, lambda m: (m != "") & (luhn_sum(F.regexp_replace(m, "[^0-9]", ""), True) % 10 == 0))


def _usual_cards(t: Column) -> Column:
    """All valid card numbers of the usual groupings, also those that overlap."""
    form = lambda w: F.array(*[F.regexp_extract(w, f"^(?:{x})(?![0-9])", 0) for x in CARD_FORMS])
    return _valid_cards(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(GROUP_STARTS), F.lit(1)), form))))


def _either(numbers: Column) -> Column:
    """A pattern of any of the numbers; it never matches when there are none."""
    return F.when(F.size(numbers) > 0, F.concat(F.lit("(?<![0-9])(?:"), F.array_join(numbers, "|"), F.lit(")(?![0-9])"))).otherwise(F.lit("(?!)"))


def patterned(clean: DataFrame, some: Column) -> DataFrame:
    """With a column `pattern`: what the values of each text `t` match, its card numbers literally."""
    t, none = F.col("t"), F.array().cast("array<string>")
    carded = clean.withColumn("digits", some & t.rlike(CARD))
    issued = F.filter(_usual_cards(t), lambda m: m.rlike(ISSUED))
    known = carded.withColumn("cards", _either(F.when(F.col("digits"), issued).otherwise(none)))
    before, after = FAR_PHONE.split("%s")
    first = known.withColumn("first", F.concat(F.lit(f"{BEFORE_CARDS}|"), "cards", F.lit(f"|{NEAR_PHONE}|{before}(?!"), "cards", F.lit(f"){after}")))
    left = lambda g: F.concat(_usual_cards(g), _valid_cards(F.regexp_extract_all(g, F.lit(CARD), F.lit(0))))
    rest = F.array_distinct(F.flatten(F.transform(F.filter(F.split(t, F.col("first"), -1), lambda g: g.rlike(CARD)), left)))
    other = first.withColumn("other", F.when(F.col("digits"), rest).otherwise(none))
    return other.withColumn("pattern", F.when(F.size("other") > 0, F.concat("first", F.lit("|"), _either(F.col("other")))).otherwise(F.col("first")))


def walked(start: Column, turn: Callable[[Column], Column], accepted: Callable[[Column], Column]) -> Column:
    """turn(turn(...(start))), at least once, until it is accepted: a permutation of the accepted values if `turn` is one of all."""

    def step(acc: Column, _: Column) -> Column:
        moved = let(turn(acc["at"]), lambda x: F.struct(x.alias("at"), accepted(x).alias("done")))
        return F.when(acc["done"], acc).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.alias("at"), F.lit(False).alias("done")), step, lambda acc: acc["at"])


_FIRST_DAY = "1800-01-01"


def _moved_day(day: Column, accepted: Callable[[Column], Column], key: str, name: str | Column) -> Column:
    """Another day of the cycle, which `accepted` holds for as it does for `day`."""
    date_of = lambda n: F.date_add(F.lit(_FIRST_DAY).cast("date"), n.cast("int"))
    turn = lambda n: let(permuted(n % CYCLE[0], F.floor(n / CYCLE[0]), *CYCLE, key, name), lambda x: x["r"] * CYCLE[0] + x["l"])
    return date_of(walked(F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long"), turn, lambda n: accepted(date_of(n))))


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    y, m, d = year.cast("int"), month.cast("int"), day.cast("int")
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _iso_date(m: Column, key: str) -> Column:
    day = _valid_date(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))
    return F.when(day.isNull(), m).otherwise(F.date_format(_moved_day(day, lambda d: F.lit(True), key, "iso"), "yyyy-MM-dd"))


def _written_date(m: Column, key: str) -> Column:
    """Dates of three parts; the day comes first where that is a valid reading."""
    a, b, year = (F.element_at(F.split(m, "[./]"), k) for k in (1, 2, 3))
    sign = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
    day, month_first = _valid_date(year, b, a), _valid_date(year, a, b)
    fits = lambda part, n: (F.length(part) == 2) | (n <= 9)
    part = lambda own, n: F.lpad(n.cast("string"), F.length(own), "0")
    name = lambda order: F.concat(F.lit(order), sign, F.length(a).cast("string"), F.length(b).cast("string"))
    shown = lambda d, x, y: F.concat(part(a, x(d)), sign, part(b, y(d)), sign, F.year(d).cast("string"))
    by_day = _moved_day(day, lambda d: fits(a, F.dayofmonth(d)) & fits(b, F.month(d)), key, name("day"))
    by_month = _moved_day(month_first, lambda d: fits(a, F.month(d)) & (F.dayofmonth(d) > 12), key, name("month"))
    moved = F.when(day.isNotNull(), let(by_day, lambda d: shown(d, F.dayofmonth, F.month))).otherwise(let(by_month, lambda d: shown(d, F.month, F.dayofmonth)))
    return F.when(day.isNull() & month_first.isNull(), m).otherwise(moved)


def _ip(m: Column, key: str) -> Column:
    octet = lambda text, k: F.element_at(F.split(text, r"\."), k).cast("long")
    number = ((octet(m, 1) * 256 + octet(m, 2)) * 256 + octet(m, 3)) * 256 + octet(m, 4)
    first_of = lambda ip: sum(int(x) << s for x, s in zip(ip.split("."), (24, 16, 8, 0), strict=True))
    blocks = [(first_of(ip), bits) for ip, bits in BLOCKS]
    inside = lambda n, first, bits: (n >= first) & (n < first + (1 << bits))

    def special(n: Column) -> Column:
        out = F.lit(False)
        for start, bits in blocks:
            out = out | inside(n, start, bits)
        return out

    def space(n: Column) -> Column:
        """Where n moves: its block, or all numbers."""
        first, a, b = F.lit(0), F.lit(1 << 16), F.lit(1 << 16)
        for start, bits in blocks:
            here = inside(n, start, bits)
            first, a, b = F.when(here, start).otherwise(first), F.when(here, 1 << bits // 2).otherwise(a), F.when(here, 1 << bits - bits // 2).otherwise(b)
        return F.struct(n.alias("n"), special(n).alias("special"), first.cast("long").alias("first"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def moved(s: Column) -> Column:
        name = F.concat(F.lit("ip|"), s["first"].cast("string"))
        turn = lambda n: let(permuted(F.floor((n - s["first"]) / s["b"]), (n - s["first"]) % s["b"], s["a"], s["b"], key, name), lambda x: s["first"] + x["l"] * s["b"] + x["r"])
        # Any number of a block is of the block; other numbers move until they are of none.
        return walked(s["n"], turn, lambda n: s["special"] | ~special(n))

    shown = lambda n: F.concat_ws(".", *[(F.floor(n / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    return let(let(let(number, space), moved), shown)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001; other numbers aren't given out, and stay."""
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    nth = area - 1 - (area > 666).cast("long")
    moved = permuted(nth * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def shown(x: Column) -> Column:
        nth = F.floor(x["l"] / 99) + 1
        return F.format_string("%03d-%02d-%04d", nth + (nth >= 666).cast("long"), x["l"] % 99 + 1, x["r"] + 1)

    return F.when(valid, let(moved, shown)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.regexp_replace(F.regexp_extract(m, COUNTRY, 0), "[^0-9]", "")
    own = F.substring(digits, F.length(code) + 1, F.length(digits))
    american = code.isin("", "1") & own.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    area, rest = F.substring(own, 1, 3).cast("long") - 200, F.substring(own, 4, 7).cast("long") - 2_000_000
    plan = let(permuted(area, rest, 800, 8_000_000, key, "phone"), lambda x: F.concat((x["l"] + 200).cast("string"), (x["r"] + 2_000_000).cast("string")))
    abroad = F.concat(F.substring(own, 1, 1), permuted_chars(F.substring(own, F.lit(2), F.length(own)), f"{key}|phone"))
    return _refilled(m, F.concat(code, F.when(american, plan).otherwise(abroad)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one value that `ANY` matched, or the value itself when it isn't valid. key: a secret of your own."""
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    local = F.substring_index(m, "@", 1)
    alnum = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    return (
        F.when(m.contains("@"), F.concat(_refilled(local, permuted_chars(alnum, f"{key}|email")), F.substring(m, F.length(local) + 1, F.length(m))))
        .when(whole("ip"), _ip(m, key))
        .when(whole("iso_date"), _iso_date(m, key))
        .when(whole("day_date"), _written_date(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("card"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, key: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_found (values replaced), pseudonyms (the new values), text (with them). key: a secret of your own."""
    clean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("own"), text_or_empty(text).alias("t"))
    t, none = F.col("t"), F.array().cast("array<string>")
    some = F.col("some")
    known = patterned(clean.withColumn("some", t.rlike(SOME) & t.rlike(ANY)), some)
    cut = known.select("doc_id", "own", F.when(some, F.split(t, F.col("pattern"), -1)).otherwise(none).alias("between"), F.when(some, F.regexp_extract_all(t, F.col("pattern"), F.lit(0))).otherwise(none).alias("values"))
    mapped = cut.withColumn("new", F.transform("values", lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with("between", "new", lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    changed = F.filter(F.arrays_zip(F.col("values").alias("v"), F.col("new").alias("n")), lambda z: z["v"] != z["n"])
    return mapped.select(
        "doc_id",
        F.size(changed).cast("long").alias("n_found"),
        F.transform(changed, lambda z: z["n"]).alias("pseudonyms"),
        F.when(F.size("values") == 0, F.col("own")).otherwise(joined).alias("text"),
    )
