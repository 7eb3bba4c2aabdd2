"""Format-preserving Feistel pseudonyms, in DataFrame functions only (operator 1).

Numbers, dates and addresses of persons are found by one pattern, validated by their kind's
own rule (Luhn, mod 97, octets, calendar), and replaced by a keyed permutation within their
format: a card becomes another valid card, a date another date. Equal values become equal
pseudonyms in every document, different ones different ones.

A value is a list of components, each with its radix: a digit 10, a letter 26, an octet 256,
a part of a day number its own. An alternating Feistel network permutes such lists: in even
rounds the left half is shifted, component by component and modulo the radix, by a keyed
hash of the right half, in odd rounds the other way round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, which is 17 * 4297.
FIRST_DAY, DAYS, DAY_RADIX = "1900-01-01", 73049, 4297

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DAY = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{7,15}(?!\d)|\+1[ -]\d{3}[ -]\d{3}[ -]\d{4}(?!\d|\.\d)|\+\d{1,3}[ -]\d{2,4}[ -]\d{5,8}(?!\d|\.\d)|\+\d{1,3}(?:[ -]\d{2,4}){1,3}(?:[ -]\d{3,4}|(?<![ -]\d{4})[ -]\d{2})(?!\d|\.\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[-.]\d{3}[-.]\d{4}(?!\d))"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}(?:[ -]\d{4}){1,2}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
KINDS = {"email": EMAIL, "iban": IBAN, "ipv4": IPV4, "date": DAY, "ssn": SSN, "phone": PHONE, "card": CARD}
FOUND = "|".join(KINDS.values())
#: Trailing groups that may be no part of a card or an account, and the lengths of accounts by country.
TAILS = 6
IBAN_LENGTHS = {n: c.split() for n, c in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC"}.items()}

#: Country calling codes: one digit, two digits, else three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chars(text: Column) -> Column:
    return F.split(text, "")


def digits(text: Column) -> Column:
    return F.transform(chars(F.regexp_replace(text, r"\D", "")), lambda c: c.cast("int"))


def luhn(numbers: Column) -> Column:
    """Sum of a list of digits, the last of which is doubled; the check digit makes up to a multiple of ten."""
    each = F.transform(F.reverse(numbers), lambda d, i: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def check_digit(numbers: Column) -> Column:
    return (10 - luhn(numbers) % 10) % 10


def mod97(text: Column) -> Column:
    """Remainder of a text of digits and capitals, letters standing for 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(chars(text), value), F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


def day_number(text: Column) -> Column:
    """Days since FIRST_DAY of a valid date in one of the formats; else null. Slashes after the first two digits are month first."""
    as_iso = (
        F.when(text.rlike(r"^\d{4}-"), text)
        .when(text.rlike(r"^\d{4}/"), F.replace(text, F.lit("/"), F.lit("-")))
        .when(text.rlike(r"^\d{2}\."), F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
        .when(text.rlike(r"^\d{2}/"), F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2)))
    )
    days = F.datediff(as_iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when((days >= 0) & (days < DAYS), days)


def spell_day(days: Column, like: Column) -> Column:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), days)
    return (
        F.when(like.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd"))
        .when(like.rlike(r"^\d{4}/"), F.date_format(day, "yyyy/MM/dd"))
        .when(like.rlike(r"^\d{2}\."), F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )


def kind_of(m: Column) -> Column:
    """Kind of a match that its rule holds valid; null otherwise."""
    is_a = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    octets = F.forall(F.split(m, r"\."), lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o))
    compact = F.replace(m, F.lit(" "), F.lit(""))
    n = F.length(F.regexp_replace(m, r"\D", ""))
    social = ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return (
        F.when(m.contains("@"), "email")
        .when(is_a("iban"), F.when(F.length(compact).between(15, 34) & (mod97(F.concat(F.substring(compact, 5, 99), F.substring(compact, 1, 4))) == 1), "iban"))
        .when(is_a("ipv4"), F.when(octets, "ipv4"))
        .when(is_a("date"), F.when(day_number(m).isNotNull(), "date"))
        .when(is_a("ssn"), F.when(social, "ssn"))
        .when(is_a("phone"), F.when(n.between(7, 15), "phone"))
        .when(is_a("card") & n.between(13, 19), F.when(luhn(F.slice(digits(m), 1, n - 1)) % 10 == (10 - F.element_at(digits(m), -1)) % 10, "card"))
    )


def valid_part(m: Column) -> Column:
    """(m, kind, rest): the match if it is valid; else its longest valid card or account before trailing groups, which are the rest.

    Where 16 digits in fours are a card and one or two digits more would also make one, the 16 are taken.
    """
    def shorter(n: int) -> Column:
        part = F.regexp_replace(m, rf"(?:[ -][A-Z0-9]{{1,6}}){{{n}}}$", "")
        compact = F.replace(part, F.lit(" "), F.lit(""))
        right = F.lit(False)
        for size, countries in IBAN_LENGTHS.items():
            right = right | ((F.length(compact) == size) & F.substring(compact, 1, 2).isin(countries))
        return F.when((part != m) & (right | ~part.rlike("^[A-Z]")), part)

    def named(part: Column) -> Column:
        return let(kind_of(part), lambda k: F.struct(part.alias("m"), k.alias("kind"), F.substring(m, F.length(part) + 1, F.length(m)).alias("rest")))

    parts = F.filter(F.array(*[shorter(n) for n in range(1, TAILS + 1)]), lambda p: p.isNotNull())
    less = F.get(F.filter(F.transform(parts, named), lambda s: s["kind"].isin("card", "iban")), F.lit(0))
    more = m.rlike(r"^\d{4}(?:[ -]\d{4}){3}[ -]\d{1,2}$")
    return let(named(m), lambda s: F.when((s["kind"].isNotNull() & ~more) | ~m.rlike("^(?:[A-Z]{2})?[0-9]{2,}[ -]?.*[ -]"), s).otherwise(F.coalesce(less, s)))


def fixed_head(m: Column, kind: Column) -> Column:
    """What stays at the start: a telephone's country code; an account's country and check digits, which are made anew."""
    return F.when(kind == "phone", F.regexp_extract(m, rf"^(?:\+(?:{COUNTRY}))?", 0)).when(kind == "iban", F.substring(m, 1, 4)).otherwise("")


def fixed_tail(m: Column, kind: Column) -> Column:
    """What stays at the end: an e-mail's domain."""
    return F.when(kind == "email", F.regexp_extract(m, r"@.*$", 0)).otherwise("")


def body(s: Column) -> Column:
    return F.substring(s["m"], F.length(s["head"]) + 1, F.length(s["m"]) - F.length(s["head"]) - F.length(s["tail"]))


def alphabet(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), DIGITS).when(c.rlike("^[a-z]$"), LOWER).when(c.rlike("^[A-Z]$"), UPPER).otherwise(c)


def components_of(s: Column) -> Column:
    """List of (value, radix)."""
    part = lambda v, m: F.struct(v.cast("int").alias("v"), F.lit(m).cast("int").alias("m"))
    area = F.substring(s["m"], 1, 3).cast("int")
    letters = F.transform(F.filter(chars(body(s)), lambda c: c.rlike("^[A-Za-z0-9]$")), lambda c: F.struct((F.position(c, alphabet(c)) - 1).cast("int").alias("v"), F.length(alphabet(c)).cast("int").alias("m")))
    return (
        F.when(s["kind"] == "ipv4", F.transform(F.split(s["m"], r"\."), lambda o: part(o, 256)))
        .when(s["kind"] == "date", let(day_number(s["m"]), lambda d: F.array(part(F.floor(d / DAY_RADIX), 17), part(d % DAY_RADIX, DAY_RADIX))))
        .when(s["kind"] == "ssn", F.array(part(area - 1 - F.when(area > 666, 1).otherwise(0), 898), part(F.substring(s["m"], 5, 2).cast("int") - 1, 99), part(F.substring(s["m"], 8, 4).cast("int") - 1, 9999)))
        .when(s["kind"] == "card", let(digits(s["m"]), lambda d: F.transform(F.slice(d, 2, F.size(d) - 2), lambda x: part(x, 10))))
        .when(s["kind"].isNotNull(), letters)
    )


def permute(values: Column, kind: Column, key: str) -> Column:
    """The Feistel network over a list of (value, radix); a list of values."""
    half = F.ceil(F.size(values) / 2).cast("int")

    def turn(now: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(now, half + 1, F.size(now))).otherwise(F.slice(now, 1, half))
        text = F.concat_ws("|", F.lit(key), kind, F.size(now).cast("string"), r.cast("string"), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ","))

        def move(t: Column) -> Column:
            shift = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", t, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.transform(now, lambda x, i: F.struct(F.when((i < half) == left, ((x["v"] + shift(i)) % x["m"]).cast("int")).otherwise(x["v"]).alias("v"), x["m"].alias("m")))

        return let(text, move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def spell(s: Column) -> Column:
    """The pseudonym in the format of the match; the match itself where it isn't valid."""
    v = lambda i: F.get(s["to"], F.lit(i))["v"]
    dots = F.array_join(F.transform(s["to"], lambda x: x["v"].cast("string")), ".")
    area = v(0) + 1 + F.when(v(0) + 1 > 665, 1).otherwise(0)
    social = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((v(1) + 1).cast("string"), 2, "0"), F.lpad((v(2) + 1).cast("string"), 4, "0"))

    def fill(source: Column, values: Column) -> Column:
        """Values put in the places of the letters and digits of a text."""
        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("t"))
        step = lambda a, c: F.when(c.rlike("^[A-Za-z0-9]$"), F.struct((a["i"] + 1).alias("i"), F.concat(a["t"], F.substring(alphabet(c), F.get(values, a["i"]) + 1, F.lit(1))).alias("t"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["t"], c).alias("t")))
        return F.aggregate(chars(source), start, step)["t"]

    plain = F.transform(s["to"], lambda x: x["v"])
    first = F.slice(digits(s["m"]), 1, 1)
    card = let(F.concat(first, plain), lambda n: fill(s["m"], F.concat(n, F.array(check_digit(n)))))

    def iban(text: Column) -> Column:
        """The new account with check digits of its own, spaced as before."""
        moved = F.concat(F.regexp_replace(text, " ", ""), F.substring(s["m"], 1, 2), F.lit("00"))
        return F.concat(F.substring(s["m"], 1, 2), F.lpad((98 - mod97(moved)).cast("string"), 2, "0"), text)

    return (
        F.when(s["kind"].isNull(), s["m"])
        .when(s["kind"] == "ipv4", dots)
        .when(s["kind"] == "date", spell_day((v(0) * DAY_RADIX + v(1)).cast("int"), s["m"]))
        .when(s["kind"] == "ssn", social)
        .when(s["kind"] == "card", card)
        .when(s["kind"] == "iban", let(fill(body(s), plain), iban))
        .otherwise(F.concat(s["head"], fill(body(s), plain), s["tail"]))
    )


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, text, n_values, kinds.

    text has every valid value replaced; n_values counts them; kinds lists their kinds in
    the order of the text, comma-joined. A telephone's country code stays and the digits after
    it are permuted, so one number is linked however it is spaced. Everything else of a text stays as it was. A null
    text stays null, with no values; an empty one stays empty. Each row stands for itself,
    so repeated rows and null ids come back as they are; other columns are ignored; an empty
    table gives no rows. No shuffle; a row's work grows with its own text only.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = F.regexp_extract_all("_text", F.lit(FOUND), F.lit(0))
    rows = rows.select("_id", "_text", F.when(F.col("_text").rlike(FOUND), found).alias("_found"))
    whole = F.transform("_found", valid_part)
    kinds = F.transform(whole, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["rest"].alias("rest"), fixed_head(s["m"], s["kind"]).alias("head"), fixed_tail(s["m"], s["kind"]).alias("tail")))
    named = F.transform(kinds, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["rest"].alias("rest"), s["head"].alias("head"), s["tail"].alias("tail"), components_of(s).alias("from")))
    moved = F.transform(named, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["rest"].alias("rest"), s["head"].alias("head"), s["tail"].alias("tail"), permute(s["from"], s["kind"], key).alias("to")))
    spelt = F.transform(moved, lambda s: F.struct(s["kind"].alias("kind"), F.concat(spell(s), s["rest"]).alias("to")))
    rows = rows.select("_id", "_text", F.when(F.col("_found").isNotNull(), spelt).alias("_new"))
    gaps = F.split("_text", FOUND, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.transform("_new", lambda s: s["to"]), lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    valid = F.filter("_new", lambda s: s["kind"].isNotNull())
    text = F.when(F.size(valid) > 0, joined).otherwise(F.col("_text"))
    return rows.select(F.col("_id").alias(id_col), text.alias("text"), F.coalesce(F.when(F.col("_new").isNotNull(), F.size(valid)), F.lit(0)).cast("long").alias("n_values"), F.coalesce(F.array_join(F.transform(valid, lambda s: s["kind"]), ","), F.lit("")).alias("kinds"))
