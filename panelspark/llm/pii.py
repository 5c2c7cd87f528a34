"""Format-preserving pseudonyms of personal numbers, dates and addresses in texts.

A value is found by its format, validated, and sent through a keyed permutation of the values of
that format: a Feistel network over two mixed-radix halves whose rounds add SHA-256 of key,
format, round and the other half. A pseudonym is thus a valid value of the same format, and
equal values have equal pseudonyms in all documents. All of it is native expressions.

A value is searched for in three steps, each over what the ones before did not take: e-mail
addresses and IBANs; addresses, dates and telephone and security numbers; card numbers. What
fails validation is text again for the next step. A card number is a whole number of digit
groups: of a run of groups, the longest valid beginning is taken and the search goes on behind
it, or one group further where none is valid. The country code fixes the length of an IBAN.

Formats: e-mail addresses (the letters and digits of the local part), IPv4 and IPv6 addresses
(the latter by the digits written, of which one is decimal), payment card numbers of 13 to 19 digits with a right check
digit (which is worked out anew), telephone numbers with a ten-digit national part, international
numbers after + or 00 with 8 to 15 digits, national ones with a leading zero, a separator and 9 to
12 digits, US social security numbers, IBANs with right check digits (in small letters where all
behind the bank's first group are digits), and dates from 1900-01-01 to 2101-01-27: yyyy-mm-dd,
yyyy/mm/dd, mm/dd/yyyy (where that is no date: dd/mm/yyyy), dd.mm.yyyy, dd-mm-yyyy (else
mm-dd-yyyy), days and months also of one digit. Digits go back between the separators of the
original; country code and trunk zero are kept, so a national and an international form of a
number stay linked (ten national digits keep the class of area and exchange, others whether they
begin with zero). Letters of a local part beyond ASCII are
permuted among those of Latin-1 of their case, later ones in their block of 16 code points. What
fails validation stays as it is.

Defined cases: a null text stays null; rows are independent, so ties, repeated rows and empty
tables need no rule; further columns stay; a text of any length is handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import free_name

ROUNDS = 10
LOCAL = r"A-Za-z0-9\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{M}._%+-"
EMAIL = (rf"(?<![{LOCAL}])[{LOCAL}]++@"
         r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}")
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """The form of an IBAN: of its country's length, or of any for a country without one."""
    def groups(size: int) -> str:
        full, rest = divmod(size - 4, 4)
        return f"(?: ?[A-Z0-9]{{4}}){{{full}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")

    known = [f"(?:{'|'.join(c.split())})\\d{{2}}{groups(n)}" for n, c in IBAN_LENGTHS.items()]
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = rf"(?!{codes})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    small = [f"(?:{'|'.join(c.lower().split())})\\d{{2}} ?[a-z0-9]{{4}}(?: ?\\d{{4}}){{{(n - 8) // 4}}}"
             + (f" ?\\d{{{(n - 8) % 4}}}" if (n - 8) % 4 else "") for n, c in IBAN_LENGTHS.items()]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other, *small])})(?![A-Za-z0-9])"


IBAN = _iban()
IPV4 = r"(?<![0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9]|\.[0-9])"
IPV6 = (r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{2,39}"
        r"(?![0-9A-Za-z:]|\.[0-9])")
# Forms of dates and the patterns that read and write them, the first that reads one holding.
DATES = {
    r"\d{4}-\d{2}-\d{2}": ("yyyy-MM-dd",), r"\d{4}/\d{2}/\d{2}": ("yyyy/MM/dd",),
    r"\d{2}/\d{2}/\d{4}": ("MM/dd/yyyy", "dd/MM/yyyy"), r"\d{2}\.\d{2}\.\d{4}": ("dd.MM.yyyy",),
    r"\d{2}-\d{2}-\d{4}": ("dd-MM-yyyy", "MM-dd-yyyy"),
    r"\d{1,2}/\d{1,2}/\d{4}": ("M/d/yyyy", "d/M/yyyy"), r"\d{1,2}\.\d{1,2}\.\d{4}": ("d.M.yyyy",),
    r"\d{1,2}-\d{1,2}-\d{4}": ("d-M-yyyy", "M-d-yyyy")}
DATE = rf"(?<![0-9/.-])(?:{'|'.join(DATES)})(?![0-9]|[/.-][0-9])"
SSN = r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9]|-[0-9])"
PHONE = (r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}"
         r"(?![0-9])")
# Calling codes of one and two digits; all others have three.
CALLING_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ABROAD = (r"(?<![0-9A-Za-z+])(?:\+[1-9](?:[ .()/-]{0,3}\d){7,14}"
          r"|(?<![0-9][ /-])00[1-9]\d{0,2}[ /-](?:[ ()/-]{0,2}\d){6,12})(?![0-9A-Za-z])")
HOME = (r"(?<![0-9A-Za-z+.,/-])(?<![0-9] )0[1-9]\d{0,3}(?:[ /.-]\d{2,8}){1,4}"
        r"(?![0-9A-Za-z]|[ /.,-][0-9])")
# Digit groups that may hold card numbers, and one of them with what separates it from the next.
RUN = r"(?<![0-9A-Za-z])[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z])"
GROUP = r"[0-9]+[ -]*"
# Stand for the values taken in the first and the second step; such characters of the text
# itself are taken like values.
MARKS = ("\ue000", "\ue001")
STEPS = ("|".join((f"[{''.join(MARKS)}]", EMAIL, IBAN)), "|".join((
    IPV4, IPV6, DATE, SSN, PHONE, ABROAD, HOME)))
# Every format has an @ or two digits next to each other, or one digit before a dot or before a
# space or hyphen and a digit, or two colons.
HINT = r"@|[0-9][0-9.]|[0-9][ -][0-9]|::"
DAYS = 271  # 271 * 271 days from 1900-01-01


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column,
            key: str) -> Column:
    """struct(l, r): the permuted place of (left, right) in [0, a) x [0, b)."""
    def term(i: Column, other: Column, radix: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % radix

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + term(i, s["r"], a)) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + term(i, s["l"], b)) % b).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def filled(form: Column, new: Column, kind: str = "0-9") -> Column:
    """`form` with its digits, characters of `kind`, replaced in turn by those of `new`."""
    def before(i: Column) -> Column:
        return F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), f"[^{kind}]", ""))

    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(
        c.rlike(f"[{kind}]"), F.substr(new, before(i), F.lit(1))).otherwise(c)), "")


def power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(base)), n)).cast("long")


def permuted_digits(value: Column, tweak: str, key: str) -> Column:
    """A string of 2 to 30 digits permuted among those of its length."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    rest = n - half

    def text(s: Column) -> Column:
        return F.concat(F.lpad(s["l"].cast("string"), half, "0"),
                        F.lpad(s["r"].cast("string"), rest, "0"))

    return bound(feistel(F.substr(value, F.lit(1), half).cast("long"),
                         F.substr(value, half + 1, rest).cast("long"),
                         power(10, half), power(10, rest),
                         F.concat(F.lit(tweak), n.cast("string")), key), text)


def check_digit(payload: Column) -> Column:
    """The Luhn digit that completes a string of digits."""
    terms = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(
        i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9)
        .otherwise(2 * c.cast("int")))
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def card(m: Column, key: str) -> Column:
    """The pseudonym of a number with a right check digit."""
    payload = bound(digits(m), lambda d: F.substr(d, F.lit(1), F.length(d) - 1))
    return bound(bound(payload, lambda p: permuted_digits(p, "card", key)),
                 lambda p: filled(m, F.concat(p, check_digit(p))))


def card_prefix(groups: Column) -> Column:
    """struct(n, text): the most first groups that make a valid card number, n = 0 for none."""
    def valid(d: Column) -> Column:
        return F.when(F.length(d).between(13, 19), check_digit(F.substr(
            d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1))).otherwise(False)

    def step(s: Column, group: Column) -> Column:
        number = F.concat(s["number"], digits(group))
        n = s["read"] + 1
        taken = F.when(s["open"] & valid(digits(number)), F.struct(
            n.alias("n"), number.alias("text"))).otherwise(s["taken"])
        return F.struct(
            (s["open"] & (F.length(group) == F.length(digits(group)) + 1)).alias("open"), n.alias(
                "read"), F.concat(s["number"], group).alias("number"), taken.alias("taken"))

    none = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("read"),
                     F.lit("").alias("number"), none.alias("taken"))
    return F.aggregate(groups, start, step, lambda s: s["taken"])


def cards(run: Column, key: str) -> Column:
    """struct(n, text): card numbers found in a run of digit groups, and the run with theirs."""
    def whole(groups: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            return F.when(i < s["next"], s).otherwise(bound(
                card_prefix(F.slice(groups, i + 1, 19)), lambda p: F.when(p["n"] > 0, F.struct(
                    (i + p["n"]).alias("next"), F.concat(s["hits"], F.array(F.struct(
                        i.alias("i"), p["n"].alias("n"), p["text"].alias("text")))).alias("hits")))
                .otherwise(s)))

        empty = F.array().cast("array<struct<i:int,n:int,text:string>>")
        hits = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.struct(
            F.lit(0).alias("next"), empty.alias("hits")), step, lambda s: s["hits"])

        def text(hits: Column) -> Column:
            def end(k: Column) -> Column:
                return bound(F.get(hits, k), lambda h: F.coalesce(h["i"] + h["n"], F.lit(0)))

            def between(start: Column, stop: Column) -> Column:
                return F.array_join(F.slice(groups, start + 1, stop - start), "")

            def piece(h: Column, k: Column) -> Column:
                last = F.get(groups, h["i"] + h["n"] - 1)
                return F.concat(between(end(k - 1), h["i"]), card(h["text"], key),
                                F.regexp_extract(last, "[^0-9]*$", 0))

            return F.struct(F.size(hits).alias("n"), F.concat(
                F.array_join(F.transform(hits, piece), ""),
                between(end(F.size(hits) - 1), F.size(groups))).alias("text"))

        return F.when(F.size(hits) > 0, bound(hits, text)).otherwise(F.struct(
            F.lit(0).alias("n"), run.alias("text")))

    return bound(F.regexp_extract_all(run, F.lit(GROUP), F.lit(0)), whole)


def phone(m: Column, key: str) -> Column:
    """Country code kept; area and exchange stay in their class (first digit below 2, or not)."""
    def new(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 10)
        area = F.substr(d, F.length(d) - 9, F.lit(3)).cast("long")
        line = F.substr(d, F.length(d) - 6, F.lit(7)).cast("long")
        low, first = F.when(area >= 200, 200).otherwise(0), F.when(line >= 2_000_000, 2_000_000)
        first = first.otherwise(0)
        place = feistel(area - low, line - first, F.when(area >= 200, 800).otherwise(200),
                        F.when(line >= 2_000_000, 8_000_000).otherwise(2_000_000),
                        F.concat(F.lit("phone"), low.cast("string"), first.cast("string")), key)
        return bound(place, lambda s: filled(m, F.concat(
            head, F.lpad((s["l"] + low).cast("string"), 3, "0"),
            F.lpad((s["r"] + first).cast("string"), 7, "0"))))

    return bound(digits(m), new)


def permuted_number(value: Column, tweak: str, key: str) -> Column:
    """2 to 30 digits permuted among those of the length that begin with zero, or don't, like it."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    unit = power(10, half - 1)
    zero = F.startswith(value, F.lit("0"))
    low = F.when(zero, 0).otherwise(unit)
    place = feistel(F.substr(value, F.lit(1), half).cast("long") - low,
                    F.substr(value, half + 1).cast("long"),
                    F.when(zero, unit).otherwise(9 * unit), power(10, n - half),
                    F.concat(F.lit(tweak), n.cast("string"), F.when(zero, "z").otherwise("")), key)
    return bound(place, lambda s: F.concat(
        F.lpad((s["l"] + low).cast("string"), half, "0"),
        F.lpad(s["r"].cast("string"), n - half, "0")))


def dialled(m: Column, key: str) -> Column:
    """A telephone number; of international ones and those with a trunk zero, ten national digits
    go like `phone`."""
    form = F.replace(m, F.lit("(0)"), F.lit("(o)"))     # a trunk zero in brackets is kept

    def new(d: Column) -> Column:
        abroad = F.startswith(m, F.lit("+")) | F.startswith(m, F.lit("00"))
        head = F.when(abroad, F.regexp_extract(
            d, rf"^(?:00)?(?:{CALLING_CODES}|\d{{3}})", 0)).otherwise(F.lit("0"))
        rest = F.substr(d, F.length(head) + 1)
        size = F.length(d) - F.when(F.startswith(m, F.lit("00")), 2).otherwise(0)
        valid = F.when(abroad, size.between(8, 15) & (F.length(rest) > 4)
                       & ~m.rlike(r"^\+\d+\.\d+$")).otherwise(size.between(9, 12))
        ten = m.rlike(f"^{PHONE}$") | (valid & (F.length(rest) == 10))
        return F.when(ten, phone(form, key)).when(valid, bound(
            rest, lambda r: filled(form, F.concat(head, permuted_number(r, "dialled", key)))))

    return F.replace(bound(digits(form), new), F.lit("(o)"), F.lit("(0)"))


def ssn(m: Column, key: str) -> Column:
    area, group = F.substr(m, F.lit(1), F.lit(3)).cast("int"), F.substr(
        m, F.lit(5), F.lit(2)).cast("int")
    serial = F.substr(m, F.lit(8), F.lit(4)).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1,
                    F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)

    def text(s: Column) -> Column:
        new = s["l"] + 1 + (s["l"] >= 665).cast("int")
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"),
                           F.lpad(F.floor(s["r"] / 9999 + 1).cast("string"), 2, "0"),
                           F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, bound(place, text))


def ipv4(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        part = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
        place = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536),
                        F.lit(65536), F.lit("ipv4"), key)
        wrong = F.exists(o, lambda x: (x.cast("int") > 255) | x.rlike("^0[0-9]"))
        return F.when(~wrong, bound(place, lambda s: F.concat_ws(
            ".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"),
            F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string"))))

    return bound(F.split(m, r"\."), new)


def permuted_hex(value: Column, tweak: str, key: str) -> Column:
    """Up to 16 hexadecimal digits, in small letters, permuted among those of the length."""
    half = F.floor(F.length(value) / 2).cast("int")
    rest = F.length(value) - half

    def number(text: Column) -> Column:
        return F.coalesce(F.conv(F.nullif(text, F.lit("")), 16, 10).cast("long"), F.lit(0))

    def text(n: Column, size: Column) -> Column:
        return F.when(size > 0, F.lpad(F.lower(F.conv(n.cast("string"), 10, 16)), size, "0")
                      ).otherwise("")

    place = feistel(number(F.substr(value, F.lit(1), half)), number(F.substr(value, half + 1)),
                    power(16, half), power(16, rest),
                    F.concat(F.lit(tweak), F.length(value).cast("string")), key)
    return bound(place, lambda s: F.concat(text(s["l"], half), text(s["r"], rest)))


def ipv6(m: Column, key: str) -> Column:
    """Of eight groups, or fewer and one `::`; the digits written are permuted."""
    groups = F.filter(F.split(m, ":"), lambda g: g != "")
    gaps = F.size(F.split(m, "::")) - 1
    valid = (m.rlike("[0-9]") & ~F.contains(m, F.lit(":::")) & ~F.exists(groups, lambda g: F.length(g) > 4)
             & F.when(gaps == 0, (F.size(groups) == 8) & m.rlike("^[^:].*[^:]$"))
             .otherwise((gaps == 1) & F.size(groups).between(2, 7)
                        & ~m.rlike("^:[^:]|[^:]:$")))

    def new(d: Column) -> Column:
        fresh = F.concat(permuted_hex(F.substr(d, F.lit(1), F.lit(16)), "ipv6-0-", key),
                         F.when(F.length(d) > 16, permuted_hex(F.substr(d, F.lit(17)), "ipv6-1-",
                                                               key)).otherwise(""))
        return F.when(F.lower(m) == m, fresh).otherwise(F.upper(fresh))

    fresh = bound(F.lower(F.replace(m, F.lit(":"), F.lit(""))), new)
    return F.when(valid, bound(fresh, lambda v: filled(m, v, "0-9A-Fa-f")))


def date(m: Column, key: str) -> Column:
    """A date of one of the forms, written by the pattern that reads it."""
    first = F.lit("1900-01-01").cast("date")

    def read(form: str, pattern: str) -> Column:
        day = F.when(m.rlike(f"^{form}$"), F.datediff(F.try_to_date(m, pattern), first))
        return F.when(day.between(0, DAYS * DAYS - 1), F.struct(
            day.alias("day"), F.lit(pattern).alias("pattern")))

    def new(d: Column) -> Column:
        place = feistel(F.floor(d["day"] / DAYS), d["day"] % DAYS, F.lit(DAYS), F.lit(DAYS),
                        F.lit("date"), key)
        return F.when(d.isNotNull(), bound(place, lambda s: F.call_function(
            "date_format", F.date_add(first, (s["l"] * DAYS + s["r"]).cast("int")),
            d["pattern"])))

    return bound(F.coalesce(*[read(form, p) for form, ps in DATES.items() for p in ps]), new)


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(
        c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))


def iban(m: Column, key: str) -> Column:
    """Country and letters kept, digits of the account permuted, check digits worked out."""
    def new(v: Column) -> Column:
        country, own = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5))
        valid = _mod97(F.concat(own, F.substr(v, F.lit(1), F.lit(4)))) == 1
        ok = valid & F.length(digits(own)).between(2, 30)

        def whole(body: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"),
                           2, "0")
            return filled(m, F.concat(check, digits(body)))

        fresh = filled(own, permuted_digits(digits(own), "iban", key))
        return F.when(ok, bound(fresh, whole))

    return bound(F.upper(F.replace(m, F.lit(" "))), new)


# Letters of Latin-1 by case, where the multiplication and division signs are left out, and the
# letters after them.
SMALL, LARGE, LATER = "[\u00e0-\u00f6\u00f8-\u00ff]", "[\u00c0-\u00d6\u00d8-\u00de]", "[\u0100-\uffff]"


def _radix(c: Column) -> Column:
    return (F.when(c.rlike("[A-Za-z]"), 26).when(c.rlike("[0-9]"), 10).when(c.rlike(SMALL), 31)
            .when(c.rlike(LARGE), 30).when(c.rlike(LATER) & c.rlike(r"\p{L}"), 16)
            .otherwise(1).cast("long"))


def _place(c: Column) -> Column:
    code = F.ascii(c)
    return (F.when(c.rlike("[a-z]"), code - 97).when(c.rlike("[A-Z]"), code - 65)
            .when(c.rlike("[0-9]"), code - 48)
            .when(c.rlike(SMALL), code - 0xE0 - (code > 0xF7).cast("int"))
            .when(c.rlike(LARGE), code - 0xC0 - (code > 0xD7).cast("int"))
            .when(c.rlike(LATER), code % 16).otherwise(0).cast("long"))


def _char(c: Column, n: Column) -> Column:
    def wide(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.conv(code.cast("string"), 10, 16), 4, "0")), "UTF-16BE")

    first = F.when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(48)
    return (F.when(c.rlike("[A-Za-z0-9]"), F.char((n + first).cast("int")))
            .when(c.rlike(SMALL), wide(n + 0xE0 + (n > 22).cast("int")))
            .when(c.rlike(LARGE), wide(n + 0xC0 + (n > 22).cast("int")))
            .when(c.rlike(LATER) & c.rlike(r"\p{L}"), wide(F.ascii(c) - F.ascii(c) % 16 + n))
            .otherwise(c))


def permuted_name(part: Column, tweak: Column, key: str) -> Column:
    """Up to 20 characters: letters and digits permuted among those of the same form."""
    half = F.floor(F.length(part) / 2).cast("int")

    def chars(text: Column) -> Column:
        return F.array_remove(F.split(text, ""), "")

    def read(c: Column) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a * _radix(x) + _place(x))

    def size(c: Column) -> Column:
        return F.aggregate(c, F.lit(1).cast("long"), lambda a, x: a * _radix(x))

    def write(c: Column, n: Column) -> Column:
        start = F.struct(n.alias("n"), F.lit("").alias("out"))
        return F.aggregate(F.reverse(c), start, lambda s, x: F.struct(
            F.floor(s["n"] / _radix(x)).cast("long").alias("n"),
            F.concat(_char(x, s["n"] % _radix(x)), s["out"]).alias("out")), lambda s: s["out"])

    def both(v: Column) -> Column:
        left, right = v["left"], v["right"]
        place = feistel(read(left), read(right), size(left), size(right), tweak, key)
        return bound(place, lambda s: F.concat(write(left, s["l"]), write(right, s["r"])))

    return bound(F.struct(chars(F.substr(part, F.lit(1), half)).alias("left"),
                          chars(F.substr(part, half + 1)).alias("right")), both)


def email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    starts = F.sequence(F.lit(0), F.floor((F.length(local) - 1) / 20).cast("int"))
    parts = F.transform(starts, lambda i: permuted_name(
        F.substr(local, i * 20 + 1, F.lit(20)), F.concat(F.lit("mail"), i.cast("string")), key))
    return F.concat(F.array_join(parts, ""), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a value found in the first two steps, or null where it isn't valid."""
    return (F.when(m.isin(*MARKS), m)
            .when(F.contains(m, F.lit("@")), email(m, key))
            .when(F.contains(m, F.lit(":")), ipv6(m, key))
            .when(m.rlike("^[A-Za-z]"), iban(m, key))
            .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), ipv4(m, key))
            .when(m.rlike(f"^(?:{'|'.join(DATES)})$"), date(m, key))
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn(m, key)).otherwise(dialled(m, key)))


def filled_gaps(text: Column, pattern: str, values: Column) -> Column:
    """`text` with `values` in turn for what `pattern` matches."""
    return F.when(F.size(values) > 0, F.array_join(F.flatten(F.zip_with(
        F.split(text, pattern), values, lambda gap, v: F.array(gap, v))), "")).otherwise(text)


def pseudonymised(docs: DataFrame, key: str, text: str = "text",
                  found: str | None = None) -> DataFrame:
    """`docs` with the personal values of `text` replaced; `found` names a column for their number."""
    rows, names = docs, []

    def keep(value: Column) -> Column:
        """A new column of `rows`, worked out once."""
        nonlocal rows
        names.append(free_name(rows, f"pii_{len(names)}"))
        rows = rows.select("*", F.explode(F.array(value)).alias(names[-1]))
        return F.col(names[-1])

    def matches(rest: Column, pattern: str) -> Column:
        return F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))

    rest, taken = keep(F.when(F.col(text).rlike(HINT), F.col(text))), []
    for pattern, mark in zip(STEPS, MARKS, strict=True):
        hits = keep(F.transform(matches(rest, pattern), lambda m: F.struct(
            m.alias("old"), pseudonym(m, key).alias("new"))))
        taken.append(keep(F.filter(F.transform(hits, lambda h: h["new"]),
                                   lambda n: n.isNotNull())))
        rest = keep(filled_gaps(rest, pattern, F.transform(
            hits, lambda h: F.when(h["new"].isNull(), h["old"]).otherwise(mark))))  # noqa: B023
    runs = keep(F.transform(matches(rest, RUN), lambda run: cards(run, key)))
    out = filled_gaps(rest, RUN, F.transform(runs, lambda r: r["text"]))
    for mark, news in reversed(list(zip(MARKS, taken, strict=True))):
        out = filled_gaps(out, mark, news)
    many = F.size(F.filter(taken[0], lambda n: ~n.isin(*MARKS))) + F.size(taken[1]) + F.aggregate(
        runs, F.lit(0), lambda a, r: a + r["n"])
    rows = rows.withColumn(text, F.coalesce(out, F.col(text)))
    if found:
        rows = rows.withColumn(found, F.when(rest.isNull(), 0).otherwise(many))
    return rows.select(*docs.columns, *[found] * bool(found))
