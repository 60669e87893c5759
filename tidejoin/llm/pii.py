"""PII (8, native): format-preserving Feistel pseudonyms, in DataFrame and SQL functions only.

Personal values are found by one regular expression, validated, and replaced by a
keyed permutation of all values of their format: the same value gets the same
pseudonym in every document, two values never share one, and the layout (signs,
spaces, length) stays.  The permutation is an alternating Feistel network on a
pair of numbers; its round function is SHA-256 over key, format, round and half.

========  ====================================  ======================================
kind      valid if                              what is permuted
========  ====================================  ======================================
email     it has that form                      a keyed name at a reserved domain
card      13-19 digits, Luhn check right        all digits but the check digit, set anew
iban      check modulo 97 right                 the account's digits; check digits set anew
ip        four numbers up to 255, also the end  the 32-bit address
          of an IPv6 address
ip6       8 groups, or ``::`` and 2 to 7        the hexadecimal digits
phone     (ddd) ddd-dddd, ddd-ddd-dddd,         all digits but the country code, which is
          +cc .., +cc (0).., ddd ddd dddd and   that of the list of calling codes, and "(0)";
          10 digits, both from 2 to 9 on        10 digits from 2 on stay so
ssn       ddd-dd-dddd or with spaces, no block  the valid numbers
          of zeros
date      a day of the years 1700 to 2099,      the days of these 400 years; if the month
          day or else month first if slashes,   comes first, the days 13 and later of each
          also before a time of day; parts may
          have one digit, the year may be first
========  ====================================  ======================================

An email's name is a keyed hash of 128 bits (a permutation of names of any length
would not be a name), of addresses in lower case; hexadecimal digits are taken in lower
case too.  Values may be of any length that their form has.  A number that fails its
check is left alone; of a grouped card of 19 digits that fails it, the first 16 count.

Nulls give null; empty texts stay empty; equal rows give equal results; an empty
table gives an empty result; no column but the named one is changed: counts get the
name ``n_<kind>``, with underscores before it if there is such a column already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: For tests and the registered query; users pass their own secret.
KEY = "tidejoin pseudonyms"
KINDS = ("email", "date", "ip", "ip6", "ssn", "phone", "iban", "card")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: How a value looks, in the order in which they are tried at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}(?![\p{L}\p{N}])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2}:))(?![/.-][0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z])(?!\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![0-9A-Za-z:]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9A-Za-z])(?!-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?: ?\(0\)(?:[ .-]?[0-9]{2,8}){1,4}|(?:[ .-]?[0-9]{2,4}){2,4})|[2-9][0-9]{2} [0-9]{3} [0-9]{4}|[2-9][0-9]{9})(?![0-9A-Za-z])(?!-[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: What every value holds: texts without it are not searched.
SIGN = "[@0-9]|::"
# Country calling codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})(?: ?\(0\))?"
#: Days of the range of dates, 400 years of the calendar, as a product of two near enough numbers.
DAYS = (27, 5411)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _long(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(c).cast("long")


def feistel(x: Column, y: Column, a: Column | int, b: Column | int, key: str, tweak: Column | str) -> Column:
    """Permutes the pairs of x below a and y below b; ``x`` and ``y`` of the result are the new pair."""
    a, b = (v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long") for v in (a, b))
    tweak = tweak if isinstance(tweak, Column) else F.lit(tweak)

    def mix(i: Column, v: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), v.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(((s["x"] + mix(i, s["y"])) % a).alias("x"), s["y"].alias("y"))
        right = F.struct(s["x"].alias("x"), ((s["y"] + mix(i, s["x"])) % b).alias("y"))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def permuted_digits(d: Column, key: str, tweak: str) -> Column:
    """A permutation of the digit strings of each length up to 36."""
    n = F.length(d)
    left = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    pair = feistel(_long(F.substring(d, F.lit(1), left)), _long(F.substring(d, left + 1, n)), ten(left), ten(n - left), key, F.concat(F.lit(tweak), n.cast("string")))
    return _let(pair, lambda p: F.concat(F.lpad(p["x"].cast("string"), left, F.lit("0")), F.lpad(p["y"].cast("string"), n - left, F.lit("0"))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def laid_out(shape: Column, d: Column, digit: str = "[0-9]") -> Column:
    """``shape`` with its digits replaced by those of ``d``, in order."""
    own = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{digit[1:]}", ""))

    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.rlike(digit), F.substring(d, own(i), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def luhn_sum(d: Column, shift: int) -> Column:
    """Sum of the digits, from the right every second doubled; shift 0 leaves the last as it is, 1 doubles it."""
    n = F.length(d)

    def add(s: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return s + F.when((n - i + shift) % 2 == 1, twice).otherwise(v)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)).otherwise(0)


def iban_rest(account: Column, country: Column, check: Column | str) -> Column:
    """Remainder modulo 97 of an IBAN in its checking order."""
    s = F.concat(account, country, check if isinstance(check, Column) else F.lit(check))

    def add(r: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _day(m: Column) -> Column:
    """The date of a match, or null."""
    slashes = F.coalesce(F.try_to_date(m, "d/M/yyyy"), F.try_to_date(m, "M/d/yyyy"))
    year_first = m.rlike("^[0-9]{4}/")
    return F.when(m.contains("-"), F.try_to_date(m, "yyyy-MM-dd")).when(year_first, F.try_to_date(m, "yyyy/M/d")).when(m.contains("/"), slashes).otherwise(F.try_to_date(m, "d.M.yyyy"))


def _month_first(day: Column, key: str) -> Column:
    """Permutes the days 13 and later of months, which are those that a date with the month first is told by.

    Days 13 to 28, 29 and 30 but of February, 31, and 29 February are permuted each among themselves, so every result
    is a day of the calendar.
    """
    year, month, d = (f(day).cast("long") for f in (F.year, F.month, F.dayofmonth))

    def at(y: Column, m: Column, dd: Column) -> Column:
        return F.make_date((y + 1700).cast("int"), m.cast("int"), dd.cast("int"))

    long_months = F.array(*[F.lit(m) for m in (1, 3, 5, 7, 8, 10, 12)])
    other_months = F.array(*[F.lit(m) for m in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)])
    usual = _let(feistel(year - 1700, (month - 1) * 16 + d - 13, 400, 192, key, "month first"), lambda p: at(p["x"], F.floor(p["y"] / 16) + 1, p["y"] % 16 + 13))
    late = _let(feistel(year - 1700, (F.array_position(other_months, month.cast("int")) - 1) * 2 + d - 29, 400, 22, key, "month first 29"), lambda p: at(p["x"], F.get(other_months, F.floor(p["y"] / 2).cast("int")), p["y"] % 2 + 29))
    last = _let(feistel(year - 1700, F.array_position(long_months, month.cast("int")) - 1, 400, 7, key, "month first 31"), lambda p: at(p["x"], F.get(long_months, p["y"].cast("int")), F.lit(31)))
    # the leap years from 1704 on in order; 1800 and 1900 are none
    leap = F.floor((year - 1704) / 4) - F.when(year > 1800, 1).otherwise(0) - F.when(year > 1900, 1).otherwise(0)
    number = _let(feistel(leap, F.lit(0), 97, 1, key, "month first leap"), lambda p: 4 + 4 * p["x"] + F.when(p["x"] >= 24, 4).otherwise(0) + F.when(p["x"] >= 48, 4).otherwise(0))
    return F.when(d <= 28, usual).when(d == 31, last).when(month == 2, at(number, F.lit(2), F.lit(29))).otherwise(late)


def permuted_hex(h: Column, key: str) -> Column:
    """A permutation of the strings of up to 32 hexadecimal digits of each length: the first 30 digits, then the last 30."""

    def window(part: Column, tweak: str) -> Column:
        n = F.length(part)
        left = F.floor(n / 2).cast("int")
        number = lambda c: F.when(c == "", F.lit(0)).otherwise(F.conv(c, 16, 10)).cast("long")
        size = lambda k: F.pow(F.lit(16), k).cast("long")
        pair = feistel(number(F.substring(part, F.lit(1), left)), number(F.substring(part, left + 1, n)), size(left), size(n - left), key, F.concat(F.lit(tweak), n.cast("string")))
        back = lambda v, k: F.when(k == 0, F.lit("")).otherwise(F.lpad(F.lower(F.hex(v)), k, F.lit("0")))
        return _let(pair, lambda p: F.concat(back(p["x"], left), back(p["y"], n - left)))

    cut = F.lit(30)
    first = _let(h, lambda v: F.concat(window(F.substring(v, F.lit(1), cut), "ip6 a"), F.substring(v, cut + 1, F.length(v))))
    over = lambda v: F.greatest(F.length(v) - 30, F.lit(0))
    return _let(first, lambda v: F.concat(F.substring(v, F.lit(1), over(v)), window(F.substring(v, over(v) + 1, F.length(v)), "ip6 b")))


def kind_of(m: Column) -> Column:
    """The kind whose form a match has and whose check it passes; null if none."""
    d = _digits(m)
    compact = F.replace(m, F.lit(" "), F.lit(""))
    groups = F.filter(F.split(m, ":"), lambda g: g != "")
    whole = lambda k: m.rlike(f"^(?:{_bare(k)})$")
    return (
        F.when(m.contains("@"), "email")
        .when(whole("date"), F.when(F.year(_day(m)).between(1700, 2099), "date"))
        .when(whole("ip"), "ip")
        .when(m.rlike(f"^(?:{_bare('ip6')})$"), F.when(~m.contains("::") | ((F.size(groups) <= 7) & (F.size(groups) >= 2) & (F.length(F.replace(m, F.lit(":"), F.lit(""))) >= 5)), "ip6"))
        .when(whole("ssn"), F.when(~m.rlike("^(?:000|666|9)|[ -]00[ -]|[ -]0000$"), "ssn"))
        .when(m.rlike(f"^(?:{_bare('phone')})$"), "phone")
        .when(m.rlike("^[A-Z]"), F.when(iban_rest(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 2), F.substring(compact, 3, 2)) == 1, "iban"))
        .when((luhn_sum(d, 0) % 10 == 0) | (luhn_sum(_card(m, d), 0) % 10 == 0), "card")
    )


def _card(m: Column, d: Column) -> Column:
    """The digits of a card number: all, or the first 16 of a grouped number of 19 digits that fails the check."""
    return F.when((F.length(m) == 23) & (luhn_sum(d, 0) % 10 != 0), F.substring(d, 1, 16)).otherwise(d)


def _bare(kind: str) -> str:
    """The form without what must stand around it."""
    body = PATTERNS[kind]
    body = body[body.index(")") + 1 :]
    return body[: body.index("(?!")]


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    """The pseudonym of a value of a kind; the value itself if the kind is null."""
    d = _digits(m)
    email = F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 32), F.lit("@example.invalid"))

    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    high = lambda v: F.floor(v / 256).cast("long").cast("string")
    ip = _let(feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip"), lambda p: F.concat_ws(".", high(p["x"]), (p["x"] % 256).cast("string"), high(p["y"]), (p["y"] % 256).cast("string")))

    # area 001-899 without 666, group 01-99, serial 0001-9999
    area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    back = lambda v: v + 1 + F.when(v >= 665, 1).otherwise(0)
    wide = lambda v, n: F.lpad(v.cast("string"), n, "0")
    ssn = _let(feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), lambda p: F.concat(wide(back(F.floor(p["x"] / 99).cast("long")), 3), F.substring(m, 4, 1), wide(p["x"] % 99 + 1, 2), F.substring(m, 4, 1), wide(p["y"] + 1, 4)))

    start = F.lit("1700-01-01").cast("date")
    day = F.datediff(_day(m), start).cast("long")
    year_first = m.rlike("^[0-9]{4}/")
    swapped = m.contains("/") & ~year_first & F.try_to_date(m, "d/M/yyyy").isNull()
    moved = _let(feistel(F.floor(day / DAYS[1]).cast("long"), day % DAYS[1], DAYS[0], DAYS[1], key, "date"), lambda p: F.date_add(start, (p["x"] * DAYS[1] + p["y"]).cast("int")))
    # a date with a part of one digit is written without zeros again
    short = F.length(m) < 10
    form = lambda v, full, bare: F.when(short, F.date_format(v, bare)).otherwise(F.date_format(v, full))
    date = (
        F.when(swapped, form(_month_first(_day(m), key), "MM/dd/yyyy", "M/d/yyyy"))
        .when(m.contains("-"), F.date_format(moved, "yyyy-MM-dd"))
        .when(year_first, form(moved, "yyyy/MM/dd", "yyyy/M/d"))
        .when(m.contains("/"), form(moved, "dd/MM/yyyy", "d/M/yyyy"))
        .otherwise(form(moved, "dd.MM.yyyy", "d.M.yyyy"))
    )

    code = F.regexp_extract(m, CALLING_CODE, 0)
    local = F.substring(m, F.length(code) + 1, F.length(m))
    # ten digits without a code keep to those that begin with 2 to 9, or to those that don't
    high_, low_ = F.substring(d, 1, 5).cast("long"), F.substring(d, 6, 5).cast("long")
    least = F.when(high_ >= 20_000, 20_000).otherwise(0).cast("long")
    ten = _let(feistel(high_ - least, low_, F.when(high_ >= 20_000, 80_000).otherwise(20_000).cast("long"), 100_000, key, F.concat(F.lit("phone from "), least.cast("string"))), lambda p: F.concat(wide(p["x"] + least, 5), wide(p["y"], 5)))
    phone = F.when((code == "") & (F.length(d) == 10), laid_out(m, ten)).otherwise(F.concat(code, laid_out(local, permuted_digits(_digits(local), key, "phone"))))

    own = _card(m, d)
    checked = _let(permuted_digits(F.substring(own, F.lit(1), F.length(own) - 1), key, "card"), lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
    card = laid_out(m, F.concat(checked, F.substring(d, F.length(own) + 1, F.length(d))))

    low = F.lower(m)
    ip6 = laid_out(low, permuted_hex(F.replace(low, F.lit(":"), F.lit("")), key), "[0-9a-f]")

    compact = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(compact, 1, 2)
    account = laid_out(F.substring(compact, F.lit(5), F.length(compact)), permuted_digits(_digits(F.substring(compact, F.lit(5), F.length(compact))), key, "iban"))
    iban = _let(account, lambda acc: _grouped(m, F.concat(country, wide(98 - iban_rest(acc, country, "00"), 2), acc)))

    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "date", date).when(kind == "iban", iban).otherwise(m)


def _grouped(shape: Column, value: Column) -> Column:
    """``value`` with the spaces of ``shape``."""
    at = lambda i: F.when(F.substring(shape, i, F.lit(1)) == " ", " ").otherwise(F.substring(value, F.length(F.replace(F.substring(shape, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the values in the text column replaced, and the number of each kind in ``n_<kind>`` columns."""
    given = F.col(text).cast("string")
    values = F.transform(F.regexp_extract_all(given, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    between = F.split(given, ANY, -1)
    held = free_name("_found", docs.columns)
    marked = docs.withColumn(held, F.when(given.rlike(SIGN), values))
    new = F.transform(F.col(held), lambda v: pseudonym(v["m"], v["kind"], key))
    joined = F.array_join(F.zip_with(between, F.array_append(new, F.lit("")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    is_kind = lambda k: lambda v: v["kind"] == k
    counts = {free_name(f"n_{k}", docs.columns): F.when(F.size(held) > 0, F.size(F.filter(F.col(held), is_kind(k)))).otherwise(0).cast("long") for k in KINDS}
    # texts without a value skip the second search
    return marked.withColumns({text: F.when(F.size(held) > 0, joined).otherwise(given), **counts}).drop(held)
