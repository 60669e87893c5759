import calendar
import datetime
import hashlib

import pytest
import regex as re
from pyspark.sql import functions as F

from tidejoin.llm import pii as P


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def iban_right(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def run(spark, texts, key=P.KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r.text for r in P.pseudonymised(df, key=key).orderBy("i").collect()]


def shape(s):
    return re.sub("[0-9]", "9", s)


def network(x, y, a, b, key, tweak):
    for i in range(1, P.ROUNDS + 1):
        mix = lambda v: int(hashlib.sha256(f"{key}|{tweak}|{i}|{v}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        x, y = ((x + mix(y)) % a, y) if i % 2 else (x, (y + mix(x)) % b)
    return x, y


def moved_digits(d, key, tweak, base=10):
    n, left = len(d), len(d) // 2
    x, y = network(int(d[:left] or "0", base), int(d[left:] or "0", base), base**left, base ** (n - left), key, f"{tweak}{n}")
    form = "x" if base == 16 else "d"
    return (format(x, f"0{left}{form}") if left else "") + (format(y, f"0{n - left}{form}") if n > left else "")


def filled(shape, d, digit="[0-9]"):
    d = iter(d)
    return "".join(next(d) if re.match(digit, c) else c for c in shape)


def month_first(day, key):
    y, m, d = day.year - 1700, day.month, day.day
    others, longs = [m for m in range(1, 13) if m != 2], [1, 3, 5, 7, 8, 10, 12]
    leaps = [v for v in range(1700, 2100) if calendar.isleap(v)]
    if d <= 28:
        x, z = network(y, (m - 1) * 16 + d - 13, 400, 192, key, "month first")
        return datetime.date(1700 + x, z // 16 + 1, z % 16 + 13)
    if d == 31:
        x, z = network(y, longs.index(m), 400, 7, key, "month first 31")
        return datetime.date(1700 + x, longs[z], 31)
    if m == 2:
        return datetime.date(leaps[network(leaps.index(day.year), 0, 97, 1, key, "month first leap")[0]], 2, 29)
    x, z = network(y, others.index(m) * 2 + d - 29, 400, 22, key, "month first 29")
    return datetime.date(1700 + x, others[z // 2], z % 2 + 29)


def day_of(m):
    for form in ("%Y-%m-%d",) if "-" in m else ("%Y/%m/%d",) if re.match(r"\d{4}/", m) else ("%d/%m/%Y", "%m/%d/%Y") if "/" in m else ("%d.%m.%Y",):
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        return (day, form) if 1700 <= day.year <= 2099 else (None, None)
    return None, None


CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def plain_value(m, key):
    """Kind and pseudonym of one match, with nothing of the library but the key and the number of rounds."""
    d, compact = re.sub("[^0-9]", "", m), m.replace(" ", "")
    groups = [g for g in m.split(":") if g]
    if "@" in m:
        return "email", hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:32] + "@example.invalid"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d{4}/\d+/\d+|\d\d?([/.])\d\d?\1\d{4}", m):
        day, form = day_of(m)
        if day is None:
            return None, m
        form = form if len(m) == 10 else form.replace("%d", "%-d").replace("%m", "%-m")
        if form.startswith(("%m", "%-m")):
            return "date", month_first(day, key).strftime(form)
        n = (day - datetime.date(1700, 1, 1)).days
        x, y = network(n // 5411, n % 5411, 27, 5411, key, "date")
        new = datetime.date(1700, 1, 1) + datetime.timedelta(x * 5411 + y)
        return "date", new.strftime(form)
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m) and all(int(o) < 256 for o in m.split(".")):
        o = [int(v) for v in m.split(".")]
        x, y = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return "ip", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if m.count(":") == 7 and len(groups) == 8 or "::" in m:
        if "::" in m and not (2 <= len(groups) <= 7 and len("".join(groups)) >= 5):
            return None, m
        h = "".join(groups).lower()
        h = moved_digits(h[:30], key, "ip6 a", 16) + h[30:]
        over = max(0, len(h) - 30)
        return "ip6", filled(m.lower(), h[:over] + moved_digits(h[over:], key, "ip6 b", 16), "[0-9a-f]")
    if re.fullmatch(r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}", m):
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None, m
        x, y = network((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        area = x // 99 + 1
        return "ssn", m[3].join([f"{area + (area >= 666):03d}", f"{x % 99 + 1:02d}", f"{y + 1:04d}"])
    if "+" in m or re.fullmatch(r"(\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}|[2-9]\d\d \d{3} \d{4}|[2-9]\d{9}", m):
        code = ""
        if m[0] != "+" and len(d) == 10:
            least = 20_000 if d[0] >= "2" else 0
            x, y = network(int(d[:5]) - least, int(d[5:]), 80_000 if least else 20_000, 100_000, key, f"phone from {least}")
            return "phone", filled(m, f"{x + least:05d}{y:05d}")
        if m[0] == "+":
            lead = re.match(r"\+(\d{1,3})", m)[1]
            code = "+" + next((c for c in CODES if lead.startswith(c)), lead)
            code += re.match(r"( ?\(0\))?", m[len(code) :])[0]
        local = m[len(code) :]
        return "phone", code + filled(local, moved_digits(re.sub("[^0-9]", "", local), key, "phone"))
    if m[0].isalpha():
        if not iban_right(m):
            return None, m
        account = filled(compact[4:], moved_digits(re.sub("[^0-9]", "", compact[4:]), key, "iban"))
        rest = int("".join(str(int(c, 36)) for c in account + compact[:2] + "00")) % 97
        return "iban", filled(m, iter(compact[:2] + f"{98 - rest:02d}" + account), "[^ ]")
    own = d if luhn(d) else d[:16] if len(m) == 23 and luhn(d[:16]) else None
    if own is None:
        return None, m
    new = moved_digits(own[:-1], key, "card")
    check = next(c for c in "0123456789" if luhn(new + c))
    return "card", filled(m, new + check + d[len(own) :])


def plain(text, key=P.KEY):
    return None if text is None else re.sub(P.ANY, lambda m: plain_value(m[0], key)[1], text)


STRINGS = ["+15551234567", "+49 30 1234567", "+442079460958", "+3725551234", "12/25/1990", "02/29/1996 and 29/02/1996", "12/31/1999 10/30/2001 04/13/1777", "31/31/1999", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "FE80::1 x fe80::1", "std::vector a::b ::1", "5551234567 and 1551234567", "n" * 70 + "@host.org", "a@" + "label." * 10 + "example.com.", "x" * 100_000 + "@y.io", "4111 1111 1111 1111 110 or 6304 0000 0000 0000 000", "4111 1111 1111 1112 123", "4111-1111-1111-1111 car", "a@b.c d@e..fg", "2001:db8::ff00:42:8329,", "1:2:3:4:5:6:7:8:9", "DE89 3704 0044 0532 0130 00", "10.0.0.255.", "1999-12-31T", "123-45-6789", "+1 (017) 555-7713 190", "jürgen@example.org x", "über.Straße@müller.de", "::ffff:192.0.2.1", "555 123 4567", "123 45 6789", "1/2/1990", "1990/12/25", "2020-01-01T10:00:00", "2020-01-01TX", "+49 (0)30 901820", "1/25/1990 3.4.2001 1990/1/2", "017-555-7713"]
#: Each is one value of a kind, which its pseudonym has to be again.
SEEN = {"jürgen@example.org": "email", "555 123 4567": "phone", "123 45 6789": "ssn", "1/2/1990": "date", "1990/12/25": "date", "+49 (0)30 901820": "phone", "1/25/1990": "date", "5551234567": "phone", "192.0.2.1": "ip", "2001:db8::ff00:42:8329": "ip6", "4111111111111111": "card", "DE89 3704 0044 0532 0130 00": "iban"}


def test_pseudonyms_are_values_of_the_same_kind(spark):
    """No part of a value stays in clear, and what replaces it would be found again."""
    df = spark.createDataFrame([(s,) for s in SEEN], "text string")
    once = P.pseudonymised(df).collect()
    again = P.pseudonymised(spark.createDataFrame([(r.text,) for r in once], "text string")).collect()
    for (s, kind), a, b in zip(SEEN.items(), once, again, strict=True):
        assert a.text != s and a[f"n_{kind}"] == 1 == b[f"n_{kind}"], (s, a.text)
    mapped, stamp = run(spark, ["::ffff:192.0.2.1", "at 2020-01-01T10:00:00Z"])
    assert mapped.startswith("::ffff:") and "192" not in mapped and re.fullmatch(r"::ffff:\d+\.\d+\.\d+\.\d+", mapped)
    assert stamp.endswith("T10:00:00Z") and "2020-01-01" not in stamp
    assert "jü" not in once[0].text


def test_ten_digits_keep_their_first(spark):
    numbers = [f"{a}{b:08d}{c}" for a in range(2, 10) for b in range(0, 10**8, 2 * 10**6 + 77) for c in (0, 7)]
    got = run(spark, numbers)
    assert len(set(got)) == len(numbers) and all(re.fullmatch(r"[2-9]\d{9}", x) for x in got)


def test_whole_texts_equal_a_plain_version(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + STRINGS
    got = run(spark, texts)
    for text, new in zip(texts, got, strict=True):
        assert new == plain(text), (text or "")[:200]
    assert sum(a != b for a, b in zip(texts, got, strict=True)) > 20
    clear = dict(zip(STRINGS, got[-len(STRINGS) :], strict=True))
    for s in ("+15551234567", "12/25/1990", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "5551234567 and 1551234567", "n" * 70 + "@host.org", STRINGS[13]):
        assert clear[s] != s
    assert clear["+15551234567"].startswith("+1") and clear["+15551234567"][2:5] != "555" and clear["std::vector a::b ::1"] == "std::vector a::b ::1"
    counts = P.pseudonymised(spark.createDataFrame([(t,) for t in STRINGS], "text string")).collect()
    for t, r in zip(STRINGS, counts, strict=True):
        kinds = [plain_value(m[0], P.KEY)[0] for m in re.finditer(P.ANY, t)]
        assert all(r[f"n_{k}"] == kinds.count(k) for k in P.KINDS), t


def test_dates_with_the_month_first_stay_apart(spark):
    days = [datetime.date(1700, 1, 1) + datetime.timedelta(k) for k in range(146_097)]
    days = [d for d in days if d.day > 12 and (d.year % 8 == 0 or d.day > 28)]
    df = spark.createDataFrame([(d.strftime("%m/%d/") + str(d.year),) for d in days], "text string")
    got = [r.text for r in P.pseudonymised(df).select("text").collect()]
    assert len(set(got)) == len(days) and all(int(t[3:5]) > 12 for t in got)


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([("x 10.0.0.1", 99, 5, "f")], "text string, n_date int, n_ip int, _found string")
    out = P.pseudonymised(df)
    r = out.first()
    assert (r.n_date, r.n_ip, r["_found"], r["_n_ip"], r["_n_date"]) == (99, 5, "f", 1, 0) and out.columns[:4] == df.columns


def test_forms_and_checks_stay(spark):
    cards = ["4111111111111111", "4539 1488 0343 6467", "378282246310005"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    others = ["+1 (017) 555-7713", "212-555-0199", "123-45-6789", "1999-12-31", "29/02/2000", "31.12.1999"]
    got = run(spark, [*cards, *ibans, *others])
    for a, b in zip([*cards, *ibans, *others], got, strict=True):
        assert a != b and shape(a) == shape(b)
    assert all(luhn(x) for x in got[:3]) and all(iban_right(x) for x in got[3:5])
    assert got[5].startswith("+1 (")
    ip = run(spark, ["10.0.0.255"])[0]
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and ip != "10.0.0.255"
    assert run(spark, ["a.b@x.org"])[0].endswith("@example.invalid")


def test_what_fails_its_check_stays(spark):
    texts = ["4111111111111112", "2001-13-40", "000-12-3456", "1.2.3.4.5", "300.1.1.1", "DE89 3704 0044 0532 0130 01", "a@b", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "", "no 12345 numbers", "x4111111111111111"]
    assert run(spark, texts) == texts


def test_equal_values_stay_linked_and_text_around_stays(spark):
    got = run(spark, ["a 4111111111111111, b.", "c\n4111111111111111 10.0.0.1 d 10.0.0.1", None])
    x = re.findall(r"\d{16}", got[0])[0]
    ip = re.findall(r"\d+\.\d+\.\d+\.\d+", got[1])
    assert got[0] == f"a {x}, b." and got[1] == f"c\n{x} {ip[0]} d {ip[0]}" and got[2] is None
    assert run(spark, ["4111111111111111"], key="other")[0] != x


@pytest.mark.parametrize(("a", "b"), [(10, 100), (27, 5), (7, 1)])
def test_the_network_permutes(spark, a, b):
    df = spark.range(a * b).select(F.floor(F.col("id") / b).cast("long").alias("x"), (F.col("id") % b).alias("y"))
    got = df.select(P.feistel(F.col("x"), F.col("y"), a, b, "k", "t").alias("p")).select("p.*").collect()
    assert sorted((r.x, r.y) for r in got) == [(x, y) for x in range(a) for y in range(b)]


def test_digit_strings_permute(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = [r[0] for r in df.select(P.permuted_digits(F.col("d"), "k", "t")).collect()]
    assert sorted(got) == [f"{i:03d}" for i in range(1000)]


def test_all_ssns_of_an_area_stay_valid_and_apart(spark):
    df = spark.range(1, 900).where("id <> 666").select(F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-01-0001")).alias("text"))
    got = [r.text for r in P.pseudonymised(df).collect()]
    assert len(set(got)) == 898 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) for x in got)


def test_rows_and_columns(docs, empty):
    out = P.pseudonymised(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count() and P.pseudonymised(empty).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
