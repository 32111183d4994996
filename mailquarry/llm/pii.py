"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days from 1800-01-01 to 2199-12-31 are 400 years of the calendar: 189 * 773 days.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1800-01-01", 189, 773

#: Kinds in the order in which they are tried, with their patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?<=(?:password|passwd|secret|api_key|token)\s?[=:]\s?[\"']?)[0-9a-f]{16,64}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "date": r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w-])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w.])\+[0-9]{8,15}(?![\w-])|(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])",
}
#: Every match holds a digit or an at sign; the look-ahead lets the scan pass over plain prose quickly.
ANY = "|".join(PATTERNS.values())


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _prf(key: str, *parts: Column) -> Column:
    """A pseudo-random 60-bit number of the parts."""
    return _number(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-z]"), 26).when(c.rlike("[A-Z]"), 26).otherwise(1)


def _base(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(0)


def _characters(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Permutes the letters and digits of a string; each stays of its class and all others stay in place.

    A Feistel network over the two halves of the letters and digits, numbered from their classes: in each round every
    place of one half is moved by a pseudo-random amount that depends on its place and on the whole other half.
    """
    own = "[0-9a-f]" if hexadecimal else "[0-9A-Za-z]"
    if hexadecimal:
        number = lambda c: F.struct(F.conv(c, 16, 10).cast("long").alias("v"), F.lit(16).alias("r"), F.lit(-1).alias("b"))
    else:
        number = lambda c: F.struct((F.ascii(c) - _base(c)).cast("long").alias("v"), _radix(c).alias("r"), _base(c).alias("b"))
    letter = lambda x: F.when(x["b"] == -1, F.lower(F.hex(x["v"]))).otherwise(F.char(x["v"] + x["b"]))

    def turn(state: Column, r: Column) -> Column:
        low, half = r % 2 == 0, F.floor(F.size(state) / 2)
        other = F.array_join(F.transform(F.filter(state, lambda x, i: (i < half) != low), lambda x: x["v"]), ",")

        def moved(by: Column) -> Column:
            def move(x: Column, i: Column) -> Column:
                v = F.when((i < half) == low, F.pmod(x["v"] + _prf(key, F.lit(kind), r, i, by), x["r"]).cast("long")).otherwise(x["v"])
                return F.struct(v.alias("v"), x["r"].alias("r"), x["b"].alias("b"))

            return F.transform(state, move)

        return _let(other, moved)

    def permuted(chars: Column) -> Column:
        start = F.transform(F.filter(chars, lambda c: c.rlike(own)), number)
        return _refilled(chars, F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), letter), own)

    return _let(F.split(value, ""), permuted)


def _refilled(chars: Column, new: Column, own: str) -> Column:
    """chars with those of a class replaced, in order, by new ones."""

    def filled(x: Column) -> Column:
        before = lambda i: F.size(F.filter(F.slice(x["own"], 1, i), lambda f: f))
        return F.array_join(F.transform(chars, lambda c, i: F.when(F.get(x["own"], i), F.get(x["new"], before(i))).otherwise(c)), "")

    return _let(F.struct(new.alias("new"), F.transform(chars, lambda c: c.rlike(own)).alias("own")), filled)


def _pair(a: Column, b: Column, rows: int, columns: int, key: str, kind: str) -> Column:
    """A Feistel network on a pair of numbers below rows and columns: an exact permutation of rows * columns values."""

    def turn(s: Column, r: Column) -> Column:
        first = F.when(r % 2 == 0, F.pmod(s["a"] + _prf(key, F.lit(kind), r, s["b"]), F.lit(rows))).otherwise(s["a"])
        second = F.when(r % 2 == 1, F.pmod(s["b"] + _prf(key, F.lit(kind), r, s["a"]), F.lit(columns))).otherwise(s["b"])
        return F.struct(first.cast("long").alias("a"), second.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn scheme of an array of digits, the last of which counts once."""

    def total(ds: Column) -> Column:
        n = F.size(ds)
        each = F.transform(ds, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
        return F.aggregate(each, F.lit(0), lambda s, d: s + d)

    return _let(F.transform(digits, lambda d: d.cast("int")), total)


def _digits(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]"))


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is made to satisfy the Luhn check."""

    def checked(payload: Column) -> Column:
        check = F.pmod(10 - _luhn(F.split(F.concat(payload, F.lit("0")), "")) % 10, F.lit(10))
        return _refilled(F.split(value, ""), F.split(F.concat(payload, check.cast("string")), ""), "[0-9]")

    text = F.array_join(_digits(value), "")
    return _let(_characters(F.substring(text, F.lit(1), F.length(text) - 1), key, "card"), checked)


def _remainder97(text: Column) -> Column:
    """A string of digits and capitals, read as the IBAN scheme does, modulo 97."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _compact(v: Column) -> Column:
    return F.replace(v, F.lit(" "), F.lit(""))


def _iban_ok(v: Column) -> Column:
    c = _compact(v)
    return _remainder97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1


def _iban(v: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits are made to fit; blanks stay in place."""
    check = lambda body: F.lpad((98 - _remainder97(F.concat(body, F.substring(v, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    body = _characters(F.substring(_compact(v), F.lit(5), F.length(v)), key, "iban")
    return _let(body, lambda b: _refilled(F.split(v, ""), F.split(F.concat(F.substring(v, 1, 2), check(b), b), ""), "[A-Z0-9]"))


def _ip(v: Column, key: str) -> Column:
    """Four octets as a pair of 16-bit numbers."""
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    pair = _pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 1 << 16, 1 << 16, key, "ip")
    return _let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))


def _ssn(v: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99 and serial 0001-9999 as a pair of numbers."""
    area = F.substring(v, 1, 3).cast("int")
    rest = (F.substring(v, 5, 2).cast("int") - 1) * 9999 + F.substring(v, 8, 4).cast("int") - 1
    pair = _pair(F.when(area > 666, area - 2).otherwise(area - 1), rest, 898, 99 * 9999, key, "ssn")
    two = lambda n, width: F.lpad(n.cast("long").cast("string"), width, "0")
    return _let(pair, lambda p: F.concat_ws("-", two(F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1), 3), two(F.floor(p["b"] / 9999) + 1, 2), two(p["b"] % 9999 + 1, 4)))


def _day(v: Column) -> Column:
    """The day that a date string names, or null."""
    day = F.coalesce(F.try_to_date(v, "yyyy-MM-dd"), F.try_to_date(v, "dd/MM/yyyy"), F.try_to_date(v, "MM/dd/yyyy"), F.try_to_date(v, "dd.MM.yyyy"))
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def _days_of_months(v: Column, key: str) -> Column:
    """A date written month first that cannot be read day first (its day is over 12): permuted among such dates only, so
    that no other notation has its pseudonym. Days 13 to 28 are a grid with all months of the range; days 29 and 30
    outside of February, the 31sts and the leap days are permuted apart."""
    day = F.to_date(v, "MM/dd/yyyy")
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day) - int(FIRST_DAY[:4])
    long_months = F.array(*[F.lit(x) for x in (1, 3, 5, 7, 8, 10, 12)])
    leap_years = F.array(*[F.lit(x) for x in range(400) if x % 4 == 0 and (x + 1800) % 100 or (x + 1800) % 400 == 0])
    shown = lambda year, month, d: F.concat_ws("/", F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(d.cast("int").cast("string"), 2, "0"), (year + int(FIRST_DAY[:4])).cast("int").cast("string"))
    grid = _let(_pair(y * 12 + m - 1, d - 13, 4800, 16, key, "day13"), lambda p: shown(F.floor(p["a"] / 12), p["a"] % 12 + 1, p["b"] + 13))
    other = lambda r: F.when(r == 0, 1).otherwise(r + 2)
    late = _let(_pair(y * 11 + F.when(m > 2, m - 2).otherwise(0), d - 29, 4400, 2, key, "day29"), lambda p: shown(F.floor(p["a"] / 11), other(p["a"] % 11), p["b"] + 29))
    last = _let(_pair(y, F.array_position(long_months, m) - 1, 400, 7, key, "day31"), lambda p: shown(p["a"], F.get(long_months, p["b"].cast("int")), F.lit(31)))
    leap = _let(_pair(F.array_position(leap_years, y) - 1, F.lit(0), 97, 1, key, "leap"), lambda p: shown(F.get(leap_years, p["a"].cast("int")), F.lit(2), F.lit(29)))
    return F.when(d <= 28, grid).when(d == 31, last).when(m == 2, leap).otherwise(late)


def _date(v: Column, key: str) -> Column:
    """A day of the range for a day of the range; what reads day first or month first only is permuted apart."""
    day = _day(v)
    shown = lambda new: F.when(v.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(v.contains("."), F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    pair = _pair(F.floor(day / DAY_COLUMNS), day % DAY_COLUMNS, DAY_ROWS, DAY_COLUMNS, key, "date")
    of_day = _let(_let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAY_COLUMNS + p["b"]).cast("int"))), shown)
    return F.when(v.contains("/") & F.try_to_date(v, "dd/MM/yyyy").isNull(), _days_of_months(v, key)).otherwise(of_day)


def kind_of(v: Column) -> Column:
    """The kind of a match, or null if it fails the check of its format (then it stays as it is)."""
    octets = F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 255)
    in_range = _day(v).between(0, DAY_ROWS * DAY_COLUMNS - 1)
    ssn = ~v.rlike("^(000|666|9)") & ~v.rlike("-00-") & ~v.rlike("-0000$")
    only = lambda k: v.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(only("email"), "email")
        .when(only("key"), "key")
        .when(v.rlike("^[0-9a-f]{16,64}$") & v.rlike("[a-f]"), "secret")
        .when(v.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_iban_ok(v), "iban"))
        .when(only("date"), F.when(in_range, "date"))
        .when(only("ip"), F.when(octets, "ip"))
        .when(only("ssn"), F.when(ssn, "ssn"))
        .when(only("card"), F.when(_luhn(_digits(v)) % 10 == 0, "card"))
        .when(only("phone"), F.when(F.size(_digits(v)).between(9, 15), "phone"))
    )


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    """The value that stands for v; v itself where kind is null. Within a kind and key it is a permutation of the format."""
    return (
        F.when(kind == "email", F.concat(_characters(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1)))
        .when(kind == "key", F.concat(F.lit("AKIA"), _characters(F.substring(v, F.lit(5), F.length(v)), key, "key")))
        .when(kind == "secret", _characters(v, key, "secret", hexadecimal=True))
        .when(kind == "iban", _iban(v, key))
        .when(kind == "date", _date(v, key))
        .when(kind == "ip", _ip(v, key))
        .when(kind == "card", _card(v, key))
        .when(kind == "ssn", _ssn(v, key))
        .when(kind == "phone", _characters(v, key, "phone"))
        .otherwise(v)
    )


def _running(numbers: Column, chunk: int = 64) -> Column:
    """Running sums of an array: sums of whole chunks, and of the rest of a chunk, so no element is added often."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)

    def summed(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda c: total(F.slice(x, c * chunk + 1, F.lit(chunk))))
        before = lambda s: F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c)))
        place = lambda firsts: F.transform(x, lambda _, i: F.get(firsts, F.floor(i / chunk).cast("int")) + total(F.slice(x, F.floor(i / chunk).cast("int") * chunk + 1, i % chunk + 1)))
        return _let(_let(chunks, before), place)

    return _let(numbers, summed)


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with personal data in a text column replaced, and `pii`: array of (kind, start, original_sha, pseudonym).

    E-mail addresses (local part), card numbers (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4
    addresses, dates, access keys and hexadecimal secrets are found by one pattern, checked against their format and put
    through a keyed permutation of it: digits stay digits, checksums and dates stay valid. Equal values of a kind have
    equal pseudonyms in all documents; different values have different ones. What fails its check stays. The text is
    split at the matches and put together again within its row: nothing is shuffled, and no row meets another. Texts
    without a match, null and empty ones are unchanged, with an empty array. start counts code points of the original,
    from 0. An existing column pii is replaced. The key stays with the caller; anyone who has it can invert the
    permutation.
    """
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(column), F.lit("")).alias("_text"))
    text = F.col("_text")
    spans = packed.withColumn("_spans", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    found = F.size("_spans") > 0
    gaps = spans.withColumn("_gaps", F.when(found, F.split(text, ANY, -1)))
    kinds = gaps.withColumn("_kinds", F.transform("_spans", kind_of))
    new = kinds.withColumn("_new", F.transform(F.arrays_zip("_spans", "_kinds"), lambda s: pseudonym(s["_spans"], s["_kinds"], key)))
    joined = F.concat(F.array_join(F.zip_with(F.slice("_gaps", F.lit(1), F.size("_spans")), "_new", lambda g, n: F.concat(g, n)), ""), F.element_at("_gaps", -1))
    lengths = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_spans")), "_spans", lambda g, s: F.length(g) + F.length(s))
    starts = F.zip_with("_ends", "_spans", lambda end, s: end - F.length(s))
    listed = F.filter(F.zip_with(F.arrays_zip(F.col("_kinds").alias("k"), F.col("_new").alias("n"), F.col("_spans").alias("s")), starts, lambda x, at: F.struct(x["k"].alias("kind"), at.alias("start"), F.sha2(x["s"], 256).alias("original_sha"), x["n"].alias("pseudonym"))), lambda x: x["kind"].isNotNull())
    out = new.withColumn("_ends", F.when(found, _running(lengths)))
    kept = [F.when(found, joined).otherwise(F.col("row")[c]).alias(c) if c == column else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "pii"]
    return out.select(*kept, F.when(found, listed).otherwise(F.array().cast("array<struct<kind:string,start:int,original_sha:string,pseudonym:string>>")).alias("pii"))
