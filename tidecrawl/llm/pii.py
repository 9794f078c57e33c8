"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every found value is permuted by a keyed Feistel network within its own format: digits stay digits, letters letters
of the same case and the same block of Unicode, cards keep a right check digit, addresses octets up to 255, dates stay
calendar dates, social security numbers stay assignable. Equal values so get equal pseudonyms in all documents, and
different values of a kind different ones; of secrets, those of hexadecimal digits only and all others by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import unused

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TEXT = (DIGITS, LOWER, UPPER)
BLOCK = 128  # code points; other letters and numerals move among those of their category in an aligned block
CATEGORIES = (r"\p{Ll}", r"\p{Lu}", r"\p{Lt}", r"\p{Lm}", r"\p{Lo}", r"\p{Nd}", r"\p{Nl}", r"\p{No}")
LONG = 100  # characters of half a value beyond which its hash stands for it, so that work grows with its length
DAY_ZERO, DAYS = "1000-01-01", (730, 1000)  # dates from there on, as a product of two near sizes
AREAS, GROUPS, SERIALS = 898, 99, 9999  # of social security numbers: 001-899 without 666, 01-99, 0001-9999

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"  # possessive throughout: a group that may be given back is matched by recursion
ADDRESS = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
DATE = r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)"
SECRET = r"(?i:(?:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"'][^\"'\s]{8,}+[\"'])"
KINDS = {"email": EMAIL, "ip": ADDRESS, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "secret": SECRET}
HINT = r"@|\d[ .-]?\d|[=:]\s{0,3}[\"']"  # every value of any kind has one of these
BUT_CARDS = "|".join(p for k, p in KINDS.items() if k != "card")
RUN = r"(?<![\w.+-])(?=\d(?:[ -]?\d){12})\d++(?!\w)(?:[ -]\d++(?!\w))*+"  # all groups of digits with a separator between


def prf(key: str, *parts) -> Column:
    """A keyed pseudo-random number below 2^60."""
    text = F.concat_ws("|", F.lit(key), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def let(value: Column, use) -> Column:
    """use(v) with the value taken once: lambdas would evaluate the expression anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def letters(x: Column) -> Column:
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))


def turned(x: Column, other: Column, k: Column, key: str, alphabets: tuple[str, ...]) -> Column:
    """x with each character moved within its alphabet by what the other half, the round and the place give."""

    def move(c, i, size, told):
        by = prf(key, k, i, size, told)
        out = F.when(c.rlike(r"[\p{L}\p{N}&&[^\p{ASCII}]]"), let(F.struct(c.alias("c"), by.alias("by")), lambda v: in_block(v["c"], v["by"]))).otherwise(c) if alphabets is TEXT else c
        for a in reversed(alphabets):
            at = F.instr(F.lit(a), c)
            out = F.when(at > 0, F.substring(F.lit(a), (F.pmod(at - 1 + by, F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    known = F.struct(F.length(x).alias("n"), F.when(F.length(other) > LONG, F.sha2(other, 256)).otherwise(other).alias("t"))
    return let(known, lambda v: F.array_join(F.transform(letters(x), lambda c, i: move(c, i, v["n"], v["t"])), ""))


def category(c: Column) -> Column:
    out = F.lit(-1)
    for i, pattern in enumerate(CATEGORIES):
        out = F.when(c.rlike(pattern), i).otherwise(out)
    return out


def in_block(c: Column, by: Column) -> Column:
    """c moved among the characters of its category in its block.

    An odd step leads through the whole block and back to c; the first one on the way that is of c's category is taken.
    Walking a permutation of the block until a subset is met again permutes the subset.
    """
    code = F.ascii(c)  # the code point
    at = F.struct(c.alias("c"), (code - F.pmod(code, F.lit(BLOCK))).alias("base"), F.pmod(code, F.lit(BLOCK)).alias("off"), (F.pmod(by, F.lit(BLOCK // 2)) * 2 + 1).alias("step"), category(c).alias("kind"))
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")
    walk = lambda v: F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: char(v["base"] + F.pmod(v["off"] + i * v["step"], F.lit(BLOCK))))
    return let(at, lambda v: F.get(F.filter(walk(v), lambda x: category(x) == v["kind"]), F.lit(0)))


def permuted(x: Column, key: str, alphabets: tuple[str, ...] = TEXT) -> Column:
    """A bijection on the strings of x's format; an even number of rounds brings both halves back to their places."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.length(x)).alias("r"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, lambda s, k: F.struct(s["r"].alias("l"), turned(s["l"], s["r"], k, key, alphabets).alias("r")), lambda s: F.concat(s["l"], s["r"]))


def permuted_pair(l: Column, r: Column, sizes: tuple[int, int], key: str, finish) -> Column:
    """finish(struct(l, r)) of a bijection on pairs below the two sizes."""

    def rounds(s, k):
        left = F.pmod(s["l"] + prf(key, k, "l", s["r"]), F.lit(sizes[0]))
        return let(left, lambda v: F.struct(v.alias("l"), F.pmod(s["r"] + prf(key, k, "r", v), F.lit(sizes[1])).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), rounds, finish)


def refilled(shape: Column, value: Column) -> Column:
    """shape with its digits, in order, replaced by those of value."""
    return let(value, lambda digits: _refilled(shape, digits))


def _refilled(shape: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s, c):
        number = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(number, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + number.cast("int")).alias("k"))

    return F.aggregate(letters(shape), start, put, lambda s: s["out"])


def luhn(digits: Column, from_right: int) -> Column:
    """The weighted sum of a card's digits; those at even places from the right, counted from from_right, double."""

    def add(s, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when((i + from_right) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def date_of(x: Column) -> Column:
    """The calendar date of a value, null if there is no such day. Day before month where both would do."""
    parsed = [F.try_to_timestamp(x, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")]
    return F.coalesce(*parsed)


def cards_of(run: Column) -> Column:
    """The cards among the stretches of whole groups of a run: 13 to 19 digits with a right check digit."""

    def stretches(parts):
        n = F.size(parts)
        pick = lambda i, k: F.regexp_replace(F.array_join(F.slice(parts, i, k), ""), "[ -]$", "")
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i + 1)), lambda k: pick(i, k))))

    sized = F.filter(let(F.split(run, "(?<=[ -])"), stretches), lambda c: F.length(only_digits(c)).between(13, 19))
    return F.filter(sized, lambda c: let(only_digits(c), lambda d: luhn(d, 0)) % 10 == 0)


def pattern_of(text: Column) -> Column:
    """What to find in a text: all kinds but cards, and the text's own cards, the longest first."""
    runs = F.coalesce(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.array().cast("array<string>"))
    cards = F.array_distinct(F.flatten(F.transform(runs, cards_of)))
    longest = F.transform(F.reverse(F.array_sort(F.transform(cards, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))), lambda s: s["c"])
    own = let(longest, lambda c: F.when(F.size(c) > 0, F.concat(F.lit(r"|(?<![\w.+]|(?<!\d)-)(?:"), F.array_join(c, "|"), F.lit(r")(?!\w)"))).otherwise(""))
    return F.concat(F.lit(BUT_CARDS), own)


def kind_of(x: Column) -> Column:
    """The kind of a found value after validation; null if it fails."""
    date = date_of(x)
    inside = date.isNotNull() & (F.datediff(date, F.lit(DAY_ZERO).cast("date")).between(0, DAYS[0] * DAYS[1] - 1))
    checks = {"date": inside, "card": let(only_digits(x), lambda d: luhn(d, 0)) % 10 == 0}
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(KINDS.items())):
        found = x.rlike(f"^(?:{pattern})$")
        out = F.when(found, F.when(checks[name], name) if name in checks else F.lit(name)).otherwise(out)
    return out


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym; values of no kind stay."""
    digits = only_digits(x)
    local = F.substring_index(x, "@", 1)
    email = F.concat(permuted(local, f"{key}email"), F.substring(x, F.length(local) + 1, F.length(x)))

    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    dotted = lambda s: F.concat_ws(".", *[c.cast("string") for c in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)])
    ip = let(octets, lambda o: permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), f"{key}ip", dotted))

    first = F.try_to_timestamp(x, F.lit("dd/MM/yyyy")).isNotNull()
    day_of = lambda s: F.date_add(F.lit(DAY_ZERO).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int"))
    moved = let(F.datediff(date_of(x), F.lit(DAY_ZERO).cast("date")), lambda d: permuted_pair(F.floor(d / DAYS[1]), d % DAYS[1], DAYS, f"{key}date", day_of))
    styled = lambda m: F.when(x.contains("-"), F.date_format(m, "yyyy-MM-dd")).when(x.contains("."), F.date_format(m, "dd.MM.yyyy")).when(first, F.date_format(m, "dd/MM/yyyy")).otherwise(F.date_format(m, "MM/dd/yyyy"))
    day_out = let(moved, styled)

    code = F.length(only_digits(F.regexp_extract(x, r"^\+(\d{1,3})(?=\D)", 1)))  # a country code stays
    phone = refilled(x, F.concat(F.substring(digits, F.lit(1), code), permuted(F.substring(digits, code + 1, F.length(digits)), f"{key}phone", (DIGITS,))))

    area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    number = lambda v, n: F.lpad(v.cast("string"), n, "0")
    shown = lambda s: F.concat_ws("-", number(s["l"] + F.when(s["l"] < 665, 1).otherwise(2), 3), number(F.floor(s["r"] / SERIALS) + 1, 2), number(s["r"] % SERIALS + 1, 4))
    ssn = permuted_pair(area - F.when(area < 666, 1).otherwise(2), (group - 1) * SERIALS + serial - 1, (AREAS, GROUPS * SERIALS), f"{key}ssn", shown)

    body = F.concat(F.substring(digits, 1, 1), permuted(F.substring(digits, F.lit(2), F.length(digits) - 2), f"{key}card", (DIGITS,)))
    card = refilled(x, let(body, lambda d: F.concat(d, F.pmod(-luhn(d, 1), F.lit(10)).cast("string"))))

    head = F.regexp_extract(x, "^[^\"']*[\"']", 0)
    value = F.substring(x, F.length(head) + 1, F.length(x) - F.length(head) - 1)
    hidden = F.when(value.rlike("^[0-9a-f]+$"), permuted(value, f"{key}hex", (DIGITS + "abcdef",))).when(value.rlike("^[0-9A-F]+$"), permuted(value, f"{key}hex", (DIGITS + "ABCDEF",))).otherwise(permuted(value, f"{key}secret"))
    secret = F.concat(head, hidden, F.substring(x, F.length(x), F.lit(1)))

    made = {"email": email, "ip": ip, "date": day_out, "ssn": ssn, "phone": phone, "card": card, "secret": secret}
    out = x
    for name, value in made.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised under the key, plus n_found and n_<kind> for each kind.

    Kinds: e-mail addresses (the part before @ is permuted, in any script), IPv4 addresses, calendar dates from 1000 to 2998, US
    social security numbers, telephone numbers, card numbers with a right check digit, and quoted secrets of 8
    characters or more after token, password and the like. What fails validation stays; of digits in a row of groups, the
    leftmost and then longest stretches of whole groups that are cards count. Values of any length are whole. Null
    text stays null with counts 0. Repeated rows are treated alike; all columns of docs are kept as they are, but for
    own ones that have the added names.
    """
    names = ["n_found", *(f"n_{k}" for k in KINDS)]
    keep = [F.col(c) for c in docs.columns if c not in (*names, "text")]
    asked, met, marked = unused(docs.columns, "asked", "met", "marked")
    none = F.array().cast("array<string>")
    rows = docs.withColumn(asked, F.when(F.col("text").rlike(HINT), pattern_of(F.col("text"))))
    parts = F.struct(F.coalesce(F.regexp_extract_all("text", F.col(asked), F.lit(0)), none).alias("x"), F.split("text", F.col(asked), -1).alias("gaps"))
    rows = rows.withColumn(met, F.when(F.col(asked).isNotNull(), parts))
    values = F.transform(F.coalesce(F.col(f"{met}.x"), none), lambda x: F.struct(x.alias("v"), kind_of(x).alias("k")))
    rows = rows.withColumn(marked, values)
    new = F.transform(marked, lambda s: pseudonym(s["v"], s["k"], key))
    text = F.array_join(F.zip_with(f"{met}.gaps", new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    text = F.when(F.exists(marked, lambda s: s["k"].isNotNull()), text).otherwise(F.col("text")).alias("text")

    def count(kind: str) -> Column:
        return F.size(F.filter(marked, lambda s: s["k"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [F.size(F.filter(marked, lambda s: s["k"].isNotNull())).cast("long").alias("n_found"), *map(count, KINDS)]
    return rows.select(*keep, text, *counts)
