"""Pseudonyms for personal data that keep the format: a keyed Feistel permutation over the symbols of each value.

DataFrame functions only. A value keeps its length, separators, letter case and symbol kinds; one key maps equal values
to equal pseudonyms in every document and different values of a kind to different ones: each kind is permuted within its
own set of valid strings. Numbers and dates are validated first: cards by the Luhn sum, IBANs by their country's length,
modulo 97 and check digits 02 to 98, addresses by octets without leading zeros up to 255, social security numbers by area
(not 000, 666 or from 900), group and serial, dates by the calendar of 1800 to 2199, and their pseudonyms are valid again.
What fails its validation is left as it is. A phone's country code, an email's last label and the name before a secret stay.

The key is the caller's secret; queries take it from the session's setting KEY_SETTING, and DEFAULT_KEY, which anybody can
read here and so protects nothing, only where that is unset.

Defined cases: a null text stays null, an empty one empty, both with counts of 0; texts are scanned whole; repeated rows
get equal results; an empty table gives an empty one; only the named text column is read, and columns of the input that
have the names of the added counts are replaced (all others stay, whatever their names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.session import positional

ROUNDS = 8
DEFAULT_KEY = "glossa-demonstration-key"
KEY_SETTING = "spark.glossa.pii.key"

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """IBANs as long as their country says, so that a token after one is not taken in; of other countries any length."""
    rest = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}{rest(n - 4)}" for n, names in IBAN_LENGTHS.items())
    every = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|(?!{every})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"


#: Kinds in order of preference where two would start at the same place, each with its pattern.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|(?i:password|passwd|pwd|token|secret|api_?key)\s*+[=:]\s*+[\"']?[A-Za-z0-9_+/-]{8,})(?![A-Za-z0-9])",
    "iban": _iban_pattern(),
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def hinted(x: Column) -> Column:
    """Whether x has what every match has: a digit, @, = or :, or a known key prefix. Other texts skip the patterns."""
    return x.rlike("[0-9@=:]") | x.contains("ghp_") | x.contains("sk-") | x.contains("AKIA") | x.contains("glpat-") | x.contains("eyJ")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _noise(key: str, kind: str, round_: Column, half: Column) -> Column:
    """64 hex digits of keyed pseudo-random data for a round: a hash of key, kind, round and the other half."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), round_.cast("string"), half, F.lit(key)), 256)


def _number(hex_: Column, at: Column | int, width: int) -> Column:
    return F.conv(F.substring(hex_, at, F.lit(width)) if isinstance(at, Column) else F.substring(hex_, at, width), 16, 10).cast("long")


def _shift(c: Column, k: Column) -> Column:
    """The symbol k places on in its own alphabet: digits, small or capital letters; others stay."""
    a = F.ascii(c)
    turn = lambda base, size: F.char(F.pmod(a - base + k, F.lit(size)) + base)
    return F.when((a >= 48) & (a <= 57), turn(48, 10)).when((a >= 97) & (a <= 122), turn(97, 26)).when((a >= 65) & (a <= 90), turn(65, 26)).otherwise(c)


def permuted(x: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of x's format: Feistel rounds that shift one half's symbols by a hash of the other."""
    text = lambda symbols: F.array_join(symbols, "")

    def round_(halves: Column, r: Column) -> Column:
        left, right = halves["left"], halves["right"]
        # one hash for each 16 symbols, bound to a name, or it would be made again for each symbol
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(left) / 16).cast("int")), lambda b: _noise(key, kind, r, F.concat_ws("\x1e", text(right), b.cast("string"))))
        moved = F.transform(F.array(blocks), lambda noise: F.transform(left, lambda c, i: _shift(c, _number(F.get(noise, F.floor(i / 16).cast("int")), F.pmod(i, F.lit(16)) * 4 + 1, 4))))[0]
        return F.struct(right.alias("left"), moved.alias("right"))

    symbols = F.filter(_chars(x), lambda c: c.rlike("[A-Za-z0-9]"))
    half = F.floor(F.size(symbols) / 2).cast("int")
    start = F.struct(F.slice(symbols, F.lit(1), half).alias("left"), F.slice(symbols, half + 1, F.size(symbols)).alias("right"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda h: F.concat(h["left"], h["right"]))
    # back between the separators: the k-th symbol of x becomes the k-th of the permuted ones
    return F.aggregate(
        _chars(x),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), done.alias("symbols")),
        lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["text"], F.get(acc["symbols"], acc["used"])).alias("text"), (acc["used"] + 1).alias("used"), acc["symbols"].alias("symbols"))).otherwise(
            F.struct(F.concat(acc["text"], c).alias("text"), acc["used"].alias("used"), acc["symbols"].alias("symbols"))
        ),
        lambda acc: acc["text"],
    )


def permuted_number(x: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 to a * b - 1: the same rounds on the quotient and the remainder."""
    a, b = [F.lit(n) if isinstance(n, int) else n for n in (a, b)]

    def round_(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        hi = F.when(even, F.pmod(s["hi"] + _number(_noise(key, kind, r, s["lo"].cast("string")), 1, 14), a)).otherwise(s["hi"])
        lo = F.when(even, s["lo"]).otherwise(F.pmod(s["lo"] + _number(_noise(key, kind, r, s["hi"].cast("string")), 1, 14), b))
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    start = F.struct(F.floor(x / b).cast("long").alias("hi"), F.pmod(x, b).cast("long").alias("lo"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: s["hi"] * b + s["lo"])


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; doubled: 0 if the last digit is to be doubled, else 1."""
    each = lambda c, i: F.when(F.pmod(i, F.lit(2)) == doubled, F.lit(2)).otherwise(F.lit(1)) * c.cast("int")
    return F.aggregate(F.transform(F.reverse(_chars(digits)), each), F.lit(0), lambda s, v: s + F.floor(v / 10).cast("int") + F.pmod(v, F.lit(10)))


def _filled(x: Column, digits: Column) -> Column:
    """x with its digits replaced in turn."""
    return F.array_join(F.transform(_chars(x), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(x, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _card(x: Column, key: str) -> Column:
    body = permuted(F.substring(_digits(x), F.lit(1), F.length(_digits(x)) - 1), key, "card")
    return F.transform(F.array(body), lambda b: _filled(x, F.concat(b, F.pmod(10 - F.pmod(_luhn(b, 0), F.lit(10)), F.lit(10)).cast("string"))))[0]


def _mod97(x: Column) -> Column:
    """x modulo 97, letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(x), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(x: Column, key: str) -> Column:
    plain = F.replace(x, F.lit(" "), F.lit(""))
    fresh = F.transform(F.array(permuted(F.substr(plain, F.lit(5)), key, "iban")), lambda b: F.concat(F.substring(plain, 1, 2), F.lpad((98 - _mod97(F.concat(b, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))[0]
    place = lambda i: F.length(F.replace(F.substring(x, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    return F.transform(F.array(fresh), lambda f: F.array_join(F.transform(_chars(x), lambda c, i: F.when(c == " ", c).otherwise(F.substring(f, place(i), F.lit(1)))), ""))[0]


def _ip(x: Column, key: str) -> Column:
    """Among the addresses whose octets have as many digits each: 0 to 9, 10 to 99 or 100 to 255."""
    octets = F.split(x, r"\.")
    least = lambda o: F.when(F.length(o) == 1, 0).when(F.length(o) == 2, 10).otherwise(100).cast("long")
    size = lambda o: F.when(F.length(o) == 1, 10).when(F.length(o) == 2, 90).otherwise(156).cast("long")
    rank = lambda k: F.get(octets, k).cast("long") - least(F.get(octets, k))
    sizes = [size(F.get(octets, k)) for k in range(4)]
    a, b = sizes[0] * sizes[1], sizes[2] * sizes[3]
    number = (rank(0) * sizes[1] + rank(1)) * b + rank(2) * sizes[3] + rank(3)

    def written(n: Column) -> Column:
        hi, lo = F.floor(n / b).cast("long"), F.pmod(n, b)
        ranks = [F.floor(hi / sizes[1]).cast("long"), F.pmod(hi, sizes[1]), F.floor(lo / sizes[3]).cast("long"), F.pmod(lo, sizes[3])]
        return F.concat_ws(".", *[(r + least(F.get(octets, k))).cast("string") for k, r in enumerate(ranks)])

    return F.transform(F.array(permuted_number(number, a, b, key, "ip")), written)[0]


#: Days of the calendar's cycle of 400 years from 1800-01-01, as a product; and those of them after a month's 12th.
DAYS, LATE_DAYS = (27, 5411), (9, 9833)
_FIRST = "1800-01-01"


def _date_format(x: Column) -> Column:
    """As a day, the format: 0 year first, 1 day/month/year, 2 month/day/year (only where the day can't be a month), 3 day.month.year; null if no date."""
    return F.when(x.contains("-"), F.lit(0)).when(x.contains("."), F.lit(3)).otherwise(F.when(F.substring(x, 4, 2).cast("int") > 12, F.lit(2)).otherwise(F.lit(1)))


_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def _days(x: Column) -> Column:
    day = reduce(lambda rest, k: F.when(_date_format(x) == k, F.try_to_timestamp(x, F.lit(_FORMATS[k])).cast("date")).otherwise(rest), range(4), F.lit(None).cast("date"))
    return F.datediff(day, F.lit(_FIRST).cast("date"))


def _date(x: Column, key: str) -> Column:
    """Among the days; a month/day/year among those after a month's 12th, as it could not be told from day/month/year else."""
    first = F.lit(_FIRST).cast("date")
    day = F.date_add(first, _days(x))
    fresh = F.date_add(first, permuted_number(_days(x), *DAYS, key, "date").cast("int"))
    # The late days in order: of month k since 1800 the first is the day firsts(k).
    months = (F.year(day) - 1800) * 12 + F.month(day) - 1
    firsts = lambda k: F.datediff(F.add_months(first, k), first) - k * 12
    rank = permuted_number((_days(x) - (months + 1) * 12).cast("long"), *LATE_DAYS, key, "late-date")

    def late(r: Column) -> Column:
        about = F.floor(r / 18.4369).cast("int")
        month = F.array_max(F.filter(F.sequence(F.greatest(about - 3, F.lit(0)), F.least(about + 3, F.lit(4799))), lambda k: firsts(k) <= r))
        return F.transform(F.array(month), lambda k: F.date_add(F.add_months(first, k), (r - firsts(k) + 12).cast("int")))[0]

    made = F.when(_date_format(x) == 2, F.transform(F.array(rank), late)[0]).otherwise(fresh)
    return F.transform(F.array(made), lambda d: reduce(lambda rest, k: F.when(_date_format(x) == k, F.date_format(d, _FORMATS[k])).otherwise(rest), range(4), F.lit(None).cast("string")))[0]


def _ssn(x: Column, key: str) -> Column:
    """Area (898 of them), group and serial together."""
    number = lambda at, n: F.substring(x, at, n).cast("long")
    area = number(1, 3) - 1 - (number(1, 3) > 666).cast("long")
    low = permuted_number((area * 99 + number(5, 2) - 1) * 9999 + number(8, 4) - 1, 898 * 99, 9999, key, "ssn")

    def written(n: Column) -> Column:
        place = F.floor(n / (99 * 9999)).cast("long") + 1
        parts = [(place + (place >= 666).cast("long"), 3), (F.pmod(F.floor(n / 9999).cast("long"), F.lit(99)) + 1, 2), (F.pmod(n, F.lit(9999)) + 1, 4)]
        return F.concat_ws("-", *[F.lpad(p.cast("string"), w, "0") for p, w in parts])

    return F.transform(F.array(low), written)[0]


def _secret(x: Column, key: str) -> Column:
    """The name before = or : and a known prefix stay, the value is permuted."""
    head = F.regexp_extract(x, r"^((?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?|AKIA|ghp_|sk-|glpat-|eyJ)", 1)
    return F.concat(head, permuted(F.substring(x, F.length(head) + 1, F.length(x)), key, "secret"))


def _email(x: Column, key: str) -> Column:
    """Name and domain are permuted apart, so one domain stays one domain; the last label stays."""
    at = F.substring_index(x, "@", -1)
    top = F.substring_index(at, ".", -1)
    return F.concat(permuted(F.substring_index(x, "@", 1), key, "name"), F.lit("@"), permuted(F.substring(at, F.lit(1), F.length(at) - F.length(top) - 1), key, "domain"), F.lit("."), top)


def kind_of(x: Column) -> Column:
    """The kind of a match after validation; null if no kind holds."""
    whole = lambda k: x.rlike(f"^(?:{PATTERNS[k]})$")
    octets = F.forall(F.split(x, r"\."), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]"))
    day = _days(x)
    tests = {
        "email": whole("email"),
        "secret": whole("secret"),
        "iban": whole("iban") & F.substring(x, 3, 2).between("02", "98") & (_mod97(F.concat(F.substr(F.replace(x, F.lit(" "), F.lit("")), F.lit(5)), F.substring(x, 1, 4))) == 1),
        "ip": whole("ip") & octets,
        "date": whole("date") & day.between(0, DAYS[0] * DAYS[1] - 1),
        "ssn": whole("ssn") & ~x.rlike("^(000|666|9)|-00-|-0000$"),
        "card": whole("card") & (F.pmod(_luhn(_digits(x), 1), F.lit(10)) == 0),
        "phone": whole("phone") & F.length(_digits(x)).between(9, 15),
    }
    return reduce(lambda rest, k: F.when(F.coalesce(tests[k], F.lit(False)), F.lit(k)).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """x in its kind's format under the key; x itself where the kind is null."""
    plain = F.regexp_extract(x, r"^(\+[0-9]{1,3}(?:[ .-]|(?=\())?)?", 0)
    phone = F.concat(plain, permuted(F.substring(x, F.length(plain) + 1, F.length(x)), key, "phone"))
    made = {"email": _email(x, key), "secret": _secret(x, key), "iban": _iban(x, key), "ip": _ip(x, key), "date": _date(x, key), "ssn": _ssn(x, key), "card": _card(x, key), "phone": phone}
    return reduce(lambda rest, k: F.when(kind == k, made[k]).otherwise(rest), made, x)


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """docs with `text` replaced, and the counts n_<kind> of each kind and n_pii of all (long).

    Matches are found from the left and don't overlap. The key belongs to the caller; under one key equal values agree.
    """
    columns = docs.columns
    rows, t = positional(docs), F.col(f"_{columns.index(text)}")
    found = F.when(hinted(t), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    made = F.transform("found", lambda m: F.transform(F.array(F.struct(m.alias("m"), kind_of(m).alias("kind"))), lambda s: F.struct(s["kind"].alias("kind"), pseudonym(s["m"], s["kind"], key).alias("made")))[0])
    rows = rows.withColumn("found", found).withColumn("made", F.when(F.size("found") > 0, made)).drop("found")
    between = F.split(t, ANY, -1)
    joined = F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("made"), i)["made"], F.lit("")))), "")
    count = lambda k: F.coalesce(F.size(F.filter(F.col("made"), lambda m: m["kind"] == k)), F.lit(0)).cast("long")
    counts = {f"n_{k}": F.when(F.col("made").isNull(), F.lit(0).cast("long")).otherwise(count(k)) for k in PATTERNS}
    added = [*counts, "n_pii"]
    out = rows.select(*[F.when(F.col("made").isNull(), t).otherwise(joined).alias(f"_{i}") if c == text else F.col(f"_{i}") for i, c in enumerate(columns)], *[c.alias(k) for k, c in counts.items()])
    out = out.withColumn("n_pii", sum((F.col(c) for c in added[1:-1]), F.col(added[0])))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns) if c not in added], *added)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)
