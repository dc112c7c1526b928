"""Personal data and secrets replaced by pseudonyms that keep the format, so equal values stay equal everywhere.

Numbers and dates are checked first (card numbers by their check digit, address parts by their range, dates by
the calendar) and then permuted by a keyed Feistel network over just the values of their format: another valid
number of the same shape, one to one. Names of accounts and secrets have no format to permute; they get a keyed
hash of fixed shape, the same for equal values. Texts are cut at the matches and joined again, in columns.

| kind | found by | becomes |
|---|---|---|
| email | local@domain.tld | keyed hash at a reserved domain |
| key | AKIA and 16 capitals or digits | AKIA and 16 keyed hex capitals |
| secret | a word such as password or token, = or :, a value of any length, quoted or up to a blank; bearer tokens, signed web tokens, vendor keys; runs of 32 hex digits or more | keyed hash of the same length |
| secret | a private key block, also one without its end | its first and last line, between them a keyed hash |
| iban | two letters, two digits, 11 to 30 more, check sum 97; runs of whole groups, of the country's length first | digits permuted, check digits made right |
| ip | four parts of 0 to 255 | 32 bits permuted |
| ip | eight hex groups, or fewer and ::, with a digit | 128 bits permuted, written as eight groups |
| date | yyyy-mm-dd (also with / or .), dd.mm.yyyy, mm/dd/yyyy in the calendar, 1900 to 2099 | days permuted |
| ssn | ddd-dd-dddd in the allowed ranges | digits permuted inside the ranges |
| phone | +1 or (ddd) and the like; + and 8 to 15 digits; 0, an area code, a gap and the rest, 9 to 12 digits | digits permuted inside the numbering plan |
| card | 13 to 19 digits with right check digit; runs of whole groups, usual groupings first | all but the check digit permuted, check digit made right |

Defined results: null text stays null, with counts of 0; text without a match stays as it is, byte for byte; a
candidate that fails its check stays; ids, repeated rows and further columns pass through; a column named like
a count is replaced by it. The key is given, or `spark.faultline.pseudonymKey` of the session; without either a
built-in one is used with a warning, as whoever knows it can undo the permutations.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY = "faultline-pseudonyms"
KEY_SETTING = "spark.faultline.pseudonymKey"
ROUNDS = 10

# characters of an account number by country; other countries may have any length
IBAN_LENGTHS = {
    c: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in countries.split()
}

_NAME = r"A-Za-z0-9._%+\p{L}\p{N}-"
EMAIL = rf"(?<![{_NAME}])[{_NAME}]++@(?:[A-Za-z0-9\p{{L}}\p{{N}}-]{{1,63}}\.){{1,8}}[A-Za-z\p{{L}}]{{2,24}}"
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
HEX = r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"
_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}"
# a key of a known maker keeps what names the maker
_MAKER = r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_(?:live|test)_|sk-|AIza)"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.-]{0,199}[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*+)"
)
SECRET = (
    rf"(?<![A-Za-z0-9])(?:(?=[PpSsTtAa]){_NAMED}(?:\"[^\"\r\n]{{6,}}+\"|'[^'\r\n]{{6,}}+'|[\"']?[^\s\"'<>]{{6,}}+)"
    r"|(?=[Bb])(?i:bearer)[ \t]{1,4}[A-Za-z0-9._~+/=-]{16,}+"
    r"|(?<![_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"
    rf"|(?=[gxsA])(?<!_){_MAKER}[A-Za-z0-9_-]{{16,}}+|{HEX})|{PRIVATE_KEY}"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
# eight groups, or up to seven around a double colon; a digit must be among them, as words of a to f may stand around one too
_H = "[0-9a-fA-F]{1,4}"
IPV6 = (
    rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{{0,28}}[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,5}})?::{_H}(?::{_H}){{0,5}})(?![0-9A-Za-z:])"
)
DATE = (
    r"(?=[0-9])(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|(?:19|20)[0-9]{2}\.[0-9]{2}\.[0-9]{2}"
    r"|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
US_PHONE = r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
PHONE = r"\+[1-9](?:[ ()/.-]{0,2}[0-9]){7,14}(?![0-9])"
NATIONAL = r"(?<![0-9+./-])0[1-9][0-9]{1,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,4}){0,3}(?![0-9]|[./-][0-9])"
# what may stand right beside a number and is no part of it
_BESIDE = "|".join(f"(?:{p})" for p in (EMAIL, KEY, SECRET, IP, DATE, SSN, US_PHONE))
_GAP = rf"(?: (?!{_BESIDE}))?+"
# all groups of digits that stand together, at least 13 digits: the numbers among them are told apart later
CARD = rf"(?<![0-9])[0-9](?:(?:[ -](?!{_BESIDE}))?+[0-9]){{12,}}+"
# an account number of its country's length, or else of any, and the groups after it, which may be other numbers
_OF_COUNTRY = "|".join(
    rf"(?:{'|'.join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)})[0-9]{{2}}(?:{_GAP}[0-9A-Z]{{4}}){{{n // 4 - 1}}}"
    + (rf"{_GAP}[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
    for n in sorted(set(IBAN_LENGTHS.values()))
)
_ACCOUNT = rf"(?:{_OF_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?:{_GAP}[0-9A-Z]{{4}}){{2,7}}(?:{_GAP}[0-9A-Z]{{1,3}})?(?![A-Za-z0-9]))"
ACCOUNT = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}){_ACCOUNT}(?:[ -](?!{_BESIDE})(?:{_ACCOUNT}|[0-9]++(?![A-Za-z0-9])))*+"
# in this order, as the first that fits at a place is taken
KINDS = {
    "email": EMAIL, "key": KEY, "secret": SECRET, "iban": ACCOUNT, "ip": IP, "ipv6": IPV6, "date": DATE, "ssn": SSN, "us_phone": US_PHONE,
    "phone": PHONE, "national": NATIONAL, "card": CARD,
}
# kinds that are counted under another's name
_COUNTED_AS = {"us_phone": "phone", "national": "phone", "ipv6": "ip"}
# inside a word nothing begins but what begins with a digit or a sign
ANY = "(?:(?<![A-Za-z0-9])|(?=[0-9(+-]))(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
COUNTED = ("email", "key", "secret", "iban", "ip", "date", "ssn", "phone", "card")
COUNTS = [f"n_{k}" for k in COUNTED]
# every kind holds one of these: spares most texts the search
HINT = "[0-9@=:]|AKIA|-----BEGIN|eyJ|[Bb][Ee][Aa][Rr][Ee][Rr]|gh[pousr]_|xox[abprs]-|sk[_-]"
LONGEST = 34  # characters of an account number
# numbers as cards bear them; other groupings count where no such number is among them
CARD_GROUPS = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
# 270 * 271 days from 1900-01-01 reach beyond 2099-12-31: a domain of two coprime factors needs no second try
DAY_ROWS, DAY_COLUMNS = 270, 271


def _number(text: Column) -> Column:
    return text.cast("bigint")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, rows: Column, columns: Column, key: str, name: str) -> Column:
    """A keyed permutation of the pairs (left in 0..rows-1, right in 0..columns-1), as a struct (l, r)."""

    def turn(state: Column, k: Column) -> Column:
        def mixed(value: Column) -> Column:
            return F.conv(F.substring(_digest(key, F.lit(name), k, rows, columns, value), 1, 15), 16, 10).cast("bigint")

        return F.when(
            k % 2 == 0, F.struct(F.pmod(state["l"] + mixed(state["r"]), rows).alias("l"), state["r"].alias("r"))
        ).otherwise(F.struct(state["l"].alias("l"), F.pmod(state["r"] + mixed(state["l"]), columns).alias("r")))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _ten(power: Column) -> Column:
    """10 to a small power, exactly."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), power.cast("int"))).cast("bigint")


def permute_digits(digits: Column, key: str, name: str) -> Column:
    """A text of 2 to 36 digits as another of the same length, one to one."""
    n = F.char_length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n)
    out = feistel(_number(left), _number(right), _ten(half), _ten(n - half), key, name)
    return _with(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), half, "0"), F.lpad(o["r"].cast("string"), n - half, "0")))


def _with(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(template: Column, digits: Column) -> Column:
    """`template` with its digits replaced, in order, by `digits`."""
    filled = F.aggregate(
        F.split(template, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
    )
    return filled["out"]


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right (not the last) doubled and cast out by nine."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.cast("int")).otherwise(
                F.when(c.cast("int") < 5, 2 * c.cast("int")).otherwise(2 * c.cast("int") - 9)),
        ),
        F.lit(0), lambda a, x: a + x,
    )


def _card(value: Column, key: str) -> Column:
    """A valid card number as another one."""

    def made(digits: Column) -> Column:
        body = permute_digits(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
        return _with(body, lambda b: refill(value, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    return _with(_only_digits(value), made)


def _mod97(text: Column) -> Column:
    """The check sum of an account number: first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, 1, 4))
    return F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda a, c: F.when(c == "", a).when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _iban(value: Column, key: str) -> Column:
    """A valid account number as another one."""

    def made(flat: Column) -> Column:
        rest = F.substring(flat, F.lit(5), F.char_length(flat))
        digits = _only_digits(rest)
        # letters of the rest stay, its digits are permuted; fewer than two digits cannot be
        moved = F.when(F.char_length(digits) >= 2, refill(rest, permute_digits(digits, key, "iban"))).otherwise(rest)
        country = F.substring(flat, 1, 2)
        check = _with(moved, lambda m: F.concat(F.lpad((98 - _mod97(F.concat(country, F.lit("00"), m))).cast("string"), 2, "0"), _only_digits(m)))
        return refill(value, check)

    return _with(F.replace(value, F.lit(" ")), made)


def _numbers(value: Column, key: str) -> Column:
    """(text, n_iban, n_card) of groups that stand together: each run of whole groups that is a number is replaced.

    From left to right; at each group an account number of its country's length comes first, then any other account
    number, then a card number in usual groups, then one in any groups that takes nothing of a number in usual groups;
    of several, the longest.
    """
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    part_of = F.lit("[ -]?(?:[0-9]+|[A-Z]+)")
    # inside what has the form of an account number, only usual groups are a card
    inside = F.size(F.regexp_extract_all(F.regexp_extract(value, f"^{_ACCOUNT}", 0), part_of, F.lit(0)))

    def replaced(parts: Column) -> Column:
        n = F.size(parts)

        def text(first: Column, last: Column) -> Column:
            return F.array_join(F.slice(parts, first + 1, last - first + 1), "")

        def bare(first: Column, last: Column) -> Column:
            return F.regexp_replace(text(first, last), "^[ -]", "")

        def longest(first: Column, valid) -> Column:
            """The last group of the longest valid run from `first`, or null."""
            ends = F.sequence(first, F.least(first + LONGEST - 1, n - 1))
            return F.array_max(F.filter(ends, lambda e: _with(bare(first, e), lambda t: valid(t, e))))

        def card(t: Column, e: Column) -> Column:
            return t.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & (luhn_sum(_only_digits(t)) % 10 == 0)

        def usual(t: Column, e: Column) -> Column:
            return t.rlike(CARD_GROUPS) & (luhn_sum(_only_digits(t)) % 10 == 0)

        def account(t: Column, e: Column) -> Column:
            border = (e == n - 1) | F.get(parts, e + 1).rlike("^[ -]")
            return border & t.rlike(f"^(?:{IBAN})$") & (_mod97(F.replace(t, F.lit(" "))) == 1)

        def of_country(t: Column, e: Column) -> Column:
            flat = F.replace(t, F.lit(" "))
            return (F.char_length(flat) == F.try_element_at(lengths, F.substring(flat, 1, 2))) & account(t, e)

        def unless_usual(first: Column, last: Column) -> Column:
            cut = F.exists(F.sequence(first + 1, F.greatest(last, first + 1)), lambda k: (k <= last) & longest(k, usual).isNotNull())
            return F.when(~cut, last)

        def at(k: Column) -> Column:
            """(kind, last group) of the number that begins at group `k`; null if none does."""
            part = F.get(parts, k)
            accounts = F.coalesce(longest(k, of_country), longest(k, account))
            cards = F.coalesce(longest(k, usual), _with(longest(k, card), lambda e: F.when(e.isNotNull() & (k >= inside), unless_usual(k, e))))
            head = part.rlike("^[ -]?[A-Z]{2}$") & ((k == 0) | part.rlike("^[ -]"))
            return F.when(head, F.struct(F.lit("iban").alias("kind"), accounts.alias("last"))).when(
                part.rlike("[0-9]"), F.struct(F.lit("card").alias("kind"), cards.alias("last")))

        def step(s: Column, k: Column) -> Column:
            def found(hit: Column) -> Column:
                sep = F.regexp_extract(F.get(parts, k), "^[ -]?", 0)
                is_iban = hit["kind"] == "iban"
                new = _with(bare(k, hit["last"]), lambda t: F.struct(t.alias("t"), F.when(is_iban, _iban(t, key)).otherwise(_card(t, key)).alias("new")))
                return _with(new, lambda r: F.struct(
                    F.concat(s["text"], sep, r["new"]).alias("text"), hit["last"].alias("done"),
                    (s["n_iban"] + (is_iban & (r["t"] != r["new"])).cast("int")).alias("n_iban"),
                    (s["n_card"] + (~is_iban & (r["t"] != r["new"])).cast("int")).alias("n_card")))

            as_is = F.struct(F.concat(s["text"], F.get(parts, k)).alias("text"), s["done"].alias("done"), s["n_iban"].alias("n_iban"), s["n_card"].alias("n_card"))
            return F.when(k <= s["done"], s).otherwise(_with(at(k), lambda hit: F.when(hit["last"].isNotNull(), found(hit)).otherwise(as_is)))

        start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("done"), F.lit(0).alias("n_iban"), F.lit(0).alias("n_card"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)

    return _with(F.regexp_extract_all(value, part_of, F.lit(0)), replaced)


def _ip(value: Column, key: str) -> Column:
    def made(parts: Column) -> Column:
        part = [_number(F.get(parts, F.lit(k))) for k in range(4)]
        side = F.lit(65536).cast("bigint")
        out = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], side, side, key, "ip")
        return _with(out, lambda o: F.concat_ws(".", *[x.cast("string") for v in (o["l"], o["r"]) for x in (F.floor(v / 256), v % 256)]))

    valid = lambda p: F.forall(p, lambda x: x.cast("int") <= 255)
    return _with(F.split(value, r"\."), lambda p: F.when(valid(p), made(p)).otherwise(value))


def _ipv6(value: Column, key: str) -> Column:
    """All 128 bits, in two halves of 64 that are mixed by exclusive or; equal addresses stay equal however they are written."""

    def group(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda g: g != "")

    def whole(sides: Column) -> Column:
        head, tail = group(F.get(sides, 0)), group(F.coalesce(F.get(sides, 1), F.lit("")))
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(tail))
        return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(F.lower(g), 4, "0")), "")

    def half(text: Column) -> Column:
        return F.conv(text, 16, -10).cast("bigint")

    def mixed(state: Column, k: Column, side: str) -> Column:
        return half(F.substring(_digest(key, F.lit("ipv6"), k, state[side]), 1, 16))

    def made(digits: Column) -> Column:
        start = F.struct(half(F.substring(digits, 1, 16)).alias("l"), half(F.substring(digits, 17, 16)).alias("r"))
        out = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
            lambda s, k: F.when(k % 2 == 0, F.struct(s["l"].bitwiseXOR(mixed(s, k, "r")).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), s["r"].bitwiseXOR(mixed(s, k, "l")).alias("r"))),
        )
        written = _with(out, lambda o: F.concat(*[F.lpad(F.lower(F.hex(o[x])), 16, "0") for x in ("l", "r")]))
        return _with(written, lambda w: F.concat_ws(":", *[F.lower(F.hex(half(F.substring(w, 4 * g + 1, 4)))) for g in range(8)]))

    fits = lambda sides: F.size(group(F.get(sides, 0))) + F.size(group(F.coalesce(F.get(sides, 1), F.lit("")))) <= 8
    return _with(F.split(value, "::"), lambda sides: F.when(fits(sides), _with(whole(sides), made)).otherwise(value))


def _date(value: Column, key: str) -> Column:
    def made(form: str) -> Column:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")

        def moved(d: Column) -> Column:
            n = F.date_diff(d, F.lit("1900-01-01").cast("date"))
            out = feistel(F.floor(n / DAY_COLUMNS), n % DAY_COLUMNS, F.lit(DAY_ROWS).cast("bigint"), F.lit(DAY_COLUMNS).cast("bigint"), key, "date")
            when = _with(out, lambda o: F.date_add(F.lit("1900-01-01").cast("date"), (o["l"] * DAY_COLUMNS + o["r"]).cast("int")))
            return F.coalesce(F.date_format(when, form), value)

        return _with(day, moved)

    return (
        F.when(value.rlike("^[0-9]{4}-"), made("yyyy-MM-dd")).when(value.rlike("^[0-9]{4}/"), made("yyyy/MM/dd"))
        .when(value.rlike(r"^[0-9]{4}\."), made("yyyy.MM.dd")).when(value.contains("."), made("dd.MM.yyyy")).otherwise(made("MM/dd/yyyy"))
    )


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = _number(F.substring(value, 1, 3)), _number(F.substring(value, 5, 2)), _number(F.substring(value, 8, 4))
    # areas 1 to 899 but 666: 898 of them; groups 1 to 99, serials 1 to 9999
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), key, "ssn")
    made = _with(out, lambda o: F.concat(
        F.lpad(F.when(o["l"] >= 665, o["l"] + 2).otherwise(o["l"] + 1).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((F.floor(o["r"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((o["r"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), made).otherwise(value)


def _us_phone(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        ten = F.substring(digits, F.char_length(digits) - 9, F.lit(10))
        # area and exchange begin with 2 to 9
        out = feistel(
            _number(F.substring(ten, 1, 3)) - 200, _number(F.substring(ten, 4, 7)) - 2000000,
            F.lit(800).cast("bigint"), F.lit(8000000).cast("bigint"), key, "us_phone",
        )
        country = F.substring(digits, F.lit(1), F.char_length(digits) - 10)
        return _with(out, lambda o: refill(value, F.concat(country, (o["l"] + 200).cast("string"), (o["r"] + 2000000).cast("string"))))

    return _with(_only_digits(value), made)


def _phone(value: Column, key: str) -> Column:
    """The first digit after + says the region and stays."""
    return _with(
        _only_digits(value),
        lambda d: refill(value, F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.char_length(d)), key, "phone"))),
    )


def _national(value: Column, key: str) -> Column:
    """A number as dialled inside its country: 0 and the digit after it stay."""
    return _with(
        _only_digits(value),
        lambda d: F.when(
            F.char_length(d).between(9, 12),
            refill(value, F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), F.char_length(d)), key, "national"))),
        ).otherwise(value),
    )


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(key, F.lit("email"), F.lower(value)), 1, 16), F.lit("@mail.invalid"))


def _key(value: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(key, F.lit("key"), value), 1, 16)))


def _secret(value: Column, key: str) -> Column:
    """The naming word, if any, and quotes stay; what is secret becomes as many hex digits."""
    named = rf"^({_NAMED}[\"']?|(?i:bearer)[ \t]{{1,4}}|{_MAKER})"
    head = F.regexp_extract(value, named, 1)
    quote = F.when(head.rlike("[\"']$") & (F.right(value, F.lit(1)) == F.right(head, F.lit(1))), F.right(head, F.lit(1))).otherwise(F.lit(""))

    def spread(tail: Column) -> Column:
        long = F.repeat(_digest(key, F.lit("secret"), tail), F.ceil(F.char_length(tail) / 64).cast("int"))
        return F.substring(long, F.lit(1), F.char_length(tail))

    between = F.substring(value, F.char_length(head) + 1, F.char_length(value) - F.char_length(head) - F.char_length(quote))
    first, last = F.regexp_extract(value, "^-----BEGIN [A-Z ]{0,40}KEY-----", 0), F.regexp_extract(value, "-----END [A-Z ]{0,40}KEY-----$", 0)
    block = F.concat(first, F.lit("\n"), _digest(key, F.lit("block"), F.regexp_replace(value, r"\s", "")), F.lit("\n"), last)
    return F.when(first != "", block).otherwise(F.concat(head, _with(between, spread), quote))


_MADE = {
    "email": _email, "key": _key, "secret": _secret, "ip": _ip, "ipv6": _ipv6, "date": _date, "ssn": _ssn, "us_phone": _us_phone, "phone": _phone,
    "national": _national,
}


def _replaced(value: Column, key: str) -> Column:
    """(kind, text, n_iban, n_card) of one match; kind is null for numbers, which are counted by themselves, and if
    the check of another kind fails."""

    def one(kind: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), F.lit(0).alias("n_iban"), F.lit(0).alias("n_card"))

    # a match that depends on what stands around it stays if no kind fits it alone
    chosen = one(F.lit(None).cast("string"), value)
    for kind in reversed(KINDS):
        if kind in _MADE:
            made = one(F.lit(_COUNTED_AS.get(kind, kind)), _MADE[kind](value, key))
            chosen = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), made).otherwise(chosen)
        elif kind == "iban":
            # groups of digits too: the first kind that fits is taken, and what begins with a digit is none of the others
            numbers = _with(_numbers(value, key), lambda r: F.struct(F.lit(None).cast("string").alias("kind"), r["text"].alias("text"), r["n_iban"].alias("n_iban"), r["n_card"].alias("n_card")))
            chosen = F.when(value.rlike(f"^(?:{ACCOUNT}|{CARD})$"), numbers).otherwise(chosen)
    return chosen


def session_key(docs: DataFrame, key: str | None) -> str:
    found = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"no key given and {KEY_SETTING} is not set: pseudonyms made with the built-in key can be undone", stacklevel=3)
    return found or DEFAULT_KEY


def _matched(docs: DataFrame, key: str | None) -> tuple[DataFrame, Column, Column]:
    """The rows as a struct with the matches of their texts, the new text, and the matches that changed."""
    key = session_key(docs, key)
    text = F.col("text")
    hit = text.rlike(HINT)

    def judged(value: Column) -> Column:
        return _with(_replaced(value, key), lambda r: F.struct(*[r[c].alias(c) for c in ("kind", "text", "n_iban", "n_card")], (r["text"] != value).alias("changed")))

    found = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.when(hit, F.split(text, ANY, -1)).alias("_gaps"),
        F.when(hit, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), judged)).alias("_found"),
    )
    parts = F.transform("_gaps", lambda gap, i: F.concat(gap, F.coalesce(F.get("_found", i)["text"], F.lit(""))))
    new = F.when(F.size("_found") > 0, F.array_join(parts, "")).otherwise(F.col("_row.text"))
    return found, new, F.filter("_found", lambda m: m["changed"])


def mask_texts(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in `text`; all other columns as they are."""
    found, new, _ = _matched(docs, key)
    return found.select(*[new.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in `text`, and a count of replaced values per kind (n_email and so on)."""
    found, new, changed = _matched(docs, key)
    others = [new.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in COUNTS]
    wide = found.select(*others, changed.alias("_changed"))

    def count(kind: str) -> Column:
        if kind in ("iban", "card"):
            n = F.aggregate("_changed", F.lit(0), lambda a, m: a + m[f"n_{kind}"])
        else:
            n = F.size(F.filter("_changed", lambda m: m["kind"] == kind))
        return F.coalesce(n, F.lit(0)).cast("bigint").alias(f"n_{kind}")

    return wide.select(*[c for c in docs.columns if c not in COUNTS], *[count(k) for k in COUNTED])
