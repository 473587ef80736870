"""PII: format-preserving Feistel pseudonyms, as SQL expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of each Feistel network.
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Card numbers as they are usually printed: in groups, or in one.
_PRINTED = r"(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}(?:[ \-]\d{3})?|\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d{13,19})(?!\d)"
#: What is looked for, in order of preference at one place. Each begins behind a border, and its repeats are
#: possessive or bounded, so that no text takes more than linear time.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._+\-])[A-Za-z0-9._+\-]++@(?:[A-Za-z0-9\-]{{1,63}}+\.){{1,8}}[A-Za-z]{{2,24}}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "grouped_iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "iso_date": r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])",
    "dmy_date": r"(?<![\d/.\-])\d{2}([/.])\d{2}\1\d{4}(?![\d/]|[.]\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
    "abroad": r"(?<![\d+])(?=\+(?:[ .\-()]{0,2}\d){8,15}(?!\d))\+[1-9]\d{0,2}(?:[ .\-]\(?\d{2,8}\)?){2,5}(?!\d)",
    "printed_card": rf"(?<!\d){_PRINTED}",
    # Any other run of digits, unless a card as usually printed begins behind its first group.
    "card": rf"(?<!\d)(?!\d{{1,12}}[ \-]{_PRINTED})\d(?:[ \-]?\d){{12,18}}(?!\d)",
}
_NUMBERS = "|".join(p for k, p in PATTERNS.items() if k not in ("email", "iban", "grouped_iban"))
PATTERN = rf"{PATTERNS['email']}|{PATTERNS['iban']}|{PATTERNS['grouped_iban']}|(?=[\d(+])(?:{_NUMBERS})"


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x worked out once: a lambda's variable holds it, where repeating the expression would redo it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _keystream(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the kind of value, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string"), F.lit(key)), 256)


def permute(x: Column, a: int | Column, b: int | Column, key: str, tweak: Column, undo: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b-1: an alternating Feistel network over the pair (x div b, x mod b).

    Each round adds a keyed function of one half to the other, modulo that half's size, which can be undone;
    so the whole is a permutation for any a and b, without walking cycles. a and b stay under 2**59. `undo` gives its inverse.
    """
    a, b = (F.lit(n).cast("long") if isinstance(n, int) else n.cast("long") for n in (a, b))

    def add(half: Column, other: Column, turn: Column, size: Column) -> Column:
        return F.pmod(half + (-1 if undo else 1) * F.pmod(F.conv(F.substring(_keystream(key, tweak, turn, other), 1, 14), 16, 10).cast("long"), size), size)

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, add(s["l"], s["r"], i, a)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(add(s["r"], s["l"], i, b)).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])


def _shift(s: Column, stream: Column) -> Column:
    """Each letter and digit of s moved by a byte of the stream within its own class; the rest as it is."""
    def one(c: Column, by: Column) -> Column:
        code = F.ascii(c)
        cls = lambda low, n: F.chr(F.pmod(code - F.lit(low) + by, F.lit(n)) + F.lit(low))
        return F.when(code.between(48, 57), cls(48, 10)).when(code.between(97, 122), cls(97, 26)).when(code.between(65, 90), cls(65, 26)).otherwise(c)

    def moved(stream: Column) -> Column:
        byte = lambda i: F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.array_join(F.transform(F.split(s, ""), lambda c, i: one(c, byte(i))), "")

    return F.when(F.length(s) > 0, _let(stream, moved)).otherwise(s)


def permute_string(s: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the ASCII strings of one shape: letters stay letters of their case, digits digits."""
    cut = F.floor(F.length(s) / 2).cast("int")

    def turn(h: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, _shift(h["l"], _keystream(key, tweak, i, h["r"]))).otherwise(h["l"]).alias("l"), F.when(even, h["r"]).otherwise(_shift(h["r"], _keystream(key, tweak, i, h["l"]))).alias("r"))

    start = F.struct(F.substring(s, F.lit(1), cut).alias("l"), F.substring(s, cut + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda h: F.concat(h["l"], h["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _permute_digits(d: Column, key: str, tweak: Column) -> Column:
    """Permute decimal strings of up to 18 digits among those of the same length."""
    def moved(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")
        tens = lambda k: F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(10)]), k + 1)
        x = F.coalesce(F.substring(d, F.lit(1), cut).try_cast("long"), F.lit(0)) * tens(n - cut) + F.substring(d, cut + 1, n).try_cast("long")
        return F.lpad(permute(x, tens(cut), tens(n - cut), key, F.concat_ws("/", tweak, n.cast("string"))).cast("string"), n, "0")

    return _let(d, moved)


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits, in order, in the places of the shape's digits."""
    def filled(digits: Column) -> Column:
        step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["o"], F.substring(digits, s["i"], F.lit(1))).alias("o"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["i"].alias("i")))
        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")), step, lambda s: s["o"])

    return _let(digits, filled)


def luhn_sum(d: Column) -> Column:
    """Sum of the digits of d, each second one from the last doubled and its digits summed."""

    def value(c: Column, i: Column) -> Column:
        x = c.cast("int")
        twice = F.pmod(F.length(d) - 1 - i, F.lit(2)) == 1
        return F.when(twice, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.transform(F.split(d, ""), value), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def mod97(s: Column) -> Column:
    """ISO 7064 remainder of a string of digits and capital letters (A is 10, Z is 35)."""
    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.pmod(F.when(letter, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48), F.lit(97))

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _date(m: Column, form: str, key: str) -> Column:
    """Dates of 1900 to 2099 permuted among those 73,049 days (17 * 4297); others and invalid ones stay."""
    day = F.expr("DATE'1900-01-01'")
    moved = lambda n: F.date_format(F.date_add(day, permute(n.cast("long"), 17, 4297, key, F.lit("date")).cast("int")), form)
    return _let(F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), day), lambda n: F.when(n.between(0, 73048), moved(n)).otherwise(m))


def _card(m: Column, key: str) -> Column:
    """A card number that validates; else one, as usually printed, that validates inside the run."""
    checked = lambda p: F.concat(p, F.pmod(10 - F.pmod(luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    valid = lambda d: F.pmod(luhn_sum(d), F.lit(10)) == 0
    new = lambda shape, d: _refill(shape, _let(_permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card")), checked))

    def inner(part: Column) -> Column:
        at = F.instr(m, part)
        put = F.concat(F.substring(m, F.lit(1), at - 1), new(part, _digits(part)), F.substring(m, at + F.length(part), F.length(m)))
        return F.when((F.length(part) > 0) & (part != m) & valid(_digits(part)), put).otherwise(m)

    whole = lambda d: F.when(valid(d), new(m, d)).otherwise(_let(F.regexp_extract(m, rf"(?<!\d){_PRINTED}", 0), inner))
    # Of groups of four with three more digits behind them, the last may not belong to the number.
    short = F.regexp_extract(m, r"^\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}(?=[ \-]\d{3}$)", 0)
    cut = F.when(valid(_digits(m)), F.lit("")).otherwise(short)
    return _let(cut, lambda head: F.when(F.length(head) > 0, inner(head)).otherwise(_let(_digits(m), whole)))


def _iban(m: Column, key: str) -> Column:
    country, bban = F.substring(m, 1, 2), F.substring(m, 5, 40)
    checked = lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    return F.when(mod97(F.concat(bban, F.substring(m, 1, 4))) == 1, _let(permute_string(bban, key, F.concat(F.lit("iban"), country)), checked)).otherwise(m)


def _grouped_iban(m: Column, key: str) -> Column:
    """An IBAN in groups of four: the longest run of groups from the first on that validates; a word behind it stays."""

    def put(groups: Column) -> Column:
        plain = lambda k: F.array_join(F.slice(groups, F.lit(1), k), "")
        valid = F.filter(F.sequence(F.size(groups), F.lit(4), F.lit(-1)), lambda k: mod97(F.concat(F.substring(plain(k), F.lit(5), F.lit(40)), F.substring(plain(k), F.lit(1), F.lit(4)))) == 1)

        def printed(k: Column) -> Column:
            spaced = lambda p: F.concat_ws(" ", F.regexp_extract_all(p, F.lit(".{1,4}"), F.lit(0)), F.slice(groups, k + 1, F.size(groups)))
            return _let(_iban(plain(k), key), spaced)

        return F.when(F.size(valid) > 0, printed(F.get(valid, F.lit(0)))).otherwise(m)

    return F.when(F.size(F.split(m, " ")) >= 4, _let(F.split(m, " "), put)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    number = F.aggregate(F.split(m, "[.]"), F.lit(0).cast("long"), lambda n, part: n * 256 + F.coalesce(part.try_cast("long"), F.lit(0)))
    octets = lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / F.lit(256**k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    return _let(permute(number, 65536, 65536, key, F.lit("ip")), octets)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999: 898 * 99 * 9999 numbers."""
    area, group, serial = (F.substring(m, *at).try_cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    number = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1

    def printed(x: Column) -> Column:
        index = F.floor(x / F.lit(99 * 9999))
        parts = (F.when(index >= 665, index + 2).otherwise(index + 1), 3), (F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), (F.pmod(x, F.lit(9999)) + 1, 4)
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(permute(number, 9999, 898 * 99, key, F.lit("ssn")), printed)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    def moved(code: Column) -> Column:
        national = F.substring(m, F.length(code) + 1, F.length(m))
        return F.concat(code, _refill(national, _permute_digits(_digits(national), key, F.lit("phone"))))

    return _let(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])", 0), moved)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN, or the match itself where it does not validate."""
    email = F.concat(permute_string(F.substring_index(m, "@", 1), key, F.lit("email")), F.lit("@"), F.substring_index(m, "@", -1))
    shape = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(m.contains("@"), email)
        .when(m.rlike(r"^[A-Z]{2}\d{2} "), _grouped_iban(m, key))
        .when(m.rlike(r"^[A-Z]{2}\d"), _iban(m, key))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(m, "yyyy-MM-dd", key))
        .when(m.rlike(r"^\d{2}/\d{2}/\d{4}$"), _date(m, "dd/MM/yyyy", key))
        .when(m.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), _date(m, "dd.MM.yyyy", key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(shape("ip"), _ip(m, key))
        .when(shape("phone") | shape("abroad"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """docs with each personal value in `text` replaced by its pseudonym; all other columns as they are.

    `key` is the secret of the pseudonyms and has no default: who has it can undo them (`permute(..., undo=True)`).
    Found and validated: e-mail addresses; IBANs, in one or in groups of four (mod 97); dates of 1900-2099 as yyyy-MM-dd, dd/MM/yyyy or
    dd.MM.yyyy; US social security numbers (area, group and serial ranges); IPv4 addresses; telephone numbers
    with area code, or with a country's code and 8-15 digits; card numbers of 13-19 digits (Luhn), also beside another number. Each is permuted within its format by a keyed Feistel
    network: check digits and separators stay valid, equal values get equal pseudonyms in all documents, and
    who has the key can undo it. A permutation has fixed points now and then, for very small formats mostly.
    Values that do not validate stay. `counted`: name of a column for the number of replaced values.
    Defined cases: null text stays null (count 0), empty text stays empty; very long texts take linear time;
    ties and repeated rows are treated alike; an empty table gives an empty table. Narrow plan: no shuffle.
    """
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    new = F.transform(found, lambda m: pseudonym(m, key))
    between = F.split(t, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    # A cheap test first, so that texts without any digit or @ are scanned once: all values have one.
    hit = t.rlike("[0-9@]")
    if not counted:
        return docs.withColumn(text, F.when(hit, joined).otherwise(t))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return docs.withColumns({text: F.when(hit, joined).otherwise(t), counted: F.when(hit, changed).otherwise(F.lit(0)).cast("int")})
