"""Personal data under format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates that pass their own validation (check digit, ranges, calendar) are permuted inside their format by a keyed
Feistel network, so a value has the same pseudonym wherever it stands and however it is spaced, two values never share
one, and the result is valid again:

card         13 to 19 digits with a Luhn check digit, single blanks or hyphens between groups: all digits but the last
             are permuted, the check digit is set anew, separators stay
phone        +1 (ddd) ddd-dddd and the like with a leading + or a bracketed area code, and ddd-ddd-dddd or ddd.ddd.dddd: the last
             seven digits are permuted, by a permutation of the digits before them
social       ddd-dd-dddd inside the issued ranges: permuted inside them
ip           dotted quad of octets: 32 bits permuted
date         yyyy-mm-dd, dd/mm/yyyy and dd.mm.yyyy that the calendar knows, 1900-01-01 to 2101-01-25: the day number is permuted;
             mm/dd/yyyy of the years 1900 to 2100 with a day over 12 (so that it can't be read as dd/mm): permuted among its
             like, days to 28 over all months, later ones over the months of equal length (29 February stays)
iban         two letters, two check digits, 11 to 30 letters or digits that pass mod 97: the digits are permuted, the check digits set anew
email        the letters and digits before the @ are permuted inside their own classes

Each round's function is SHA-256 under the key, cut to 60 bits. Equal values are meant to stay equal, so frequencies remain visible.

A number of a card's length without a valid check digit is no card and stays.

Everything else in a text is copied byte for byte. Defined results: null text stays null, a text without matches is returned
unchanged, a value is replaced at every place it stands, other columns (also those that clash with
internal names) pass through untouched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

CARD = r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"
PHONE = r"(?<![0-9A-Za-z.+-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])|(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[/.-][0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9À-ɏ][A-Za-z0-9À-ɏ._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
#: Alternatives are tried in this order at each place.
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "social": SOCIAL, "phone": PHONE, "iban": IBAN, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these has no match; a cheap test before the full pattern.
HINT = r"[0-9][ ).-]?[ ]?[0-9]|@"


def _keyed(key: str, *parts: Column | str | int) -> Column:
    """A number below 2^60: a cut SHA-256 of a block made from the key, and the parts."""
    block = hashlib.sha256(key.encode()).hexdigest()  # as long as a block of the hash
    message = F.concat_ws("|", F.lit(block), *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(message, 256), 1, 15), 16, 10).cast("long")


def permuted(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tweak: Column | str = "") -> tuple[Column, Column]:
    """Feistel network over pairs of Z_a x Z_b (bigint columns): each round adds a keyed function of one half, and of the tweak, to the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    # a one-element transform binds each round's value, so that expressions don't double from round to round
    state = F.array(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")))
    for i in range(0, ROUNDS, 2):
        state = F.transform(state, _round(lambda s, i: F.struct(F.pmod(s.l + F.pmod(_keyed(key, i, tweak, s.r), a), a).alias("l"), s.r.alias("r")), i))
        state = F.transform(state, _round(lambda s, i: F.struct(s.l.alias("l"), F.pmod(s.r + F.pmod(_keyed(key, i, tweak, s.l), b), b).alias("r")), i + 1))
    return state[0].l, state[0].r


def _round(step, i: int):
    """A step of one argument: a second one would be taken for the element's index."""
    return lambda s: step(s, i)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def digits_permuted(d: Column, key: str, tweak: Column | str = "") -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), h).cast("long"), F.pow(F.lit(10.0), n - h).cast("long")
    left, right = permuted(F.substring(d, F.lit(1), h).cast("long"), F.substring(d, h + 1, n).cast("long"), a, b, key, tweak)
    return F.concat(_padded(left, h), _padded(right, n - h))


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(chars, start, step, lambda s: s["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit for a string of digits."""
    def add(s: Column, c: Column) -> Column:
        x = c.cast("int") * F.when(s["twice"], 2).otherwise(1)
        return F.struct((s["sum"] + F.when(x > 9, x - 9).otherwise(x)).alias("sum"), (~s["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("twice"))
    return F.aggregate(F.split(F.reverse(payload), ""), start, add, lambda s: F.pmod(10 - F.pmod(s["sum"], F.lit(10)), F.lit(10)).cast("string"))


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    check = F.right(d, F.lit(1))
    new = digits_permuted(payload, key + "card")
    return F.when(check == luhn_digit(payload), refilled(v, F.concat(new, luhn_digit(new)))).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    d = _digits(v)
    head = F.substring(d, F.lit(1), F.length(d) - 7)
    return F.when(F.length(d).between(10, 15), refilled(v, F.concat(head, digits_permuted(F.right(d, F.lit(7)), key + "phone", head)))).otherwise(v)


def _social(v: Column, key: str) -> Column:
    area, group, serial = F.substring(v, 1, 3).cast("long"), F.substring(v, 5, 2).cast("long"), F.substring(v, 8, 4).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    slot = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    left, right = permuted(slot, serial - 1, 898 * 99, 9999, key + "social")
    index = F.floor(left / 99).cast("long")
    new = F.concat_ws("-", _padded(index + 1 + F.when(index >= 665, 1).otherwise(0), 3), _padded(F.pmod(left, F.lit(99)) + 1, 2), _padded(right + 1, 4))
    return F.when(valid, new).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    o = F.split(v, r"\.")
    left, right = permuted(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), 65536, 65536, key + "ip")
    return F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(left / 256), F.pmod(left, F.lit(256)), F.floor(right / 256), F.pmod(right, F.lit(256)))))


#: Days since 1900-01-01 that dates are permuted among: DAYS_A * DAYS_B of them.
DAYS_A, DAYS_B = 270, 272


def _date(v: Column, key: str) -> Column:
    mark = F.substring(v, 3, 1)
    iso = F.substring(v, 5, 1) == "-"
    text = F.when(iso, v).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))
    origin = F.lit("1900-01-01").cast("date")
    n = F.datediff(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), origin).cast("long")
    left, right = permuted(F.floor(n / DAYS_B).cast("long"), F.pmod(n, F.lit(DAYS_B)), DAYS_A, DAYS_B, key + "date")
    new = F.date_add(origin, (left * DAYS_B + right).cast("int"))
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(mark == "/", F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.when(n.between(0, DAYS_A * DAYS_B - 1), out).when(n.isNull() & (mark == "/"), _month_first(v, key)).otherwise(v)


#: (months, first day, days) that dates written month first are permuted among.
MONTH_FIRST = [(list(range(1, 13)), 13, 16), ([1, 3, 5, 7, 8, 10, 12], 29, 3), ([4, 6, 9, 11], 29, 2)]


def _month_first(v: Column, key: str) -> Column:
    month, day, year = (F.substring(v, i, n).cast("long") for i, n in ((1, 2), (4, 2), (7, 4)))
    out = F.lit(None).cast("string")
    for i, (months, first, days) in enumerate(MONTH_FIRST):
        of = F.array(*map(F.lit, months))
        at = F.array_position(of, month.cast("int"))
        left, right = permuted((year - 1900) * len(months) + at - 1, day - first, 201 * len(months), days, f"{key}month{i}")
        new = F.concat_ws("/", _padded(F.element_at(of, (F.pmod(left, F.lit(len(months))) + 1).cast("int")), 2), _padded(right + first, 2), (F.floor(left / len(months)) + 1900).cast("string"))
        out = F.when((at > 0) & day.between(first, first + days - 1), new).otherwise(out)
    return F.when(year.between(1900, 2100), out)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of digits and letters (A = 10)."""
    step = lambda m, c: F.when(c.rlike("^[0-9]$"), F.pmod(m * 10 + F.coalesce(c.cast("int"), F.lit(0)), F.lit(97))).otherwise(F.pmod(m * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban(v: Column, key: str) -> Column:
    plain = F.replace(v, F.lit(" "), F.lit(""))
    country, check, rest = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = (_mod97(F.concat(rest, country, check)) == 1) & (F.length(plain) <= 34) & (F.length(_digits(rest)) >= 4)
    new = refilled(rest, digits_permuted(_digits(rest), key + "iban"))
    again = _padded(98 - _mod97(F.concat(new, country, F.lit("00"))), 2)
    whole = F.concat(again, new)  # letters of the rest keep their places, so filling digits alone is enough
    return F.when(valid, refilled(v, _digits(whole))).otherwise(v)


def _email(v: Column, key: str) -> Column:
    """Feistel over the characters before the @: each half is shifted, inside each character's class, by a keyed function of the other."""
    local = F.substring_index(v, "@", 1)
    n = F.length(local)
    h = F.floor(n / 2).cast("int")

    def shifted(half: Column, other: Column, label: int) -> Column:
        def shift(c: Column, i: Column) -> Column:
            x = F.ascii(c)
            by = F.pmod(_keyed(key + "email", label, other, i), F.lit(26 * 10)).cast("int")
            moved = lambda base, size: F.chr(F.pmod(x - base + by, F.lit(size)) + base)
            return F.when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).when(c.rlike("^[0-9]$"), moved(48, 10)).otherwise(c)

        return F.concat_ws("", F.transform(F.split(half, ""), shift))

    state = F.array(F.struct(F.substring(local, F.lit(1), h).alias("l"), F.substring(local, h + 1, n).alias("r")))
    for i in range(0, 4, 2):
        state = F.transform(state, _round(lambda s, i: F.struct(shifted(s.l, s.r, i).alias("l"), s.r.alias("r")), i))
        state = F.transform(state, _round(lambda s, i: F.struct(s.l.alias("l"), shifted(s.r, s.l, i).alias("r")), i + 1))
    return F.concat(state[0].l, state[0].r, F.substring(v, n + 1, F.length(v)))


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one match of ANY; a match that fails validation is returned as it is."""
    kind = F.when(v.contains("@"), "email")
    for name in ("ip", "date", "social", "iban", "card"):
        kind = kind.when(v.rlike(f"^(?:{KINDS[name]})$"), name)
    kind = kind.otherwise("phone")
    out = F.when(kind == "email", _email(v, key)).when(kind == "ip", _ip(v, key)).when(kind == "date", _date(v, key))
    out = out.when(kind == "social", _social(v, key)).when(kind == "iban", _iban(v, key)).when(kind == "card", _card(v, key))
    return F.coalesce(out.otherwise(_phone(v, key)), v)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with its text column rewritten; ``count_col`` (optional) gets the number of values replaced, in place of a column of that name."""
    text = F.col(text_col)
    parts = F.split(text, ANY, -1)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    changed = F.transform(found, lambda v: pseudonym(v, key))
    woven = F.zip_with(parts, F.concat(changed, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    maybe = text.rlike(HINT)
    new = F.when(maybe, F.concat_ws("", woven)).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    if count_col:
        n = F.when(maybe, F.size(F.filter(F.arrays_zip(found.alias("v"), changed.alias("w")), lambda x: x["v"] != x["w"]))).otherwise(F.lit(0))
        columns.append(F.coalesce(n, F.lit(0)).cast("long").alias(count_col))
    return docs.select(*columns)
