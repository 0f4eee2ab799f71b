"""Personal data replaced by format-preserving Feistel pseudonyms, in Spark SQL functions only.

Found and validated: e-mail addresses, IPv4 addresses, telephone numbers, payment card numbers
(Luhn), IBANs (mod 97), US social security numbers, dates, and secrets (access keys, ``password=``
and ``token=`` values).  A value is permuted within its own format by a keyed Feistel network, so
equal values get equal pseudonyms in every document, different ones different, and the pseudonym
is valid where the value was:

* numbers and dates are mapped to 0 .. N - 1 and back, N split into two factors, one per half, each
  round adding a keyed hash of the other half modulo the factor (exact, without cycle walking):
  dates within the 400 years 1800-2199 (146,097 days = 189 x 773), IPv4 as 2**16 x 2**16, social
  security numbers as 898 areas x 99 groups x 9999 serials, North American telephone numbers as
  800 x 8,000,000, cards as two halves of the digits before a recomputed check digit;
* strings of any length (e-mail names and domains, bank account parts, secrets, other telephone numbers) are
  permuted character by character within digits, lower and upper case letters: each round adds
  keyed digits of a hash of one half to the characters of the other half.

Where a match fails validation as a whole, valid values inside it are looked for (``_scanned``).
Not touched: numbers that fail validation, and everything else of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: a longer half of a string goes into the rounds by its hash, so the work stays linear in the length
WIDE = 128

# Expressions for both Java and Python's regex; the first that fits at a place wins.
_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.){1,8}[A-Za-z]{2,24}" + _END,
    "secret": _EDGE + r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey) ?[=:] ?[\"']?[A-Za-z0-9_\-]{8,128}[\"']?)" + _END,
    "date": _EDGE + r"(?:(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:1[89]|2[01])[0-9]{2})" + _END,
    "ip": r"(?<![A-Za-z0-9_.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![A-Za-z0-9_]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9_\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_\-])",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": r"(?<![A-Za-z0-9_+.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![A-Za-z0-9_]|[.\-][0-9])",
    "phone": r"(?<![A-Za-z0-9_+.\-])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}|[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4})" + _END,
}
#: any of them, without groups that capture; the common edge comes first, so the inside of a word is passed quickly
ANY = _EDGE + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"

#: characters of an IBAN by country
_IBAN_LENGTHS = {c: int(w[2:]) for w in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 "
    "GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
    "MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 "
    "VA22 VG24 XK20").split() for c in [w[:2]]}
#: characters after a match that one of another kind can reach, at most
_REACH = 80
#: pieces of text after a place that are looked at, and places whose parts are put together at once
_PIECES, _BLOCK = 63, 256

_EPOCH, _DAYS = -62091, (189, 773)  # 1800-01-01 in days since 1970-01-01; 400 years


def _let(value: Column, f) -> Column:
    """``f(value)``, the value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hash(key: str, tweak: str, i: Column, half: Column) -> Column:
    """Non-negative 60-bit number from a keyed SHA-256 of the round and one half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), 256), 1, 15),
                  16, 10).cast("bigint")


def permute_number(n: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """Keyed permutation of 0 .. a * b - 1: the two mixed-radix digits take turns."""
    start = F.struct(F.floor(n / b).cast("bigint").alias("x"), F.pmod(n, F.lit(b)).cast("bigint").alias("y"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["x"] + _hash(key, tweak, i, acc["y"]) % a) % a).otherwise(acc["x"]).alias("x"),
            F.when(even, acc["y"]).otherwise((acc["y"] + _hash(key, tweak, i, acc["x"]) % b) % b).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["x"] * F.lit(b) + s["y"])


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shift(char: Column, by: Column) -> Column:
    """The character moved within its class; others stay."""
    out = char
    for letters in (_DIGITS, _LOWER, _UPPER):
        n = len(letters)
        at = F.instr(F.lit(letters), char)
        out = F.when(at > 0, F.substring(F.lit(letters), ((at - 1 + by % n) % n + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _stream(key: str, tweak: str, i: Column, half: Column, at: Column) -> Column:
    """Number for one character: eight hex digits of a hash per block of eight characters."""
    block = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.floor(at / 8).cast("string"), half), 256)
    return F.conv(F.substring(block, ((at % 8) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("bigint")


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of the strings of one format (a class of character at each place)."""
    cut = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("x"), F.substring(text, cut + 1, F.char_length(text)).alias("y"))

    def moved(part: Column, other: Column, i: Column) -> Column:
        chars = F.split(part, "")
        half = F.when(F.char_length(other) > WIDE, F.sha2(other, 256)).otherwise(other)
        return F.when(F.char_length(part) == 0, part).otherwise(
            _let(half, lambda h: F.array_join(F.transform(chars, lambda c, p: _shift(c, _stream(key, tweak, i, h, p))), "")))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(acc["x"], acc["y"], i)).otherwise(acc["x"]).alias("x"),
                        F.when(even, acc["y"]).otherwise(moved(acc["y"], acc["x"], i)).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["x"], s["y"]))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column, doubled_first: Column) -> Column:
    """Luhn sum of a digit string; ``doubled_first``: 1 if the first digit is doubled, else 0."""
    return F.aggregate(
        F.split(digits, ""), F.struct(F.lit(0).alias("s"), doubled_first.cast("int").alias("d")),
        lambda a, c: F.struct((a["s"] + F.when(a["d"] == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10)
                               .otherwise(c.cast("int"))).cast("int").alias("s"), (1 - a["d"]).alias("d")), lambda a: a["s"])


def luhn_valid(c: Column) -> Column:
    d = _digits(c)
    return (_luhn(d, (F.char_length(d) % 2 == 0).cast("int")) % 10 == 0) & (d.rlike("[1-9]"))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN-like string, letters as 10 .. 35."""
    values = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_DIGITS + _UPPER), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int"))


def iban_valid(c: Column) -> Column:
    s = F.regexp_replace(c, " ", "")
    n = F.char_length(s)
    return n.between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), n), F.substring(s, 1, 4))) == 1)


def _refill(mask: Column, digits: Column) -> Column:
    """Put characters in order into the letters and digits of a mask (separators stay)."""
    filled = F.aggregate(
        F.split(mask, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"),
                                                               (a["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))), lambda a: a["s"])
    return filled


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.char_length(d)
    body = permute_text(F.substring(d, F.lit(1), n - 1), key, "card")
    check = (10 - _luhn(body, (n % 2 == 0).cast("int")) % 10) % 10
    return _refill(m, F.concat(body, check.cast("int").cast("string")))


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    country, bban = F.substring(s, 1, 2), permute_text(F.substring(s, F.lit(5), F.char_length(s)), key, "iban")
    check = F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
    return _refill(m, F.concat(country, check, bban))


def _ip(m: Column, key: str) -> Column:
    n = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda a, c: a * 256 + c.cast("bigint"))
    p = permute_number(n, 1 << 16, 1 << 16, key, "ip")
    return F.concat_ws(".", *[(F.shiftrightunsigned(p, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def _date_of(m: Column) -> Column:
    iso = m.rlike(r"^[0-9]{4}-")
    return F.try_to_date(F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))),
                         "yyyy-MM-dd")


def _date(m: Column, key: str) -> Column:
    days = F.unix_date(_date_of(m)) - _EPOCH
    moved = F.date_from_unix_date((permute_number(days.cast("bigint"), *_DAYS, key, "date") + _EPOCH).cast("int"))
    sep = F.substring(m, 3, 1)
    return F.when(m.rlike(r"^[0-9]{4}-"), F.date_format(moved, "yyyy-MM-dd")).otherwise(
        F.concat(F.date_format(moved, "dd"), sep, F.date_format(moved, "MM"), sep, F.date_format(moved, "yyyy")))


def ssn_valid(m: Column) -> Column:
    area = F.substring(m, 1, 3)
    return (~area.isin("000", "666")) & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("bigint")
    low = (F.substring(m, 5, 2).cast("bigint") - 1) * 9999 + F.substring(m, 8, 4).cast("bigint") - 1
    p = permute_number((F.when(area > 666, area - 2).otherwise(area - 1)) * (99 * 9999) + low, 898, 99 * 9999, key, "ssn")
    a, rest = F.floor(p / (99 * 9999)), p % (99 * 9999)
    return F.concat(F.lpad((F.when(a >= 665, a + 2).otherwise(a + 1)).cast("string"), 3, "0"), F.lit("-"),
                    F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    country = F.when(m.rlike(r"^\+1[ .\-]?\("), F.lit("1")).otherwise(F.lit(""))
    own = F.substring(d, F.char_length(country) + 1, F.char_length(d))
    american = own.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & (~m.rlike(r"^\+") | m.rlike(r"^\+1[ .\-]?\("))
    n = (own.cast("bigint") - 2_000_000_000)
    area, rest = F.floor(n / 10_000_000), F.pmod(n, F.lit(10_000_000)) - 2_000_000
    p = permute_number(area * 8_000_000 + rest, 800, 8_000_000, key, "phone")
    moved = ((F.floor(p / 8_000_000) + 200) * 10_000_000 + p % 8_000_000 + 2_000_000).cast("bigint").cast("string")
    cc = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    other = F.concat(cc, permute_text(F.substring(m, F.char_length(cc) + 1, F.char_length(m)), key, "phone"))
    return F.when(american, _refill(m, F.concat(country, moved))).otherwise(other)


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|ASIA|[A-Za-z_]+ ?[=:] ?)", 0)
    return F.concat(head, permute_text(F.substring(m, F.char_length(head) + 1, F.char_length(m)), key, "secret"))


def _email(m: Column, key: str) -> Column:
    """Name and host labels are permuted, each with its own tweak; the last label (com, org, ...) stays."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.substring_index(host, ".", -1)
    labels = F.substring(host, F.lit(1), F.char_length(host) - F.char_length(top) - 1)
    return F.concat(permute_text(F.lower(name), key, "email"), F.lit("@"), permute_text(F.lower(labels), key, "host"), F.lit("."), top)


def kind_of(m: Column) -> Column:
    """Kind of a match of ``ANY``, null when it isn't valid as any."""
    valid = {"date": _date_of(m).isNotNull(), "ssn": ssn_valid(m), "iban": iban_valid(m), "card": luhn_valid(m)}
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        fits = m.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(fits & valid[kind] if kind in valid else fits, F.lit(kind)).otherwise(out)
    return out


_PSEUDONYMS = {"email": _email, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "iban": _iban, "card": _card, "phone": _phone}


def _replaced(m: Column, kind: Column, key: str) -> Column:
    out = m
    for name, f in _PSEUDONYMS.items():
        out = F.when(kind == name, f(m, key)).otherwise(out)
    return out


def _within(window: Column) -> Column:
    """The value and kind that begin at the second character of a window where the first match isn't valid as a whole.

    Kinds are tried in their order, cards and IBANs at each end of a group of characters, the longest
    first; null when none is valid.
    """
    def at(expression: str) -> Column:
        return F.regexp_extract(window, rf"^[\s\S]({expression})", 1)

    def known(v: Column) -> Column:
        """An IBAN has its country's length."""
        n = F.element_at(F.create_map(*[F.lit(x) for pair in _IBAN_LENGTHS.items() for x in pair]), F.substring(v, 1, 2))
        return F.char_length(F.regexp_replace(v, " ", "")) == F.coalesce(n, F.char_length(F.regexp_replace(v, " ", "")))

    def longest(tries: Column, valid) -> Column:
        return F.try_element_at(F.filter(tries, lambda v: F.when(v == "", F.lit(False)).otherwise(valid(v))), F.lit(1))

    groups = F.split(at(PATTERNS["iban"]), " ")
    ibans = _let(groups, lambda g: F.transform(F.sequence(F.size(g), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(g, 1, n), " ")))
    # shorter than the match, a card may stand before a mark and more digits
    cards = F.array(at(PATTERNS["card"]), *[at(r"(?<![A-Za-z0-9_+.\-])[0-9](?:[ \-]?[0-9]){%d}(?![A-Za-z0-9_]|\.[0-9])" % (n - 1)) for n in range(19, 12, -1)])
    cards = F.when(at(PATTERNS["card"]) != "", cards).otherwise(F.array().cast("array<string>"))
    found = {"date": longest(F.array(at(PATTERNS["date"])), lambda v: _date_of(v).isNotNull()), "ip": F.nullif(at(PATTERNS["ip"]), F.lit("")),
             "ssn": longest(F.array(at(PATTERNS["ssn"])), ssn_valid), "iban": longest(ibans, lambda v: iban_valid(v) & known(v)),
             "card": longest(cards, luhn_valid), "phone": F.nullif(at(PATTERNS["phone"]), F.lit(""))}

    def told(kind: str, value: Column) -> Column:
        return _let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("m"), F.lit(kind).alias("kind"))))

    return F.coalesce(*[told(kind, v) for kind, v in found.items()])


def _candidates(text: Column) -> Column:
    """``m, kind, after`` of every place where ``ANY`` fits, in order, and in front what stands before the first.

    ``m`` is the valid value that begins at the place: the match, or where that isn't valid as a whole what ``_within`` finds, or
    null.  ``after`` is the text from the place to the next.  Each is told from the match and at most ``_REACH`` characters after
    it, so the work is linear in the text.
    """
    marked = F.concat(F.lit("\n"), text)  # the cut in front of a first character would leave nothing before it
    pieces = F.split(marked, f"(?={ANY})", -1)
    found = F.regexp_extract_all(marked, F.lit(f"(?=({ANY}))"), F.lit(1))
    nothing = F.struct(F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("kind"))

    def value(p: Column, m: Column, i: Column) -> Column:
        def inside() -> Column:
            # the pieces that follow are cut short: a candidate has two characters or more, so these cover match and reach
            follow = F.transform(F.slice(p, i + 3, _PIECES), lambda x: F.substring(x, 1, _REACH))
            ahead = F.substring(F.concat(F.element_at(p, i + 2), F.array_join(follow, "")), F.char_length(m) + 1, F.lit(_REACH))
            return F.coalesce(_within(F.concat(F.right(F.element_at(p, i + 1), F.lit(1)), m, ahead)), nothing)

        return _let(kind_of(m), lambda kind: F.when(kind.isNotNull(), F.struct(m.alias("m"), kind.alias("kind"))).otherwise(inside()))

    def told(p: Column) -> Column:
        first = F.struct(nothing["m"].alias("m"), nothing["kind"].alias("kind"), F.substring(F.element_at(p, 1), F.lit(2), F.char_length(F.element_at(p, 1))).alias("after"))
        rest = F.transform(found, lambda m, i: _let(value(p, m, i), lambda v: F.struct(
            v["m"].alias("m"), v["kind"].alias("kind"), F.element_at(p, i + 2).alias("after"))))
        return F.concat(F.array(first), rest)

    return _let(pieces, told)


def _scanned(text: Column) -> Column:
    """The text as parts ``t, m, kind`` (what stands before a value, the value, its kind), values taken from left to right.

    A place inside a value that was taken is passed over.  The fold carries how far the last value still reaches, never the
    text, and its parts in blocks, so adding one copies only its block.
    """
    part = "array<struct<t:string,m:string,kind:string>>"

    def step(s: Column, c: Column) -> Column:
        take = (s["over"] <= 0) & c["m"].isNotNull()
        size = F.char_length(c["after"])
        over = F.when(take, F.char_length(c["m"])).otherwise(s["over"])
        left = F.when(over <= 0, c["after"]).when(over >= size, F.lit("")).otherwise(F.substring(c["after"], over + 1, size))
        value = F.when(take, F.array(F.struct(F.lit("").alias("t"), c["m"].alias("m"), c["kind"].alias("kind")))).otherwise(F.array().cast(part))
        text_ = F.array(F.struct(left.alias("t"), F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("kind")))
        return F.struct(F.greatest(over - size, F.lit(0)).alias("over"), F.concat(s["out"], value, text_).alias("out"))

    def block(s: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(s["over"].alias("over"), F.array().cast(part).alias("out")), step)
        return _let(inner, lambda r: F.struct(r["over"].alias("over"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    def whole(c: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _BLOCK).cast("int")), lambda b: F.slice(c, b * _BLOCK + 1, _BLOCK))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("over"), F.array().cast(f"array<{part}>").alias("out")), block, lambda s: F.flatten(s["out"]))

    return _let(_candidates(text), whole)


def _matches(text: Column) -> Column:
    """Matches of ``ANY`` and their kinds, null where a match isn't valid as a whole."""
    return F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))


def _whole(matches: Column) -> Column:
    return F.forall(matches, lambda s: s["kind"].isNotNull())


def parts_of(text: Column) -> Column:
    """The text as parts ``t, m, kind``: what stands before a value, the value (null after the last), its kind.  Null for a null text."""
    nothing = F.lit(None).cast("string")
    between = F.split(text, ANY, -1)
    parts = _let(_matches(text), lambda found: F.when(_whole(found), F.zip_with(between, found, lambda t, s: F.struct(
        t.alias("t"), s["m"].alias("m"), s["kind"].alias("kind")))).otherwise(_scanned(text)))
    return F.when(text.rlike(ANY), parts).when(text.isNotNull(), F.array(F.struct(text.alias("t"), nothing.alias("m"), nothing.alias("kind"))))


def rendered(parts: Column, key: str) -> Column:
    """The text of the parts, each value under its pseudonym."""
    # a match's kind was told once, then the pseudonym of that kind is made
    return F.array_join(F.transform(parts, lambda s: F.concat(s["t"], F.coalesce(_replaced(s["m"], s["kind"], key), F.lit("")))), "")


def kinds_in(parts: Column) -> Column:
    """Kinds of the values in order of appearance (an empty array for a null text)."""
    kinds = F.filter(F.transform(parts, lambda s: s["kind"]), lambda k: k.isNotNull())
    return F.coalesce(kinds, F.array().cast("array<string>"))


def pseudonymised(text: Column, key: str) -> Column:
    """The text with every valid value replaced; a null text stays null, one without a value as it is."""
    return rendered(parts_of(text), key)


def found_kinds(text: Column) -> Column:
    return kinds_in(parts_of(text))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Replace personal data in ``text_col`` (and set ``length_col`` to the new length in characters).

    All other columns, whatever their names, pass as they are.  A null text stays null and an empty
    one empty; repeated rows and repeated values get the same pseudonyms; an empty table stays empty.
    """
    new = pseudonymised(F.col(f"`{text_col}`"), key)
    out = docs.withColumn(text_col, new)
    return out.withColumn(length_col, F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.col(f"`{length_col}`")).cast(docs.schema[length_col].dataType)) \
        if length_col else out
