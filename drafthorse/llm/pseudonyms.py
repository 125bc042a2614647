"""Pseudonyms for personal data, in DataFrame functions alone.

Values are found by one pattern and, where their format has a check, validated: card numbers (issuer and Luhn), IBANs
(mod 97), telephone numbers in the shape of the +1 plan (any area and exchange), social security numbers, IPv4
addresses, dates from 1800 to 2199. A valid value is permuted by a keyed Feistel network on exactly the values of its
format (two halves with their own moduli, eight rounds of SHA-256), check digits are made anew, and separators stay
where they are. So a pseudonym is valid itself, equal values have equal pseudonyms in every document, and the holder of
the key can go back (`inverse=True`). Of an IBAN every account digit is permuted and every letter masked under them;
the country alone stays. Mail addresses and secrets have no such domain: they are replaced by keyed digests in their
format, equal for equal values as well. Anything else in a text, numbers that fail their check included, is left as it
is. Names of secrets are matched in any case. An IBAN ends where its country's length says, for other countries where
mod 97 comes out at 1.

Nothing is shuffled: a text is split at its matches, and joined again.

Defined cases. Null text stays null. Empty text stays empty. Very long texts are gone through whole; the number of
matches in a text is not limited. Repeated rows get equal results. Null ids are ids like any other. Columns that are not
asked for are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:1[89]|20|21)[0-9]{2}"
_NAMED = '(?i:password|passwd|secret|token|api_key|apikey)(?: = "| = |: |="|=|:)'
#: Lengths of IBANs by country; a country that is not here has its end found by mod 97.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


#: First digits of card issuers, and what follows them.
ISSUERS = {
    "4": "(?:[0-9]{12}|[0-9]{15}|[0-9]{18})",
    "5[1-5]": "[0-9]{14}",
    "222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720": "[0-9]{12}",
    "3[47]": "[0-9]{13}",
    "6011|65[0-9]{2}|64[4-9][0-9]": "[0-9]{12}",
    "30[0-5]|3[68][0-9]": "[0-9]{11}",
    "352[89]|35[3-8][0-9]": "[0-9]{12}",
    "62": "[0-9]{14,17}",
    "5[06-8]": "[0-9]{11,17}",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    last = f" [A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|(?: [A-Z0-9]{{4}}){{{groups}}}{last})(?![A-Za-z0-9])"


_IBAN_LISTED = "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())
#: What each kind looks like, in order of preference where two begin at one place.
KINDS = {
    "mail": r"(?<![._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "access_key": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<=[=:\" ])(?<=[=:\"]|[=:] )(?<={_NAMED})[A-Za-z0-9+/_.-]{{8,128}}",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_LISTED}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?![A-Za-z0-9]))",
    "phone": r"(?<!\+)(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<!-)(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "date": rf"(?<![./-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_MONTH}/{_YEAR})(?![0-9/-]|\.[0-9])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
#: A value begins where no letter or digit stands before it: one look rules out most places of a text.
PATTERN = f"(?<![A-Za-z0-9])(?:{'|'.join(KINDS.values())})"
#: No kind is without one of these, so most texts need one cheap look.
HINT = "[0-9@=:]|AKIA"


def let(x: Column, f) -> Column:
    """f(x), with x worked out once: what a lambda refers to is otherwise worked out at every step."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def feistel(a: Column, b: Column, radix_a: Column | int, radix_b: Column | int, key: str, label: Column | str, inverse: bool = False) -> Column:
    """struct(a, b): the keyed permutation of the pairs a < radix_a, b < radix_b (both at most 10^9)."""
    ra, rb = (F.lit(r).cast("long") if isinstance(r, int) else r.cast("long") for r in (radix_a, radix_b))
    label = F.lit(label) if isinstance(label, str) else label

    def mask(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), label, ra.cast("string"), rb.cast("string"), i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    pair = lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    even = lambda i: F.when(i % 2 == 0, ra).otherwise(rb)
    if inverse:
        turn = lambda s, i: pair(F.pmod(s["b"] - F.pmod(mask(i, s["a"]), even(i)), even(i)), s["a"])
        return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0)), pair(a, b), turn)
    turn = lambda s, i: pair(s["b"], F.pmod(s["a"] + mask(i, s["b"]), even(i)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(a, b), turn)


def _part(s: Column, first: Column | int, size: Column | int) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(s, lit(first), lit(size))


def _digits_permuted(digits: Column, key: str, label: Column | str, inverse: bool) -> Column:
    """A string of 2 to 18 digits as another of the same length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        radix = lambda k: F.pow(F.lit(10.0), k).cast("long")
        s = feistel(_part(d, 1, half).cast("long"), _part(d, half + 1, n).cast("long"), radix(half), radix(n - half), key, label, inverse)
        return let(s, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), n - half, "0")))

    return let(digits, run)


def fill(template: Column, chars: Column, what: str = "[0-9]") -> Column:
    """The template with its characters of this class replaced by chars, one after the other."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def run(chars: Column) -> Column:
        put = lambda s, c: F.when(c.rlike(what), F.struct(F.concat(s["s"], F.substring(chars, s["k"], F.lit(1))).alias("s"), (s["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(s["s"], c).alias("s"), s["k"].alias("k"))
        )
        return F.aggregate(F.split(template, ""), start, put)["s"]

    return let(chars, run)


def _only(s: Column, keep: str) -> Column:
    return F.regexp_replace(s, f"[^{keep}]", "")


def _luhn(digits: Column, odd: int) -> Column:
    """Sum of the digits from the right, those at places i with i % 2 == odd (from 0) doubled and their digits added."""

    def run(digits: Column) -> Column:
        n = F.length(digits)

        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, n - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 != odd, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)

    return let(digits, run)


def _mod97(s: Column) -> Column:
    """The letters and digits of s (A is 10) as a number, modulo 97."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda r, c: add(r, c).cast("int"))


def _card(m: Column, key: str, inverse: bool) -> Column:
    """The issuer's digits stay, so that a pseudonym is of the same issuer; the check digit is made anew."""

    def run(d: Column) -> Column:
        lead = F.regexp_extract(d, f"^(?:{'|'.join(ISSUERS)})", 0)

        def body(p: Column) -> Column:
            n = F.length(p)
            return F.concat(p, _digits_permuted(F.substring(d, n + 1, F.length(d) - n - 1), key, F.concat(F.lit("card"), p), inverse))

        whole = let(let(lead, body), lambda x: F.concat(x, F.pmod(-_luhn(x, 0), F.lit(10)).cast("string")))
        issued = d.rlike("^(?:" + "|".join(f"(?:{lead}){rest}" for lead, rest in ISSUERS.items()) + ")$")
        return F.when(issued & (_luhn(d, 1) % 10 == 0), fill(m, whole)).otherwise(m)

    return let(_only(m, "0-9"), run)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """Of the groups of m as many as make mod 97 come out at 1, the most first; what follows them stays."""

    def valid(s: Column) -> Column:
        return _mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), _part(s, 1, 4))) == 1

    def run(groups: Column) -> Column:
        first = lambda k: F.slice(groups, F.lit(1), k)
        n = F.size(groups)
        ends = F.filter(F.sequence(n, F.least(n, F.lit(3)), F.lit(-1)), lambda k: valid(F.array_join(first(k), "")))
        head = F.array_join(first(F.coalesce(F.get(ends, F.lit(0)), n)), " ")
        return let(head, lambda h: F.concat(_iban_whole(h, key, inverse), F.substring(m, F.length(h) + 1, F.length(m))))

    return let(F.split(m, " "), run)


def _long_digits_permuted(digits: Column, key: str, label: Column, inverse: bool) -> Column:
    """As _digits_permuted for 2 to 36 digits: over 18 the first half is permuted under the new second half."""

    def run(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        first, last = _part(d, 1, half), F.substring(d, half + 1, F.length(d))
        new_last = _digits_permuted(last, key, label, inverse)
        both = let(new_last, lambda x: F.concat(_digits_permuted(first, key, F.concat(label, F.lit("|"), last if inverse else x), inverse), x))
        return F.when(F.length(d) <= 18, _digits_permuted(d, key, label, inverse)).otherwise(both)

    return let(digits, run)


def _letters_masked(letters: Column, key: str, label: Column, inverse: bool) -> Column:
    """Capital letters moved on in the alphabet by what a digest of the label says for their place."""

    def run(mask: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(mask, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
            return F.char(F.pmod(F.ascii(c) - 65 + (-by if inverse else by), F.lit(26)) + 65)

        return F.array_join(F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), move), "")

    return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("letters"), label), 256), run)


def _iban_whole(m: Column, key: str, inverse: bool) -> Column:
    """All digits of the account are permuted, then its letters are masked by the permuted digits."""

    def run(s: Column) -> Column:
        country, rest = _part(s, 1, 2), F.substring(s, F.lit(5), F.length(s))

        def numbers(digits: Column) -> Column:
            permuted = _long_digits_permuted(digits, key, F.concat(F.lit("iban"), country), inverse)
            letters = lambda d: _letters_masked(_only(rest, "A-Z"), key, F.concat(country, F.lit("|"), digits if inverse else d), inverse)
            new = let(permuted, lambda d: fill(fill(rest, d), letters(d), "[A-Z]"))
            check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
            whole = let(new, lambda x: F.concat(country, check(x), x))
            return F.when((_mod97(F.concat(rest, _part(s, 1, 4))) == 1) & (F.length(digits) >= 2), fill(m, whole, "[A-Z0-9]")).otherwise(m)

        return let(_only(rest, "0-9"), numbers)

    return let(_only(m, "A-Z0-9"), run)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    def run(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        s = feistel(_part(ten, 1, 3).cast("long"), _part(ten, 4, 7).cast("long"), 1000, 10_000_000, key, "phone", inverse)
        new = let(s, lambda p: F.concat(F.lpad(p["a"].cast("string"), 3, "0"), F.lpad(p["b"].cast("string"), 7, "0")))
        return fill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))

    return let(_only(m, "0-9"), run)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", inverse)
    return let(s, lambda p: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.floor(p[h] / 256), p[h] % 256))))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (_part(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    s = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", inverse)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    new = lambda p: p["a"] + 1 + F.when(p["a"] >= 665, 1).otherwise(0)
    return let(s, lambda p: F.concat_ws("-", pad(new(p), 3), pad(F.floor(p["b"] / 9999) + 1, 2), pad(p["b"] % 9999 + 1, 4)))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Over the 146,097 days (189 * 773) of the 400 years from 1800."""
    iso = m.rlike("^[0-9]{4}-")
    first = F.lit("1800-01-01").cast("date")

    def run(day: Column) -> Column:
        n = F.datediff(day, first)
        s = feistel(F.floor(n / 773), n % 773, 189, 773, key, "date", inverse)
        new = let(s, lambda p: F.date_add(first, (p["a"] * 773 + p["b"]).cast("int")))
        digits = F.when(iso, F.date_format(new, "yyyyMMdd")).otherwise(F.date_format(new, "ddMMyyyy"))
        return F.when(day.isNotNull(), fill(m, digits)).otherwise(m)

    return let(F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.regexp_replace(m, "[./]", "-"), "dd-MM-yyyy")), run)


def _digest(m: Column, key: str, label: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), m), 256)


def _replace(m: Column, before: Column, key: str, inverse: bool) -> Column:
    """The pseudonym of match m; before: the text between the last match and this one."""
    is_ = lambda kind: m.rlike(f"^(?:{SHAPES[kind]})$")
    keep = m if inverse else None
    wide = F.repeat(_digest(m, key, "secret"), F.lit(2))
    secret = keep if inverse else F.substring(wide, F.lit(1), F.length(m))
    x = F.when(before.rlike(f"{_NAMED}$"), secret)
    x = x.when(m.contains("@"), keep if inverse else F.concat(F.lit("u"), F.substring(_digest(m, key, "mail"), 1, 15), F.lit("@example.invalid")))
    x = x.when(is_("access_key"), keep if inverse else F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(m, key, "access_key"), 1, 16))))
    for kind, to in (("ip", _ip), ("phone", _phone), ("ssn", _ssn), ("date", _date), ("card", _card), ("iban", _iban)):
        x = x.when(is_(kind), to(m, key, inverse))
    return x.otherwise(secret)


#: The patterns without what has to stand around a match.
SHAPES = {
    "access_key": "AKIA[A-Z0-9]{16}",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "date": rf"{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_MONTH}/{_YEAR}",
    "card": "[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}",
    "iban": "[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,40}",
}


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), inverse: bool = False) -> DataFrame:
    """(id_col, *keep, text_col, n_values): every text with its personal data replaced; n_values: how many were changed.

    inverse=True takes pseudonyms of numbers and dates back; digests of mail addresses and secrets are one-way.
    """
    raw = F.col(text_col)
    found = F.when(raw.rlike(HINT), F.regexp_extract_all(raw, F.lit(PATTERN), F.lit(0)))
    x = docs.select(F.col(id_col), *keep, raw.alias("__text"), found.alias("__found"))
    gaps = F.split("__text", PATTERN, -1)
    new = F.zip_with("__found", F.slice(gaps, F.lit(1), F.size("__found")), lambda m, before: _replace(m, before, key, inverse))
    x = x.withColumn("__new", F.when(F.size("__found") > 0, new))
    joined = F.array_join(F.zip_with(gaps, F.concat("__new", F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda c: c))
    some = F.col("__new").isNotNull()
    return x.select(
        id_col, *keep, F.when(some, joined).otherwise(F.col("__text")).alias(text_col),
        F.when(some, changed).otherwise(0).cast("int").alias("n_values"),
    )
