"""Operator 7: format-preserving pseudonyms for personal numbers and dates.

Values are found by one pattern, validated by kind (Luhn's sum, the IBAN's rest by 97, ranges of parts,
real calendar days) and replaced by a keyed permutation of the values of the same format. A value is a
vector of digits in mixed radices; a Feistel network of `ROUNDS` rounds adds a keyed hash of one half of
the vector to each digit of the other half, modulo the digit's radix. Each round can be undone, so the
whole is a permutation: different values never meet, and equal values have equal pseudonyms in every
document. Check digits are computed anew, days stay days, signs between digits stay in place.

The kind tells a value's vector, and one network serves all kinds. An e-mail name is permuted under its
domain, so equal short names of different domains part; its letters stay in their alphabets, and letters
of alphabets not listed in `ALPHABETS` stay as they are. IBANs in small letters stay in small letters, and
parts of addresses with zeros before them keep their width.

A pattern takes the longest value, which may reach into what stands beside a card or an IBAN (an expiry
date, a code, a currency). Where a match fails its validation, its groups are searched for a card or an
IBAN that passes, from each group on and down to the shortest, and what lies around it is searched again,
in work that grows with the text.
What fails then too stays as it is. Native DataFrame functions only: one row in, one row out, no
shuffle.

Cases. NULL text: stays NULL, nothing found. Empty text: stays empty. Repeated rows, NULL ids and extra
columns: kept. Values that touch or overlap: the leftmost wins. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Even, so that the halves end where they began.
ROUNDS = 6
#: Longer halves of a vector go into the hash as their digest, so that a long name costs no square of its length.
LONG_HALF = 64
#: The days that a date's permutation covers: 400 years, 189 * 773 days.
FIRST_DAY, DAY_RADICES = "1800-01-01", (189, 773)
#: Country codes of one, two and three digits, by which the digits of a number alone tell where its own begin; fixed values.
COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Kinds and their patterns, the first that fits wins. A value may not touch other letters or digits. A name has any
#: length and a host 127 labels of 63 characters at most; repetitions of groups are bounded, as each step of one takes a frame of the stack.
EMAIL = r"(?<![\p{L}\p{N}_%+\-])(?<![\p{L}\p{N}_%+\-]\.)[\p{L}\p{N}_%+\-][\p{L}\p{N}._%+\-]*+@(?:[A-Za-z0-9\-]{1,63}\.){1,127}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![\p{L}\p{N}])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])"
DATE = r"(?<![\p{L}\p{N}./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\p{L}\p{N}]|[./\-][0-9])"
SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
CARD = r"(?<![\p{L}\p{N}.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}]|[\-.][0-9])"
PHONE = r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}\-])[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
#: Runs of letters and digits that are permuted among themselves, by first and last character.
ALPHABETS = ("09", "az", "AZ", "àö", "øþ", "ÀÖ", "ØÞ", "Āſ", "αω", "ΑΡ", "ΣΩ", "ая", "АЯ", "את", "ぁゖ", "ァヺ", "一龥", "가힣")
#: Tokens of a text, and more of them, and more characters of one, than a card or an IBAN has.
TOKEN, LONGEST = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]", 40
ANY = "|".join(f"(?:{x})" for x in (EMAIL, IBAN, DATE, IP, SSN, CARD, PHONE))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def numbers(s: Column) -> Column:
    """The digits of a string of digits, as an array."""
    return F.transform(F.split(s, ""), lambda c: F.ascii(c) - 48)


def at(s: Column, i: Column) -> Column:
    """The character at a place from 1."""
    return F.substr(s, i, F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: bound to a name by a transform over one element."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, radices: Column, key: str, kind: Column) -> Column:
    """The permuted vector: both arrays of int, of equal length; a digit of radix 1 stays 0.

    Each round adds noise to one half and swaps the halves, so an even number of rounds puts them back.
    The rounds are a fold, so the plan holds one round only, whatever the number of rounds and kinds.
    """

    def turned(s: Column, turn: Column) -> Column:
        other = F.array_join(F.transform(s["b"], lambda x: x.cast("string")), ",")
        other = F.when(F.size(s["b"]) > LONG_HALF, F.sha2(other, 256)).otherwise(other)
        secret = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), other)
        noise = lambda x, i: F.conv(F.substring(F.sha2(F.concat_ws("|", x, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
        # the secret is bound first, as a lambda's body is computed anew for each digit
        noisy = let(secret, lambda x: F.transform(F.arrays_zip(s["a"].alias("v"), s["x"].alias("r")), lambda z, i: ((z["v"] + noise(x, i)) % z["r"]).cast("int")))
        return F.struct(s["b"].alias("a"), noisy.alias("b"), s["y"].alias("x"), s["x"].alias("y"))

    half = (F.size(values) / 2).cast("int")
    cut_at = lambda x: (F.slice(x, 1, half), F.slice(x, half + 1, F.size(values) - half))
    (left, right), (x, y) = cut_at(values), cut_at(radices)
    start = F.struct(left.alias("a"), right.alias("b"), x.alias("x"), y.alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda s: F.concat(s["a"], s["b"]))


def joined(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), "")


def tens(v: Column) -> Column:
    return F.transform(v, lambda x: F.lit(10))


def rendered(form: Column, d: Column) -> Column:
    """The form with its digits replaced in order; its other characters stay."""
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("[0-9]"), at(d, F.length(digits(F.substr(form, F.lit(1), i + 1))))).otherwise(c)), "")


def luhn_rest(d: Column) -> Column:
    """Luhn's sum by 10; 0 if the last digit checks the others."""
    doubled = F.transform(F.reverse(numbers(d)), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def iban_rest(compact: Column) -> Column:
    """The number of a compact IBAN by 97; 1 if it is right."""
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


class Kind:
    """A kind of value: what is valid, its vector as (values, radices), and the text of a permuted vector."""

    def __init__(self, name: str, pattern: str, valid, vector, shown, tweak=None) -> None:
        self.name, self.pattern, self.valid, self.vector, self.shown = name, pattern, valid, vector, shown
        #: What the permutation depends on besides the kind.
        self.tweak = tweak or (lambda m: F.lit(name))


def is_card(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(13, 19) & (luhn_rest(d) == 0) & ~d.rlike("^(.)\\1*$")


def card_vector(m: Column) -> tuple[Column, Column]:
    d = digits(m)
    v = numbers(F.substr(d, F.lit(1), F.length(d) - 1))
    return v, tens(v)


def card_text(m: Column, out: Column) -> Column:
    body = joined(out)
    return rendered(m, F.concat(body, ((10 - luhn_rest(F.concat(body, F.lit("0")))) % 10).cast("string")))


def compact(m: Column) -> Column:
    return F.upper(F.regexp_replace(m, " ", ""))


def is_iban(m: Column) -> Column:
    """15 to 34 characters that pass the check; in small letters ten digits at least, as words in a row take that form."""
    c = compact(m)
    return F.length(c).between(15, 34) & (iban_rest(c) == 1) & (~m.rlike("[a-z]") | (F.length(digits(m)) >= 10))


def iban_vector(m: Column) -> tuple[Column, Column]:
    chars = F.split(F.substr(compact(m), F.lit(5)), "")
    is_digit = lambda c: c.rlike("[0-9]")
    return F.transform(chars, lambda c: F.ascii(c) - F.when(is_digit(c), 48).otherwise(65)), F.transform(chars, lambda c: F.when(is_digit(c), 10).otherwise(26))


def iban_text(m: Column, out: Column) -> Column:
    chars = F.split(F.substr(compact(m), F.lit(5)), "")
    moved = F.array_join(F.zip_with(out, chars, lambda x, c: F.when(c.rlike("[0-9]"), x.cast("string")).otherwise(F.chr(x + 65))), "")
    country = F.substring(compact(m), 1, 2)
    check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), moved))).cast("string"), 2, "0")
    shown = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(at(F.concat(country, check, moved), F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", ""))))), "")
    return F.when(m.rlike("[a-z]"), F.lower(shown)).otherwise(shown)


def ip_parts(m: Column) -> Column:
    return F.transform(F.split(m, "\\."), lambda x: x.cast("int"))


def ip_text(m: Column, out: Column) -> Column:
    """Parts with zeros before them keep their width."""
    padded = lambda x, part: F.when(part.rlike("^0.") & (F.length(x) < F.length(part)), F.lpad(x, F.length(part), F.lit("0"))).otherwise(x)
    return F.array_join(F.zip_with(out, F.split(m, "\\."), lambda x, part: padded(x.cast("string"), part)), ".")


def ssn_parts(m: Column) -> tuple[Column, ...]:
    return tuple(F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))


def is_ssn(m: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serial numbers 0001 to 9999."""
    area, group, serial = ssn_parts(m)
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


def ssn_vector(m: Column) -> tuple[Column, Column]:
    area, group, serial = ssn_parts(m)
    return F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999))


def ssn_text(m: Column, out: Column) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", pad(out[0] + F.when(out[0] > 664, 2).otherwise(1), 3), pad(out[1] + 1, 2), pad(out[2] + 1, 4))


def day(m: Column, form: str) -> Column:
    return F.to_date(F.try_to_timestamp(m, F.lit(form)))


def day_number(m: Column) -> Column:
    """Days from 1800 on; with slashes month or day first, whichever is a day, months first if both are."""
    value = F.when(m.rlike("-"), day(m, "yyyy-MM-dd")).when(m.rlike("/"), F.coalesce(day(m, "M/d/yyyy"), day(m, "d/M/yyyy"))).otherwise(day(m, "d.M.yyyy"))
    return F.datediff(value, F.lit(FIRST_DAY).cast("date"))


def date_vector(m: Column) -> tuple[Column, Column]:
    a, b = DAY_RADICES
    return let(day_number(m), lambda n: F.array((n / b).cast("int"), (n % b).cast("int"))), F.array(F.lit(a), F.lit(b))


def date_text(m: Column, out: Column) -> Column:
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), out[0] * DAY_RADICES[1] + out[1])
    wide = m.rlike("^[0-9]{2}[./][0-9]{2}[./]")
    two = lambda long, short: F.when(wide, F.date_format(moved, long)).otherwise(F.date_format(moved, short))
    slashes = F.when(day(m, "M/d/yyyy").isNotNull(), two("MM/dd/yyyy", "M/d/yyyy")).otherwise(two("dd/MM/yyyy", "d/M/yyyy"))
    return F.when(m.rlike("-"), F.date_format(moved, "yyyy-MM-dd")).when(m.rlike("/"), slashes).otherwise(two("dd.MM.yyyy", "d.M.yyyy"))


def country_digits(m: Column) -> Column:
    return F.when(m.startswith("+"), F.length(F.regexp_extract(digits(m), COUNTRY, 1))).otherwise(0)


def is_phone(m: Column) -> Column:
    """Seven to fifteen digits in all, two at least behind the country's."""
    n = F.length(digits(m))
    return (n >= 7) & (n <= 15) & (n - country_digits(m) >= 2)


def phone_vector(m: Column) -> tuple[Column, Column]:
    """The country code stays; how the digits are set apart does not matter."""
    v = numbers(F.substr(digits(m), country_digits(m) + 1))
    return v, tens(v)


def phone_text(m: Column, out: Column) -> Column:
    return rendered(m, F.concat(F.substr(digits(m), F.lit(1), country_digits(m)), joined(out)))


def alphabet(c: Column) -> Column:
    """struct(first code point, size) of the alphabet that a character is in; NULL where it is in none."""
    table = F.expr(f"array({', '.join(f'struct({ord(x)} AS first, {ord(y) - ord(x) + 1} AS size)' for x, y in ALPHABETS)})")
    return F.get(F.filter(table, lambda r: (F.ascii(c) >= r["first"]) & (F.ascii(c) < r["first"] + r["size"])), F.lit(0))


def email_name(m: Column) -> Column:
    return F.split(F.substring_index(m, "@", 1), "")


def email_vector(m: Column) -> tuple[Column, Column]:
    chars = email_name(m)
    return F.transform(chars, lambda c: F.coalesce(F.ascii(c) - alphabet(c)["first"], F.lit(0))), F.transform(chars, lambda c: F.coalesce(alphabet(c)["size"], F.lit(1)))


def email_text(m: Column, out: Column) -> Column:
    """Letters and digits before the @ are permuted, each within its own alphabet; the domain stays."""
    char = lambda point: F.when(point < 128, F.chr(point)).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    moved = F.zip_with(out, email_name(m), lambda x, c: F.coalesce(char(x + alphabet(c)["first"]), c))
    return F.concat(F.array_join(moved, ""), F.lit("@"), F.substring_index(m, "@", -1))


KINDS = (
    Kind("email", EMAIL, lambda m: F.exists(email_name(m), lambda c: alphabet(c).isNotNull()), email_vector, email_text, lambda m: F.concat(F.lit("email|"), F.lower(F.substring_index(m, "@", -1)))),
    Kind("iban", IBAN, is_iban, iban_vector, iban_text),
    Kind("date", DATE, lambda m: day_number(m).between(0, DAY_RADICES[0] * DAY_RADICES[1] - 1), date_vector, date_text),
    Kind("ip", IP, lambda m: F.forall(ip_parts(m), lambda x: x < 256), lambda m: (ip_parts(m), F.transform(ip_parts(m), lambda x: F.lit(256))), ip_text),
    Kind("ssn", SSN, is_ssn, ssn_vector, ssn_text),
    Kind("card", CARD, is_card, card_vector, card_text),
    Kind("phone", PHONE, is_phone, phone_vector, phone_text),
)


def by_kind(kind: Column, make) -> Column:
    """make(k) of the kind whose name stands in a column; NULL where it is NULL."""
    out = F.lit(None)
    for k in reversed(KINDS):
        out = F.when(kind == k.name, make(k)).otherwise(out)
    return out


def kind_of(m: Column) -> Column:
    """The kind whose pattern the whole match fits."""
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{k.pattern})$"), k.name).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, text) of a match; kind is NULL and the text as it was where the value is not valid.

    The kind says what the vector is; then one network permutes it, whichever kind it is of.
    """

    def vector(k: Kind) -> Column:
        values, radices = k.vector(m)
        return F.struct(values.alias("v"), radices.alias("r"), k.tweak(m).alias("t"))

    def moved(kind: Column) -> Column:
        out = let(by_kind(kind, vector), lambda s: feistel(s["v"], s["r"], key, s["t"]))
        text = let(out, lambda x: by_kind(kind, lambda k: k.shown(m, x)))
        return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), text).otherwise(m).alias("text"))

    valid = lambda kind: F.when(by_kind(kind, lambda k: k.valid(m)), kind)
    return let(let(kind_of(m), valid), moved)


def longest(candidate: Column, passes) -> Column:
    """The longest start of a candidate that ends with one of its groups and passes; NULL if none does."""
    ends = F.filter(F.sequence(F.lit(1), F.length(candidate)), lambda i: at(candidate, i).rlike("[A-Za-z0-9]") & ~at(candidate, i + 1).rlike("[A-Za-z0-9]"))
    return F.try_element_at(F.filter(F.transform(ends, lambda i: F.substr(candidate, F.lit(1), i)), passes), F.lit(-1))


def unsettled(m: Column) -> Column:
    """Whether a match has a card's, an IBAN's or a phone's form and reaches too far or is none."""
    return F.when(m.rlike(f"^(?:{CARD})$"), ~is_card(m)).when(m.rlike(f"^(?:{IBAN})$"), ~is_iban(m)).otherwise(m.startswith("+") & (F.length(digits(m)) > 15))


def cut(text: Column) -> Column:
    """struct(gaps, values): a text's matches in order, and what stands before, between and behind them."""
    none = F.array().cast("array<string>")
    some = text.rlike("[0-9@]")
    return F.struct(F.when(some, F.split(text, ANY, -1)).otherwise(F.array(text)).alias("gaps"), F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none).alias("values"))


def best(around: Column) -> Column:
    """The card or IBAN that starts behind the first character, the longest that passes; NULL where there is none."""
    first = lambda pattern, passes: longest(F.regexp_extract(around, f"(?s)^.({pattern})", 1), passes)
    return let(F.array_compact(F.array(first(CARD, is_card), first(IBAN, is_iban))), lambda found: F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(0)))


def tokens(s: Column) -> Column:
    """Runs of letters and digits, and each other character; a text is its tokens joined."""
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))


def cut_again(parts: Column) -> Column:
    """A cut text, cut anew where a match is unsettled: first at the cards and IBANs that start at any of its groups.

    A value has a bounded number of tokens, so each group looks at so many, and the leftmost values that don't
    overlap are chosen in one fold: the work grows with the text. Settled matches stay as they are, each as one token.
    """
    pair = lambda shown, seen: F.struct(shown.alias("shown"), seen.alias("seen"))
    plain = lambda s: F.transform(tokens(s), lambda t: pair(t, F.substring(t, 1, LONGEST)))
    settled = lambda m: F.when(m.isNotNull(), F.array(pair(m, F.lit("\n")))).otherwise(F.array().cast("array<struct<shown: string, seen: string>>"))
    rows = F.flatten(F.zip_with(parts["gaps"], parts["values"], lambda g, m: F.concat(plain(g), F.when(unsettled(m), plain(m)).otherwise(settled(m)))))
    # what a token sees begins with the token before it
    both = let(rows, lambda r: pair(r["shown"], F.concat(F.array(F.lit("\n")), r["seen"])))

    def picked(s: Column) -> Column:
        """struct(i, n) of the settled matches and the values that are chosen: the first token and the number of tokens."""
        fixed = lambda t, i: (F.get(s["seen"], i + 1) == "\n") & (t != "\n")
        starts = F.filter(F.transform(s["shown"], lambda t, i: F.when(fixed(t, i) | t.rlike("^(?:[0-9]|[A-Z]{2}[0-9]{2}|[a-z]{2}[0-9]{2})"), F.struct((i + 1).alias("i"), fixed(t, i).alias("fixed")))), lambda x: x.isNotNull())
        n = lambda i: F.size(tokens(best(F.array_join(F.slice(s["seen"], i, LONGEST + 2), ""))))
        found = F.transform(starts, lambda x: F.struct(x["i"].alias("i"), F.when(x["fixed"], 1).otherwise(n(x["i"])).alias("n")))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i: int, n: int>>").alias("all"))
        take = lambda a, x: F.when(x["i"] >= a["end"], F.struct((x["i"] + x["n"]).alias("end"), F.array_append(a["all"], x).alias("all"))).otherwise(a)
        return F.aggregate(F.filter(found, lambda x: x["n"] > 0), start, take, lambda a: a["all"])

    def around(s: Column, values: Column) -> Column:
        text = lambda i, n: F.array_join(F.slice(s["shown"], i, n), "")
        begins = F.concat(F.array(F.lit(1)), F.transform(values, lambda x: x["i"] + x["n"]))
        ends = F.concat(F.transform(values, lambda x: x["i"]), F.array(F.size(s["shown"]) + 1))
        pieces = F.zip_with(begins, ends, lambda a, b: cut(text(a, b - a)))
        hits = F.transform(values, lambda x: text(x["i"], x["n"]))
        found = lambda p: F.zip_with(p, hits, lambda x, h: F.concat(x["values"], F.array_compact(F.array(h))))
        return let(pieces, lambda p: F.struct(F.flatten(p["gaps"]).alias("gaps"), F.flatten(found(p)).alias("values")))

    return let(both, lambda s: let(picked(s), lambda values: F.when(F.size(values) > 0, around(s, values)).otherwise(parts)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "found_kinds") -> DataFrame:
    """docs with the text's values replaced, and the kinds of the replaced values in order in `found_col`.

    Texts without a digit or an @ pass untouched, before any pattern is tried. Where docs have a column
    `found_col`, it stays, and the kinds stand under the first free name with underscores before it.
    """
    text, found_col = F.col(text_col), free_name(docs.columns, found_col)
    parts = free_name([*docs.columns, found_col], "text_parts")
    made = docs.withColumn(parts, cut(text))
    made = made.withColumn(parts, F.when(F.exists(F.col(parts)["values"], unsettled), cut_again(F.col(parts))).otherwise(F.col(parts)))
    made = made.withColumn(found_col, F.transform(F.col(parts)["values"], lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with(F.col(parts)["gaps"], F.col(found_col), lambda p, m: F.concat(p, F.coalesce(m["text"], F.lit("")))), "")
    made = made.withColumn(text_col, F.when(F.size(found_col) > 0, joined).otherwise(text)).drop(parts)
    return made.withColumn(found_col, F.coalesce(F.filter(F.col(f"{found_col}.kind"), lambda k: k.isNotNull()), F.array().cast("array<string>")))


#: The session's setting that has the key, and the key where it is unset: for trials only, as whoever has the code has it.
SETTING, TRIAL_KEY = "spark.tessera.pii.key", "tessera-demo-key"


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = pseudonymize(docs, spark.conf.get(SETTING, TRIAL_KEY))
    return made.select("doc_id", "text", F.size("found_kinds").alias("n_replaced"), F.array_join("found_kinds", ",").alias("kinds"))
