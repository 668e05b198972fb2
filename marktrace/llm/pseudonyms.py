"""Personal data: format-preserving pseudonyms from a keyed Feistel network, in Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import bind

ROUNDS = 10
#: days within which dates are permuted, as a product of two factors: blocks from 0001-01-01 on, and what is left up to 9999-12-31
BLOCK_DAYS, LAST_DAYS = (270, 270), (39, 181)
#: days from 0001-01-01 to 1970-01-01, and the number of the last, shorter block
FIRST_DAY, LAST_BLOCK = 719_162, 50

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9]|[-/.][0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: published shapes of credentials: long hexadecimal strings, cloud access keys, and what follows "password="
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16})(?![0-9A-Za-z])|(?<=(?i:password)=)[^\s\"']+"
BEFORE, AFTER = [EMAIL, ADDRESS, DATE, PHONE, SOCIAL], [SECRET]


def _gap(*values: str) -> str:
    """What may stand between digit groups of a card number: no other value starts behind it."""
    return f"[ -](?!{'|'.join(values)})"


def _bounded(form: str) -> str:
    return f"(?<![0-9A-Za-z])(?:{form})(?![0-9A-Za-z])"


_G = _gap(*BEFORE)
#: published groupings of card numbers, and any other grouping, each of which may end elsewhere
LONG_CARD = _bounded(f"(?:[0-9]{{4}}{_G}){{4}}[0-9]{{3}}")
GROUPED_CARD = _bounded(f"[0-9]{{13,19}}|(?:[0-9]{{4}}{_G}){{3}}[0-9]{{4}}|[0-9]{{4}}{_G}[0-9]{{6}}{_G}[0-9]{{4,5}}|[0-9]{{4}}(?:{_G}[0-9]{{3}}){{3}}|[0-9]{{6}}{_G}[0-9]{{13}}")
LOOSE_CARD = _bounded(f"[0-9](?:(?:{_gap(*BEFORE, LONG_CARD, GROUPED_CARD)})?[0-9]){{12,18}}")


def feistel(symbols: Column, radix: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of all symbol strings of the same radixes.

    In each round one half has a keyed hash of the other half added, symbol by symbol modulo its radix, which
    can be undone; halves take turns. Symbols of radix 1 never change.
    """

    def network(z: Column) -> Column:
        def one_round(state: Column, turn: Column) -> Column:
            left, half = turn % 2 == 0, z["half"]
            other = F.array_join(F.when(left, F.slice(state, half + 1, F.greatest(F.size(state) - half, F.lit(0)))).otherwise(F.slice(state, 1, half)), ",")

            def moved(value: Column, i: Column, mark: Column) -> Column:
                added = F.conv(F.substring(F.sha2(F.concat_ws("|", mark, i), 256), 1, 12), 16, 10).cast("long")
                return F.when(((i < half) == left) & (F.get(z["radix"], i) > 1), (value + added) % F.get(z["radix"], i)).otherwise(value)

            mark = F.concat_ws("|", F.lit(key), F.lit(kind), turn, other)
            return bind(mark, lambda m: F.transform(state, lambda value, i: moved(value, i, m)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), z["symbols"], one_round)

    return bind(F.named_struct(F.lit("symbols"), symbols, F.lit("radix"), radix, F.lit("half"), F.ceil(F.size(symbols) / 2).cast("int")), network)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _base(code: Column) -> Column:
    return F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97).otherwise(code)


def _radix(code: Column) -> Column:
    return F.when(code.between(48, 57), 10).when(code.between(65, 90) | code.between(97, 122), 26).otherwise(1)


def same_classes(text: Column, key: str, kind: str) -> Column:
    """Digits become digits, ASCII letters letters of the same case; all else stays in place."""

    def moved(letters: Column) -> Column:
        def written(code: Column) -> Column:
            new = feistel(F.transform(code, lambda c: c - _base(c)), F.transform(code, lambda c: _radix(c).cast("long")), key, kind)
            made = F.zip_with(new, code, lambda v, c: F.when(_radix(c) > 1, F.chr(v + _base(c))))
            return F.array_join(F.zip_with(made, letters, lambda new, old: F.coalesce(new, old)), "")

        return bind(F.transform(letters, lambda c: F.ascii(c).cast("long")), written)

    return bind(_letters(text), moved)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(text: Column, new: Column) -> Column:
    """``text`` with its digits replaced one by one by those of ``new``, which has as many."""
    start = F.named_struct(F.lit("s"), F.lit(""), F.lit("n"), F.lit(0))

    def step(digits_of: Column, a: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.named_struct(F.lit("s"), F.concat(a["s"], F.when(is_digit, F.substr(digits_of, a["n"] + 1, F.lit(1))).otherwise(c)), F.lit("n"), a["n"] + is_digit.cast("int"))

    return bind(new, lambda v: F.aggregate(_letters(text), start, lambda a, c: step(v, a, c))["s"])


def _luhn(number: Column) -> Column:
    """Sum of the Luhn rule over all digits, the last one counted once."""
    value = F.transform(F.reverse(_letters(number)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v)


def card(text: Column, key: str) -> Column:
    """All digits but the last are permuted and the check digit is made anew; other numbers stay."""
    number = digits(text)

    def whole(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    new = bind(same_classes(F.substr(number, F.lit(1), F.length(number) - 1), key, "card"), whole)
    return F.when(_luhn(number) % 10 == 0, refill(text, new)).otherwise(text)


def address(text: Column, key: str) -> Column:
    part = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    moved = feistel(part, F.transform(part, lambda p: F.lit(256).cast("long")), key, "address")
    return F.when(F.forall(part, lambda p: p <= 255), F.array_join(moved, ".")).otherwise(text)


def phone(text: Column, key: str) -> Column:
    """The last ten digits are permuted, so a number is linked with and without country code."""
    number = digits(text)
    lead = F.length(number) - 10
    return refill(text, F.concat(F.substr(number, F.lit(1), lead), same_classes(F.substr(number, lead + 1, F.lit(10)), key, "phone")))


def social(text: Column, key: str) -> Column:
    valid = ~text.rlike("^(?:000|666|9)") & ~text.rlike("-00-|-0000$")
    return F.when(valid, refill(text, same_classes(digits(text), key, "social"))).otherwise(text)


def date(text: Column, key: str) -> Column:
    """Days are permuted within blocks of 72,900, the last of 7,059 up to 9999-12-31; order of parts and separators stay, parts keep two digits if they had.

    Of two leading parts the first is the month unless only the other order is a date.
    """
    part, gap = F.split(text, "[-/.]"), F.split(text, "[0-9]+")
    a, b, c = (F.get(part, F.lit(i)).cast("int") for i in range(3))
    year_first = F.length(F.get(part, F.lit(0))) == 4
    year = F.when(year_first, a).otherwise(c)
    day_first = ~year_first & (a > 12)
    month = F.when(year_first, b).when(day_first, b).otherwise(a)
    day = F.when(year_first, c).when(day_first, a).otherwise(b)
    sound = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    month_start = F.make_date(year, month, F.lit(1))
    valid = sound & (day <= F.dayofmonth(F.last_day(month_start)))
    number = F.unix_date(month_start).cast("long") + day - 1 + FIRST_DAY
    size = BLOCK_DAYS[0] * BLOCK_DAYS[1]
    block, place = F.floor(number / size), F.pmod(number, F.lit(size).cast("long"))
    high, low = (F.when(block == LAST_BLOCK, last).otherwise(full).cast("long") for full, last in zip(BLOCK_DAYS, LAST_DAYS, strict=True))
    moved = feistel(F.array(F.floor(place / low), place % low), F.array(high, low), key, "date")
    new = F.transform(F.array(moved), lambda m: F.date_from_unix_date((block * size + F.get(m, F.lit(0)) * low + F.get(m, F.lit(1)) - FIRST_DAY).cast("int")))
    day_out = F.get(new, F.lit(0))
    y, m, d = F.lpad(F.year(day_out).cast("string"), 4, "0"), F.lpad(F.month(day_out).cast("string"), 2, "0"), F.lpad(F.dayofmonth(day_out).cast("string"), 2, "0")
    out = F.when(year_first, F.array(y, m, d)).when(day_first, F.array(d, m, y)).otherwise(F.array(m, d, y))
    sep = F.get(gap, F.lit(1)), F.get(gap, F.lit(2))
    written = F.transform(F.array(out), lambda o: F.concat(F.get(o, F.lit(0)), sep[0], F.get(o, F.lit(1)), sep[1], F.get(o, F.lit(2))))
    return F.when(valid, F.get(written, F.lit(0))).otherwise(text)


def email(text: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted; the mail host stays."""
    return F.concat(same_classes(F.substring_index(text, "@", 1), key, "email"), F.lit("@"), F.substring_index(text, "@", -1))


def _is(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def pseudonym(text: Column, key: str) -> Column:
    """The pseudonym of one found value; values that fail their check stay as they are."""
    chosen = F.when(text.contains("@") & _is(text, EMAIL), email(text, key)).when(_is(text, ADDRESS), address(text, key)).when(_is(text, DATE), date(text, key)).when(_is(text, PHONE), phone(text, key))
    return chosen.when(_is(text, SOCIAL), social(text, key)).when(_is(text, CARD), card(text, key)).otherwise(same_classes(text, key, "secret"))


def valid_cards(text: Column) -> Column:
    """The distinct strings of ``text`` that are card numbers by form and Luhn sum, looked for at each digit group, wherever others end."""
    forms = [F.regexp_extract_all(text, F.lit(f"(?=({form}))"), F.lit(1)) for form in (LONG_CARD, GROUPED_CARD, LOOSE_CARD)]
    some = F.array_distinct(F.concat(*forms))
    return F.when(text.rlike(CARD), F.filter(some, lambda n: _luhn(digits(n)) % 10 == 0)).otherwise(F.array().cast("array<string>"))


def any_value(cards: Column) -> Column:
    """The pattern of all values, of card numbers only ``cards``: a number that is none hides no value behind it."""
    listed = F.concat(F.lit("(?<![0-9A-Za-z])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9A-Za-z])"))
    return F.concat_ws("|", F.lit("|".join(BEFORE)), F.when(F.size(cards) > 0, listed), F.lit("|".join(AFTER)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced, plus ``n_replaced``.

    Found are mail addresses, IPv4 addresses, dates, phone numbers, social security numbers, card numbers and
    credentials. Numbers and dates are checked (octets, calendar, Luhn sum, issued ranges) and left alone where
    they fail. Card numbers are looked for at each digit group, so a number that fails hides none behind it. Each value is permuted among values of its own format under ``key``, so equal values stay equal
    in all documents, different ones differ, and a holder of the key can undo it. Whole texts are scanned; a
    null text stays null with 0 replaced. Rows are independent; an input column n_replaced is replaced.

    Distinct values are few, texts many: the found values of a text are permuted inside its row, nothing moves.
    """
    base = docs.drop("n_replaced")
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    rows = base.select(F.struct(*base.columns).alias("row")).withColumn("cards", valid_cards(text)).select("row", any_value(F.col("cards")).alias("form"))
    found = F.when(text.rlike("[0-9@]|(?i:password=)"), F.regexp_extract_all(text, F.col("form"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = rows.withColumn("found", found)
    swapped = named.withColumn("new", F.transform("found", lambda v: pseudonym(v, key)))
    gaps = F.split(text, F.col("form"), -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col("new"), lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    new_text = F.when(F.size("found") > 0, whole).otherwise(F.col("row")["text"])
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x)).cast("long")
    return swapped.select(*(new_text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in base.columns), changed.alias("n_replaced"))
