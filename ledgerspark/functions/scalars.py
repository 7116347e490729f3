"""Column functions without shuffles: bands, flags, parsing, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CREDIT_TYPES = ("CREDIT", "INCOMING", "DEPOSIT", "SALARY", "REFUND", "CASHBACK")
CRYPTO_WORDS = ("CRYPTO", "VAULD", "WAZIRX", "BINANCE", "COIN", "BTC")
SHELL_WORDS = ("INFRA", "TRADERS", "ENTERPRISES", "CONSTRUCTION", "SUPPLIERS")
TRADE_CATEGORIES = ("TRADE", "INVOICE", "IMPORT", "EXPORT")
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(x: Column, cuts: list[float], labels: list[str], right_closed: bool = False) -> Column:
    """labels[i] for the first cut that x is under (or at most, if right-closed), else the last label."""
    tests = [(x <= c) if right_closed else (x < c) for c in cuts]
    first = F.when(tests[0], labels[0])
    return reduce(lambda w, t: w.when(t[0], t[1]), zip(tests[1:], labels[1:], strict=False), first).otherwise(labels[-1])


def credit_debit(kind: Column) -> Column:
    return F.when(F.upper(F.trim(kind)).isin(*CREDIT_TYPES), "CREDIT").otherwise("DEBIT")


def signed(amount: Column, kind: Column) -> Column:
    return F.when(credit_debit(kind) == "CREDIT", F.abs(amount)).otherwise(-F.abs(amount))


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.upper(text).rlike("|".join(words))


def parsed_time(text: Column) -> Column:
    """The first format that fits, ISO with a zone first. Where the separators name the format only that one is tried, as a failed
    attempt costs an exception; other texts go through all of them."""
    t = F.trim(text)
    parse = lambda f: F.try_to_timestamp(t, F.lit(f))
    shape = lambda n, *at: (F.length(t) == n) & reduce(lambda x, y: x & y, [F.substring(t, i, 1) == c for i, c in at])
    day = ((5, "-"), (8, "-"))
    named = {
        "yyyy-MM-dd HH:mm:ss": shape(19, *day, (11, " ")), "yyyy-MM-dd": shape(10, *day), "yyyy-MM-dd'T'HH:mm:ss": shape(19, *day, (11, "T")),
        "yyyy-MM-dd HH:mm": shape(16, *day, (11, " ")), "yyyy/MM/dd": shape(10, (5, "/")),
        "dd-MM-yyyy": shape(10, (3, "-")), "dd-MM-yyyy HH:mm:ss": shape(19, (3, "-")),
    }
    found = reduce(lambda w, kv: w.when(kv[1], parse(kv[0])), named.items(), F.when(shape(10, (3, "/")), F.coalesce(parse("dd/MM/yyyy"), parse("MM/dd/yyyy"))))
    digits = t.rlike(r"^\d")
    return F.when(digits, found.otherwise(F.coalesce(*[parse(f) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", *TIME_FORMATS)])))


def fingerprint(source: Column, target: Column, amount: Column, ts: Column, kind: Column) -> Column:
    money = F.format_string("%.2f", F.round(F.abs(amount), 2))
    return F.sha2(F.concat_ws("|", source, target, money, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.upper(kind)), 256)


def case_id(prefix: str, ts: Column, fp: Column) -> Column:
    """The same for every replay of the same transaction."""
    return F.concat(F.lit(f"{prefix}_"), F.year(ts).cast("string"), F.lit("_"), F.upper(F.substring(fp, 1, 8)))


def mask_id(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 8), F.lit("***"))


def fired(flags: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
