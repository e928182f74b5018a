"""Grounding of written explanations (V-09): what a text claims, held against what is known of its store.

A text is cut into sentences and each sentence into typed claims: numbers with
their unit and written precision, references, metric names, currencies, and
wording that names a cause. Claims meet the store's evidence in joins; a text
never meets another store's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import METRICS
from ..sources import scratch

#: A number not inside a word or a reference, with grouped digits or not, and the sign that makes it a share.
#: Digits once taken are never given back (a digit left over could only fail the look ahead), so a long run is read once.
_ALONE = r"(?![\w.,]*?[0-9])\s?%?"
#: Every shape looks at its first character before anything else, so that most of a text is passed over at once.
NUMBER = rf"(?=[0-9])(?<![\w.\[#-])(?:[0-9]{{1,3}}+(?:,[0-9]{{3}})++(?:\.[0-9]{{1,4}}+)?+{_ALONE}|[0-9]++(?:\.[0-9]{{1,4}}+)?+{_ALONE})"
REFERENCE = r"\[([A-Za-z][\w-]*)\]"
CURRENCIES = {"EUR": "€", "USD": r"\$", "GBP": "£", "JPY": "¥", "CHF": None, "SEK": None, "NOK": None, "DKK": None, "PLN": None, "CAD": None, "AUD": None}
CAUSES = r"(?i)(?=[bcdlr])\b(because of|caused by|due to|led to|resulted in)\b"
#: Decimals at which a trusted value may be quoted.
DECIMALS = 5


def claims(explanations: DataFrame, key: str, text_col: str, store_col: str) -> DataFrame:
    """One row per claim: key, store_id, sentence (from 1), kind, unit and claim.

    Kinds are number (unit "percent" or "plain"; the claim is the number as
    written, ungrouped), reference, metric, currency and cause.
    """
    # outer, and empty sentences dropped behind it: of a plain explode the optimizer asks first whether there will be rows,
    # and so reads every text twice
    sentences = F.posexplode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?=\s)(?<=[.!?])\s+"))
    said = explanations.select(key, F.col(store_col).cast("string").alias("store_id"), sentences.alias("place", "said"))
    text = F.col("said")
    claim = lambda kind, unit, e: F.struct(F.lit(kind).alias("kind"), unit.alias("unit"), e.alias("claim"))
    none = F.lit(None).cast("string")
    percent = lambda n: F.when(F.endswith(n, F.lit("%")), "percent").otherwise("plain")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: claim("number", percent(n), F.trim(F.translate(n, ",%", ""))))
    references = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda r: claim("reference", none, r))
    plain = F.replace(F.lower(text), F.lit("_"), F.lit(" "))
    named = lambda pattern, kind, name: F.when(F.regexp_like(plain if kind == "metric" else text, F.lit(pattern)), claim(kind, none, F.lit(name)))
    metric = {m: rf"\b{m.replace('_', ' ')}\b" for m in METRICS}
    money = {code: rf"\b{code}\b" + (f"|{sign}" if sign else "") for code, sign in CURRENCIES.items()}

    def any_of(patterns: dict[str, str], kind: str, first: str, extra: str = "") -> Column:
        """One look for all names, which begin with ``first``; only a sentence that has one is looked through for each."""
        names = "|".join(p.split("|")[0].replace(r"\b", "") for p in patterns.values())
        some = F.regexp_like(plain if kind == "metric" else text, F.lit(rf"(?=[{first}])\b(?:{names})\b{extra}"))
        each = F.array_compact(F.array(*[named(p, kind, n) for n, p in patterns.items()]))
        return F.when(some, each).otherwise(F.array().cast("array<struct<kind: string, unit: string, claim: string>>"))

    cause = F.when(F.regexp_like(text, F.lit(CAUSES)), claim("cause", none, F.lower(F.regexp_extract(text, CAUSES, 1))))
    every = F.array_distinct(F.concat(numbers, references, any_of(metric, "metric", "".join(sorted({m[0] for m in METRICS}))), any_of(money, "currency", "A-Z", "|[" + "".join(filter(None, CURRENCIES.values())) + "]"), F.array_compact(F.array(cause))))
    return said.select(key, "store_id", (F.col("place") + 1).alias("sentence"), F.inline_outer(every)).filter("kind is not null")


def forms_used(numbers: DataFrame) -> list[tuple[str, int]]:
    """The units and decimals that number claims are written with: a row for each, ten at most."""
    point = F.instr("claim", ".")
    decimals = F.when(point > 0, F.length("claim") - point).otherwise(0)
    return [(r.unit, r.decimals) for r in numbers.select("unit", decimals.alias("decimals")).distinct().collect()]


def trusted_numbers(trusted: DataFrame, forms: list[tuple[str, int]]) -> DataFrame:
    """(store_id, unit, claim): how each trusted ``value`` of a store is quoted in the given units and decimals, as it is and as a share."""
    value = {"plain": F.abs(F.col("value").cast("double")), "percent": F.abs(F.col("value").cast("double") * 100)}
    quoted = [F.struct(F.lit(unit).alias("unit"), F.format_string(f"%.{d}f", value[unit]).alias("claim")) for unit, d in forms if d < DECIMALS]
    none = F.array().cast("array<struct<unit: string, claim: string>>")
    return trusted.select(F.col("store_id").cast("string").alias("store_id"), F.inline(F.array(*quoted) if quoted else none))


def faults(found: DataFrame, key: str, trusted: DataFrame, references: DataFrame, unavailable: DataFrame, currencies: DataFrame) -> DataFrame:
    """Claims that nothing supports: key, store_id, sentence, fault and claim.

    ``trusted`` has store_id and value, ``references`` store_id and ref,
    ``unavailable`` store_id and metric, ``currencies`` store_id and currency.
    A number is grounded if a trusted value of its store has its digits at its
    precision; an unavailable metric may be named but not beside a number; a
    store without a known currency may be told in none; a cause is never
    grounded, since no figure shows one.

    Claims are written once and read by each kind. Evidence may be as large as
    the texts and is larger than its files look, so it is always shuffled and
    merged, never sent whole to the driver and all tasks; repeated evidence is
    harmless to a semi or anti join.
    """
    found = scratch.table(found, "claims")
    text = lambda df, **names: df.select(*[F.col(c).cast("string").alias(n) for n, c in names.items()]).hint("merge")
    of = lambda kind: found.filter(F.col("kind") == kind)
    fault = lambda df, name: df.select(key, "store_id", "sentence", F.lit(name).alias("fault"), "claim")
    numbers = of("number")
    counted = numbers.select(key, "store_id", "sentence").hint("merge")
    parts = [
        fault(numbers.join(trusted_numbers(trusted, forms_used(numbers)).hint("merge"), ["store_id", "unit", "claim"], "left_anti"), "ungrounded_number"),
        fault(of("reference").join(text(references, store_id="store_id", claim="ref"), ["store_id", "claim"], "left_anti"), "unknown_reference"),
        fault(of("metric").join(text(unavailable, store_id="store_id", claim="metric"), ["store_id", "claim"], "left_semi").join(counted, [key, "store_id", "sentence"], "left_semi"), "unavailable_metric"),
        fault(of("currency").join(text(currencies, store_id="store_id", claim="currency"), ["store_id", "claim"], "left_anti"), "foreign_currency"),
        fault(of("cause"), "causal_claim"),
    ]
    return reduce(DataFrame.unionByName, parts)


def is_causal(text: Column) -> Column:
    """Wording that claims a cause."""
    return F.regexp_like(text, F.lit(CAUSES))
