"""Personal data replaced by surrogates. DataFrame functions only.

One regular expression finds the entities of a text: mail addresses, IPv4 addresses, payment cards, phone numbers, social
security numbers, IBANs, access keys, passwords and tokens, and names behind a title. A mention has a type and a canonical form
(case of mail addresses and spacing of numbers aside), and equal canonical forms are one entity in all documents.

An entity's surrogate is drawn by a keyed hash: every digit, letter and cased letter becomes another of its class
and script, so the format stays; octets stay octets; a card number that passes its check digit passes again; top-level
domains, IBAN countries and the fixed head of an access key stay. A given name becomes a name of the gender that its title tells and
of its script. Surrogates that coincide with each other, or with any real entity, are drawn again until none do: this
keeps different people different, and the same person the same (each mention then gets its own spacing and case back).
Where a format is so full of real entities that ``WIDE`` draws do not do, it widens: octets may then have any width (and after
as many draws more there is a fifth), and other values gain a letter or digit for every ``WIDE`` draws.

Entities are counted and checked as grouped and joined tables; the distinct ones are shuffled, never collected.

Defined results: null texts stay null; texts without entities are unchanged. Rows alike in doc_id and text are treated alike; rows
with a null doc_id are treated too. Columns of the input are kept; only the text changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import let, named, unused, written

# Patterns of the entity types, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "secret": r"(?i:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{8,128}+[\"']?",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}+",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Г-н|Г-жа)\.? \p{Lu}[\p{Ll}'-]{1,30}+(?: \p{Lu}[\p{Ll}'-]{1,30}+)?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Titles by gender; given names by gender and script.
_FEMALE = r"\A(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа)\b"
_GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Emma", "Helen", "Ines", "Julia", "Laura", "Lucia", "Maria", "Nora", "Paula", "Rosa", "Sara", "Sofia", "Vera"],
    ("m", "latin"): ["Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Viktor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Олег", "Павел"],
}
# letters and digits of a class, and what they may become
_CLASSES = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "áéíóúàèìòùäëïöüâêîôû", "ÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")
WIDE = 12


def mentions(text: Column) -> Column:
    return F.when(text.rlike(r"[0-9@=:]|\p{Lu}\p{Ll}*\.? \p{Lu}"), F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    return F.coalesce(*(F.when(mention.rlike(rf"\A(?:{p})\z"), k) for k, p in PATTERNS.items()), F.lit("other"))


def canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    value = F.regexp_extract(mention, r"[=:]\s{0,2}[\"']?([A-Za-z0-9+/_-]+)[\"']?\z", 1)
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "secret", value).otherwise(mention)


def _drawn(key: str, kind: Column, canon: Column, draw: Column, fixed: Column) -> Column:
    """``canon`` with every character replaced within its class, but where ``fixed`` (a column of its position) holds."""

    def one(c: Column, i: Column) -> Column:
        number = F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string"), F.floor(i / 12).cast("string")), 256), i % 12 * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return reduce(lambda other, group: F.when(F.instr(F.lit(group), c) > 0, F.substr(F.lit(group), number % len(group) + 1, F.lit(1))).otherwise(other), _CLASSES, c)

    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(fixed(i), c).otherwise(one(c, i))), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit scheme, modulo 10."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0), lambda a, x: a + x) % 10


def surrogate(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    number = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    none = lambda i: F.lit(False)
    tail = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    mail = _drawn(key, kind, canon, draw, lambda i: i >= tail)
    card = _drawn(key, kind, canon, draw, lambda i: i == 0)
    head = F.substr(card, F.lit(1), F.length(card) - 1)
    checked = F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string"))
    drawn = lambda i: F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), canon, draw.cast("string"), i.cast("string")), 256), F.lit(1), F.lit(6)), 16, 10).cast("int")
    from_, many = (lambda o: F.when(draw >= WIDE, 0).when(F.length(o) == 1, 0).when(F.length(o) == 2, 10).otherwise(100)), (lambda o: F.when(draw >= WIDE, 256).when(F.length(o) == 1, 10).when(F.length(o) == 2, 90).otherwise(156))
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: F.pmod(drawn(i), many(o)) + from_(o)), ".")
    words = F.split(canon, " ")
    given = F.lit(None).cast("string")
    for (gender, script), names in _GIVEN.items():
        fits = (canon.rlike(_FEMALE) if gender == "f" else ~canon.rlike(_FEMALE)) & (F.element_at(words, -1).rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~F.element_at(words, -1).rlike(r"\p{IsCyrillic}"))
        given = F.when(fits, F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))).otherwise(given)
    first = F.length(F.element_at(words, 1)) + F.when(F.size(words) > 2, F.length(F.element_at(words, 2)) + 1).otherwise(0)
    drawn_name = _drawn(key, kind, canon, draw, lambda i: i <= first)
    name = F.when(F.size(words) > 2, F.concat_ws(" ", F.element_at(words, 1), given, F.element_at(F.split(drawn_name, " "), -1))).otherwise(drawn_name)
    more = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), canon, draw.cast("string"), F.lit("wide")), 256), 1, F.floor(draw / WIDE).cast("int"))  # none before WIDE draws
    letters = lambda to: F.translate(more, "0123456789abcdef", to)
    digits = letters("0123456789012345")
    return (
        F.when(kind == "email", F.concat(letters("bcdfghjklmnpqrst"), mail))
        .when(kind == "card", F.concat(F.when(_luhn(canon) == 0, checked).otherwise(card), digits))
        .when(kind == "ip", F.concat(octets, F.when(draw >= 2 * WIDE, F.concat(F.lit("."), F.pmod(drawn(F.lit(99)), F.lit(256)).cast("string"))).otherwise("")))
        .when(kind == "key", F.concat(_drawn(key, kind, canon, draw, lambda i: i < 4), letters("BCDFGHJKLMNPQRST")))
        .when(kind == "iban", F.concat(_drawn(key, kind, canon, draw, lambda i: i < 2), digits))
        .when(kind == "name", F.concat(name, F.when(F.element_at(words, -1).rlike(r"\p{IsCyrillic}"), letters("бвгджзклмнпрстфх")).otherwise(letters("bcdfghjklmnpqrst"))))
        .otherwise(F.concat(_drawn(key, kind, canon, draw, none), digits))
    )


def rendered(kind: Column, mention: Column, canon: Column, value: Column) -> Column:
    """A canonical surrogate in the spacing and case of a mention."""
    chars = F.split(mention, "")
    # the k-th digit (of an IBAN: letter or digit) of the mention is the k-th of the surrogate
    counts = lambda c: c.rlike("[A-Z0-9]")
    spaced = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda a, c: F.when(counts(c), F.struct(F.concat(a["out"], F.substr(value, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: F.concat(a["out"], F.substr(value, a["k"] + 1)),
    )
    longer = F.length(value) - F.length(mention)
    cased = F.concat(F.substr(value, F.lit(1), longer), F.array_join(F.transform(chars, lambda c, i: let(F.substr(value, longer + i + 1, F.lit(1)), lambda v: F.when(c.rlike("[A-Z]"), F.upper(v)).otherwise(v))), ""))
    # a secret is the last of its mention but for a quote; the word before it may be the same
    quote = F.regexp_extract(mention, "[\"']?\\z", 0)
    secret = F.concat(F.substr(mention, F.lit(1), F.length(mention) - F.length(canon) - F.length(quote)), value, quote)
    return F.when(kind == "email", cased).when(kind.isin("card", "phone", "ssn", "iban"), spaced).when(kind == "secret", secret).otherwise(value)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, value) for distinct (kind, canon): no two values alike within a kind, and none a real entity.

    Of coinciding draws the first by canon stands, and what stands is never touched again: a further round draws only for those that lost, few as they
    are, and holds them against the real entities and all values that stand. Formats widen with the number of draws, so some round is the last."""
    real = written(entities.select("kind", "canon").distinct())
    names, stand, rows = real.select(F.col("kind").alias("rk"), F.col("canon").alias("rc")), [], real.withColumn("draw", F.lit(0))
    while True:
        drawn = rows.withColumn("value", surrogate(key, F.col("kind"), F.col("canon"), F.col("draw")))
        judged = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "value").orderBy("canon")))
        used = reduce(DataFrame.unionByName, [names, *(s.select(F.col("kind").alias("rk"), F.col("value").alias("rc")) for s in stand)]).distinct() if stand else names
        judged = judged.join(used, (F.col("kind") == F.col("rk")) & (F.col("value") == F.col("rc")), "left")
        judged = written(judged.select("kind", "canon", "draw", "value", ((F.col("rank") > 1) | F.col("rc").isNotNull()).alias("lost")))
        stand.append(judged.where("not lost").select("kind", "canon", "value"))
        if len(stand) > 16:
            stand = [written(reduce(DataFrame.unionByName, stand))]
        if judged.where("lost").isEmpty():
            return reduce(DataFrame.unionByName, stand)
        rows = judged.where("lost").select("kind", "canon", (F.col("draw") + 1).alias("draw"))


def replace_pii(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """``docs`` with surrogates in its text; with ``counts`` also ``n_entities``, the mentions replaced."""
    text = F.col("text").cast("string")
    version = F.xxhash64(text)
    found = docs.where("text is not null").select("doc_id", version.alias("version"), F.posexplode(mentions(text)).alias("at", "mention"))
    found = found.withColumn("kind", kind_of(F.col("mention"))).withColumn("canon", canonical(F.col("kind"), F.col("mention")))
    found = written(found)
    value = found.join(surrogates(found, key), ["kind", "canon"]).select("doc_id", "version", "at", rendered(F.col("kind"), F.col("mention"), F.col("canon"), F.col("value")).alias("new"))
    d, v, x = (unused(docs, c) for c in ("d", "v", "x"))
    by_doc = value.groupBy(F.col("doc_id").alias(d), F.col("version").alias(v)).agg(F.sort_array(F.collect_set(F.struct("at", "new"))).alias(x))
    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col(d)) & (version == F.col(v)), "left")
    gaps = F.split(text, _ANY, -1)
    filled = F.array_join(F.zip_with(gaps, x, lambda g, n: F.concat(g, F.coalesce(n["new"], F.lit("")))), "")
    extra = [F.when(F.col(v).isNull(), 0).otherwise(F.size(x)).cast("bigint").alias("n_entities")] if counts else []
    return joined.select(*(F.when(F.col(v).isNull(), text).otherwise(filled).alias(c) if c == "text" else named(c) for c in docs.columns if not (counts and c == "n_entities")), *extra)


def op7_pii(docs: DataFrame) -> DataFrame:
    return replace_pii(docs.select("doc_id", "text"), key="granary", counts=True)
