"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns. Each distinct (type, value) of the corpus gets one replacement, derived with a secret key and
consistent with its type: letters stay letters of the same script and case, digits stay digits, separators, prefixes and
check digits hold, and a titled person's name is replaced by a name of the title's gender in the same script. Replacements
that meet each other or a value of the corpus are derived anew with a higher attempt number until all are distinct, so
equal values stay equal (coreference) and different ones different.

Distinct values are aggregated before they move, so a value that fills a third of the corpus is one row. Texts without
an entity are passed through in place; only texts with one are joined with their replacements.

Defined results: null text stays null, empty text empty; texts are processed whole; repeated rows are treated alike;
further columns are kept; an empty table gives no rows; values that outnumber their format get longer surrogates. Persons
are found behind the titles below only, and a secret behind the words of ``_SECRET`` or by its form; given names come from
short lists, so different persons may share one, while family names stay distinct. A secret without quotes ends at white space, so of one that has spaces
only its first word is replaced; bare numbers of a phone need hyphens or dots (555-123-4567), for others could be amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import durable, free_name, table

# Titles by gender and script, and names that replace others.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "госпожа", "г-жа")
NAMES = {
    "male_latin": ("Adrian", "Bruno", "Carlo", "David", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Kilian", "Lucas"),
    "female_latin": ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura"),
    "male_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Лев", "Максим", "Олег", "Павел"),
    "female_cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга"),
}
ALPHABETS = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[à-öø-ÿ]": "àáâãäåæçèéêëìíîïñòóôõöøùúûü", "[À-ÖØ-Þ]": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ", "[а-я]": "абвгдежзийклмнопрстуфхцчшщыэюя", "[А-Я]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}

# Further alphabets by rule: the letters of a block of characters, by case where the block has cases.
for _first, _last in ((0x100, 0x24F), (0x1E00, 0x1EFF), (0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x4EFF)):
    _letters = [c for c in map(chr, range(_first, _last + 1)) if c.isalpha() and not any(c in a for a in ALPHABETS.values())]
    for _some in ([c for c in _letters if c.islower()], [c for c in _letters if c.isupper()], [c for c in _letters if not c.islower() and not c.isupper()]):
        if _some:
            ALPHABETS["[\u4e00-\u9fff]" if _first == 0x4E00 else "[" + "".join(_some) + "]"] = "".join(_some)

# Secrets with a form of their own, and the words that name the others.
_HEX = r"\b(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}\b"
_CLOUD = r"\bAKIA[0-9A-Z]{16}\b"
_SECRET = r"(?i:\b(?:password|passwd|secret|token)[\"']?[ \t]*+[=:][ \t]*+)"
_NAME = r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}_.+-])[\p{L}\p{M}\p{N}_.+-]++@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.\p{L}{2,}",
    # A key of a known form is one entity with and without a word before it.
    "password": rf"{_SECRET}(?![\"']?(?:{_CLOUD}|{_HEX})[.!?)]*(?:[\"'\s,;]|$))(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[\"']?[^\s\"',;]+)",
    "cloud_key": _CLOUD,
    "hex_key": _HEX,
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b|\b[A-Z]{2}\d{2}(?=(?: [A-Z0-9]{4}){0,5} \d{4} \d{4})(?: [A-Z0-9]{4}){2,7}(?: \d[A-Z0-9]{0,2})?(?!\w)",
    "card": r"(?<![\w+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d)",
    "person": rf"(?<!\w)(?:{'|'.join((*MALE_TITLES, *FEMALE_TITLES))})\.? {_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Every pattern needs one of these, so texts without them need no closer look.
HINT = rf"[0-9@=]|AKIA|{_SECRET}|(?:{'|'.join((*MALE_TITLES, *FEMALE_TITLES))})\.? "


def kind_of(value: Column) -> Column:
    """The type of an entity, in the order of the patterns."""
    kind = F.lit("person")
    for name, pattern in reversed(list(PATTERNS.items())):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def draw(seed: Column, i: Column | int, n: int) -> Column:
    """A number below ``n`` that follows from the keyed seed and a place."""
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def alike(value: Column, seed: Column) -> Column:
    """The value with each letter and digit replaced by one of its own script and case."""

    def char(c: Column, i: Column) -> Column:
        out = c
        for pattern, alphabet in ALPHABETS.items():
            out = F.when(c.rlike(pattern), F.substring(F.lit(alphabet), draw(seed, i, len(alphabet)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), char), "")


def luhn(digits: Column) -> Column:
    """The weighted digit sum whose multiples of ten are valid card numbers."""
    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), lambda a, d: F.struct((a["s"] + luhn_part(d, a["i"])).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])


def luhn_part(d: Column, i: Column) -> Column:
    n = d.try_cast("int")
    twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
    return F.coalesce(F.when(i % 2 == 1, twice).otherwise(n), F.lit(0))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a value, for an attempt number."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 256)
    same = alike(value, seed)
    local = F.substring_index(value, "@", 1)
    # A format whose values run out gets longer ones, the longer the more attempts fail.
    more = F.call_function("substr", seed, F.lit(1), F.least(F.lit(64), F.lit(5) + F.floor(attempt / 6).cast("int")))
    letters = F.when(attempt > 5, F.translate(more, "0123456789", "ghijklmnop")).otherwise("")
    mail = F.concat(alike(local, seed), letters, F.lit("@mail"), draw(seed, -1, 1000).cast("string"), F.lit(".example."), F.regexp_extract(value, r"\.(\p{L}+)$", 1))
    ip = F.concat_ws(".", (draw(seed, -1, 223) + 1).cast("string"), *[draw(seed, -k, 256).cast("string") for k in (2, 3, 4)])
    digits, own = F.regexp_replace(value, "[^0-9]", ""), F.concat(F.substring(value, 1, 1), F.substring(same, 2, 64))
    own_digits = F.regexp_replace(own, "[^0-9]", "")
    stem = F.call_function("substr", own, F.lit(1), F.length(own) - 1)
    zero = F.call_function("substr", own_digits, F.lit(1), F.length(own_digits) - 1)
    check = F.pmod(F.lit(10) - F.pmod(luhn(F.concat(zero, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(luhn(digits) % 10 == 0, F.concat(stem, check)).otherwise(own)
    head = lambda pattern: F.regexp_extract(value, pattern, 1)
    rest = lambda pattern: alike(F.regexp_replace(value, pattern, ""), seed)
    hex_digit = lambda c, new: F.when((value == F.upper(value)) | c.rlike("[A-F]"), F.upper(new)).otherwise(new)
    hexes = F.array_join(F.transform(F.split(value, ""), lambda c, i: hex_digit(c, F.substring(F.lit("0123456789abcdef"), draw(seed, i, 16) + 1, F.lit(1)))), "")
    # A secret of a few letters, or of signs only, runs out of others like it and gets a longer one.
    secret = rest(f"^{_SECRET}")
    longer = F.when((attempt > 5) | (secret == F.regexp_replace(value, f"^{_SECRET}", "")), F.substring(seed, 1, 8)).otherwise("")
    quote = F.regexp_extract(secret, "([\"']?)$", 1)
    password = F.concat(head(f"^({_SECRET})"), F.regexp_replace(secret, "[\"']$", ""), longer, quote)
    title = F.regexp_extract(value, rf"^((?:{'|'.join((*MALE_TITLES, *FEMALE_TITLES))})\.? )", 1)
    male = F.regexp_replace(F.trim(title), r"\.$", "").isin(*MALE_TITLES)
    cyrillic = F.call_function("substr", value, F.length(title) + 1).rlike(r"\p{IsCyrillic}")
    pick = lambda name: F.get(F.array(*map(F.lit, NAMES[name])), draw(seed, -1, 12))
    given = F.when(male & cyrillic, pick("male_cyrillic")).when(cyrillic, pick("female_cyrillic")).when(male, pick("male_latin")).otherwise(pick("female_latin"))
    name = F.call_function("substr", value, F.length(title) + 1)
    two = name.contains(" ")
    # The family name alone decides on its replacement, so a person is the same with and without the given name.
    own_family = F.when(two, F.substring_index(name, " ", -1)).otherwise(name)
    family = alike(own_family, F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("family"), own_family, attempt.cast("string")), 256))
    person = F.concat(title, F.when(two, F.concat(given, F.lit(" "), family)).otherwise(family))
    digits_more = F.when(attempt > 20, F.concat(F.lit("-"), draw(seed, -9, 1_000_000_000).cast("string"))).otherwise("")
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.concat(ip, digits_more))
        .when(kind == "card", F.concat(card, digits_more))
        .when(kind == "hex_key", hexes)
        .when(kind == "cloud_key", F.concat(F.lit("AKIA"), rest("^AKIA")))
        .when(kind == "password", password)
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substring(same, 3, 64), digits_more))
        .when(kind == "phone", F.concat(head(r"^(\+\d{1,3}(?=\D)|)"), rest(r"^\+\d{1,3}(?=\D)"), digits_more))
        .when(kind == "person", F.concat(person, letters))
        .otherwise(F.concat(same, digits_more))
    )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate), all surrogates distinct and none a value. ``values``: distinct (kind, value)."""
    made = lambda df: df.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
    given = durable(made(values.withColumn("attempt", F.lit(0))))
    originals = values.select(F.col("value").alias("surrogate")).distinct()
    while True:
        # Of the values that share a surrogate the smallest keeps it, unless the surrogate is itself a value.
        owner = given.groupBy("surrogate").agg(F.min(F.concat_ws("\u0001", "kind", "value")).alias("owner"), F.count("*").alias("n"))
        real = owner.join(originals, "surrogate", "left_semi").select("surrogate", F.lit("").alias("owner"))
        clash = durable(owner.filter("n > 1").join(real.select("surrogate"), "surrogate", "left_anti").select("surrogate", "owner").unionByName(real))
        if clash.isEmpty():
            return given.drop("attempt")
        again = given.join(clash, "surrogate", "left").withColumn("move", F.col("owner").isNotNull() & (F.concat_ws("\u0001", "kind", "value") != F.col("owner")))
        given = durable(made(again.select("kind", "value", (F.col("attempt") + F.col("move").cast("int")).alias("attempt"))))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and their number (``n_entities``)."""
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    name = free_name(docs, "n_entities")
    entities = free_name(docs, "entities")
    marked = docs.withColumn(entities, found)
    plain = marked.filter(F.size(entities) == 0).drop(entities).withColumn(name, F.lit(0))
    some = marked.filter(F.size(entities) > 0)
    rows = some.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), F.posexplode(entities).alias("i", "value")).withColumn("kind", kind_of(F.col("value")))
    rows = durable(rows)
    made = surrogates(rows.select("kind", "value").distinct(), key)
    by_doc = rows.join(made, ["kind", "value"]).groupBy("d", "th").agg(F.array_sort(F.collect_set(F.struct("i", "surrogate"))).alias("new"))
    th, parts = free_name(docs, "th"), F.split("text", ANY)
    joined = some.drop(entities).withColumn(th, F.xxhash64("text")).alias("doc").join(by_doc.alias("by"), F.col("doc.doc_id").eqNullSafe(F.col("by.d")) & (F.col(f"doc.{th}") == F.col("by.th")))
    text = F.concat_ws("", F.zip_with(parts, "by.new", lambda gap, new: F.concat(gap, F.coalesce(new["surrogate"], F.lit("")))))
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    return plain.unionByName(joined.select(*columns, F.size("by.new").alias(name)))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return replace_entities(table(spark, sf_dir, "documents"), key="sievework").select("doc_id", "text", "n_entities")
