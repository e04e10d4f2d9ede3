"""Personal data replaced by keyed surrogates.

Entities are found by one pattern. Each distinct entity gets one surrogate in the whole corpus, so mentions still refer to the same thing: digits,
letters and hex digits change by a keyed stream, the format (lengths, separators, case, country code, key prefix, check sum of card
numbers, octet range, top-level domain) stays, and names keep their title, gender and script. A surrogate must differ from every
entity and from every other surrogate of its kind; those that clash are drawn again until none does, so distinct entities stay
distinct. From draw WIDEN on, names, e-mails, secrets and phone numbers get one more drawn letter or digit every fourth draw, so a small space
(short surnames) never runs out; all other kinds have at least 10^9 values by their format. Only DataFrame functions are used. Equal texts are looked up once; texts without an entity are passed on without a join.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.llm.shared import keep

# Patterns of the kinds, in the order of the alternation, and name lists by script and gender.
KINDS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[ ]?[=:][ ]?\"?)[A-Za-z0-9+/_.-]{6,}",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
    "local_phone": r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[3-6](?:[0-9]{12,15}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9])",
    "name": r"(?:\b(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? |(?<![А-Яа-яё])(?:Господин|Госпожа) )\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+",
}
TITLES = ["Mr", "Ms", "Herr ", "Herr.", "Frau", "Monsieur", "Madame", "Señor", "Господин", "Госпожа"]
FEMALE = "^(Mrs|Ms|Frau|Madame|Señora|Госпожа)"
NAMES = {
    ("latin", "f"): "Anna Clara Diane Elena Emma Julia Laura Lucia Maria Nora Paula Rosa Sarah Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Hugo Jonas Karl Louis Marco Martin Oscar Paul Peter Simon".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Ольга Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Иван Максим Олег Павел".split(),
}
STREAMS = [("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789")]
LETTERS = {"vowels": "aeiou", "consonants": "bcdfghjklmnpqrstvwxyz", "кириллица": "аеиоуыэюяё", "согласные": "бвгджзйклмнпрстфхцчшщ",
           "accented": "àáâäåèéêëìíîïòóôöùúûü"}
PATTERN = "|".join(KINDS.values())
MOST_DRAWS = 64
WIDEN = 8


def kind_of(value: Column) -> Column:
    """The first kind whose whole pattern the entity is."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items()])


def _stream(i: Column) -> Column:
    """A number below 65,536 for each place, from the entity's keyed digest (renewed every 28 places)."""
    block = F.sha2(F.concat_ws("|", "_digest", (F.floor(i / 28)).cast("string")), 512)
    return F.conv(F.substring(block, (i % 28 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _shift(char: Column, n: Column, letters: str) -> Column:
    """A letter of the list for a letter of the list."""
    return F.element_at(F.array(*[F.lit(c) for c in letters]), (F.pmod(F.instr(F.lit(letters), char) - 1 + n, F.lit(len(letters))) + 1).cast("int"))


def _mapped(text: Column, hexadecimal: bool = False) -> Column:
    """Every digit becomes a digit, every letter one of its case; hex digits stay hex digits; other characters stay."""
    lists = [letters[:6] if hexadecimal and name == "lower" else letters for name, letters in STREAMS]

    def one(char, i):
        n = _stream(i)
        return reduce(lambda other, letters: F.when(F.contains(F.lit(letters), char), _shift(char, n, letters)).otherwise(other), lists, char)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _spelled(name: Column) -> Column:
    """A name of the same length, script and case, vowel for vowel."""
    def one(char, i):
        n, low = _stream(i + 7), F.lower(char)
        new = reduce(lambda other, letters: F.when(F.contains(F.lit(letters), low), _shift(low, n, letters)).otherwise(other), LETTERS.values(), low)
        return F.when(char == low, new).otherwise(F.initcap(new))
    return F.array_join(F.transform(F.split(name, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, modulo 10."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10


def _card(value: Column) -> Column:
    """First digit and grouping stay, as does the check sum: a valid number gets a valid one."""
    drawn = F.concat(F.substring(value, 1, 1), F.substring(_mapped(value), F.lit(2), F.length(value)))
    as_digits = lambda c: F.transform(F.split(F.regexp_replace(c, "[^0-9]", ""), ""), lambda d: d.cast("int"))
    last = F.pmod(F.substring(drawn, -1, 1).cast("int") + _luhn(as_digits(value)) - _luhn(as_digits(drawn)), F.lit(10))
    return F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), last.cast("int").cast("string"))


def _name(value: Column) -> Column:
    parts = F.split(value, " ")
    script = F.when(value.rlike("[А-Яа-я]"), "cyrillic").otherwise("latin")
    gender = F.when(value.rlike(FEMALE), "f").otherwise("m")
    first = F.coalesce(*[F.when((script == s) & (gender == g), F.element_at(F.array(*[F.lit(x) for x in names]), (_stream(F.lit(3)) % len(names) + 1).cast("int")))
                         for (s, g), names in NAMES.items()])
    return F.concat_ws(" ", F.element_at(parts, 1), first, _spelled(F.element_at(parts, 3)))


def _more(n: int, letters: str) -> Column:
    """n drawn characters of a list."""
    return F.concat(F.lit(""), *[_shift(F.lit(letters[0]), _stream(F.lit(1000 + i)), letters) for i in range(n)])


def surrogate(kind: Column, value: Column, more: int = 0) -> Column:
    """The drawn surrogate of an entity whose keyed digest is in `_digest`; more: characters by which kinds of free length grow."""
    email = F.concat(_mapped(F.regexp_extract(value, r"^(.*)(\.[A-Za-z]+)$", 1)), F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1))
    label = r"^((?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?\"?)(.*)$"
    body = F.regexp_extract(value, label, 2)
    secret = F.concat(F.regexp_extract(value, label, 1), F.when(body.rlike("^[0-9a-f]+$"), _mapped(body, True)).otherwise(_mapped(body)))
    key = F.concat(F.substring(value, 1, 4), _mapped(F.substring(value, 5, 100)))
    iban = F.concat(F.substring(value, 1, 2), _mapped(F.substring(value, 3, 100)))
    phone = F.concat(F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])", 1), _mapped(F.regexp_replace(value, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])", "")))
    ip = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (_stream(i) % 254 + 1).cast("string")), ".")
    if more:
        low = STREAMS[0][1]
        email, phone = F.concat(_more(more, low), email), F.concat(phone, _more(more, STREAMS[2][1]))
        secret = F.concat(secret, F.when(body.rlike("^[0-9a-f]+$"), _more(more, low[:6])).otherwise(_more(more, low)))
    name = F.concat(_name(value), F.when(value.rlike("[А-Яа-я]"), _more(more, LETTERS["согласные"])).otherwise(_more(more, low))) if more else _name(value)
    return (F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "cloud_key", key).when(kind == "iban", iban)
            .when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", _card(value)).when(kind == "name", name).otherwise(_mapped(value)))


def table(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, value, distinct. Returns kind, value, surrogate: distinct ones for distinct entities, none equal to an entity."""
    def draw(rows, n):
        more = 0 if n < WIDEN else 1 + (n - WIDEN) // 4
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "value", F.lit(str(n))), 256)
        return rows.withColumn("_digest", digest).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), more)).select("kind", "value", "surrogate")
    entities = keep(entities, "entities")
    drawn = keep(draw(entities, 0), "surrogates")
    for n in range(1, MOST_DRAWS):
        # the least entity keeps a surrogate that several drew; earlier draws stay ahead of later ones as they are no longer redrawn
        shared = drawn.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("_m"), F.min("value").alias("_first"))
        taken = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("_real"))
        marked = drawn.join(shared.filter("_m > 1"), ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        marked = marked.select("kind", "value", "surrogate", (F.coalesce("_real", F.lit(False)) | (F.col("_m").isNotNull() & (F.col("value") != F.col("_first")))).alias("_bad"))
        marked = keep(marked, "surrogates")
        if marked.filter("_bad").isEmpty():
            return marked.drop("_bad")
        again = draw(marked.filter("_bad").select("kind", "value"), n)
        drawn = keep(marked.filter("NOT _bad").drop("_bad").union(again), "surrogates")
    raise ValueError("no distinct surrogates found; the space of some kind is too small")


def _may_hold(text: Column) -> Column:
    """False only where no pattern can match: most kinds need a digit or an @, a secret its sign, a cloud key its prefix, a name its title."""
    signs = [F.contains(text, F.lit(x)) for x in (*"=:", "AKIA", "ASIA", *TITLES)]
    return text.rlike("[0-9@]") | reduce(lambda a, b: a | b, signs)


def replaced(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """All columns of docs with text replaced, plus n_pii and pii_kinds (sorted). Null and empty texts stay as they are with 0; an empty
    table gives no rows; equal texts get equal results; a column named n_pii or pii_kinds is taken over by the new one; all other columns travel in
one struct, so that no name clashes."""
    names = [c for c in docs.columns if c.lower() not in ("n_pii", "pii_kinds")]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")
    may = F.coalesce(_may_hold(F.col("text")), F.lit(False))
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    texts = docs.filter(may).groupBy(F.md5("text").alias("_same")).agg(F.first("text").alias("_text")).withColumn("text", F.col("_text"))
    texts = keep(texts.select("_same", found.alias("_found")), "pii-texts").filter(F.size("_found") > 0)
    mentions = texts.select("_same", F.posexplode("_found").alias("_at", "value")).withColumn("kind", kind_of(F.col("value")))
    drawn = table(mentions.select("kind", "value").distinct(), key)
    maps = mentions.join(drawn, ["kind", "value"]).groupBy("_same").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "surrogate"))), lambda x: x["surrogate"]).alias("_new"), F.array_sort(F.collect_set("kind")).alias("_kinds"))
    # texts without an entity are told apart by the join alone, so the patterns run once to find and once to cut
    hit = docs.filter(may).withColumn("_same", F.md5("text")).join(maps, "_same", "left")
    parts = F.split("text", PATTERN, -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size("_new")), F.col("_new"), lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))
    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(new)
    none = F.array().cast("array<string>")
    hit = hit.select("_row", text.alias("text"), F.coalesce(F.size("_new"), F.lit(0)).cast("long").alias("n_pii"), F.coalesce("_kinds", none).alias("pii_kinds"))
    hit = hit.withColumn("n_pii", F.greatest("n_pii", F.lit(0).cast("long")))
    clean = docs.filter(~may).select("_row", "text", F.lit(0).cast("long").alias("n_pii"), none.alias("pii_kinds"))
    return hit.unionByName(clean).select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in names], "n_pii", "pii_kinds")
