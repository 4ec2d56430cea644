"""Surrogates for personal data, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.common import free_names, key_of, stage, text_of

# Patterns in order of preference.  Each begins where no such character stands before it
# and has bounded or possessive repeats, so a long run of one character is passed in linear time.
# A secret has a letter or digit; a line of punctuation is none.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?[\"']?)(?=[+/_.~-]*+[A-Za-z0-9])[A-Za-z0-9+/_.~-]{8,}+"),
    ("accesskey", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    (
        "person",
        r"(?<![\p{L}])(?:Mrs|Mr|Ms|Miss|Mister|Herr|Frau|Madame|Mme|Monsieur|Señora|Señor|Sra|Sr|Господин|Госпожа)\.?"
        r"[ ]\p{Lu}[\p{L}'-]{1,30}(?:[ ]\p{Lu}[\p{L}'-]{1,30})?",
    ),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
PREFIX = r"^(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?[\"']?)"
TITLE = r"^(\p{L}+\.?[ ])"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)"

GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Greta", "Ines", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia"),
    ("m", "latin"): ("Adam", "Bruno", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Peter"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Денис", "Иван", "Кирилл", "Михаил", "Олег", "Павел", "Юрий"),
}
SYLLABLES = {
    "latin": tuple(c + v for c in "bdfgklmnprstvz" for v in "aeio"),
    "cyrillic": tuple(c + v for c in "бвгдклмнпрст" for v in "аеио"),
}

#: Rounds of new draws for surrogates that collide; each round leaves only what collided again.
#: What is left after them gets a longer code that is free for certain.
MAX_ROUNDS = 40


def _byte(digest: Column, i: Column | int) -> Column:
    """Number 0..255 from a place of a hexadecimal digest; places past the end begin anew."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(digest, i * 2 % 62 + 1, F.lit(2)), 16, 10).cast("int")


def poured(value: Column, digest: Column, hexadecimal: Column | bool = False) -> Column:
    """Characters of the same kind for each letter and digit; all others stay."""
    hexadecimal = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal

    def one(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        letters = F.when(hexadecimal, 6).otherwise(26)
        return (
            F.when(c.between("0", "9"), F.char(F.lit(48) + n % 10))
            .when(c.between("a", "z"), F.char(F.lit(97) + n % letters))
            .when(c.between("A", "Z"), F.char(F.lit(65) + n % letters))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def filled(value: Column, code: Column, kind: str = "[0-9]") -> Column:
    """``value`` with its characters of a kind replaced in turn by those of ``code``."""
    return F.array_join(
        F.zip_with(F.split(value, kind, -1), F.split(code, ""), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )


def luhn_digit(digits: Column) -> Column:
    """The check digit behind ``digits``."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string")


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def gender_of(value: Column) -> Column:
    return F.when(value.rlike(FEMALE), "f").otherwise("m")


def script_of(value: Column) -> Column:
    return F.when(F.regexp_replace(value, TITLE, "").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity share, whatever their format."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "secret", F.regexp_replace(value, PREFIX, ""))
        .when(kind == "person", F.concat_ws("|", gender_of(value), script_of(value), F.lower(F.regexp_replace(value, TITLE, ""))))
        .otherwise(value)
    )


def _person(canon: Column, digest: Column) -> Column:
    """As many names as the entity has; the last is a family name of three syllables."""
    parts = F.split(canon, r"\|")
    two = F.element_at(parts, 3).contains(" ")
    out = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        # two bytes for each syllable and a fourth one, so that many families differ
        family = F.concat(*[F.element_at(syllables, (_byte(digest, 2 * i + 1) % len(SYLLABLES[script])) + 1) for i in range(4)])
        given = F.element_at(F.array(*map(F.lit, names)), (_byte(digest, 0) % len(names)) + 1)
        name = F.when(two, F.concat(given, F.lit(" "), F.initcap(family))).otherwise(F.initcap(family))
        out = F.when((parts[0] == gender) & (parts[1] == script), name).otherwise(out)
    return out


def codes(kind: Column, canon: Column, secret: str, attempt: Column) -> Column:
    """The surrogate's canonical form, drawn with the secret key."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, canon, attempt.cast("string")), 256)
    site = F.sha2(F.concat_ws("\u0001", F.lit(secret), F.lit("site"), F.substring_index(canon, "@", -1)), 256)
    host = F.substring_index(canon, "@", -1)
    first = F.substring_index(host, ".", 1)
    email = F.concat(
        poured(F.substring_index(canon, "@", 1), digest), F.lit("@"), poured(first, site),
        F.substr(host, F.length(first) + 1),
    )
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), poured(F.substr(canon, F.lit(2), F.length(canon) - 2), digest))
    return (
        F.when(kind == "email", email)
        .when(kind == "card", F.concat(body, luhn_digit(body)))
        .when(kind == "ip", F.concat_ws(".", F.lit("10"), *[_byte(digest, i).cast("string") for i in range(3)]))
        .when(kind == "accesskey", F.concat(F.lit("AKIA"), poured(F.substr(canon, F.lit(5)), digest)))
        .when(kind == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), poured(F.substr(canon, F.lit(3)), digest)))
        .when(kind == "person", _person(canon, digest))
        .otherwise(poured(canon, digest, canon.rlike("^[0-9a-f]+$") | canon.rlike("^[0-9A-F]+$")))
    )


def rendered(kind: Column, value: Column, code: Column) -> Column:
    """The surrogate in the format of this mention."""
    cased = F.array_join(
        F.zip_with(
            F.split(value, ""), F.split(code, ""),
            lambda v, c: F.when(v.between("A", "Z"), F.upper(c)).otherwise(c),
        ), "",
    )
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    country = F.substr(F.regexp_replace(value, "[^0-9]", ""), F.lit(1), F.greatest(F.lit(0), digits - 10))
    return (
        F.when(kind == "email", cased)
        # a widened code has more digits than the mention's format has room for
        .when(kind.isin("phone", "card", "ssn", "iban") & (F.length(code) > 34), code)
        .when(kind == "phone", filled(value, F.concat(country, code)))
        .when(kind.isin("card", "ssn"), filled(value, code))
        .when(kind == "iban", filled(value, code, "[A-Z0-9]"))
        .when(kind == "secret", F.concat(F.regexp_extract(value, PREFIX, 0), code))
        .when(kind == "person", F.concat(F.regexp_extract(value, TITLE, 1), code))
        .otherwise(code)
    )


def surrogate_codes(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, code) of distinct (kind, canon): codes that differ from each other and from all entities.

    Every entity draws a code.  Where several drew the same, the smallest
    keeps it; where a code is an entity or was given before, nobody does.  The
    rest draws anew; what is left after ``MAX_ROUNDS`` draws, because its
    format has no or hardly any free code, gets a widened one.
    """
    entities = stage(entities.select("kind", "canon").distinct())
    given: DataFrame | None = None
    left = entities
    taken = entities.select("kind", F.col("canon").alias("code"))
    for attempt in range(MAX_ROUNDS):
        drawn = left.withColumn("code", codes(F.col("kind"), F.col("canon"), secret, F.lit(attempt)))
        rank = F.row_number().over(Window.partitionBy("kind", "code").orderBy("canon"))
        judged = stage(
            drawn.withColumn("rank", rank)
            .join(taken.withColumn("taken", F.lit(True)), ["kind", "code"], "left")
            .select("kind", "canon", "code", ((F.col("rank") == 1) & F.col("taken").isNull()).alias("fine"))
        )
        fine = judged.where("fine").drop("fine")
        given = fine if given is None else given.unionByName(fine)
        left = judged.where("not fine").select("kind", "canon")
        if left.isEmpty():
            return given
        taken = entities.select("kind", F.col("canon").alias("code")).unionByName(given.select("kind", "code"))
    return given.unionByName(left.withColumn("code", _widened(F.col("kind"), F.col("canon"), secret)))


def _widened(kind: Column, canon: Column, secret: str) -> Column:
    """A code for an entity whose format is full: 32 keyed digits (letters in names) behind the last draw, in an email before the @."""
    code = codes(kind, canon, secret, F.lit(MAX_ROUNDS))
    digits = F.translate(
        F.substr(F.sha2(F.concat_ws("\u0001", F.lit(secret), F.lit("wide"), kind, canon), 256), F.lit(1), F.lit(32)), "abcdef", "012345"
    )
    script = F.split(canon, r"\|")[1]
    letters = F.when(script == "cyrillic", F.translate(digits, "0123456789", "абвгдезикл")).otherwise(
        F.translate(digits, "0123456789", "abcdefghij")
    )
    return (
        F.when(kind == "email", F.concat(F.substring_index(code, "@", 1), digits, F.lit("@"), F.substring_index(code, "@", -1)))
        .when(kind == "person", F.concat(code, letters))
        .otherwise(F.concat(code, digits))
    )


def replace_entities(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and an added column ``entities``.

    ``entities`` lists (kind, value, surrogate) in the order of the text; it is
    empty where nothing was found.  One entity has one surrogate in all
    documents and in all its formats, of the same type, length, gender and
    script, and different entities have different ones (longer where a format
    has no free code left); only who holds ``secret`` can draw them again.  Null texts stay null.  Rows that repeat
    come back as often as given, and all columns of ``docs`` are kept; only
    ``text`` changes.  An empty table gives an empty result.
    """
    marks = free_names(docs, "key", "h1", "h2")
    found_name, told = free_names(docs, "found", "entities")
    hashed = [key_of(), F.xxhash64(text_of()), F.xxhash64(F.lit(1), text_of())]
    marked = docs.select(*docs.columns, *[h.alias(m) for h, m in zip(hashed, marks)])
    mentions = stage(
        docs.select(
            *[h.alias(m) for h, m in zip(hashed, marks)],
            F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("place", "value"),
        )
        .withColumn("kind", kind_of(F.col("value")))
        .withColumn("canon", canonical(F.col("kind"), F.col("value")))
        .distinct()
    )
    given = stage(surrogate_codes(mentions, secret))
    replaced = (
        mentions.join(given, ["kind", "canon"])
        .select(*marks, "place", "kind", "value", rendered(F.col("kind"), F.col("value"), F.col("code")).alias("surrogate"))
        .groupBy(*marks)
        .agg(F.array_sort(F.collect_list(F.struct("place", "kind", "value", "surrogate"))).alias(found_name))
    )
    between = F.split("text", ANY, -1)
    text = F.array_join(
        F.zip_with(between, F.col(found_name), lambda a, b: F.concat(a, F.coalesce(b["surrogate"], F.lit("")))), ""
    )
    entities = F.transform(
        F.coalesce(F.col(found_name), F.array().cast("array<struct<place:int,kind:string,value:string,surrogate:string>>")),
        lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), e["surrogate"].alias("surrogate")),
    )
    return (
        marked.join(replaced, marks, "left")
        .withColumn("text", F.when(F.col(found_name).isNotNull(), text).otherwise(F.col("text")))
        .select(*docs.columns, entities.alias(told))
    )
