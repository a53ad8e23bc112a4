"""Personal data and secrets replaced by surrogates, as Spark expressions only.

Entities are found by one pattern: e-mail addresses, passwords and tokens after
their name, access keys, IPv4 addresses, telephone, social security and card
numbers (cards with a right check digit only), and names after a title. A text
is cut at its entities and put together again with surrogates, so that nothing
else in it changes and no surrogate is looked at twice.

A surrogate depends on a secret key, the kind and the canonical value (letters
of addresses in lower case, digits of numbers), so the same entity has the same
surrogate in all documents, whatever its punctuation. It keeps the kind's form:
lengths, separators, letter case, hexadecimal digits, valid octets and check
digits, country codes; names follow the title's gender and the script.

Collisions are checked over all documents: where two values of a kind got one
surrogate, or a surrogate is itself a value, all but the smallest value take
their next surrogate, until none collide. Those choices are few and go to the
documents that hold such a value. A value that still collides after `MOST_TRIES`
of its own form, since that form has too few values, moves on to a longer form
(32 characters more, or an IPv6 address), of which there are always enough. A
secret without letters and digits (a mask, a line of signs) becomes 32 characters
at once.

Defined cases: a null text stays null, an empty one empty; a null doc_id and
repeated rows are treated like any row; all other columns pass unchanged; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import by_position, stored

KEY = "change this key for every corpus"
# Surrogates of a value's own form; later ones have LONGER characters more.
MOST_TRIES = 12
LONGER = 32
BROADCAST_ROWS = 10_000

# Titles by gender, and parts of names by gender and script.
MALE = "Mr|Mister|Herr|Herrn|Señor|Sr|Monsieur|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Señorita|Srta|Madame|Mme|Mlle|Госпожа"
OTHER = "Dr|Prof|Mx"
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oskar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Инна", "Мария", "Нина"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gor", "hal", "ke", "lin", "mar", "no", "per", "ran", "sol", "tem", "vik", "wes", "zan"],
    "cyrillic": ["ба", "ден", "фи", "гор", "хал", "ке", "лин", "мар", "но", "пер", "ран", "сол", "тем", "вик", "вес", "зан"],
}

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,256}"
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\d.])\d{13,19}(?!\d)"
NAME = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{OTHER})\.? \p{{Lu}}[\p{{Ll}}'-]{{1,40}}(?: \p{{Lu}}[\p{{Ll}}'-]{{1,40}})?(?!\p{{L}})"
ANY = "|".join([EMAIL, SECRET, ACCESS, IP, PHONE, SOCIAL, CARD, NAME])
# A cheap test that every text with an entity passes.
HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{{0,3}}[=:]|(?<!\p{{L}})(?:{MALE}|{FEMALE}|{OTHER})\.? \p{{Lu}}"
TITLE = r"^\p{L}+\.? "
BEFORE_SECRET = r"^(?i:[a-z_-]+)\s*[=:]\s*[\"']?"


def _kind(raw: Column) -> Column:
    def whole(pattern: str) -> Column:
        return raw.rlike(f"^(?:{pattern})$")

    return (
        F.when(raw.rlike(BEFORE_SECRET), F.lit("secret"))
        .when(F.contains(raw, F.lit("@")), F.lit("email"))
        .when(whole(ACCESS), F.lit("access"))
        .when(whole(IP), F.lit("ip"))
        .when(whole(SOCIAL), F.lit("social"))
        .when(whole(CARD), F.when(_check_digit(raw), F.lit("card")))
        .when(whole(PHONE), F.lit("phone"))
        .otherwise(F.lit("name"))
    )


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of digits, every second doubled, from the right; `doubled` is 0 if the last one is."""
    own = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(own, value), F.lit(0), lambda a, x: a + x)


def _check_digit(raw: Column) -> Column:
    return _luhn(_digits(raw), 1) % 10 == 0


def _canonical(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("phone", "social", "card"), _digits(raw))
        .when(kind == "secret", F.regexp_replace(raw, BEFORE_SECRET, ""))
        .when(kind == "name", F.regexp_replace(raw, TITLE, ""))
        .otherwise(raw)
    )


def _entities(text: Column) -> Column:
    """Structs (raw, kind, canon) of the pattern's matches, in order; kind is null where a check fails."""
    raws = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(raws, lambda r: F.struct(r.alias("raw"), _kind(r).alias("kind")))
    return F.transform(
        kinds, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"), _canonical(e["kind"], e["raw"]).alias("canon"))
    )


def _byte(code: Column, place: Column) -> Column:
    """A number from 0 to 255 of a hexadecimal code of 128 digits."""
    return F.conv(F.substr(code, 2 * (place % 64) + 1, F.lit(2)), 16, 10).cast("int")


def _poured(raw: Column, code: Column, hexadecimal: Column, shift: int = 0) -> Column:
    """The value with each letter and digit replaced by one of its class; the place among those decides, not punctuation.

    Cyrillic letters stay Cyrillic, those of other scripts become Latin ones.
    """
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    small, large = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
    zero = F.struct(F.lit("").alias("out"), F.lit(shift).alias("n"))

    def other(c: Column, own: Column) -> Column:
        return (
            F.when(c.rlike(r"\p{Nd}"), F.substr(F.lit(digit), own % 10 + 1, F.lit(1)))
            .when(c.rlike(r"^(?=\p{IsCyrillic})\p{Lu}"), F.substr(F.lit(large), own % 32 + 1, F.lit(1)))
            .when(c.rlike(r"^(?=\p{IsCyrillic})\p{L}"), F.substr(F.lit(small), own % 32 + 1, F.lit(1)))
            .when(c.rlike(r"\p{Lu}"), F.substr(F.lit(upper), own % 26 + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substr(F.lit(lower), own % 26 + 1, F.lit(1)))
        )

    def pour(a: Column, c: Column) -> Column:
        own = _byte(code, a["n"]) + F.floor(a["n"] / 64).cast("int") * 7
        new = (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), own % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), F.substr(F.lit(digit), own % 10 + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substr(F.lit(lower), own % 26 + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substr(F.lit(upper), own % 26 + 1, F.lit(1)))
            .when(c.rlike(r"[^\x00-\x7F]"), other(c, own))
        )
        return F.struct(F.concat(a["out"], F.coalesce(new, c)).alias("out"), F.when(new.isNull(), a["n"]).otherwise(a["n"] + 1).alias("n"))

    return F.aggregate(F.filter(F.split(raw, ""), lambda c: c != ""), zero, pour)["out"]


def _tail(code: Column, alphabet: str = "0123456789abcdef") -> Column:
    """`LONGER` characters of 10 at least, for the longer forms."""
    return F.translate(F.substr(code, F.lit(129 - LONGER), F.lit(LONGER)), "0123456789abcdef", alphabet)


def _pick(choices: list[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, choices)), place % len(choices))


def _name(raw: Column, code: Column, longer: Column) -> Column:
    title = F.regexp_extract(raw, TITLE, 0)
    full = F.size(F.split(raw, " ")) > 2
    gender = F.when(raw.rlike(f"^(?:{MALE})\\b"), "m").when(raw.rlike(f"^(?:{FEMALE})\\b"), "f").otherwise(
        F.when(_byte(code, F.lit(9)) % 2 == 0, "m").otherwise("f")
    )

    def built(script: str) -> Column:
        given = F.when(gender == "m", _pick(GIVEN["m", script], _byte(code, F.lit(0)))).otherwise(_pick(GIVEN["f", script], _byte(code, F.lit(0))))
        family = F.initcap(F.concat(*[_pick(SYLLABLES[script], _byte(code, F.lit(i))) for i in range(1, 6)]))
        second = F.initcap(_tail(code, "aeiourstlnmdkbgv" if script == "latin" else "аеиоурстлнмдкбгв"))
        family = F.concat(family, F.when(longer, F.concat(F.lit("-"), second)).otherwise(F.lit("")))
        return F.concat(title, F.when(full, F.concat(given, F.lit(" "))).otherwise(F.lit("")), family)

    return F.when(raw.rlike(r"\p{IsCyrillic}"), built("cyrillic")).otherwise(built("latin"))


def _code(key: str, kind: Column, canon: Column, tries: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, tries.cast("string")), 512)


def _surrogate(key: str, kind: Column, raw: Column, canon: Column, code: Column, tries: Column) -> Column:
    """What stands for an entity; a kind of null leaves it as it is."""
    no, longer = F.lit(False), tries >= MOST_TRIES

    def more(tail: Column) -> Column:
        return F.when(longer, tail).otherwise(F.lit(""))

    numbers = more(F.concat(F.lit("-"), _tail(code, "0123456789012345")))
    local, domain = F.substring_index(raw, "@", 1), F.lower(F.substring_index(raw, "@", -1))
    domain_code = _code(key, F.lit("domain"), domain, F.lit(0))
    labels = F.regexp_extract(domain, r"^(.*)\.[a-z]+$", 1)
    email = F.concat(_poured(local, code, no), more(_tail(code)), F.lit("@"), _poured(labels, domain_code, no), F.lit(".example"))
    secret = F.regexp_replace(raw, BEFORE_SECRET, "")
    secret = F.when(secret.rlike(r"[\p{L}\p{Nd}]"), F.concat(_poured(secret, code, secret.rlike("^[0-9a-f]+$")), more(_tail(code)))).otherwise(_tail(code))
    hidden = F.concat(F.regexp_extract(raw, BEFORE_SECRET, 0), secret)
    octets = F.concat_ws(".", *[(_byte(code, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    groups = F.concat_ws(":", F.lit("2001:db8"), *[F.substr(code, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])
    country = F.regexp_extract(raw, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = F.concat(country, _poured(F.substr(raw, F.length(country) + 1), code, no), numbers)
    poured = _poured(raw, code, no)
    bare = F.concat(F.substr(raw, F.lit(1), F.lit(1)), F.substr(poured, F.lit(2), F.length(raw) - 2), numbers)
    check = (10 - _luhn(_digits(bare), 0) % 10) % 10
    card = F.concat(bare, check.cast("string"))
    access = F.concat(F.lit("AKIA"), _poured(F.substr(raw, F.lit(5)), code, no), more(_tail(code, "0123456789ABCDEF")))
    return (
        F.when(kind == "email", email).when(kind == "secret", hidden).when(kind == "ip", F.when(longer, groups).otherwise(octets)).when(kind == "phone", phone)
        .when(kind == "social", F.concat(poured, numbers)).when(kind == "card", card).when(kind == "access", access).when(kind == "name", _name(raw, code, longer))
        .otherwise(raw)
    )


def _shape(kind: Column, surrogate: Column) -> Column:
    """What two surrogates are compared by."""
    return _canonical(kind, surrogate)


def found(docs: DataFrame) -> DataFrame:
    """(kind, canon, raw, documents): the distinct entities; raw is one way to write them."""
    rows = docs.filter(F.col("text").rlike(HINT)).select(F.explode(_entities(F.col("text"))).alias("e"))
    rows = rows.select("e.kind", "e.canon", "e.raw").filter("kind IS NOT NULL")
    return rows.groupBy("kind", "canon").agg(F.min("raw").alias("raw"), F.count(F.lit(1)).alias("n"))


def collisions(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, tries) of the entities that do not take their first surrogate."""
    values = entities.select("kind", F.col("canon").alias("shape"), F.lit(True).alias("is_value"))
    current = entities.select("kind", "canon", "raw", F.lit(0).alias("tries"))
    while True:  # ends: from MOST_TRIES on, there are far more surrogates than values
        code = _code(key, F.col("kind"), F.col("canon"), F.col("tries"))
        new = current.withColumn("code", code)
        new = new.withColumn("shape", _shape(F.col("kind"), _surrogate(key, F.col("kind"), F.col("raw"), F.col("canon"), F.col("code"), F.col("tries"))))
        new = stored(new.select("kind", "canon", "raw", "tries", "shape"), "surrogates")
        first = new.groupBy("kind", "shape").agg(F.min(F.struct("tries", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        first = first.join(values, ["kind", "shape"], "left").filter("n > 1 OR is_value")
        clash = new.join(first, ["kind", "shape"]).filter("is_value OR canon <> first.canon").select("kind", "canon")
        clash = stored(clash, "clashes")
        if clash.isEmpty():
            return new.filter("tries > 0").select("kind", "canon", "tries")
        current = new.join(clash.withColumn("clash", F.lit(True)), ["kind", "canon"], "left").select(
            "kind", "canon", "raw", F.when(F.col("clash"), F.col("tries") + 1).otherwise(F.col("tries")).alias("tries")
        )


def _rewritten(text: Column, tries: Column, key: str) -> Column:
    """(text, kinds) with all entities replaced; tries: a map from 'kind canon' to a number, or null."""
    def choice(e: Column) -> Column:
        return F.coalesce(F.element_at(tries, F.concat_ws(" ", e["kind"], e["canon"])), F.lit(0))

    coded = F.transform(
        _entities(text),
        lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"), e["canon"].alias("canon"), choice(e).alias("tries"), _code(key, e["kind"], e["canon"], choice(e)).alias("code")),
    )
    placed = F.transform(coded, lambda e: F.struct(_surrogate(key, e["kind"], e["raw"], e["canon"], e["code"], e["tries"]).alias("new"), e["kind"].alias("kind")))
    def joined(x: Column) -> Column:
        pieces = F.zip_with(F.slice(x["gaps"], 2, F.size(x["placed"])), x["placed"], lambda gap, e: F.concat(e["new"], gap))
        kinds = F.filter(F.transform(x["placed"], lambda e: e["kind"]), lambda k: k.isNotNull())
        return F.struct(F.concat(F.get(x["gaps"], F.lit(0)), F.array_join(pieces, "")).alias("text"), kinds.alias("kinds"))

    # An array of one binds both parts to a variable, so that each is computed once.
    parts = F.array(F.struct(F.split(text, ANY, -1).alias("gaps"), placed.alias("placed")))
    return F.get(F.transform(parts, joined), F.lit(0))


def rewritten(docs: DataFrame, text: str, key: str = KEY) -> DataFrame:
    """All rows and columns with the column `text` rewritten, and `replaced`, the kinds of what was replaced.

    Beside it, no column may be called replaced, hash, tries or new.
    """
    own = F.col(text)
    entities = stored(found(docs.select(own.alias("text"))), "entities")
    other = stored(collisions(entities, key), "tries")
    has = own.rlike(HINT)
    count = other.count()
    if not count:
        rows = docs.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        # Documents with an entity that takes another surrogate: each entity asks for its number.
        asked = docs.filter(has).select(F.xxhash64(own).alias("hash"), own.alias("text")).select(
            "hash", "text", F.explode(F.transform(_entities(F.col("text")), lambda e: F.struct(e["kind"].alias("kind"), e["canon"].alias("canon")))).alias("e")
        )
        few = F.broadcast(other) if count <= BROADCAST_ROWS else other
        asked = asked.select("hash", "e.kind", "e.canon").distinct().join(few, ["kind", "canon"])
        maps = asked.groupBy("hash").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "canon"), "tries"))).alias("tries"))
        maps = stored(maps, "maps")
        rows = docs.withColumn("hash", F.when(has, F.xxhash64(own)))
        rows = rows.join(F.broadcast(maps) if maps.count() <= BROADCAST_ROWS else maps, "hash", "left")
    rows = rows.withColumn("new", F.when(has, _rewritten(own, F.col("tries"), key)))
    new = F.when(F.col("new").isNull(), own).otherwise(F.col("new.text")).alias(text)
    kinds = F.coalesce(F.col("new.kinds"), F.array().cast("array<string>")).alias("replaced")
    return rows.select(*[new if c == text else c for c in docs.columns], kinds)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the rewritten text, and the kinds of the entities replaced in order."""
    own = docs.select(F.col("doc_id").cast("long"), "text")
    kinds = F.col("replaced")
    return rewritten(own, "text", key).select("doc_id", "text", F.size(kinds).cast("long").alias("n_replaced"), F.concat_ws(",", kinds).alias("kinds"))


def cleaned(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with all their columns, their texts rewritten."""
    rows, names = by_position(docs)
    return rewritten(rows, f"c{names.index('text')}", key).drop("replaced").toDF(*names)
