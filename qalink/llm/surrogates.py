"""Replaces personal data by surrogates of the same kind and form.

Found are e-mail addresses, phone numbers, IP addresses, card and account numbers, social security
numbers, long hexadecimal secrets and names after a form of address. What identifies a mention is its canonical form (lower case, digits
without separators), so all mentions of one entity, in all documents, get the same surrogate,
written in the form of the mention. A surrogate is drawn from a keyed hash of kind and canonical
form: digits become digits, letters become letters of their script and case, checksums that held
hold again, and names keep the gender of the form of address and their script.

Entities are one table. A surrogate that two entities of a kind would share, or that is itself an
entity of the corpus, is drawn anew until there is none; so different entities stay different.

Only column functions are used. The texts are searched once; after that only documents that hold
something are touched, and they are not shuffled as long as their replacements are few enough to
be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qalink.llm.base import row_key, text_of
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
#: Titles that say nothing about gender; names after them are drawn like those after MALE.
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία")

#: A part of a name: inner capitals, apostrophes and hyphens belong to it, a possessive 's does not.
_SIGN = r"(?:['’](?!s(?!\p{L})))?\p{L}"
_PART = rf"\p{{Lu}}(?:{_SIGN}){{1,40}}(?:-\p{{L}}(?:{_SIGN}){{0,40}}){{0,4}}"

#: What is searched for, in the order in which it is tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[0-9A-Fa-f:]{0,39}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7})(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])\p{Lu}{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}.-])(?!000|666|9\d\d)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|[.-]\d)",
    # National forms: three groups of an area code, or a leading 0 and two groups.
    "national": r"(?<![\p{L}\p{N}+.-])(?<!\d[ )])(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}|0\d{2,4}[ /-]\d{5,8})(?![\p{L}\p{N}]|[.-]\d)",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![\p{L}\p{N}])",
    "name": r"(?<!\p{L})(?:" + "|".join(MALE + NEUTRAL + FEMALE) + rf")\.? {_PART}(?: {_PART})*(?!\p{{L}})",
}
FIND = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Names to draw from, by kind and script; several are joined where one is not enough.
NAMES = {
    ("male", "latin"): ("Anton", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Leo", "Martin", "Oscar", "Paul", "Victor"),
    ("female", "latin"): ("Alma", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Laura", "Maria", "Nora", "Paula", "Vera"),
    ("family", "latin"): ("Albers", "Brandt", "Costa", "Dorn", "Ellis", "Falk", "Graf", "Hale", "Lange", "Moreno", "Rivas", "Vidal"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Кирилл", "Максим", "Павел"),
    ("female", "cyrillic"): ("Алла", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("family", "cyrillic"): ("Белов", "Волков", "Громов", "Егоров", "Зимин", "Комаров", "Орлов", "Титов"),
    ("male", "greek"): ("Αντώνης", "Γιώργος", "Κώστας", "Νίκος", "Παύλος", "Πέτρος"),
    ("female", "greek"): ("Άννα", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
    ("family", "greek"): ("Βλάχος", "Γεωργίου", "Καραγιάννης", "Μακρής", "Νικολάου", "Παππάς"),
}
_LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "accented": "àáâäçèéêëìíîïñòóôöùúûü",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшыэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}


def _pick(options: str, number: Column) -> Column:
    return F.substring(F.lit(options), F.pmod(number, F.lit(len(options))) + 1, F.lit(1))


def stream(key: str, kind: Column, canonical: Column, attempt: Column, length: Column) -> Column:
    """Numbers 0 to 65535, as many as asked for, from a keyed hash."""
    blocks = F.sequence(F.lit(0), F.floor(length / 16).cast("int"))
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    digest = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("#", seed, b.cast("string")), 256)), "")
    return F.transform(
        F.sequence(F.lit(0), length.cast("int")),
        lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int"),
    )


def _alike(sign: Column, number: Column) -> Column:
    """A sign of the same class, script and case; what is neither letter nor digit stays."""
    lower = F.lower(sign)
    letter = (
        F.when(lower.rlike("^[a-z]$"), _pick(_LETTERS["latin"], number))
        .when(lower.rlike(r"^\p{IsCyrillic}$"), _pick(_LETTERS["cyrillic"], number))
        .when(lower.rlike(r"^\p{IsGreek}$"), _pick(_LETTERS["greek"], number))
        .when(lower.rlike(r"^\p{L}$"), _pick(_LETTERS["accented"], number))
    )
    upper = (sign != lower) & sign.rlike(r"^\p{L}$")
    return (
        F.when(sign.rlike(r"^\d$"), _pick("0123456789", number))
        .when(letter.isNull(), sign)
        .otherwise(F.when(upper, F.upper(letter)).otherwise(letter))
    )


def _signs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def _spelled(text: Column, numbers: Column) -> Column:
    return F.array_join(F.transform(_signs(text), lambda c, i: _alike(c, F.get(numbers, i))), "")


def luhn_sum(digits: Column, doubled_from_last: int = 1) -> Column:
    """The weighted sum of a card number; 0 modulo 10 for valid ones."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def weighted(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        from_last = F.length(digits) - i
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(from_last % 2 == doubled_from_last, twice).otherwise(d)

    return F.aggregate(F.transform(places, weighted), F.lit(0), lambda a, x: a + x)


def _card(canonical: Column, numbers: Column) -> Column:
    """Another number of the same first digit and length, valid if this one is."""
    body = F.concat(F.substring(canonical, 1, 1), F.array_join(
        F.transform(F.sequence(F.lit(2), F.greatest(F.length(canonical) - 1, F.lit(2))), lambda i: _pick("0123456789", F.get(numbers, i))), ""))
    # The sum of all but the last digit, each as it counts once a last digit follows.
    check = F.pmod(10 - F.pmod(luhn_sum(body, doubled_from_last=0), F.lit(10)), F.lit(10))
    valid = F.pmod(luhn_sum(canonical), F.lit(10)) == 0
    last = F.when(valid, check).otherwise(F.pmod(check + 1 + F.pmod(F.get(numbers, F.lit(0)), F.lit(9)), F.lit(10)))
    return F.concat(body, last.cast("string"))


def _phone(canonical: Column, numbers: Column) -> Column:
    """Canonical form: country code, a colon, the other digits; the country stays."""
    rest = F.substring_index(canonical, ":", -1)
    return F.concat(F.substring_index(canonical, ":", 1), F.lit(":"), _spelled(rest, numbers))


def _ip(numbers: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(F.get(numbers, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])


def _email(canonical: Column, numbers: Column) -> Column:
    """Everything but the last two labels of the host is spelled anew."""
    kept = F.regexp_extract(canonical, r"(?:@|\.)([^.@]+\.[^.@]+)$", 1)
    own = F.substring(canonical, F.lit(1), F.length(canonical) - F.length(kept))
    return F.concat(_spelled(own, numbers), kept)


def _secret(canonical: Column, numbers: Column) -> Column:
    return F.array_join(F.transform(_signs(canonical), lambda c, i: _pick("0123456789abcdef", F.get(numbers, i))), "")


def _hexadecimal(canonical: Column, numbers: Column) -> Column:
    """Hexadecimal digits anew, none of them 0, and the colons where they are."""
    return F.array_join(F.transform(_signs(canonical), lambda c, i: F.when(c == ":", c).otherwise(_pick("123456789abcdef", F.get(numbers, i)))), "")


def _mod97(text: Column) -> Column:
    """What is left of an IBAN, its first four signs moved to the end, by 97."""
    values = F.transform(_signs(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: F.pmod(F.when(x > 9, a * 100 + x).otherwise(a * 10 + x), F.lit(97)))


def _iban(canonical: Column, numbers: Column) -> Column:
    """Another account of the same country, valid if this one is."""
    country, body = F.substring(canonical, 1, 2), _spelled(F.substring(canonical, F.lit(5), F.length(canonical)), numbers)
    check = F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))
    other = F.when(_mod97(canonical) == 1, check).otherwise(F.pmod(check + 1, F.lit(97)))
    return F.concat(country, F.lpad(other.cast("string"), 2, "0"), body)


def _name(kind: Column, canonical: Column, attempt: Column, numbers: Column) -> Column:
    """One name of the list of its kind and script; more with every second attempt."""
    script = (
        F.when(canonical.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(canonical.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    )
    count = F.floor(attempt / 2).cast("int")

    def joined(names: tuple[str, ...]) -> Column:
        options = F.array(*[F.lit(n) for n in names])
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), count),
                lambda i: F.get(options, F.pmod(F.get(numbers, F.pmod(i, F.size(numbers))), F.lit(len(names)))),
            ),
            "-",
        )

    out = None
    for (of, written), names in NAMES.items():
        case = (kind == of) & (script == written)
        out = F.when(case, joined(names)) if out is None else out.when(case, joined(names))
    return out


def surrogate(kind: Column, canonical: Column, attempt: Column, numbers: Column) -> Column:
    """The canonical form of a surrogate, from the numbers drawn for it."""
    return (
        F.when(kind == "email", _email(canonical, numbers))
        .when(kind == "ip", _ip(numbers))
        .when(kind == "phone", _phone(canonical, numbers))
        .when(kind == "card", _card(canonical, numbers))
        .when(kind == "secret", _secret(canonical, numbers))
        .when(kind == "ipv6", _hexadecimal(canonical, numbers))
        .when(kind.isin("national", "ssn"), _spelled(canonical, numbers))
        .when(kind == "iban", _iban(canonical, numbers))
        .otherwise(F.lower(_name(kind, canonical, attempt, numbers)))
    )


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    length = F.greatest(F.length("canonical"), F.lit(4)) + F.col("attempt")
    numbers = stream(key, F.col("kind"), F.col("canonical"), F.col("attempt"), length)
    made = surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), F.col("numbers"))
    return entities.withColumn("numbers", numbers).withColumn("made", made).drop("numbers")


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, made`` for the different ``entities(kind, canonical)``.

    Of several entities with one surrogate the one settled first keeps it, then the smallest; a
    surrogate that is an entity is given to none. The others draw again.
    """
    entities = stored(entities)
    now = stored(_drawn(entities.withColumn("attempt", F.lit(0)), key))
    real = entities.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("real"))
    while True:
        order = Window.partitionBy("kind", "made").orderBy("attempt", "canonical")
        judged = now.join(real, ["kind", "made"], "left").withColumn("place", F.row_number().over(order))
        judged = stored(judged.withColumn("again", (F.col("place") > 1) | F.coalesce("real", F.lit(False))))
        if judged.where("again").isEmpty():
            return now.select("kind", "canonical", "made")
        same = judged.where("not again").select("kind", "canonical", "attempt", "made")
        anew = judged.where("again").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        now = stored(same.unionByName(_drawn(anew, key)))


# From mentions to entities and back.


def _kind(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        case = mention.rlike(f"^(?:{pattern})$")
        out = F.when(case, kind) if out is None else out.when(case, kind)
    return out


def _units(kind: Column, mention: Column) -> Column:
    """The entities of a mention: one, or the parts of a name, as kind and canonical form."""

    def unit(k, c: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), F.lower(c).alias("canonical"))

    digits = F.regexp_replace(mention, r"\D", "")
    bare = F.regexp_replace(mention, " ", "")
    country = F.regexp_extract(mention, r"^\+(\d+)", 1)
    parts = F.split(mention, " ")
    gender = F.when(F.regexp_replace(F.get(parts, F.lit(0)), r"\.$", "").isin(*FEMALE), "female").otherwise("male")
    last = F.get(parts, F.size(parts) - 1)
    family = unit("family", last)
    given = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: unit(gender, p))
    return (
        F.when(kind == "card", F.array(unit("card", digits)))
        .when(kind == "phone", F.array(unit("phone", F.concat(country, F.lit(":"), F.substring(digits, F.length(country) + 1, F.length(digits))))))
        .when(kind.isin("national", "ssn"), F.array(unit(kind, digits)))
        .when(kind == "iban", F.array(unit("iban", bare)))
        .when(kind == "name", F.concat(given, F.array(family)))
        .otherwise(F.array(unit(kind, mention)))
    )


def _rendered(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogates ``made`` (one per unit) in the form of the mention."""
    one = F.get(made, F.lit(0))
    digits = F.regexp_replace(one, r"\D", "")
    signs = _signs(mention)
    grouped = F.array_join(F.transform(signs, lambda c, i: F.when(c == " ", c).otherwise(F.upper(F.substring(
        one, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), " ", "")), F.lit(1))))), "")
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
    numbered = F.array_join(
        F.transform(signs, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, before(i), F.lit(1))).otherwise(c)), ""
    )
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(one)).otherwise(
        F.when(
            kind == "email",
            F.array_join(
                F.transform(signs, lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(one, i + 1, F.lit(1)))).otherwise(
                    F.substring(one, i + 1, F.lit(1)))), ""),
        ).otherwise(one)
    )
    capital = F.transform(made, lambda n: F.array_join(F.transform(F.split(n, "-"), lambda p: F.initcap(p)), "-"))
    title = F.substring_index(mention, " ", 1)
    return (
        F.when(kind.isin("card", "phone", "national", "ssn"), numbered)
        .when(kind == "iban", grouped)
        .when(kind == "name", F.concat_ws(" ", title, F.array_join(capital, " ")))
        .when(kind == "ip", one)
        .otherwise(cased)
    )


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """``mention, replacement`` for the different mentions of ``mentions(mention)``."""
    each = stored(
        mentions.select("mention").distinct().withColumn("form", _kind(F.col("mention"))).where("form is not null")
        .select("mention", "form", F.posexplode(_units(F.col("form"), F.col("mention"))).alias("place", "unit"))
        .select("mention", "form", "place", "unit.*")
    )
    made = assigned(each.select("kind", "canonical").distinct(), key)
    found = each.join(made, ["kind", "canonical"]).groupBy("mention", "form").agg(
        F.sort_array(F.collect_list(F.struct("place", "made"))).alias("parts")  # as many as the name has
    )
    made = F.transform("parts", lambda p: p["made"])
    return found.select("mention", _rendered(F.col("form"), F.col("mention"), made).alias("replacement"))


def without_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``replaced``, the number of mentions, per row.

    Null text stays null with 0 mentions; the rest of every text stays as it is. The same key gives
    the same surrogates in every run over the same documents. Rows that repeat id and text get the
    same result. All columns of ``docs(doc_id, text)`` are kept; one named ``replaced`` is replaced.
    """
    mentions = F.regexp_extract_all(text_of(), F.lit(f"({FIND})"), F.lit(1))
    found = stored(
        docs.select(row_key().alias("key"), mentions.alias("mentions")).where(F.size("mentions") > 0).distinct()
    )
    each = found.select("key", F.explode(F.array_distinct("mentions")).alias("mention"))
    map_of = stored(replacements(each, key))
    # A row per document that holds something; its entries are bounded by its own text.
    known = each.join(map_of, "mention").groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("known")
    )
    ready = found.join(known, "key").select(
        "key", F.transform("mentions", lambda m: F.coalesce(F.col("known")[m], m)).alias("new")
    )
    others = [c for c in docs.columns if c.lower() not in ("text", "replaced")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text", row_key().alias("key"))
    joined = lookup_join(rows, stored(ready), ["key"], "left", spread_by=["key"])
    pieces = F.split("text", FIND, -1)
    whole = F.array_join(
        F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get("new", i), F.lit("")))), ""
    )
    text = F.when(F.col("new").isNull(), F.col("text")).otherwise(whole)
    made = joined.select("row", text.alias("text"), F.coalesce(F.size("new"), F.lit(0)).alias("replaced"))
    made = made.withColumn("replaced", F.greatest("replaced", F.lit(0)).cast("long"))
    order = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "replaced"]
    return made.select(*order, "replaced")
