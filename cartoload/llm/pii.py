"""Surrogates for personal data (operator 7), in DataFrame functions only.

Entities are found by one pattern over the whole text, and each is replaced by a surrogate of its own
kind: digits by digits, letters by letters of the same script and case, separators kept; addresses
stay addresses, valid card numbers stay valid, names keep title, gender and script. A surrogate is made
from a secret key and the entity's canonical form (lower case, without separators where these are
only layout), so one entity has one surrogate in all documents and spellings.

Distinctness is checked over the corpus: if two entities of a kind came to one surrogate, or a surrogate
were itself an entity found in the corpus, all but the first move on to their next surrogate, until
none collides. Only these exceptions are ever joined to documents; all other surrogates are computed
in place, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import truncate_lineage

# What entities look like.
_L, _R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа"], "n": ["Dr", "Prof"]}
# Every pattern takes a number of steps at each place that has a bound, so that texts of any make take time in
# proportion to their length: addresses have the lengths that mail formats allow (64 before the sign, 63 a
# label, 127 labels), secrets 1,024 characters, words of names 40. Runs beyond that are no entities.
NAME_WORD = r"\p{Lu}[\p{L}'’-]{1,39}(?![\p{L}'’-])"
PATTERNS = {
    "email": _L + r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,126}+",
    "iban": _L + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _R,
    "secret": _L + r"(?<![A-Za-z0-9_]_)(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{20,1024}" + _R,
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}" + _R
             + r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}" + _R + "|" + _L + r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}" + _R,
    "card": _L + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _R,
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R,
    "name": _L + "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? " + NAME_WORD + "(?: " + NAME_WORD + "){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no entity: addresses hold "@", names begin with a title, all other kinds ask for a digit.
HINT = r"[0-9]|@|" + _L + "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? \p{Lu}"

#: Country codes by ITU-T E.164: one digit, two digits, and three for all others.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

# The alphabets that letters stay in, and the parts of made-up names.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
MOST_ATTEMPTS = 100
SYLLABLES = "ba be bo da de di do fa fe ga go ha ka ke ki la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si ta te ti to va".split()
CYRILLIC = "ба бе бо да де ди до фа га го ка ке ки ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се си та те ти то ва ви зо".split()
ENDINGS = {"m": ["rto", "ldo", "nus", "mas"], "f": ["nna", "lina", "retta", "ria"], "n": ["ly", "rin", "ney", "sey"]}
CYRILLIC_ENDINGS = {"m": ["слав", "мир", "ний", "рей"], "f": ["на", "лия", "рина", "ша"], "n": ["ся", "ня", "ля", "ша"]}


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def kind_of(entity: Column) -> Column:
    """Kind of one entity, by the first pattern that it is a whole match of."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = entity.rlike(rf"\A(?:{pattern})\z")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.otherwise(F.lit("card"))


def canonical(kind: Column, entity: Column) -> Column:
    """The form that spellings of one entity share; a phone number keeps its plus, which says that a country code follows."""
    bare = F.regexp_replace(F.lower(entity), r"[^\p{L}\p{N}]", "")
    return (F.when(kind.isin("email", "ip", "secret", "name"), F.lower(entity))
            .when((kind == "phone") & entity.startswith("+"), F.concat(F.lit("+"), bare)).otherwise(bare))


def stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Keyed hexadecimal digits, two for every letter of ``canon``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 64).cast("int")),
                                    lambda block: F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt, block), 512)), "")


def octet(digits: Column, place: Column) -> Column:
    return F.conv(F.substring(digits, place * 2 + 1, F.lit(2)), 16, 10).cast("int")


def turned(letter: Column, by: Column, hexadecimal: Column) -> Column:
    """The letter moved on within its alphabet; letters of no alphabet stay."""
    spot = F.instr(F.lit("abcdef"), letter)
    out = F.when(hexadecimal & (spot > 0), F.substring(F.lit("abcdef"), (spot - 1 + by) % 6 + 1, F.lit(1)))
    for alphabet in ALPHABETS:
        spot = F.instr(F.lit(alphabet), letter)
        out = out.when(spot > 0, F.substring(F.lit(alphabet), (spot - 1 + by) % len(alphabet) + 1, F.lit(1)))
    return out.otherwise(letter)


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a text of digits."""
    return F.aggregate(F.transform(letters(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))),
                       F.lit(0), lambda a, b: a + b) % 10


def made(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate's canonical form."""
    def from_digits(digits: Column) -> Column:
        moved = let((kind == "secret") & canon.rlike("^[0-9a-f]+$"), lambda hexadecimal: F.transform(letters(canon), lambda c, i: turned(c, octet(digits, i), hexadecimal)))
        return let(F.array_join(moved, ""), lambda plain: of_kind(kind, canon, attempt, digits, plain, key))

    return let(stream(key, kind, canon, attempt), from_digits)


def of_kind(kind: Column, canon: Column, attempt: Column, digits: Column, plain: Column, key: str) -> Column:
    """The surrogate from keyed digits, and from the canonical form with all its letters turned."""
    called = code(canon)
    phone = F.concat(F.substring(canon, F.lit(1), called), F.substring(plain, called + 1, F.length(canon)))
    # Phone numbers keep the country's digits, card numbers the first one and the check digit's validity.
    card = F.concat(F.substring(canon, 1, 1), F.substring(plain, F.lit(2), F.length(canon) - 2))
    # The digit that makes the sum zero stands in place 0, where it counts once.
    fitting = ((10 - luhn(F.concat(card, F.lit("0")))) % 10).cast("string")
    card = F.concat(card, F.when(luhn(canon) == 0, fitting).otherwise(F.substring(plain, -1, 1)))
    ip = F.concat_ws(".", octet(digits, F.lit(0)) % 223 + 1, octet(digits, F.lit(1)), octet(digits, F.lit(2)), octet(digits, F.lit(3)))
    # An address keeps its last label; its domain goes by the domain alone.
    domain = F.substring_index(canon, "@", -1)
    host = F.array_join(F.slice(F.split(domain, r"\."), F.lit(1), F.size(F.split(domain, r"\.")) - 1), ".")
    hidden = let(stream(key, F.lit("domain"), domain, F.lit(0)), lambda turn: F.array_join(F.transform(letters(host), lambda c, i: turned(c, octet(turn, i), F.lit(False))), ""))
    email = F.concat(F.substring(plain, F.lit(1), F.length(canon) - F.length(domain)), hidden,
                     F.lit("."), F.substring_index(domain, ".", -1))
    iban = F.concat(F.substring(canon, 1, 2), F.substring(plain, F.lit(3), F.length(canon)))
    cyrillic = canon.rlike(r"\p{IsCyrillic}")

    def pick(values: list[str], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), octet(digits, at) % len(values) + 1)

    def name(values: list[str], endings: list[str] | None) -> Column:
        # Made-up names get longer where many are taken, so that there is always a free one.
        body = F.array_join(F.transform(F.sequence(F.lit(1), 2 + F.floor(attempt / 3).cast("int")), lambda k: pick(values, k)), "")
        return F.concat(body, pick(endings if endings else values, F.lit(0)))

    out = (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone)
           .when((kind == "surname") & cyrillic, F.concat(name(CYRILLIC, None), F.lit("н"))).when(kind == "surname", F.concat(name(SYLLABLES, None), F.lit("n"))))
    for gender in ENDINGS:
        out = out.when((kind == f"given-{gender}") & cyrillic, name(CYRILLIC, CYRILLIC_ENDINGS[gender])).when(kind == f"given-{gender}", name(SYLLABLES, ENDINGS[gender]))
    return out.otherwise(plain)


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, r"^\S+ ", 0)


def gender_of(entity: Column) -> Column:
    title = F.regexp_replace(title_of(entity), r"[. ]+$", "")
    return F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")


def name_words(entity: Column) -> Column:
    return F.split(F.substring(entity, F.length(title_of(entity)) + 1, F.length(entity)), " ")


def name_parts(entity: Column) -> Column:
    """``(kind, canon)`` of each word of a name: the last is the surname."""
    words = name_words(entity)
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given-"), gender_of(entity))).alias("kind"), F.lower(w).alias("canon")))


def parts(entity: Column) -> Column:
    """The ``(kind, canon)`` pairs of an entity: one, or one per word of a name."""
    return let(kind_of(entity), lambda kind: F.when(kind == "name", name_parts(entity)).otherwise(F.array(F.struct(kind.alias("kind"), canonical(kind, entity).alias("canon")))))


def dressed(entity: Column, kind: Column, plain: Column) -> Column:
    """The surrogate in the entity's layout: its separators and its capitals."""
    exact = kind.isin("email", "secret")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(a: Column, c: Column) -> Column:
        taken = exact | c.rlike(r"[\p{L}\p{N}]")
        new = F.substring(plain, a["next"], F.lit(1))
        new = F.when(c != F.lower(c), F.upper(new)).otherwise(new)
        return F.struct(F.concat(a["out"], F.when(taken, new).otherwise(c)).alias("out"), (a["next"] + F.when(taken, 1).otherwise(0)).alias("next"))

    return F.aggregate(letters(entity), start, step, lambda a: a["out"])


def surrogate(key: str, entity: Column, attempt_of) -> Column:
    """What replaces an entity; ``attempt_of(kind, canon)`` is 0 but for collisions."""
    def word(part: Column, written: Column) -> Column:
        return let(made(key, part["kind"], part["canon"], attempt_of(part["kind"], part["canon"])),
                   lambda new: F.when((written == F.upper(written)) & (F.length(written) > 1), F.upper(new)).otherwise(F.initcap(new)))

    def name() -> Column:
        return F.concat(title_of(entity), F.array_join(F.zip_with(name_parts(entity), name_words(entity), word), " "))

    def other(kind: Column, plain: Column) -> Column:
        # The plus of a phone number is layout to dressed().
        return F.when(kind == "ip", plain).otherwise(let(F.when(kind == "phone", F.ltrim(plain, F.lit("+"))).otherwise(plain), lambda whole: dressed(entity, kind, whole)))

    def of(kind: Column) -> Column:
        plain = let(canonical(kind, entity), lambda canon: let(made(key, kind, canon, attempt_of(kind, canon)), lambda new: other(kind, new)))
        return F.when(kind == "name", name()).otherwise(plain)

    return let(kind_of(entity), of)


def code(canon: Column) -> Column:
    """How long a phone number's plus and country code are, 0 without a plus; four digits at least come after them."""
    return F.least(F.length(F.regexp_extract(canon, COUNTRY, 0)), F.length(canon) - 4)


def exceptions(spark: SparkSession, entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, attempt)`` of the entities whose first surrogate collides.

    ``entities`` holds distinct ``(kind, canon)``. Of entities that share a surrogate the first keeps
    it; a surrogate that is an entity itself is kept by none. Each round moves the others on by one.
    Fails where a format is so short, and so many of its values are entities, that none comes free.
    """
    current = truncate_lineage(spark, entities.select("kind", "canon", F.lit(0).alias("attempt")), "surrogates")
    for _ in range(MOST_ATTEMPTS):
        with_made = current.withColumn("made", made(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        first = with_made.groupBy("kind", "made").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        taken = entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
        clashing = first.join(taken, ["kind", "made"], "left").where("n > 1 or real").select("kind", "made", "owner", "real")
        clashing = truncate_lineage(spark, clashing, "collisions")
        if clashing.isEmpty():
            return current.where("attempt > 0")
        moved = with_made.join(clashing, ["kind", "made"], "left").select(
            "kind", "canon", (F.col("attempt") + F.when(F.col("real") | (F.col("owner") != F.col("canon")), 1).otherwise(0)).alias("attempt"))
        current = truncate_lineage(spark, moved, "surrogates")
    raise ValueError(f"no free surrogate after {MOST_ATTEMPTS} attempts")


def replace(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``, the number of entities replaced.

    Null and empty texts stay as they are, with no entity; texts without an entity stay byte for byte;
    repeated rows get the same text; an empty table gives none; a column ``n_entities`` is replaced.
    A text of any length is gone through as a whole, in time proportional to its length.
    Within a name's title, only the words that follow it are replaced.
    """
    names = [c for c in docs.columns if c.lower() != "n_entities"]
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = F.when(hinted, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    listed = docs.select(F.explode(found).alias("entity")).distinct()
    entities = truncate_lineage(spark, listed.select(F.explode(parts(F.col("entity"))).alias("p")).select("p.kind", "p.canon").distinct(), "entities")
    moved = exceptions(spark, entities, key)
    marked = docs.select(*[F.col(f"`{c}`") for c in names], found.alias("__found"))
    if moved.isEmpty():
        attempt_of = lambda kind, canon: F.lit(0)
    else:
        # Texts with an exception, by their digest, get a map of its attempts.
        name = lambda kind, canon: F.concat_ws("|", kind, canon)
        texts = docs.select(F.sha2("text", 256).alias("digest"), F.explode(found).alias("entity")).distinct()
        texts = texts.select("digest", F.explode(parts(F.col("entity"))).alias("p")).select("digest", "p.kind", "p.canon").distinct()
        fixes = texts.join(moved, ["kind", "canon"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("canon")), "attempt"))).alias("__fixes"))
        marked = marked.withColumn("__digest", F.sha2("text", 256)).join(fixes.withColumnRenamed("digest", "__digest"), "__digest", "left")
        attempt_of = lambda kind, canon: F.coalesce(F.try_element_at(F.col("__fixes"), name(kind, canon)), F.lit(0))
    between = F.split("text", ANY, -1)
    rebuilt = F.concat(between[0], F.array_join(F.transform("__found", lambda e, i: F.concat(surrogate(key, e, attempt_of), between[i + 1])), ""))
    text = F.when(F.size("__found") > 0, rebuilt).otherwise(F.col("text"))
    n = F.when(F.size("__found") > 0, F.size("__found")).otherwise(0)
    return marked.select(*[(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`")) for c in names], n.alias("n_entities"))
