"""Private data replaced by surrogates, with DataFrame functions only.

Each entity found gets a replacement that is a keyed function (SHA-512) of what it stands for, of the same type and format:
a digit stays a digit, an upper-case letter an upper-case one, a letter stays in its script, separators stay; country codes,
top-level domains and titles stay; names after a title are built word by word from syllables of their script with an ending
for their gender; octets stay below 256; card numbers and IBANs get valid check digits.

Coreference: mentions of one thing get one surrogate in every document. A name's words are replaced one by one by gender, so
"Mrs Anna Smith", "Mrs. Smith" and, in the same text, "Anna Smith" without a title agree; a phone number goes by its last ten
digits and a card by its digits, however they are written; an e-mail address by its lower-case letters.

Collision checks run over the distinct entities of all documents (a name's words each count as one): a surrogate that two
would share, or that is itself an entity somewhere, is drawn again with the next attempt number for all but the first of
them, and for all mentions of the same thing, until all are distinct. So that the free surrogates never run out, later
attempts draw longer ones: a name gains a syllable and an e-mail a letter with each attempt, short phone numbers gain digits,
and other kinds, whose 4 billion forms and more have a fixed length, gain digits after ``FIXED`` attempts only. Redrawn
entities are few; they are joined to the documents that hold them, all others are computed in place.

Edge cases: null texts stay null and have no entities; empty and very long texts are handled whole (the patterns cannot
backtrack over long words); repeated rows are replaced alike; an empty table stays empty; other columns stay as they are,
and those named like a result are replaced.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Titles before names, by the gender they tell.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Mx"],
}
#: Syllables and endings by script, then gender.
SYLLABLES = {
    "Latin": ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"],
    "Cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ша"],
    "Greek": ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "ξυ", "πα", "ρε", "σι", "το", "φυ", "χα"],
}
ENDINGS = {
    "Latin": {"m": "mir", "f": "lina", "n": "ren"},
    "Cyrillic": {"m": "мир", "f": "лина", "n": "рен"},
    "Greek": {"m": "νος", "f": "λινα", "n": "ρεν"},
}
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшщэюя",
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{Ll}": "àáâäçèéêëìíîïñòóôöùúûü",
    r"\p{Lu}": "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
}
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group) + ")"
_FIRST = "(?=[" + "".join(sorted({t[0] for group in TITLES.values() for t in group})) + "])"
_JUNK = r"[\s|#*$%&!,.-]{0,6}"
#: Type and pattern, in the order of trial.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": rf"(?<![0-9+])(?:\+[0-9]{{1,3}}{_JUNK})?\([0-9]{{3}}\){_JUNK}[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLE}\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
}
ANY = "|".join(f"(?:{x})" for x in PATTERNS.values())
#: What any entity holds or starts with; a quarter of the cost of the patterns where a text has none of it.
ANCHORS = [
    "[0-9@]",
    _FIRST + _TITLE + r"\.? \p{Lu}",
    "(?=[a-fA-F])(?:[a-f]{32}|[A-F]{32})",
    "sk-[A-Za-z_-]{20}|gh[pousr]_[A-Za-z]{36}|AKIA[A-Z]{16}",
]
RESULTS = ["n_entities", "kinds"]
#: Draws of a surrogate of fixed length, before it gains digits.
FIXED = 8
#: Places of a digest: each two bytes as four hex digits.
PLACES = 32


def entities_of(text: Column) -> Column:
    """All entities of a text in order; null of null."""
    none = F.expr("cast(array() as array<string>)")
    maybe = F.lit(False)
    for anchor in ANCHORS:
        maybe = maybe | text.rlike(anchor)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(maybe, found).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def kind_of(entity: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return F.coalesce(found, F.lit("other"))


def _draw(digest: Column, place: Column, n: int) -> Column:
    """A number below ``n`` from two bytes of the hex digest; places over 32 use them shifted."""
    hexes = F.substring(digest, (place * 4) % 125 + 1, F.lit(4))
    return (F.conv(hexes, 16, 10).cast("int") + place.cast("int") * 7) % n


def _same_shape(text: Column, digest: Column, hexadecimal: Column, keep: Column, by_digit: Column) -> Column:
    """Each character from index ``keep`` on replaced by a drawn one of its own class; ``by_digit``: a digit is drawn by the
    number of digits after it, whatever stands between them."""

    def one(c: Column, i: Column) -> Column:
        after = F.length(F.regexp_replace(F.substring(text, i + 2, F.length(text)), "[^0-9]", ""))

        def drawn(place: Column) -> Column:
            out = c
            for pattern, letters in reversed(ALPHABETS.items()):
                n = F.when(hexadecimal, 6).otherwise(len(letters)) if pattern.lower() == "[a-z]" else len(letters)
                out = F.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(letters), _draw(digest, place, n) + 1, F.lit(1))).otherwise(out)
            return out

        return F.when(i < keep, c).otherwise(_let(F.when(by_digit, after).otherwise(i), drawn))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(card: Column) -> Column:
    """The card number with a valid last digit."""
    digits = F.reverse(F.split(F.regexp_replace(F.substring(card, F.lit(1), F.length(card) - 1), "[^0-9]", ""), ""))

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda s, x: s + x)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _mod97(iban: Column) -> Column:
    """The IBAN with valid check digits."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(2)), F.lit("00"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + c.try_cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97
    check = F.lpad((98 - F.aggregate(F.split(moved, ""), F.lit(0), step)).cast("string"), 2, "0")
    return F.concat(F.substring(iban, F.lit(1), F.lit(2)), check, F.substring(iban, F.lit(5), F.length(iban)))


def _more(digest: Column, letters: str, n: int) -> Column:
    """``n`` drawn characters; places from the digest's end, as the shape takes them from its start."""
    drawn = [F.substring(F.lit(letters), _draw(digest, F.lit(PLACES - 1 - k % PLACES), len(letters)) + 1, F.lit(1)) for k in range(n)]
    return F.concat(*drawn) if n > 0 else F.lit("")


def _longer_phone(entity: Column, digest: Column) -> Column:
    """As many digits more as the format takes after the last one."""
    out = F.lit("")
    for n in range(1, 7):
        fits = F.concat(entity, F.lit("0" * n)).rlike(f"^(?:{PATTERNS['phone']})$")
        out = F.when(fits, _more(digest, "0123456789", n)).otherwise(out)
    return out


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"^{_TITLE}\.? ", 0)


def _gender(title: Column) -> Column:
    gender = F.lit("n")
    for g, titles in TITLES.items():
        gender = F.when(title.rlike(rf"^(?:{'|'.join(titles)})\.? $"), g).otherwise(gender)
    return gender


def _name_words(name: Column) -> Column:
    return F.split(F.substring(name, F.length(_title(name)) + 1, F.length(name)), " ")


def units_of(entity: Column, kind: Column) -> Column:
    """What is replaced as one: a name's words, each after the first title of its gender; else the entity itself."""
    gender = _gender(_title(entity))
    title = F.lit("")
    for g, titles in TITLES.items():
        title = F.when(gender == g, titles[0] + " ").otherwise(title)
    return F.when(kind == "name", F.transform(_name_words(entity), lambda w: F.concat(title, w))).otherwise(F.array(entity))


def _canonical(unit: Column, kind: Column) -> Column:
    """What a unit stands for, however it is written."""
    digits = F.regexp_replace(unit, "[^0-9]", "")
    return F.when(kind == "phone", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10))).when(kind == "card", digits).when(kind == "email", F.lower(unit)).otherwise(unit)


def _name(entity: Column, key: str, attempt: int) -> Column:
    n = 4 + attempt

    def build(word: Column, gender: Column, digest: Column) -> Column:
        built = F.lit("")
        for script, syllables in SYLLABLES.items():
            table = F.array(*map(F.lit, syllables))
            parts = [F.element_at(table, _draw(digest, F.lit(j), 16) + 1) for j in range(n)]
            end = F.lit("")
            for g, ending in ENDINGS[script].items():
                end = F.when(gender == g, ending).otherwise(end)
            here = word.rlike(rf"\p{{Is{script}}}") if script != "Latin" else F.lit(True)  # also of scripts without a table
            built = F.when(here, F.initcap(F.concat(*parts, end))).otherwise(built)
        return built

    def named(t: Column) -> Column:
        digest = lambda w: F.sha2(F.concat_ws("\x00", F.lit(key), F.lit("name"), F.lit(str(attempt)), t["gender"], w), 512)
        words = F.transform(t["words"], lambda w: _let(digest(w), lambda d: build(w, t["gender"], d)))
        return F.concat(t["title"], F.array_join(words, " "))

    return _let(F.struct(_title(entity).alias("title"), _gender(_title(entity)).alias("gender"), _name_words(entity).alias("words")), named)


def surrogate(entity: Column, kind: Column, key: str, attempt: int) -> Column:
    """The replacement of an entity at an attempt."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(key), kind, F.lit(str(attempt)), _canonical(entity, kind)), 512)
    country = F.length(F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[^0-9])", 0))
    bound = F.struct(
        entity.alias("e"), kind.alias("k"), digest.alias("d"),
        entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").alias("hex"),
        F.when(kind == "phone", country).when(kind == "iban", 2).otherwise(0).alias("keep"),
    )

    def shaped(u: Column) -> Column:
        shape = _same_shape(u["e"], u["d"], u["hex"], u["keep"], u["k"].isin("phone", "card"))
        return _let(shape, lambda shape: drawn(u, shape))

    def drawn(u: Column, shape: Column) -> Column:
        e, k, d = u["e"], u["k"], u["d"]
        octets = [F.conv(F.substring(d, 1 + 4 * j, 4), 16, 10).cast("int") % 254 + 1 for j in range(4)]
        domain = F.regexp_extract(e, r"\.[A-Za-z0-9-]+$", 0)
        letters = _more(d, "abcdefghijklmnopqrstuvwxyz", attempt)
        digits = _more(d, "0123456789", attempt - FIXED)
        fixed = (
            F.when(k == "ip", F.concat_ws(".", *(x.cast("string") for x in octets)))
            .when(k == "phone", F.concat(shape, _longer_phone(e, d) if attempt else F.lit("")))
            .when(k == "iban", _mod97(shape))
            .when(k == "card", _luhn(shape))
            .otherwise(shape)
        )
        mail = F.concat(letters, F.substring(shape, F.lit(1), F.length(e) - F.length(domain)), domain)
        return F.when(k == "email", mail).otherwise(F.concat(fixed, digits) if attempt > FIXED else fixed)

    return F.when(kind == "name", _name(entity, key, attempt)).otherwise(_let(bound, shaped))


def _redrawn(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(entity, surrogate) of the units whose first draw is taken: by another unit, or as a unit itself."""
    found = docs.select(F.explode(F.array_distinct(entities_of(F.col(text).cast("string")))).alias("entity")).distinct()
    found = found.withColumn("kind", kind_of(F.col("entity")))
    units = found.select("kind", F.explode(units_of(F.col("entity"), F.col("kind"))).alias("entity")).distinct()
    entities = stored(units.withColumn("thing", _canonical(F.col("entity"), F.col("kind"))))
    pending, settled, extra = entities, None, None
    for attempt in count():
        drawn = stored(pending.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), key, attempt)))
        taken = entities.select(F.col("entity").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("surrogate"))
        free = drawn.join(taken, "surrogate", "left_anti").groupBy("surrogate").agg(F.min("thing").alias("thing"))
        # one mention that has to be drawn again takes all of the same thing along
        lost = drawn.join(free, ["surrogate", "thing"], "left_anti").select("kind", "thing").distinct()
        first = stored(drawn.join(lost, ["kind", "thing"], "left_anti").select("entity", "surrogate"))
        pending = stored(pending.join(lost, ["kind", "thing"], "left_semi"))
        settled = first if settled is None else settled.unionByName(first)
        if attempt:
            extra = first if extra is None else extra.unionByName(first)
        if pending.isEmpty():
            return extra


def replace_private_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with private data in the column ``text`` replaced, ``n_entities`` and ``kinds`` (distinct, sorted)."""
    names = {f"k{i}": c for i, c in enumerate(docs.columns) if c not in RESULTS and c != text}
    redrawn = _redrawn(docs, text, key)
    plain = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in names.items()), F.col(text).cast("string").alias("_text"))
    found = F.transform(entities_of(F.col("_text")), lambda e: F.struct(e.alias("e"), kind_of(e).alias("k")))
    df = plain.withColumn("_found", found)
    if redrawn is None:
        df = df.withColumn("_redrawn", F.lit(None).cast("map<string,string>"))
    else:
        row = F.sha2("_text", 256)
        holders = plain.select(row.alias("_row"), F.explode(entities_of(F.col("_text"))).alias("entity")).distinct()
        holders = holders.select("_row", F.explode(units_of(F.col("entity"), kind_of(F.col("entity")))).alias("entity"))
        maps = holders.distinct().join(redrawn, "entity").groupBy("_row")
        maps = maps.agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("_redrawn"))
        df = df.withColumn("_row", row).join(maps, "_row", "left").drop("_row")

    def named(entity: Column) -> Column:
        drawn = lambda unit: F.coalesce(F.col("_redrawn")[unit], _name(unit, key, 0))
        words = F.transform(units_of(entity, F.lit("name")), lambda u: F.element_at(F.split(drawn(u), " "), -1))
        return F.concat(_title(entity), F.array_join(words, " "))

    def other(x: Column) -> Column:
        return F.coalesce(F.col("_redrawn")[x["e"]], surrogate(x["e"], x["k"], key, 0))

    both = F.transform("_found", lambda x: F.struct(x["e"].alias("old"), F.when(x["k"] == "name", named(x["e"])).otherwise(other(x)).alias("new")))
    df = df.withColumn("_both", F.when(F.size("_found") > 0, both))
    pieces = F.split(F.col("_text"), ANY, -1)
    whole = F.array_join(F.zip_with(pieces, F.col("_both"), lambda p, e: F.concat(p, F.coalesce(e["new"], F.lit("")))), "")
    # later mentions of a full name without its title
    words = lambda name: F.substring(name, F.length(_title(name)) + 1, F.length(name))
    full = F.array_distinct(F.filter("_both", lambda e: e["old"].rlike(rf"^{_TITLE}\.? \S+ \S+$")))
    again = F.aggregate(full, whole, lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), words(e["old"]), F.lit(r"(?!\p{L})")), words(e["new"])))
    n = F.coalesce(F.size("_found"), F.lit(0))
    back = {c: k for k, c in names.items()}
    columns = [
        F.when(n > 0, again).otherwise(F.col("_text")).alias(c) if c == text else F.col(back[c]).alias(c)
        for c in docs.columns
        if c not in RESULTS
    ]
    return df.select(
        *columns,
        n.cast("long").alias("n_entities"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("_found", lambda x: x["k"]))), ",").alias("kinds"),
    )
