"""Surrogates for personal data, with DataFrame functions alone.

One pattern finds e-mail addresses, IPv4 addresses, IBANs, social security numbers, card numbers, phone numbers and
names after a form of address (initials included). In a text with such a name, the words of the name are replaced where
they stand alone, too, unless the text also has them in lower case. Each entity gets a replacement that depends on a
secret key and on the entity, not on where it stands: so the same entity has the same surrogate in all documents
(coreference), whatever its separators, its letters' case or the form of address.

Numbers and addresses are enciphered character by character within their alphabet, forwards and then backwards, each
shift keyed by what stands before. That is one-to-one on strings of a form, so distinct entities stay distinct, and it
keeps length, separators and case. Country codes, the first digit of cards, the first number of IPv4 addresses and the
top-level domain stay; check digits of cards and IBANs that were right are right again, and those that were off stay
off by as much; area codes come to begin with 0 or 1 only where they did.

A word of a name becomes a word of the same script (Latin, Cyrillic, Greek): its first letter goes through a keyed
permutation of the alphabet, so initials agree with whole names; keyed syllables follow, which belong to the word; the
ending follows the gender of the form of address, or, where that has none, the gender that the word has in most names
of the corpus. Given and family names have stems of their own. A word that stands alone has the role, gender and stem
that it has in the first name of its own text, so a text is coherent whatever other texts hold. Other documents can
change a surrogate in two ways alone: by the gender of a word whose form of address has none, and by an entity or word
that comes before it in order and has the same surrogate. Who needs surrogates that last keeps the table of
``surrogates_of``.

Texts are read by the pattern once; what it finds and what stands between is written. Distinct entities, and distinct
words of names, are resolved in tables of their own: where surrogates of two meet, all but the first take a key (and
for words a syllable) more, until none meet. The results are joined back to the places of entities, and only texts that
have some are put together anew.

Addresses longer than the public limits (64 characters before the @, 63 in a label, 127 labels) are none.

Defined results: a null text stays null; a text without entities stays as it is. Repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, named, table, written

#: The key of the contract's query; users pass their own.
KEY = "vellum-surrogates-1"
#: Syllables of a word after its first two letters; words that meet get more.
SYLLABLES = {"given": 2, "family": 3}
#: Letters of the shortest word of a name that is replaced where it stands alone.
LEAST_ALONE = 3

#: Forms of address by gender.
ADDRESS = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Mademoiselle", "Sra", "Señora", "Srta", "Señorita", "Doña", "Signora", "г-жа", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "Signor", "г-н", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Professor"),
}
#: Letters, consonants, vowels and the endings of given and of family names by gender, for each script.
SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "bdfghklmnprstvz", "aeiou", {"f": "a", "m": "us", "n": "en"}, {"f": "er", "m": "er", "n": "er"}),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщэюя", "бвгджзклмнпрстф", "аеиоу", {"f": "а", "m": "ий", "n": "ен"}, {"f": "ова", "m": "ов", "n": "енко"}),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "βγδζθκλμνπρστφχ", "αειου", {"f": "α", "m": "ος", "n": "ι"}, {"f": "ου", "m": "ης", "n": "ακη"}),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}(?:['’]\p{L}{2,}+|\p{L}++(?:['’]\p{L}{2,}+)?)"
_WORD = rf"(?:{_NAME}(?:-{_NAME})?|\p{{Lu}}\.)"
_FORMS = "|".join(sorted((f for forms in ADDRESS.values() for f in forms), key=len, reverse=True))
_TITLE = rf"(?:(?:{_FORMS})\.?|M\.)"
_CARD = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}"
#: Country codes by their first digits, so that a number's digits alone tell where its code ends.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: No group repeats without a bound: each round of one takes a frame of the JVM's stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}+(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": rf"(?<![\d+])(?:{_CARD})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "person": rf"(?=[MFSDHPгГΚ])(?<!\p{{L}}){_TITLE}(?: {_TITLE}){{0,2}}(?: {_WORD}){{1,3}}",
}
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ssn", "card", "phone"))
#: What can't begin an entity is passed over by its first characters.
_UNMAILED = rf"(?=[\d+(])(?:{_NUMBERS})|(?=[A-Z]{{2}}\d){PATTERNS['iban']}|{PATTERNS['person']}"
_ALL = rf"(?=[A-Za-z0-9._%+-]){PATTERNS['email']}|{_UNMAILED}"
#: A word that may be part of a name, standing alone.
_ALONE = rf"(?<![\p{{L}}\p{{N}}])(?:{_NAME})(?![\p{{L}}\p{{N}}@_%+]|\.[\p{{L}}\p{{N}}])"


def _hash(*parts: Column | str) -> Column:
    """A keyed number of 48 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256), 1, 12), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """The body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _shifted(c: Column, by: Column) -> Column:
    digit = ((F.ascii(c) - 48 + by) % 10).cast("string")
    letter = F.char(97 + (F.ascii(c) - 97 + by) % 26)
    return F.when(c.between("0", "9"), digit).when(c.between("a", "z"), letter).otherwise(c)


def cipher(s: Column, key: Column | str, tweak: Column | str) -> Column:
    """One-to-one on strings with digits and lower-case letters in given places; other characters stay."""

    def once(text: Column, way: str) -> Column:
        return F.aggregate(_chars(text), F.lit(""), lambda done, c: F.concat(done, _shifted(c, _hash(key, way, tweak, done))))

    return F.reverse(once(F.reverse(once(s, "1")), "2"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _refilled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(new: Column) -> Column:
        def put(state: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(F.concat(state["out"], F.when(is_digit, F.substr(new, state["at"], F.lit(1))).otherwise(c)).alias("out"), (state["at"] + is_digit.cast("int")).alias("at"))

        return F.aggregate(_chars(form), start, put, lambda s: s["out"])

    return _let(digits, filled)


def _cased(text: Column, like: Column) -> Column:
    """Letters in upper case where the other text has them."""
    return F.array_join(F.zip_with(_chars(text), _chars(like), lambda a, b: F.when(b.between("A", "Z"), F.upper(a)).otherwise(a)), "")


def _email(m: Column, key: Column | str) -> Column:
    low = F.lower(m)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    top = F.substring_index(domain, ".", -1)
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return _cased(F.concat(cipher(local, key, "mail"), F.lit("@"), cipher(name, key, "domain"), F.lit("."), top), m)


def _ip(m: Column, key: Column | str) -> Column:
    part = F.split(m, r"\.")
    at = lambda i: F.get(part, F.lit(i)).cast("long")
    value = at(1) * 65536 + at(2) * 256 + at(3)
    state = F.struct((value / 4096).cast("long").alias("a"), (value % 4096).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        a = (s["a"] + _hash(key, "ip", i.cast("string"), s["b"].cast("string"))) % 4096
        return F.struct(a.alias("a"), ((s["b"] + _hash(key, "pi", i.cast("string"), a.cast("string"))) % 4096).alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(3)), state, turn, lambda s: s["a"] * 4096 + s["b"])
    return _let(done, lambda v: F.concat_ws(".", F.get(part, F.lit(0)), (v / 65536).cast("long").cast("string"), (v / 256).cast("long") % 256, v % 256))


def _check_digit(digits: Column) -> Column:
    """The digit that makes a card number valid."""
    at = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return (10 - F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10) % 10


def _card(m: Column, key: Column | str) -> Column:
    digits = _digits(m)
    head, last = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
    new = F.concat(F.left(digits, F.lit(1)), cipher(F.substr(head, F.lit(2)), key, "card"))
    # A number whose check digit is off by so much stays off by as much.
    return _refilled(m, _let(new, lambda v: F.concat(v, ((_check_digit(v) + last - _check_digit(head) + 10) % 10).cast("string"))))


def _phone(m: Column, key: Column | str) -> Column:
    digits = _digits(m)
    code = F.when(m.startswith("+"), F.regexp_extract(digits, _COUNTRY, 0)).otherwise("")

    def national(own: Column) -> Column:
        """One-to-one: the first digit moves among 0 and 1 or among 2 to 9, by the others, before and after these change."""
        lead = lambda c, by: F.when(c > 1, (c - 2 + by) % 8 + 2).otherwise((c + by) % 2)
        others = F.substr(own, F.lit(2))
        first = lead(F.left(own, F.lit(1)).cast("int"), _hash(key, "lead", "1", others))
        new = lambda c: cipher(others, key, F.concat(F.lit("phone"), c.cast("string")))
        return _let(first, lambda c: _let(new(c), lambda tail: F.concat(lead(c, _hash(key, "lead", "2", tail)).cast("string"), tail)))

    return _refilled(m, _let(code, lambda c: F.concat(c, _let(F.substr(digits, F.length(c) + 1), national))))


def _iban(m: Column, key: Column | str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    account = F.upper(cipher(F.lower(F.substr(plain, F.lit(5))), key, "iban"))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def right(own: Column) -> Column:
        return 98 - F.aggregate(_chars(F.concat(own, F.left(plain, F.lit(2)), F.lit("00"))), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)

    # Check digits that are off by so much stay off by as much.
    off = F.substr(plain, F.lit(3), F.lit(2)).cast("int") - right(F.substr(plain, F.lit(5))) + 100

    def checked(own: Column) -> Column:
        return F.concat(F.left(plain, F.lit(2)), F.lpad(((right(own) + off) % 100).cast("string"), 2, "0"), own)

    def filled(new: Column) -> Column:
        def put(state: Column, c: Column) -> Column:
            return F.struct(F.concat(state["out"], F.when(c == " ", c).otherwise(F.substr(new, state["at"], F.lit(1)))).alias("out"), (state["at"] + (c != " ").cast("int")).alias("at"))

        return F.aggregate(_chars(m), start, put, lambda s: s["out"])

    return _let(_let(account, checked), filled)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column) -> Column:
    """Of one or more forms of address."""
    bare = F.transform(F.split(F.trim(title), " "), lambda w: F.rtrim(w, F.lit(".")))
    neutral = lambda w: w.isin(*ADDRESS["n"])
    return F.when(F.exists(bare, lambda w: w.isin(*ADDRESS["f"])), "f").when(F.forall(bare, neutral), "n").otherwise("m")


def _permuted(letters: str, key: str) -> str:
    return "".join(sorted(letters, key=lambda c: hashlib.sha256(f"{key}|letter|{c}".encode()).digest()))


def _first(word: Column, key: str) -> Column:
    """The first letter of a word's surrogate: a keyed permutation of each script's letters."""
    source = "".join(x[0] for x in SCRIPTS.values())
    target = "".join(_permuted(x[0], key) for x in SCRIPTS.values())
    return F.translate(F.left(F.translate(F.lower(word), "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßčďěňřšťůžłąęśźżńćőűğışёґєії", "aaaaaaaceeeeiiiidnoooooouuuuypscdenrstuzlaeszzncouqiseгеии"), F.lit(1)), source, target)


def stem(low: Column, role: Column, key: str, more: Column | int = 0) -> Column:
    """The surrogate of a lower-cased word of a name, but for its ending. Stems of a role are equally long but for ``more``."""

    def letter(of: str, h: Column) -> Column:
        return F.substr(F.lit(of), (h % len(of) + 1).cast("int"), F.lit(1))

    def made(letters: str, consonants: str, vowels: str, *_: dict) -> Column:
        def syllable(i: Column) -> Column:
            return _let(_hash(key, "name", role, low, i.cast("string"), F.lit(more).cast("string") if isinstance(more, int) else more.cast("string")), lambda h: F.concat(letter(consonants, h), letter(vowels, (h / 64).cast("long"))))

        n = F.when(role == "family", SYLLABLES["family"]).otherwise(SYLLABLES["given"]) + more

        def begun(first: Column) -> Column:
            known = F.when(F.contains(F.lit(letters), first), first).otherwise(letter(letters, _hash(key, "first", low)))
            second = lambda c: F.when(F.contains(F.lit(vowels), c), letter(consonants, _hash(key, "second", low))).otherwise(letter(vowels, _hash(key, "second", low)))
            return _let(known, lambda c: F.concat(c, second(c)))

        return F.concat(_let(_first(low, key), begun), F.array_join(F.transform(F.sequence(F.lit(1), n), syllable), ""))

    script = _script(low)
    return F.when(script == "cyrillic", made(*SCRIPTS["cyrillic"])).when(script == "greek", made(*SCRIPTS["greek"])).otherwise(made(*SCRIPTS["latin"]))


def _word(word: Column, made: Column, role: Column, gender: Column) -> Column:
    """A stem with its ending, in the word's case."""

    def ending(given: dict[str, str], family: dict[str, str]) -> Column:
        of = lambda ends: F.when(gender == "f", ends["f"]).when(gender == "m", ends["m"]).otherwise(ends["n"])
        return F.when(role == "family", of(family)).otherwise(of(given))

    script = _script(word)
    end = F.when(script == "cyrillic", ending(*SCRIPTS["cyrillic"][3:])).when(script == "greek", ending(*SCRIPTS["greek"][3:])).otherwise(ending(*SCRIPTS["latin"][3:]))
    whole = F.concat(made, end)
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(whole)).otherwise(F.initcap(whole))


def kind_of(m: Column) -> Column:
    """The kind of a match, by its form."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip").when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(rf"^(?:{_CARD})$"), "card").when(m.rlike(r"^[+(\d]"), "phone").otherwise("person")
    )


def surrogate(m: Column, key: Column | str) -> Column:
    """The surrogate of an entity that is no name."""

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "iban", _iban(m, key)).when(kind == "ssn", _refilled(m, cipher(_digits(m), key, "ssn")))
            .when(kind == "card", _card(m, key)).when(kind == "phone", _phone(m, key))
        )

    return _let(kind_of(m), of)


def _identity(m: Column) -> Column:
    """What entities are told apart by: case of addresses and separators of numbers don't count."""
    plain = lambda kind: F.when(kind == "email", F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind.isin("ssn", "card", "phone"), F.regexp_replace(m, r"[^\d+]", "")).otherwise(m)
    return _let(kind_of(m), lambda kind: F.concat_ws(":", kind, plain(kind)))


def apart(owns: DataFrame, new: Callable[[Column], Column]) -> DataFrame:
    """Adds retry and new to a table with a row per ``own``, such that no two rows have the same ``new``.

    ``new`` gives the surrogate for a number of retries. Of the rows that meet, the one with the least ``own`` keeps its
    surrogate and the others try again, so a round works on a table of the entities alone.
    """
    rows = written(owns.withColumn("retry", F.lit(0)).withColumn("new", new(F.col("retry"))), "entities")
    while True:
        meeting = rows.groupBy("new").agg(F.min("own").alias("keeps"), F.count("*").alias("n")).filter("n > 1").select(F.col("new").alias("met"), "keeps")
        if meeting.isEmpty():
            return rows
        later = rows.join(meeting, F.col("new") == F.col("met"), "left")
        later = later.withColumn("retry", F.col("retry") + F.coalesce((F.col("own") != F.col("keeps")).cast("int"), F.lit(0))).select(*owns.columns, "retry")
        later = written(later.withColumn("new", new(F.col("retry"))), "entities")
        discard(rows)
        rows = later


def _names(m: Column) -> Column:
    """A person without forms of address."""
    return F.regexp_replace(m, rf"^{_TITLE}(?: {_TITLE}){{0,2}} (?=\p{{Lu}})", "")


def _parts(m: Column) -> Column:
    return F.split(_names(m), "[ -]")


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with what the pattern finds, written: row, doc_id, text (where nothing is found), found, gaps, alone.

    ``found`` has entities in order, and in texts with names also words that may be part of one; ``gaps`` is what stands
    between. ``alone`` are lower-cased words of the text's names that are to be replaced where they stand alone.
    """
    text = F.col("text")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("first", F.coalesce(F.when(text.contains("@"), all_of(_ALL)).otherwise(all_of(_UNMAILED)), none))
    people = F.filter("first", lambda m: kind_of(m) == "person")
    words = F.filter(F.array_distinct(F.transform(F.flatten(F.transform(people, _parts)), F.lower)), lambda w: F.length(w) >= LEAST_ALONE)
    alone = F.when(F.exists("first", lambda m: kind_of(m) == "person"), F.array_except(words, F.split(text, r"[^\p{L}'’]+")))
    rows = rows.withColumn("alone", F.coalesce(alone, none))
    with_words = f"{_ALL}|{_ALONE}"
    some, any_words = F.size("first") > 0, F.size("alone") > 0
    found = F.when(any_words, all_of(with_words)).otherwise(F.col("first"))
    gaps = F.when(any_words, F.split(text, with_words, -1)).when(some, F.split(text, _ALL, -1)).otherwise(none)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return written(rows.select("row", "doc_id", F.when(~some, text).alias("text"), found.alias("found"), gaps.alias("gaps"), "alone"), "found")


def occurrences(found: DataFrame) -> DataFrame:
    """(row, at, entity, is_word): all that was found; words alone have neither blanks nor digits nor an @."""
    rows = found.filter("size(found) > 0").select("row", F.posexplode("found").alias("at", "entity"))
    return rows.withColumn("is_word", ~F.col("entity").rlike(r"[ @\d]"))


def _stems(people: DataFrame, key: str) -> DataFrame:
    """(role, low, gender, new): a row per word of a name in a role; its gender is that of most names that have one."""
    votes = lambda g: F.sum((F.col("gender") == g).cast("int"))
    words = people.filter("role <> 'initial'").groupBy("role", "low").agg(votes("m").alias("m"), votes("f").alias("f"))
    words = words.select("role", "low", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n").alias("gender"), F.concat_ws(":", "role", "low").alias("own"))
    return apart(words, lambda retry: F.concat_ws(":", "role", stem(F.col("low"), F.col("role"), key, retry)))


_WORDS = "array<struct<at:int,part:string,low:string,role:string,gender:string,stem:string>>"


def surrogates_of(entities: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """For distinct entities: (entity, kind, new, words of a name); and the stems of these: (role, low, gender, new)."""
    entity = F.col("entity")
    entities = entities.withColumn("kind", kind_of(entity))
    people = entities.filter("kind = 'person'").withColumn("names", _names(entity)).withColumn("title", F.left(entity, F.length(entity) - F.length("names"))).withColumn("of_title", _gender(F.col("title")))
    parts = F.split("names", "[ -]")
    tail = F.size(F.split(F.element_at(F.split("names", " "), -1), "-"))
    people = people.select("entity", "title", F.regexp_extract_all("names", F.lit("[ -]"), F.lit(0)).alias("between"), F.col("of_title"), (F.size(parts) - tail).alias("family_from"), F.posexplode(parts).alias("at", "word"))
    role = F.when(F.col("word").endswith("."), "initial").when(F.col("at") >= F.col("family_from"), "family").otherwise("given")
    people = written(people.withColumn("role", role).withColumn("low", F.lower("word")).withColumn("gender", F.col("of_title")), "people")
    stems = _stems(people, key)
    made = people.join(stems.select("role", "low", F.col("gender").alias("of_word"), F.substring_index("new", ":", -1).alias("stem")), ["role", "low"], "left")
    gender = F.when(F.col("of_title") != "n", F.col("of_title")).otherwise(F.col("of_word"))
    initial = F.concat(F.upper(_first(F.col("word"), key)), F.lit("."))
    made = made.withColumn("part", F.concat(F.when(F.col("role") == "initial", initial).otherwise(_word(F.col("word"), F.col("stem"), F.col("role"), gender)), F.coalesce(F.get("between", F.col("at")), F.lit(""))))
    # A name has a few parts.
    named_ = made.withColumn("gender", gender).groupBy("entity", "title").agg(F.array_sort(F.collect_list(F.struct("at", "part", "low", "role", "gender", "stem"))).alias("words"))
    named_ = named_.select("entity", F.lit("person").alias("kind"), F.concat("title", F.array_join("words.part", "")).alias("new"), F.col("words").cast(_WORDS).alias("words"))
    others = entities.filter("kind <> 'person'").withColumn("own", _identity(entity))
    own_key = lambda retry: F.when(retry > 0, F.concat(F.lit(f"{key}#"), retry.cast("string"))).otherwise(F.lit(key))
    under = lambda m, retry: _let(own_key(retry), lambda k: surrogate(m, k))
    owns = apart(others.groupBy("own").agg(F.min("entity").alias("one")), lambda retry: _let(under(F.col("one"), retry), _identity))
    rest = others.join(owns.select("own", "retry"), "own").select("entity", "kind", under(entity, F.col("retry")).alias("new"), F.lit(None).cast(_WORDS).alias("words"))
    return written(named_.unionByName(rest), "surrogates"), stems


def replace_entities(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with surrogates, and the number of entities replaced, in all and by kind."""
    found = found_in(docs, id_col, text_col)
    places = occurrences(found)
    entities = written(places.filter("not is_word").select("entity").distinct(), "entities")
    answers, _ = surrogates_of(entities, key)
    whole = written(places.filter("not is_word").join(answers, "entity").select("row", "at", "new", "kind", "words"), "replaced")
    # A word alone is what it is in the first name of its own text that has it.
    by_text = whole.filter("kind = 'person'").select("row", "at", F.explode("words").alias("w"))
    by_text = by_text.groupBy("row", F.col("w.low").alias("low")).agg(F.min(F.struct("at", F.col("w.at").alias("part_at"), "w.role", "w.gender", "w.stem")).alias("of"))
    own = found.select("row", F.explode("alone").alias("low")).join(by_text, ["row", "low"])
    words = places.filter("is_word").withColumn("low", F.lower("entity")).join(own, ["row", "low"], "left")
    new = F.when(F.col("of").isNotNull(), _word(F.col("entity"), F.col("of.stem"), F.col("of.role"), F.col("of.gender"))).otherwise(F.col("entity"))
    words = words.select("row", "at", new.alias("new"), F.when(F.col("of").isNotNull(), "person").alias("kind"))
    whole = whole.drop("words")
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    put = whole.unionByName(words).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("put"), F.count("kind").alias("n_entities"), *map(count, PATTERNS))
    counts = ["n_entities", *(f"n_{k}" for k in PATTERNS)]
    changed = found.filter("size(found) > 0").select("row", "doc_id", "gaps").join(put, "row")
    pieces = F.zip_with("gaps", F.col("put.new"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    changed = changed.select("doc_id", F.array_join(pieces, "").alias("text"), *counts)
    same = found.filter("size(found) = 0").select("doc_id", "text", *(F.lit(0).cast("long").alias(c) for c in counts))
    return changed.unionByName(same)


def op4_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))
