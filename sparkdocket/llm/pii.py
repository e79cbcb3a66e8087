"""PII surrogates with DataFrame functions only.

One pattern finds e-mail addresses, long hexadecimal secrets, IPv4 addresses,
payment cards, social security numbers, phone numbers, bank account numbers and
names after a form of address.  Each entity is reduced to a normal form, so that
all its spellings and occurrences in all documents refer to one surrogate, and a
keyed digest of the normal form fills the entity's own format:

* digits become digits, letters letters of the same case, punctuation stays;
* card numbers keep their first digit and pass the check-digit test (digit runs
  that fail it are no entities); bank account numbers keep their country and pass theirs; e-mail addresses keep their top-level domain; international phone numbers
  keep their country code; octets stay in range;
* names keep their forms of address and particles, get given names of the same gender and
  script, and surnames of the same script; a surname alone and with a given name
  maps to the same surrogate surname.  "Dr. John Smith" is "Mr. John Smith" if the
  corpus has just one of him and her.

Not found, since nothing but digits tells them from other numbers: social security
and phone numbers without separators, national phone numbers such as 030 12345678;
nor IPv6 addresses.

Distinct entities must get distinct surrogates and no surrogate may be an entity
of the corpus.  Both are checked over all distinct entities; where a check fails,
the digest is drawn anew with the next attempt number until none fails.  Surnames
have attempts of their own, over the distinct surnames, and given names within
their surname, so that a redrawn given name leaves the surname as it is.  Each
attempt at a name adds a syllable; in other kinds the format is kept for ``DRAWS``
attempts, and each later one adds a character, for formats with too few values.

The patterns run once over each text, which is written as its parts: what stands
between entities and the entities by turns.  All later steps read the parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocket.plans.staging import Scratch
from sparkdocket.plans.staging import stage as staged

# Forms of address by gender.
MALE = ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof"]
# Words that stand before a surname and stay.
PARTICLES = ["von", "vom", "van", "zu", "zum", "zur", "der", "den", "de", "del", "della", "des", "di", "da", "do", "dos", "du", "la", "las", "le", "los", "ter", "ten", "bin", "ibn", "al", "el"]
# Given names by script and gender.
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Emma", "Helen", "Julia", "Karin", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Pablo", "Robert", "Simon", "Victor"],
    ("latin", "n"): ["Alex", "Andrea", "Charlie", "Dominique", "Eden", "Jules", "Kim", "Lou", "Noa", "Pat", "Robin", "Sam", "Sascha", "Toni", "Val", "Yael"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Павел", "Степан"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Слава", "Шура", "Вася", "Паша", "Тоня"],
}
# Syllables of invented surnames.
SYLLABLES = {
    "latin": ["bal", "ber", "cor", "dan", "del", "fer", "gan", "hal", "kel", "lan", "mar", "mor", "nel", "par", "rin", "sol", "tal", "ter", "ven", "wal"],
    "cyrillic": ["бал", "вер", "гор", "дан", "кал", "лан", "мар", "нор", "пан", "рин", "сол", "тал", "фер", "хар", "чел", "шар"],
}

# Lengths of bank account numbers by country, to find them written with spaces.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

#: Draws within an entity's own format before its surrogate gets longer.
DRAWS = 12

_WORD = r"\p{Lu}[\p{L}'’-]+"
_BLANK = r"[  ]"
_CYRILLIC = r"^\p{IsCyrillic}"
_TITLE = "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=len, reverse=True))
#: Up to four forms of address, one after the other.
_TITLES = rf"(?:(?:{_TITLE})\.?{_BLANK}){{1,4}}"
_PARTICLES = "|".join(PARTICLES)
_SPACED_IBAN = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![0-9A-Za-z])" for n, codes in IBAN_LENGTHS.items())
#: Kinds and their patterns, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z+.-])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "iban": rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_SPACED_IBAN}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?![0-9A-Za-z]))",
    "name": rf"(?<![\p{{L}}]){_TITLES}(?:{_WORD}{_BLANK}){{0,2}}(?:(?:{_PARTICLES}){_BLANK}){{0,3}}{_WORD}",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these holds no entity; this is cheap to test.  Every match of every pattern holds one.
_HINT = rf"[0-9]{{3}}|@|[0-9]\.[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|[0-9a-f]{{32}}|[0-9A-F]{{32}}|(?:{_TITLE})\.?{_BLANK}(?:\p{{Lu}}|(?:{_PARTICLES}){_BLANK})"
_LOWER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def entities_of(text: Column) -> Column:
    """What the patterns match, in order; empty for a null text or one without any.

    Some of it may be no entity, see ``is_entity``.
    """
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(none)


#: Stands between the parts of a text while they are found; a noncharacter.
_CUT = "\ufdd0"


def parts_of(text: Column) -> Column:
    """A text's parts, gaps and matches by turns, first and last a gap; null for a null text."""
    marked = F.split(F.regexp_replace(text, f"({ANY})", f"{_CUT}$1{_CUT}"), _CUT, -1)
    gaps, found = F.split(text, f"(?:{ANY})", -1), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    by_turns = F.concat(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.array(g, m))), F.array(F.element_at(gaps, -1)))
    return F.when(~text.rlike(_HINT), F.array(text)).when(text.contains(_CUT), by_turns).when(text.isNotNull(), marked)


def kind_of(entity: Column) -> Column:
    """The kind whose whole pattern an entity matches, in the order of PATTERNS."""
    out = F.lit("name")
    for kind, pattern in [*PATTERNS.items()][-2::-1]:
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def is_entity(entity: Column) -> Column:
    """False for runs of digits that look like a card but fail its check digit."""
    return (kind_of(entity) != "card") | (_luhn_sum(F.regexp_replace(entity, "[^0-9]", "")) == 0)


def _bare_name(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^{_TITLES}", "")


def normal_form(entity: Column, kind: Column) -> Column:
    """What all spellings of an entity share."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    name = F.concat(_gender(entity), F.lit(" "), F.lower(F.regexp_replace(_bare_name(entity), r"[  ]", " ")))
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.lower(F.replace(entity, F.lit(" "), F.lit(""))))
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "name", name).otherwise(F.lower(entity))
    )


def _gender(entity: Column) -> Column:
    """m, f or n, by the first form of address that tells, else by a known given name."""
    titled = lambda titles: entity.rlike(rf"^(?:(?:{'|'.join(NEUTRAL)})\.?{_BLANK}){{0,3}}(?:{'|'.join(titles)})\.?{_BLANK}")
    given = F.regexp_extract(_bare_name(entity), rf"^({_WORD})[  ]", 1)
    known = lambda g: [n for (_, gender), names in GIVEN.items() if gender == g for n in names]
    return (
        F.when(titled(MALE), "m").when(titled(FEMALE), "f")
        .when(given.isin(known("m")), "m").when(given.isin(known("f")), "f").otherwise("n")
    )


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, not at each place where ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _byte(digest: Column, at: Column) -> Column:
    return F.conv(F.substring(digest, 2 * F.pmod(at, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(symbols: str, byte: Column) -> Column:
    return F.substring(F.lit(symbols), F.pmod(byte, F.lit(len(symbols))) + 1, F.lit(1))


def _like(original: Column, made: Column) -> Column:
    """``made`` with the case of ``original``, character by character."""
    return F.array_join(
        F.zip_with(F.split(made, ""), F.split(original, ""), lambda m, o: F.when(F.upper(o) != F.lower(o), F.when(o == F.upper(o), F.upper(m)).otherwise(m)).otherwise(m)), ""
    )


def _poured(original: Column, digits: Column) -> Column:
    """``original`` with its digits replaced in order by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(original, ""), start, step, lambda acc: acc["out"])


def _luhn_sum(digits: Column) -> Column:
    """Check sum modulo 10 of a digit string, its last digit being the check digit."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x), F.lit(10))


def _made_digits(digest: Column, count: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: _one_of(_DIGITS, _byte(digest, i))), "")


def _card(entity: Column, digest: Column) -> Column:
    old = F.regexp_replace(entity, "[^0-9]", "")
    n = F.length(old)
    body = F.concat(F.substring(old, 1, 1), F.substring(_made_digits(digest, n), F.lit(2), n - 2))
    last = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return _poured(entity, F.concat(body, last.cast("string")))


def _phone(entity: Column, digest: Column) -> Column:
    code = F.regexp_extract(entity, r"^(\+[0-9]{1,3})[ .(-]", 1)
    rest = F.substring(entity, F.length(code) + 1, F.length(entity))
    return F.concat(code, _poured(rest, _made_digits(digest, F.length(entity))))


def _address(entity: Column, digest: Column) -> Column:
    top = F.regexp_extract(entity, r"(\.[A-Za-z]+)$", 1)
    rest = F.substring(entity, F.lit(1), F.length(entity) - F.length(top))
    made = F.transform(
        F.split(F.lower(rest), ""),
        lambda c, i: F.when(c.rlike("^[a-z]$"), _one_of(_LOWER, _byte(digest, i))).when(c.rlike("^[0-9]$"), _one_of(_DIGITS, _byte(digest, i))).otherwise(c),
    )
    return F.concat(_like(rest, F.array_join(made, "")), top)


def _octets(digest: Column) -> Column:
    first = F.pmod(_byte(digest, F.lit(0)), F.lit(222)) + 1
    return F.concat_ws(".", first.cast("string"), *[_byte(digest, F.lit(k)).cast("string") for k in (1, 2, 3)])


def _coded(entity: Column, digest: Column, hexadecimal: bool) -> Column:
    letters = _HEX[10:] if hexadecimal else _LOWER
    bare = F.replace(entity, F.lit(" "), F.lit(""))
    made = F.transform(
        F.split(F.lower(bare), ""),
        lambda c, i: F.when(c.rlike("^[0-9]$"), _one_of(_DIGITS, _byte(digest, i))).otherwise(_one_of(letters, _byte(digest, i))),
    )
    return _spaced(entity, _like(bare, F.array_join(made, "")))


def _mod97(code: Column) -> Column:
    """A code of digits and letters (A is 10, Z is 35) modulo 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(code, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def _iban(entity: Column, digest: Column) -> Column:
    """Country and format stay, and the check digits fit."""
    country, rest = F.substring(entity, 1, 2), F.substring(entity, F.lit(3), F.length(entity))
    made = F.replace(_coded(rest, digest, False), F.lit(" "), F.lit(""))
    account = F.substring(made, F.lit(3), F.length(made))
    check = lambda a: F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, _let(account, lambda a: _spaced(rest, F.concat(check(a), a))))


def _spaced(original: Column, made: Column) -> Column:
    """``made``, which has no spaces, with spaces where ``original`` has them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(
            F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substring(made, acc["at"], F.lit(1)))).alias("out"),
            (acc["at"] + (c != " ").cast("int")).alias("at"),
        )

    return F.when(original.contains(" "), F.aggregate(F.split(original, ""), start, step, lambda acc: acc["out"])).otherwise(made)


def _syllables(digest: Column, count: Column, script: str) -> Column:
    """Up to 32 syllables, each from two bytes of the digest."""
    parts = F.array(*[F.lit(x) for x in SYLLABLES[script]])

    def pick(k: Column) -> Column:
        high = F.when(k < 8, k).otherwise(2 * k)
        low = F.when(k < 8, k + 8).otherwise(2 * k + 1)
        return F.element_at(parts, F.pmod(_byte(digest, high) * 256 + _byte(digest, low), F.size(parts)) + 1)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(count, F.lit(32)) - 1), pick), "")


def _part_digest(part: str, word: Column, key: str, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(part), F.lower(word), attempt.cast("string")), 512)


def _stem(word: Column, key: str, attempt: Column, script: str) -> Column:
    """A made surname in lower case, without an ending."""
    return _let(_part_digest("surname", word, key, attempt), lambda digest: _syllables(digest, 4 + attempt, script))


def _titled(word: Column) -> Column:
    return _let(word, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))


def _cased(made: Column, word: Column) -> Column:
    return _let(made, lambda m: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(m)).otherwise(m))


def _surname(word: Column, key: str, attempt: Column, script: str, gender: Column) -> Column:
    made = _stem(word, key, attempt, script)
    if script == "cyrillic":
        made = F.concat(made, F.when(gender == "f", F.lit("ова")).otherwise(F.lit("ов")))
    return _cased(_titled(made), word)


def _given(word: Column, key: str, attempt: Column, script: str, gender: Column) -> Column:
    """A given name of the gender; later attempts are double names."""

    def drawn(digest: Column) -> Column:
        first = F.lit(None).cast("string")
        for g in ("n", "f", "m"):
            names = F.array(*[F.lit(n) for n in GIVEN[script, g]])
            first = F.when(gender == g, F.element_at(names, F.pmod(_byte(digest, F.lit(0)), F.size(names)) + 1)).otherwise(first)
        second = _let(F.sha2(digest, 512), lambda d: _titled(_syllables(d, attempt + 1, script)))
        return F.concat(first, F.when(attempt > 0, F.concat(F.lit("-"), second)).otherwise(F.lit("")))

    return _cased(_let(_part_digest("given", word, key, attempt), drawn), word)


def _given_words(bare: Column) -> Column:
    """The given names of a name without form of address, an array: all words before the last but particles."""
    words = F.split(bare, _BLANK)
    return F.filter(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: ~w.rlike(r"^\p{Ll}"))


def _name(entity: Column, key: str, attempt: Column, surname_attempt: Column, as_gender: Column | None = None) -> Column:
    """Forms of address and particles stay; given names by gender and script, surname by script."""

    def made(bare: Column, words: Column, gender: Column, script: str) -> Column:
        prefix = F.substring(entity, F.lit(1), F.length(entity) - F.length(bare))
        before = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.concat(F.when(w.rlike(r"^\p{Ll}"), w).otherwise(_given(w, key, attempt, script, gender)), F.lit(" ")))
        surname = _surname(F.element_at(words, -1), key, surname_attempt, script, gender)
        return F.concat(prefix, F.array_join(before, ""), surname)

    def whole(bare: Column) -> Column:
        known = _gender(entity) if as_gender is None else F.coalesce(as_gender, _gender(entity))
        each = lambda script: _let(F.split(bare, _BLANK), lambda words: _let(known, lambda gender: made(bare, words, gender, script)))
        return F.when(bare.rlike(_CYRILLIC), each("cyrillic")).otherwise(each("latin"))

    return _let(_bare_name(entity), whole)


def surrogate_of(entity: Column, key: str, attempt: Column, surname_attempt: Column | None = None, as_gender: Column | None = None) -> Column:
    """The replacement of one entity under a key; attempts are 0 unless there was a collision.

    ``as_gender`` is the gender of a name whose form of address does not tell it.
    """
    late = attempt - DRAWS
    more = lambda digest, symbols: F.when(late > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(late, F.lit(1))), lambda i: _one_of(symbols, _byte(digest, 64 - i))), "")).otherwise(F.lit(""))

    def made(kind: Column, digest: Column) -> Column:
        by_kind = [
            ("email", F.concat(more(digest, _LOWER), _address(entity, digest))), ("secret", _coded(entity, digest, True)),
            ("ipv4", F.concat(_octets(digest), F.when(late > 0, F.lit(".")).otherwise(F.lit("")), more(digest, _DIGITS))),
            ("ssn", F.concat(_poured(entity, _made_digits(digest, F.lit(9))), more(digest, _DIGITS))), ("card", _card(entity, digest)), ("phone", F.concat(_phone(entity, digest), more(digest, _DIGITS))),
            ("iban", _iban(entity, digest)),
        ]
        name = _name(entity, key, attempt, F.lit(0) if surname_attempt is None else surname_attempt, as_gender)
        return reduce(lambda other, m: F.when(kind == m[0], m[1]).otherwise(other), reversed(by_kind), name)

    seed = lambda kind: F.sha2(F.concat_ws("|", F.lit(key), kind, normal_form(entity, kind), attempt.cast("string")), 512)
    return _let(kind_of(entity), lambda kind: _let(seed(kind), lambda digest: made(kind, digest)))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks: making a surrogate takes long and the tables are small files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _settled(forms: DataFrame, scope: list[str], make, taken, label: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``forms`` (``scope``, ``form``, ...) with the ``attempt`` at which no made value is shared within the scope or taken.

    ``make`` gives the made value of a row; ``taken`` the rows of a table with ``made`` whose values must not be used, or is None.
    Of those that share a value the one of fewest attempts keeps it, so that settled ones stay.  Made values get longer with
    further attempts, so that there always are enough.
    """
    state, changed, stage = forms.withColumn("attempt", F.lit(0)), False, scratch.stage
    while True:
        made = stage(_spread(state, *scope, "form").withColumn("made", make), f"pii-made-{label}")
        own = F.min(F.struct("attempt", "form"))["form"].alias("owner")
        shared = made.groupBy(*scope, "made").agg(own, F.count(F.lit(1)).alias("n")).where("n > 1")
        again = made.join(shared, [*scope, "made"]).where("form <> owner").select(*scope, "form")
        if taken is not None:
            again = again.union(taken(made).select(*scope, "form"))
        again = stage(again.distinct(), f"pii-again-{label}")
        if again.isEmpty():
            return made.drop("made"), changed
        changed = True
        state = made.drop("made").join(again.withColumn("again", F.lit(1)), [*scope, "form"], "left")
        state = state.withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again")


def collision_attempts(entities: DataFrame, key: str) -> DataFrame | None:
    """Attempt numbers (``kind, norm, attempt, surname_attempt, as_gender``) of entities whose first surrogate collided,
    and of names whose gender another form of address tells.

    ``entities`` has a column ``entity``.  None if no surrogate is shared by two
    normal forms of a kind or equals an entity of the corpus.
    """
    scratch = Scratch()
    out = _attempts(entities, key, scratch)
    scratch.clear()
    return out


def _attempts(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame | None:
    stage = scratch.stage
    entity, attempt = F.col("entity"), F.col("attempt")
    forms = _spread(entities, "entity").select("entity", kind_of(entity).alias("kind")).withColumn("norm", normal_form(entity, F.col("kind")))
    forms = stage(forms.groupBy("kind", "norm").agg(F.min("entity").alias("entity")), "pii-forms")

    others = forms.where("kind <> 'name'").withColumnRenamed("norm", "form")
    real = others.select("kind", F.col("form").alias("made"))
    values, changed = _settled(others, ["kind"], _let(surrogate_of(entity, key, attempt), lambda e: normal_form(e, F.col("kind"))), lambda made: made.join(real, ["kind", "made"], "left_semi"), "values", scratch)

    bare = _bare_name(entity)
    names = forms.where("kind = 'name'").select(
        "norm", bare.rlike(_CYRILLIC).alias("cyrillic"), _gender(entity).alias("gender"), F.substring("norm", F.lit(3), F.length("norm")).alias("bare"),
        F.lower(F.element_at(F.split(bare, _BLANK), -1)).alias("last"), F.when(F.size(_given_words(bare)) > 0, F.lower(F.array_join(_given_words(bare), " "))).alias("given"),
    )
    # A name whose gender is not told is the one name of a told gender that is the same otherwise, if there is exactly one.
    told = names.where("gender <> 'n'").groupBy("bare").agg(F.min("gender").alias("as_gender"), F.max("gender").alias("other")).where("as_gender = other").drop("other")
    names = names.join(told, "bare", "left").withColumn("as_gender", F.when((F.col("gender") == "n") & F.col("given").isNotNull(), F.col("as_gender")))
    names = stage(names.withColumn("as_norm", F.when(F.col("as_gender").isNotNull(), F.concat("as_gender", F.lit(" "), "bare")).otherwise(F.col("norm"))), "pii-names")
    both = lambda make: F.when(F.col("cyrillic"), make("cyrillic")).otherwise(make("latin"))
    lasts = names.select("cyrillic", F.col("last").alias("form")).distinct()

    def in_use(made: DataFrame) -> DataFrame:
        stem = F.col("made")
        whole = F.when(F.col("cyrillic"), F.array(F.concat(stem, F.lit("ов")), F.concat(stem, F.lit("ова")))).otherwise(F.array(stem))
        return made.withColumn("whole", F.explode(whole)).join(lasts.select(F.col("form").alias("whole")).distinct(), "whole", "left_semi")

    surnames, new_surnames = _settled(lasts, ["cyrillic"], both(lambda script: _stem(F.col("form"), key, attempt, script)), in_use, "surnames", scratch)
    # A made surname belongs to one surname and is none of the corpus: given names need only differ within it.
    given = names.where("given IS NOT NULL AND as_gender IS NULL").select("cyrillic", "last", "gender", "norm", F.col("given").alias("form"))
    each_given = lambda script: F.array_join(F.transform(F.split("form", " "), lambda w: _given(w, key, attempt, script, F.col("gender"))), " ")
    firsts, new_firsts = _settled(given, ["cyrillic", "last", "gender"], F.lower(both(each_given)), None, "given", scratch)
    if not (changed or new_surnames or new_firsts) and names.where("as_gender IS NOT NULL").isEmpty():
        return None
    tries = names.join(surnames.select("cyrillic", F.col("form").alias("last"), attempt.alias("surname_attempt")), ["cyrillic", "last"])
    tries = tries.join(firsts.select(F.col("norm").alias("as_norm"), "attempt"), "as_norm", "left").select(F.lit("name").alias("kind"), "norm", F.coalesce("attempt", F.lit(0)).alias("attempt"), "surname_attempt", "as_gender")
    tries = tries.union(values.select("kind", "form", "attempt", F.lit(0), F.lit(None).cast("string")))
    return staged(tries.where("attempt > 0 OR surname_attempt > 0 OR as_gender IS NOT NULL"), "pii-attempts").df


def replace_pii(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """Replace every entity in ``text_col`` by its surrogate; other columns stay, whatever their names.

    ``count_col`` (int, replaces a clashing column; left out where None) counts the
    entities.  A null text stays null with count 0, an empty one empty.  Rows are
    independent but for the collision check, whatever their ids; repeated rows get
    equal results, very long texts are replaced whole, and an empty table stays
    empty.
    """
    kept = [(n, c) for n, c in enumerate(docs.columns) if c != text_col and (count_col is None or c.lower() != count_col.lower())]
    own = [F.col(f"`{c}`").alias(f"own_{n}") for n, c in kept]
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), *own, parts_of(F.col(text_col)).alias("parts")), "pii-parts").df
    matches = F.filter("parts", lambda x, i: i % 2 == 1)
    found = rows.where(F.size("parts") > 1).select("row", F.explode(F.array_distinct(matches)).alias("entity"))
    clashes = collision_attempts(found.select("entity").distinct().where(is_entity(F.col("entity"))), key)
    if clashes is None:
        made_of = lambda e: surrogate_of(e, key, F.lit(0))
        base = rows
    else:
        # Attempt numbers travel to the rows that hold such entities.
        spots = found.withColumn("kind", kind_of(F.col("entity"))).withColumn("norm", normal_form(F.col("entity"), F.col("kind")))
        per_row = (
            spots.join(clashes, ["kind", "norm"]).select("row", "entity", F.struct("attempt", "surname_attempt", "as_gender").alias("try"))
            .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "try"))).alias("tries"))
        )
        base = rows.join(per_row, "row", "left")
        tries = lambda e, part: F.coalesce(F.element_at(F.col("tries"), e)[part], F.lit(0))
        made_of = lambda e: surrogate_of(e, key, tries(e, "attempt"), tries(e, "surname_attempt"), F.element_at(F.col("tries"), e)["as_gender"])
    woven = F.array_join(F.transform("parts", lambda x, i: F.when((i % 2 == 1) & is_entity(x), made_of(x)).otherwise(x)), "")
    new_text = F.when(F.size("parts") > 1, woven).otherwise(F.col("parts")[0])
    names = {c: F.col(f"own_{n}") for n, c in kept} | {text_col: new_text}
    out = [names[c].alias(c) for c in docs.columns if c in names]
    if count_col is not None:
        out.append(F.coalesce(F.size(F.filter(matches, is_entity)), F.lit(0)).alias(count_col))
    return base.select(*out)


#: Production key of the registered query and of the pipeline.  A deployment sets its own.
DEMO_KEY = "rotate-me"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, key=DEMO_KEY)


QUERIES = {"op9_pii_surrogates": op9_pii_surrogates}
ORACLE: dict[str, str] = {}
