"""Personal data: detected entities get keyed surrogates of the same type and format.

Detection is one regular expression, so a text is scanned once and never overlaps.
Distinct entities of the corpus form a dictionary: canonical value -> surrogate, drawn
from a keyed digest.  A surrogate that another entity already has, or that is itself an
entity of the corpus, is drawn again until none is left, so different entities stay
different.  After a few draws each further one has more room than the one before (longer
names and addresses; numbers only where their format is all but full), so this ends for
every corpus.  One canonical value has one surrogate, so repeated mentions stay the same
person, address or number.  Each word of a name is an entity of its own: a given name, if
others follow, or a surname; particles (van, de la) stay.  The dictionary is joined to the
documents that hold entities.  Everything is a DataFrame expression.
"""

from __future__ import annotations

import functools
import itertools
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.sources.storage import materialize

#: Session setting that holds the key of the surrogates: whoever knows it can draw them again.
KEY_SETTING = "spark.buildlens.surrogates.key"
#: Draws within the shortest room of names, mail addresses and secrets; each later draw is one syllable or character longer.
DRAWS = 4
#: Draws within the format of numbers and keys; each later draw is one character longer (an IP address: IPv6, documentation block).
FORMAT_DRAWS = 32

# ---- fixed values: patterns, honorifics, names, alphabets -------------------------------------------------
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Г-жа", "Госпожа", "Κυρία", "Mlle", "Mademoiselle", "Señorita", "Srta", "Lady"]
#: Titles of any gender, alone or after one of the others.
TITLES = ["Dr", "Dra", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Profesor", "Profesora", "Ing", "Dipl"]
#: Small words inside a name.
PARTICLES = ["van", "von", "vom", "zu", "zur", "zum", "der", "den", "dem", "ter", "ten", "de", "del", "della", "delle", "di", "da", "dal", "das", "do", "dos",
             "du", "des", "la", "las", "le", "les", "lo", "los", "y", "e", "und", "bin", "ibn", "ben", "al", "el", "af", "av"]
#: Words before a number that is no phone number, and units after it.
LABELS = ["order", "orders", "isbn", "issn", "ean", "invoice", "item", "items", "article", "serial", "ref", "sku", "ticket", "page", "build", "version",
          "bestellung", "rechnung", "artikel", "seite", "commande", "facture", "pedido", "factura", "página"]
UNITS = ["units", "unit", "pieces", "pcs", "items", "users", "rows", "records", "bytes", "tokens", "words", "people", "euro", "euros", "eur", "usd", "dollars", "kg", "km", "stück",
         "einheiten", "unités", "pièces", "unidades", "piezas"]
#: A possessive 's is no part of a name.
NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L})))++"
HEXES = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around '::' with a digit and a group of three or more.
IPV6 = (rf"(?:(?:{HEXES}:){{7}}{HEXES}|(?=[0-9A-Fa-f:]*[0-9])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})"
        rf"(?:(?:{HEXES}:){{1,6}}(?::{HEXES}){{1,6}}|(?:{HEXES}:){{1,7}}:|:(?::{HEXES}){{1,7}}))(?![\p{{L}}\p{{N}}:]|\.[0-9])")
#: Phone groupings: North American, unbroken international, international; national ones of North America, fr, en/de and es.
PHONES = [
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", r"\+[0-9]{8,15}",
    r"(?=(?:\+|00)(?:[ ./()-]{0,2}[0-9]){8})(?:\+[1-9][0-9]{0,2}[ ./-]?|00[1-9][0-9]{0,2}[ ./-])(?:\([0-9]{1,5}\)[ ./-]?)?"
    r"(?:[0-9]{1,4}(?:[ .-][0-9]{2}){3,4}|[0-9]{1,4}[ .-][0-9]{3}(?:[ .-][0-9]{2}){2}|[0-9]{2,5}[ ./-][0-9]{3,4}[ .-][0-9]{3,4}"
    r"|[0-9]{2,5}[ ./-][0-9]{5,8}|[0-9]{7,12}|[0-9]{1,5}(?:[ ./-][0-9]{2,8}){1,3})",
]
NATIONAL_PHONES = [
    r"(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    r"0[1-9](?<pfr>[ .-])[0-9]{2}(?:\k<pfr>[0-9]{2}){3}",
    r"(?:\(0[1-9][0-9]{0,3}\) ?|0[1-9][0-9]{0,3}[ /-])[0-9]{3,4}[ -][0-9]{3,4}",
    r"(?:\(0[1-9][0-9]{0,3}\) ?|0[1-9][0-9]{1,3}[ /-])(?:[0-9]{5,8}|[0-9]{2,3}(?: [0-9]{2}){2,3})",
    r"(?<![0-9][ .,])(?:[6-9][0-9]{2}(?<pes>[ -])[0-9]{3}\k<pes>[0-9]{3}|[689][0-9]{2}(?<pet>[ .-])[0-9]{2}(?:\k<pet>[0-9]{2}){2}"
    r"|[89][0-9](?<peu>[ -])[0-9]{3}(?:\k<peu>[0-9]{2}){2})(?![ .,-][0-9])",
]
NATIONAL = (rf"(?=[0-9(])(?<!(?<!\p{{L}})(?i:{'|'.join(LABELS)})[ :.#]{{1,3}})(?:{'|'.join(NATIONAL_PHONES)})"
            rf"(?![\p{{L}}\p{{N}}]| (?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))")
_TITLED = (rf"(?:(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? (?:(?:{'|'.join(TITLES)})\.? )*+|(?:(?:{'|'.join(TITLES)})\.? )++)")
#: Type -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]++\.)+[\p{L}]{2,24}",
    "secret": r"(?i:password|passwd|pwd|secret|token|api_key|apikey)\s?[=:]\s?(?:\"[^\"\s]{6,}+\"|[^\s\",;]{6,}+)",
    "access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}])",
    "ip": rf"(?:(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])|{IPV6})",
    "card": r"(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "phone": rf"(?:(?:{'|'.join(PHONES)})(?![\p{{L}}\p{{N}}])|{NATIONAL})",
    "name": rf"{_TITLED}{NAME}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}+{NAME})*+",
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Marco"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"],
    ("greek", "m"): ["Αλέξης", "Γιάννης", "Δημήτρης", "Κώστας"],
    ("greek", "f"): ["Άννα", "Ελένη", "Κατερίνα", "Μαρία"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fal", "gor", "han", "kel", "lin", "mar", "nov", "per", "ros", "sal", "tor", "ven", "wil", "zan"],
    "cyrillic": ["ба", "вел", "гор", "дан", "жев", "зор", "кол", "лин", "мир", "нов", "пет", "рос", "сав", "тор", "фед", "чер"],
    "greek": ["βα", "γερ", "δαν", "κολ", "λιν", "μαρ", "νικ", "παπ"],
}
SURNAME_END = {("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ης", ("greek", "f"): "η"}
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
ALNUM = LOWER + UPPER + DIGITS
CYRILLIC, CYRILLIC_UPPER = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
GREEK, GREEK_UPPER = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
SAFE_TLDS = ["com", "net", "org"]
# ---- end of fixed values ----------------------------------------------------------------------------------

#: A match starts where a word or number starts.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + ")"
#: A capitalised word, which may be an untitled mention of a name.
MENTION = rf"(?<![\p{{L}}\p{{N}}]){NAME}(?![\p{{L}}\p{{N}}])"
TITLE = "^" + _TITLED
_TMP = "__pii_"


def entities(text: Column) -> Column:
    """All entity strings of a text in order; NULL text gives NULL."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def entity_type(surface: Column) -> Column:
    """Type of an entity string: the first pattern that matches the whole of it; NULL for a
    number that looks like a card but fails its check digit, which is no entity."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(surface.rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    digits = F.regexp_replace(surface, "[^0-9]", "")
    return F.when((kind == "card") & (_luhn_sum(digits) % 10 != 0), F.lit(None)).otherwise(kind)


def canonical(kind: Column, surface: Column) -> Column:
    """What stays the same between mentions: case of an address, punctuation of a number, an IPv6 address written out."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    groups = lambda side: F.filter(F.split(F.substring_index(F.lower(surface), "::", side), ":"), lambda g: g != "")
    left, right = groups(1), F.when(F.contains(surface, F.lit("::")), groups(-1)).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    ipv6 = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    return (F.when(kind == "email", F.lower(surface)).when(kind.isin("phone", "card", "ssn"), digits)
            .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
            .when(kind == "secret", F.trim(F.replace(F.regexp_extract(surface, r"[=:](.*)$", 1), F.lit('"'), F.lit(""))))
            .when((kind == "ip") & F.contains(surface, F.lit(":")), ipv6).otherwise(surface))


def untitled(surface: Column) -> Column:
    return F.regexp_replace(surface, TITLE, "")


def name_words(surface: Column) -> Column:
    """The capitalised words of a titled name."""
    return F.filter(F.split(untitled(surface), " "), lambda w: w.rlike(r"^\p{Lu}"))


def values(kind: Column, surface: Column) -> Column:
    """The canonical values of a mention, each with a surrogate of its own: one, or given name and surnames.

    A given name has a gender if the title tells it, a surname only where its ending shows it.
    """
    words, gender = name_words(surface), _gender(surface)
    surname = lambda w: F.concat_ws("|", F.lit("surname"), F.when(_script(w) == "latin", "").otherwise(gender), w)
    given = F.concat_ws("|", F.lit("given"), gender, F.get(words, 0))
    named = F.transform(words, lambda w, i: F.when((i == 0) & (F.size(words) > 1), given).otherwise(surname(w)))
    return F.when(kind != "name", F.array(canonical(kind, surface))).otherwise(named)


def _bare(kind: Column, value: Column) -> Column:
    return F.when(kind == "name", F.substring_index(value, "|", -1)).otherwise(value)


def _gender(surface: Column) -> Column:
    return (F.when(surface.rlike("^(?:" + "|".join(MALE_TITLES) + r")\.? "), "m")
            .when(surface.rlike("^(?:" + "|".join(FEMALE_TITLES) + r")\.? "), "f").otherwise("n"))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.try_to_number(F.substr(digits, n - i, F.lit(1)), F.lit("9")).cast("int"))
    return F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)),
                       F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, i % 60 * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, at: Column) -> Column:
    return F.substr(F.lit(alphabet), at % len(alphabet) + 1, F.lit(1))


def _choose(values: list[str], at: Column) -> Column:
    return F.get(F.lit(values), at % len(values))


def _same_shape(value: Column, digest: Column, digits_only: bool = False) -> Column:
    """Every letter and digit replaced by one of its class; everything else stays."""
    def one(c: Column, i: Column) -> Column:
        at = _byte(digest, i)
        number = F.when(c.rlike("[0-9]"), _pick(DIGITS, at))
        if digits_only:
            return number.otherwise(c)
        return (number.when(c.rlike("[A-Z]"), _pick(UPPER, at)).when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick(CYRILLIC_UPPER, at)).otherwise(_pick(CYRILLIC, at)))
                .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), _pick(GREEK_UPPER, at)).otherwise(_pick(GREEK, at)))
                .when(c.rlike(r"\p{L}"), _pick(LOWER, at)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def surrogate(kind: Column, value: Column, attempt: int, key: str) -> Column:
    """Surrogate of a canonical value: a pure function of key, type, value and attempt."""
    def keyed(*parts: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, *parts, F.lit(str(attempt))), 512)

    digest = keyed(value)
    at = lambda i: _byte(digest, F.lit(i))
    longer, over = max(attempt - DRAWS + 1, 0), max(attempt - FORMAT_DRAWS + 1, 0)

    def string(alphabet: str | list[str], n: int | Column) -> Column:
        """n drawn characters or syllables; their digest is new for every 30, so the room grows with n."""
        def one(i: Column) -> Column:
            own = keyed(value, F.lit("more"), F.floor(i / 30).cast("string"))
            place = F.conv(F.substr(own, i % 30 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return _pick(alphabet, place) if isinstance(alphabet, str) else _choose(alphabet, place)
        return F.lit("") if isinstance(n, int) and n == 0 else F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n) - 1), one), "")

    more = string(DIGITS, over)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    host = F.substring_index(domain, ".", 1)
    host_digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), domain), 512)  # a shared domain stays shared
    email = F.concat(_same_shape(local, digest), string(LOWER, longer), F.lit("@"), _same_shape(host, host_digest), F.lit(".example."),
                     F.when(tld.isin(SAFE_TLDS), tld).otherwise("org"))
    block = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.lower(F.conv(F.substr(digest, F.lit(4 * i + 1), F.lit(4)), 16, 16))) for i in range(6)])
    ip = F.when(F.lit(over > 0) | F.contains(value, F.lit(":")), block).otherwise(F.concat_ws(".", F.lit(240) + at(0) % 16, at(1) % 256, at(2) % 256, at(3) % 256))  # reserved block
    drawn = _same_shape(value, digest, digits_only=True)
    body = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(drawn) - 2), more)
    card = F.concat(body, ((F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    ssn = F.concat(F.lit("9"), F.substr(drawn, F.lit(2), F.lit(8)), more)  # never issued
    prefix = (F.when(value.startswith("00"), 4).when(value.startswith("0"), 1)
              .otherwise(F.length(value) - F.least(F.length(value), F.lit(10))))  # a country code or leading 0 stays
    phone = F.concat(F.substr(value, F.lit(1), prefix), _pick("23456789", at(61)),
                     F.substr(drawn, prefix + 2, F.length(value)), more)
    iban = F.concat(F.substr(value, F.lit(1), F.lit(2)), _same_shape(F.substr(value, F.lit(3), F.length(value)), digest), more)
    access = F.concat(F.substr(value, F.lit(1), F.lit(4)), _same_shape(F.substr(value, F.lit(5), F.length(value)), digest), more)
    hexed = F.array_join(F.transform(F.split(value, ""), lambda c, i: _pick(HEX, _byte(digest, i))), "")
    free = F.lit(longer > 0) | ~value.rlike(r"[0-9\p{L}]")  # nothing in it that a draw could replace
    secret = (F.when(free, string(ALNUM, F.length(value) + longer)).when(value.rlike("^[0-9a-f]+$"), hexed)
              .otherwise(_same_shape(value, digest)))
    role, gender, word = F.substring_index(value, "|", 1), F.split_part(value, F.lit("|"), F.lit(2)), _bare(F.lit("name"), value)
    script = _script(word)
    name = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        end = F.when(gender == "m", SURNAME_END.get((s, "m"), "")).when(gender == "f", SURNAME_END.get((s, "f"), "")).otherwise("")
        surname = F.initcap(F.concat(*[_choose(syllables, at(i)) for i in (5, 9, 13)], string(syllables, longer), end))
        drawn_given = F.initcap(F.concat(_choose(syllables, at(5)), _choose(syllables, at(9)), string(syllables, longer)))
        male, female = GIVEN[(s, "m")], GIVEN[(s, "f")]
        given = drawn_given if longer else (F.when(gender == "m", _choose(male, at(1))).when(gender == "f", _choose(female, at(1)))
                                            .otherwise(_choose(male + female, at(1))))
        name = F.when(script == s, F.when(role == "given", given).otherwise(surname)).otherwise(name)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn)
            .when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "access_key", access)
            .when(kind == "secret", secret).when(kind == "name", name).otherwise(drawn))


def render(kind: Column, surface: Column, value: Column) -> Column:
    """The surrogate in the mention's own punctuation, title, spacing and quotes."""
    mask = F.when(kind == "iban", "[A-Za-z0-9]").otherwise("[0-9]")
    chars = F.split(surface, "")
    counts = F.transform(chars, lambda c: F.when(F.regexp(c, mask), 1).otherwise(0))
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(
        F.regexp(c, mask), F.substr(value, F.aggregate(F.slice(counts, 1, i + 1), F.lit(0), lambda a, x: a + x), F.lit(1))).otherwise(c)), "")
    filled = F.concat(filled, F.substr(value, F.aggregate(counts, F.lit(1), lambda a, x: a + x), F.length(value)))  # a longer one's rest
    old = canonical(F.lit("secret"), surface)
    secret = F.concat(F.substr(surface, F.lit(1), F.length(surface) - F.length(old) - F.when(surface.endswith('"'), 1).otherwise(0)),
                      value, F.when(surface.endswith('"'), F.lit('"')).otherwise(F.lit("")))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "secret", secret).otherwise(value)


def render_name(surface: Column, to: Column) -> Column:
    """A titled name with its capitalised words replaced in turn; title and particles stay."""
    words, capital = F.split(untitled(surface), " "), lambda w: w.rlike(r"^\p{Lu}")
    place = lambda i: F.size(F.filter(F.slice(words, 1, i + 1), capital))
    return F.concat(F.regexp_extract(surface, TITLE, 0), F.array_join(F.transform(
        words, lambda w, i: F.when(capital(w), F.get(to, place(i) - 1)).otherwise(w)), " "))


@functools.cache
def _drawn_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, one drawn for this application, which nobody can use again."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_key()


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """``surface, kind, surrogates`` for distinct entity strings (column ``surface``): one surrogate of
    each of its ``values``.  A surrogate of a name is no other name's, given or last."""
    surfaces = materialize(
        found.select("surface").distinct().withColumn("kind", entity_type(F.col("surface")))
        .where(F.col("kind").isNotNull()).select("surface", "kind", F.posexplode(values(F.col("kind"), F.col("surface"))).alias("pos", "value")), "pii-surfaces")
    waiting = materialize(surfaces.select("kind", "value").distinct(), "pii-entities")
    taken = surfaces.select("kind", _bare(F.col("kind"), F.col("value")).alias("surrogate")).distinct()
    settled = None
    for n in itertools.count():
        drawn = materialize(waiting.withColumn("attempt", F.lit(n)).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), n, key)), "pii-drawn")
        # The smallest value keeps a surrogate that several draw: found by partial aggregation, joined on the value, so no draw is a hot key.
        owner = (drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
                 .join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", F.lit(False).alias("lost")))
        marked = materialize(drawn.join(owner, ["kind", "value"], "left").withColumn("again", F.coalesce("lost", F.lit(True))).drop("lost"), "pii-state")
        done, waiting = marked.where(~F.col("again")).drop("again"), marked.where("again").select("kind", "value")
        settled = done if settled is None else settled.unionByName(done)
        if waiting.isEmpty():
            return (surfaces.join(settled, ["kind", "value"]).groupBy("surface", "kind")
                    .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))), lambda p: p["surrogate"]).alias("surrogates")))
        taken = taken.unionByName(done.select("kind", "surrogate"))


def _name_keys(surface: Column, to: Column) -> Column:
    """``key, rank, to`` of a titled name's untitled mentions: each of its words alone, and beside its neighbours."""
    words, n = name_words(surface), F.size(to)
    alone = F.transform(words, lambda w, i: F.struct(F.concat(F.lit("0|"), w).alias("key"), F.when(i == n - 1, 0).when(i == 0, 1).otherwise(2).alias("rank"),
                                                     F.get(to, i).alias("to")))
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    beside = lambda mark, shift: F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda _, i: F.struct(
        F.concat(F.lit(mark), pair(i)).alias("key"), F.lit(0).alias("rank"), F.get(to, i + shift).alias("to")))
    return F.concat(alone, beside("1|", 0), beside("2|", 1))


def _mentions(pieces: Column, by_name: Column) -> Column:
    """For every piece ``rest, words, to``: capitalised words, the text around them, and what replaces each (NULL: it stays)."""
    def beside(mark: str, space: Column, one: Column, two: Column) -> Column:
        return F.when(space.rlike(r"^\s$"), F.concat(F.lit(mark), one, F.lit(" "), two))

    def replaced(p: Column, by: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            keys = (beside("1|", F.get(p["rest"], i + 1), w, F.get(p["words"], i + 1)),
                    beside("2|", F.get(p["rest"], i), F.get(p["words"], i - 1), w), F.concat(F.lit("0|"), w))
            return F.coalesce(*[F.element_at(by, k) for k in keys])
        return F.struct(p["rest"].alias("rest"), p["words"].alias("words"), F.transform(p["words"], one).alias("to"))

    split = F.transform(pieces, lambda p: F.struct(F.split(p, MENTION, -1).alias("rest"), F.regexp_extract_all(p, F.lit(MENTION), F.lit(0)).alias("words")))
    once = F.array(F.struct(by_name.alias("by"), split.alias("split")))  # the map is built once a row
    return F.get(F.transform(once, lambda o: F.transform(o["split"], lambda p: replaced(p, o["by"]))), 0)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None, report: str | None = None) -> DataFrame:
    """The table with every entity of ``text_col`` replaced; other columns unchanged.

    The words of a name that has a title somewhere in a text are replaced in that text
    without it, too.  Names and secrets have any length; very long texts are read whole.
    Numbers that only look like cards stay, so do national phone groupings after the name
    of another number (order, ISBN) or before a unit.  NULL and empty texts and texts
    without entities pass as they are.  Rows that repeat are each rewritten alike; an empty
    table stays empty; columns keep their names and values, whatever they are called.
    ``key`` draws the surrogates: the session's (``session_key``) if none is given.
    ``report`` adds an array column ``<kind, surface, replacement>`` of the distinct
    replacements (empty where there are none).
    """
    key = key or session_key(docs.sparkSession)
    columns = docs.columns
    ents, row, repl, names = f"{_TMP}entities", f"{_TMP}row", f"{_TMP}map", f"{_TMP}names"
    tagged = docs.withColumn(ents, entities(F.col(text_col)))
    hits = materialize(tagged.where(F.size(ents) > 0).withColumn(row, F.monotonically_increasing_id()), "pii-hits")
    mentions = hits.select(F.col(row).alias("row"), F.explode(F.array_distinct(ents)).alias("surface"))
    rendered = F.when(F.col("kind") == "name", render_name(F.col("surface"), F.col("surrogates"))).otherwise(
        render(F.col("kind"), F.col("surface"), F.get("surrogates", F.lit(0))))
    words = materialize(dictionary(mentions, key).withColumn("replacement", rendered)
                        .select("surface", "kind", "replacement", F.when(F.col("kind") == "name", F.col("surrogates")).alias("to")), "pii-words")
    named = (mentions.join(words.where("kind = 'name'"), "surface").select("row", F.inline(_name_keys(F.col("surface"), F.col("to"))))
             .groupBy("row", "key").agg(F.min(F.struct("rank", "to"))["to"].alias("to")))
    entity, name = F.struct("kind", "surface", "replacement"), F.struct("key", "to")
    found = mentions.join(words, "surface").select("row", entity.alias("entity"))
    per_row = (found.unionByName(named.select("row", name.alias("name")), allowMissingColumns=True).groupBy("row")
               .agg(F.sort_array(F.collect_list("entity")).alias(repl), F.collect_list("name").alias(names)))
    empty = F.array().cast("array<struct<kind:string,surface:string,replacement:string>>")
    by_surface = F.map_from_entries(F.transform(F.coalesce(repl, empty), lambda r: F.struct(r["surface"], r["replacement"])))
    pieces = F.split(F.col(text_col), ANY, -1)
    mentioned = F.when(F.size(names) > 0, _mentions(pieces, F.map_from_entries(names)))
    marked = F.col(f"{_TMP}mentions")
    again = F.transform(marked, lambda p: F.array_join(F.zip_with(
        p["rest"], F.zip_with(p["words"], p["to"], lambda w, t: F.coalesce(t, w)), lambda r, w: F.concat(r, F.coalesce(w, F.lit("")))), ""))
    joined = F.array_join(F.zip_with(F.coalesce(again, pieces), F.col(ents), lambda p, e: F.concat(
        p, F.coalesce(F.element_at(F.col(f"{_TMP}by"), e), e, F.lit("")))), "")
    untold = F.flatten(F.transform(marked, lambda p: F.filter(F.zip_with(p["words"], p["to"], lambda w, t: F.struct(
        F.lit("name").alias("kind"), w.alias("surface"), t.alias("replacement"))), lambda r: r["replacement"].isNotNull())))
    told = F.when(marked.isNotNull(), F.array_sort(F.array_union(F.col(repl), untold))).otherwise(F.coalesce(repl, empty))
    per_row = per_row.withColumnRenamed("row", f"{_TMP}row_of")
    changed = (hits.join(per_row, F.col(row) == F.col(f"{_TMP}row_of"), "left").withColumn(f"{_TMP}by", by_surface)
               .withColumn(f"{_TMP}mentions", mentioned).withColumn(text_col, joined).withColumn(f"{_TMP}report", told))
    plain = (tagged.where(F.coalesce(F.size(ents), F.lit(0)) <= 0)
             .withColumn(f"{_TMP}report", empty))
    extra = [F.col(f"{_TMP}report").alias(report)] if report else []
    picked = [F.col(f"`{c}`") for c in columns]
    return changed.select(*picked, *extra).unionByName(plain.select(*picked, *extra))
