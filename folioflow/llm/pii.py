"""Surrogates for personal data and secrets, with DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import saved, table

#: Rounds of collision checks after which remaining collisions are an error.
ROUNDS = 60
#: From this attempt on mail addresses, secrets and phone numbers grow by a character per attempt, and 192.168 addresses
#: move to 10; from the later one on all private addresses move to public ones.
GROWS, LEAVES = 4, 12
DIGITS_OF_HEX = "0123456789345678"

# Honorifics by the gender that they show.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Mister", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof", "Доктор", "Профессор")

# Common given names, which show a name without an honorific and its gender.
MALE_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel",
    "Matthew", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Wolfgang", "Jean", "Pierre", "Michel", "François", "Juan",
    "José", "Carlos", "Miguel", "Pedro", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Владимир",
)
FEMALE_NAMES = (
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily",
    "Anna", "Maria", "Ursula", "Monika", "Petra", "Sabine", "Marie", "Nathalie", "Isabelle", "Sophie", "Carmen",
    "Lucía", "Dolores", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна",
)

# Parts from which surrogate names are put together.
LATIN_PARTS = ("Al", "Be", "Cor", "Da", "El", "Fen", "Gar", "Hol", "In", "Jor", "Kel", "Lan", "Mar", "Nor", "Or", "Per")
LATIN_INNER = ("ba", "de", "fi", "go", "li", "ma", "ne", "ro", "sa", "ti", "vi", "wo", "ra", "le", "mi", "no")
LATIN_ENDS = {
    "m": ("ron", "mund", "bert", "ric"), "f": ("lina", "rice", "dora", "bella"), "n": ("len", "ry", "kim", "quin"),
    "s": ("ford", "wick", "mann", "ez"),
}
CYRILLIC_PARTS = ("Ар", "Бо", "Вел", "Гор", "Да", "Ер", "Жан", "Зор", "Ин", "Ки", "Лад", "Мар", "Ни", "Ор", "Пре", "Рад")
CYRILLIC_INNER = ("ба", "ве", "го", "ди", "ли", "ма", "не", "ро", "са", "ти", "ви", "ко", "ра", "ле", "ми", "но")
CYRILLIC_ENDS = {
    "m": ("слав", "мир", "дан", "тин"), "f": ("слава", "мира", "дана", "тина"), "n": ("ша", "ля", "ся", "ня"),
    "s": ("енко", "ских", "чук", "овых"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"(?:\p{Lu}\.[ ]){0,3}\p{Lu}[\p{Ll}\p{Lu}'’-]*+"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: What stands before a secret, and the secret itself. Both are found together, and the key goes to what stays.
KEY = r"(?:[Tt](?i:oken)|[Pp](?i:assw(?:or)?d)|[Ss](?i:ecret)|[Aa](?i:pi_?key|ccess_key))(?:\\?[\"'])?[ ]{0,2}[=:][ ]{0,2}(?:\\?[\"'])?"
BEHIND_KEY = r"[A-Za-z0-9_+/.-]{6,}+"
#: Types and patterns, in the order in which they are tried at a place. Words are taken possessively, so that no text
#: makes the matcher go back; look-behinds have a bounded length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=[A-Za-z0-9-]\.[A-Za-z]{2,24})",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{15,17}+|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "mac": r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*+[0-9])[0-9A-Fa-f]{{4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z]|:[0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?[ ]{_NAME}(?:[ ]{_NAME}){{0,3}}|(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)})(?:[ ]{_NAME}){{1,3}})(?![\p{{L}}\p{{N}}])",
}
KEYED = rf"(?=[TtPpSsAa]){KEY}{BEHIND_KEY}(?!@)"


def _either(*names: str) -> str:
    return "|".join(f"(?:{PATTERNS[n]})" for n in names)


#: All of them, in the same order for each first character. Only keys may begin inside a word, so most places of a text
#: fail at the first look; names begin with one of these letters.
CAPITAL = "(?=[A-ZА-Яг])"
_DIGIT_FIRST = f"(?=[0-9+(])(?:{_either('ip', 'mac', 'ipv6', 'phone', 'ssn', 'card')})"
_LETTER_FIRST = rf"(?=\p{{L}})(?:{_either('secret', 'mac', 'ipv6')}|{CAPITAL}(?:{_either('iban', 'name')}))"
ANY = f"(?<![A-Za-z0-9])(?:{_either('email')}|{_DIGIT_FIRST}|{_LETTER_FIRST})|{KEYED}"
WORDS_OF_NAMES = MALE + FEMALE + NEUTRAL + MALE_NAMES + FEMALE_NAMES
#: Stands around what was found while a text is cut.
MARK = "\x01\x02"


def has_cue(text: Column) -> Column:
    """A text without any of these holds nothing that a pattern finds. Plain searches go first; the pattern of names is
    tried only where a letter stands that one begins with."""
    keyed = (text.contains("=") | text.contains(":")) & text.rlike(r"(?i)token|passw|secret|api_?key|access_key")
    known = text.contains("AKIA") | text.contains("sk-") | text.contains("eyJ") | (text.contains("gh") & text.rlike("gh[pousr]_"))
    paired = (text.contains(":") & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")) | (text.contains("-") & text.rlike("[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-"))
    return text.rlike("[0-9@]") | known | keyed | paired | text.rlike(rf"{CAPITAL}(?<![\p{{L}}\p{{N}}])(?:{'|'.join(WORDS_OF_NAMES)})[. ]")


def _only(c: Column, pattern: str) -> Column:
    """Whether the whole of c matches; look-arounds at the ends see nothing, as at the ends of a text."""
    return c.rlike(rf"\A(?:{pattern})\z")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of digits with every second one from the right doubled, modulo 10, as a card number's check wants it."""
    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * F.when(pair["k"] % 2 == 1, 2).otherwise(1)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    each = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.struct(d.cast("int").alias("d"), k.alias("k")))
    return F.aggregate(F.filter(each, lambda x: x["d"].isNotNull()), F.lit(0), add) % 10


def _mod97(iban: Column) -> Column:
    """The number that an IBAN stands for (first four characters moved to the end, letters as 10 to 35) modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise((rest * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _keyed(key: str, text: Column) -> Column:
    """HMAC-SHA256 of the text, as hex digits."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in block.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def _stream(key: str, seed: Column, length: Column) -> Column:
    """At least 2 * length hex digits that the key and the seed decide. The seed's digest is bound as a variable of the
    outer lambda, so a long seed is read once, not for each part."""
    def parts(digest: Column) -> Column:
        counted = F.sequence(F.lit(0), F.floor(length / 32).cast("int"))
        return F.array_join(F.transform(counted, lambda k: _keyed(key, F.concat_ws("|", digest, k.cast("string")))), "")

    return F.element_at(F.transform(F.array(_keyed(key, seed)), parts), 1)


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substr(stream, 2 * k + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _same_shape(value: Column, stream: Column) -> Column:
    """Each letter becomes a letter of the same case, each digit a digit, other characters stay; a value of hex digits
    stays one. Linear: characters meet the stream's pairs of digits as arrays, and nothing whole is read in the lambda."""
    pairs = F.regexp_extract_all(stream, F.lit(".."), F.lit(0))

    def shaped(small: int) -> Column:
        def char(c: Column, pair: Column) -> Column:
            n = F.conv(pair, 16, 10).cast("int")
            return (
                F.when(c.rlike("[0-9]"), F.char(48 + n % 10))
                .when(c.rlike("[a-z]"), F.char(97 + n % small))
                .when(c.rlike("[A-Z]"), F.char(65 + n % 26))
                .otherwise(c)
            )

        return F.array_join(F.zip_with(F.split(value, ""), pairs, char), "")  # what the pairs are longer joins as null

    return F.when(value.rlike(r"\A(?=[0-9a-f]*[0-9])[0-9a-f]+\z"), shaped(6)).otherwise(shaped(26))


def kind_of(found: Column, keyed: Column) -> Column:
    """The type whose pattern found the text: behind a key (`keyed`) whatever a secret may be, else the first that the
    text has as a whole."""
    kind = F.lit("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        kind = F.when(_only(found, PATTERNS[name]), name).otherwise(kind)
    return F.when(keyed & _only(found, BEHIND_KEY), "secret").otherwise(kind)


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, with four digits each; more than eight if it is none."""
    left, right = (F.filter(F.split(x, ":"), lambda g: g != "") for x in (F.substring_index(address, "::", 1), F.when(address.contains("::"), F.substring_index(address, "::", -1)).otherwise("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.lpad(F.lower(g), 4, "0"))


def _holds(kind: Column, found: Column) -> Column:
    """Check digits: cards by Luhn's sum, IBANs modulo 97; and IPv6 addresses have eight groups."""
    iban = F.regexp_replace(found, " ", "")
    return F.when(kind == "card", F.length(_digits(found)).between(13, 19) & (_luhn(_digits(found)) == 0)).when(kind == "iban", _mod97(iban) == 1).when(kind == "ipv6", F.size(_groups(found)) == 8).otherwise(True)


def _canonical(kind: Column, found: Column) -> Column:
    """What all spellings of one entity share."""
    return (
        F.when(kind.isin("email", "mac"), F.lower(found))
        .when(kind == "ipv6", F.array_join(_groups(found), ":"))
        .when(kind.isin("card", "ssn"), _digits(found))
        .when(kind == "phone", F.concat(F.regexp_extract(found, r"\A(\+[0-9]{1,3})(?![0-9])", 1), F.lit("/"), _digits(F.regexp_replace(found, r"\A\+[0-9]{1,3}(?![0-9])", ""))))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .otherwise(found)
    )


def _candidate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """A keyed surrogate in canonical form. Names, mail addresses, secrets and phone numbers grow with the attempt, so
    that later attempts draw from ever larger spaces; the other types are as long as their format."""
    seed = F.concat_ws("|", kind, value, attempt.cast("string"))
    s = _stream(key, seed, F.length(value) + attempt + 6)
    more = F.when(attempt >= GROWS, F.substr(_keyed(key, F.concat(seed, F.lit("|more"))), F.lit(1), attempt - GROWS + 1)).otherwise("")
    digits = F.translate(s, "0123456789abcdef", DIGITS_OF_HEX)
    n = F.length(value)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(_same_shape(local, s), more, F.lit("@"), _same_shape(F.substring_index(domain, ".", 1), _stream(key, domain, F.length(domain))), F.lit(".example."), F.substring_index(domain, ".", -1))
    octet = lambda k: (_byte(s, F.lit(k)) % 254 + 1).cast("string")
    first, second = F.substring_index(value, ".", 1), F.element_at(F.split(value, "[.]"), 2)
    private = F.when(first == "10", "10").when((first == "192") & (second == "168"), F.when(attempt < GROWS, "192.168").otherwise(F.concat_ws(".", F.lit("10"), octet(1)))).otherwise(F.concat_ws(".", (_byte(s, F.lit(9)) % 111 + 11).cast("string"), octet(1)))
    ip = F.concat_ws(".", private, *[octet(k) for k in (2, 3)])
    ip = F.when((first == "10") | ((attempt >= LEAVES) & (first == "192") & (second == "168")), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).otherwise(
        F.when(attempt >= LEAVES, F.concat_ws(".", (_byte(s, F.lit(9)) % 111 + 11).cast("string"), octet(1), octet(2), octet(3))).otherwise(ip)
    )
    country, rest = F.substring_index(value, "/", 1), F.substring_index(value, "/", -1)
    phone = F.concat(country, F.lit("/"), F.translate(F.substring(digits, 1, 1), "01", "78"), F.substr(digits, F.lit(2), F.length(rest) - 1), F.translate(more, "0123456789abcdef", DIGITS_OF_HEX))
    body = F.concat(F.substring(value, 1, 1), F.substr(digits, F.lit(1), n - 2))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    ssn = F.concat(F.translate(F.substring(digits, 1, 1), "069", "128"), F.translate(F.substring(digits, 2, 8), "0", "5"))
    account = _same_shape(F.substr(value, F.lit(5)), s)
    check = F.lpad((98 - _mod97(F.concat(F.substring(value, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(value, 1, 2), check, account)
    hexed = F.array_join(F.transform(F.split(value, ""), lambda c, k: F.when(c.isin(":", "-", ""), c).otherwise(F.substr(s, k + 1, F.lit(1)))), "")
    prefix = F.regexp_extract(value, r"\A(AKIA|gh[pousr]_|sk-|eyJ)", 1)
    secret = F.concat(prefix, _same_shape(F.substr(value, F.length(prefix) + 1), s), more)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("mac", "ipv6"), hexed).when(kind == "phone", phone)
        .when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "secret", secret)
        .otherwise(_name(kind, value, s, attempt))
    )


def _name(kind: Column, value: Column, s: Column, attempt: Column) -> Column:
    """Names are put together from parts of the same script, with an end that fits the gender (name_m, name_f, or
    name_n where none shows) or, for family names (name_s), a family name's end. Each attempt has one more inner part than the one before."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")

    def made(parts, inner, ends) -> Column:
        end = F.when(kind == "name_m", _one_of(ends["m"], _byte(s, F.lit(5)))).when(kind == "name_f", _one_of(ends["f"], _byte(s, F.lit(5)))).when(kind == "name_n", _one_of(ends["n"], _byte(s, F.lit(5)))).otherwise(_one_of(ends["s"], _byte(s, F.lit(5))))
        further = F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda k: _one_of(inner, _byte(s, k + 5))), "")
        return F.concat(*[_one_of(p, _byte(s, F.lit(k))) for k, p in enumerate((parts, inner, inner))], F.when(attempt > 0, further).otherwise(""), end)

    return F.when(cyrillic, made(CYRILLIC_PARTS, CYRILLIC_INNER, CYRILLIC_ENDS)).otherwise(made(LATIN_PARTS, LATIN_INNER, LATIN_ENDS))


def _spelled(kind: Column, found: Column, surrogate: Column) -> Column:
    """The surrogate with the punctuation and case of this occurrence."""
    rest = F.when(kind == "phone", F.concat(_digits(F.substring_index(surrogate, "/", 1)), F.substring_index(surrogate, "/", -1))).otherwise(surrogate)
    mark = r"[0-9]"
    marks = F.when(kind == "iban", found.rlike(" ")).otherwise(kind.isin("phone", "card", "ssn"))

    def place(c: Column, k: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(found, F.lit(1), k + 1), "[^0-9A-Z]", ""))
        return F.when(c.rlike(rf"{mark}|[A-Z]"), F.substr(rest, before, F.lit(1))).otherwise(c)

    laid = F.array_join(F.transform(F.split(found, ""), place), "")
    laid = F.concat(laid, F.when(kind == "phone", F.substr(rest, F.length(_digits(found)) + 1, F.lit(ROUNDS))).otherwise(""))
    shout = kind.startswith("name") & (F.length(found) > 1) & (F.upper(found) == found)
    return F.when(marks, laid).when(shout | (kind.isin("mac", "ipv6") & (F.upper(found) == found)), F.upper(surrogate)).otherwise(surrogate)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two values of a kind share a surrogate and none is a
    value that occurs. Of colliding values all but the smallest try again with the next attempt."""
    state = saved(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), "entities")
    for _ in range(ROUNDS):
        tried = saved(state.withColumn("surrogate", _candidate(F.col("kind"), F.col("value"), key, F.col("attempt"))), "surrogates")
        taken = tried.select("kind", F.col("value").alias("surrogate"), F.lit("").alias("first"), F.lit(2).alias("n"))
        owners = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n"))
        rule = owners.where("n > 1").unionByName(taken).groupBy("kind", "surrogate").agg(F.min("first").alias("first"))
        clash = tried.join(rule, ["kind", "surrogate"]).where("value != first").select("kind", "value", F.lit(1).alias("again"))
        clash = saved(clash, "collisions")
        if not clash.limit(1).count():
            return tried.drop("attempt")
        state = tried.drop("surrogate").join(clash, ["kind", "value"], "left").select(
            "kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")
        )
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds; the space of a type is too small")


def _tokens(kind: Column, found: Column, key: str) -> Column:
    """An occurrence as parts (kind, value, text): a name's honorific stays, its given names have a gender, its last
    word is the family name; all else is one part. Parts without a kind stay as `text` says: initials, which are too
    few to be distinct, become a letter that the key and the family name decide."""
    words = F.split(found, " ")
    title = F.regexp_replace(words[0], "[.]", "")
    honour = title.isin(*MALE, *FEMALE, *NEUTRAL)
    gender = (
        F.when(title.isin(*MALE, *MALE_NAMES), "name_m").when(title.isin(*FEMALE, *FEMALE_NAMES), "name_f")
        .when(words[1].isin(*FEMALE_NAMES), "name_f").when(words[1].isin(*MALE_NAMES), "name_m").otherwise("name_n")
    )

    def part(w: Column, k: Column) -> Column:
        last = k == F.size(words) - 1
        initial = w.rlike(r"\A\p{Lu}\.\z")
        role = F.when((honour & (k == 0)) | initial, None).when(last, "name_s").otherwise(gender)
        letter = (_byte(_keyed(key, F.concat_ws("|", w, F.lower(F.element_at(words, -1)))), F.lit(0)) % 26).cast("int")
        other = F.concat(F.when(w.rlike(r"\p{IsCyrillic}"), F.substr(F.lit("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), letter + 1, F.lit(1))).otherwise(F.char(65 + letter)), F.lit("."))
        return F.struct(role.alias("kind"), F.initcap(F.lower(w)).alias("value"), F.when(initial, other).otherwise(w).alias("text"))

    whole = F.array(F.struct(kind.alias("kind"), _canonical(kind, found).alias("value"), found.alias("text")))
    return F.when(kind == "name", F.transform(words, part)).otherwise(whole)


def _mentions(text: Column, known: Column) -> Column:
    """The text with capitalised words of `known`, a map from parts of names to their surrogates, replaced, in their
    case and also before 's. The text is cut into words and what stands between them."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]++(?:['’-][\p{L}\p{N}_]++)*+|[^\p{L}\p{N}_]++"), F.lit(0))

    def new(word: Column) -> Column:
        own = F.regexp_replace(word, "['’]s\\z", "")
        found = F.try_element_at(known, F.initcap(F.lower(own)))
        spelled = F.when((F.upper(own) == own) & (F.length(own) > 1), F.upper(found)).otherwise(found)
        return F.when(word.rlike(r"\A\p{Lu}") & found.isNotNull(), F.concat(spelled, F.substr(word, F.length(own) + 1))).otherwise(word)

    return F.array_join(F.transform(words, new), "")


def _marked(text: Column) -> Column:
    """The text with marks around what the patterns find; null for a text that holds such a mark itself."""
    return F.when(~text.contains(MARK), F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"))


def _cut(text: Column, marked: Column) -> tuple[Column, Column]:
    """What the patterns find, and the pieces around it (one more)."""
    pieces = F.split(marked, MARK, -1)
    every = lambda first: F.filter(pieces, lambda _, k: k % 2 == first)
    return (
        F.when(marked.isNotNull(), every(1)).otherwise(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))),
        F.when(marked.isNotNull(), every(0)).otherwise(F.split(text, ANY, -1)),
    )


def _without_keys(found: Column, gap: Column) -> tuple[Column, Column]:
    """Keys before secrets moved from what was found to the pieces before."""
    key = lambda f: F.regexp_extract(F.coalesce(f, F.lit("")), rf"\A{KEY}(?={BEHIND_KEY}\z)", 0)
    short = F.transform(found, lambda f: F.substr(f, F.length(key(f)) + 1))
    return short, F.zip_with(gap, F.transform(found, key), lambda g, k: F.concat(g, F.coalesce(k, F.lit(""))))


def replace_entities(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities"
) -> DataFrame:
    """Replace personal data and secrets in whole texts by surrogates; all columns of `docs` stay, `count_col` comes.

    Types: email, secret, ip, mac, ipv6, iban, phone, ssn, card, name. Cards and IBANs count only with right check
    digits, and get them again. The same entity gets the same surrogate everywhere, however it is spelled; different
    ones of a type get different ones, none of which occurs in the corpus as an entity; honorifics and country codes
    stay, names keep gender, script and case, numbers their punctuation. Where a document has a name, single mentions
    of its parts in that document are replaced too (they aren't counted). The key decides all surrogates, by HMAC.

    Texts that no cue marks pass through a narrow job. Of the others the pieces between entities stay with the row,
    the entities go to the dictionary by (kind, value) and come back by row. Null and empty texts stay as they are,
    with 0 entities; null ids and repeated rows are rows like others; an empty table gives no rows. Columns of `docs`
    may have any names; if one is named like `count_col`, underscores are added to the new one.
    """
    if not key:
        raise ValueError("a key is needed")
    while count_col in docs.columns:
        count_col += "_"
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("folioflow_row"))
    docs, names = docs.select(others.alias("doc"), F.col(f"`{text_col}`").alias("text")), docs.columns

    def whole(df: DataFrame, text: Column, count: Column) -> DataFrame:
        return df.select(*[(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in names], count.cast("int").alias(count_col))

    text = F.col("text")
    plain = docs.where(~F.coalesce(has_cue(text), F.lit(False)))
    marked = saved(docs.where(has_cue(text)).select("doc", "text", _marked(text).alias("marked")), "marked")
    same = marked.where("marked = text")
    found, gap = _cut(text, F.col("marked"))
    cut = marked.where("marked is null or marked != text").select("doc", found.alias("found"), gap.alias("gap"))
    found, gap = _without_keys(F.col("found"), F.col("gap"))
    cut = saved(cut.select("doc", found.alias("found"), gap.alias("gap"), F.monotonically_increasing_id().alias("row")), "cut")
    out = whole(plain, text, F.lit(0)).unionByName(whole(same, text, F.lit(0)))
    out = out.unionByName(whole(cut.where(F.size("found") == 0), F.element_at("gap", 1), F.lit(0)))
    marked = cut.where(F.size("found") > 0)

    def behind(f: Column, k: Column) -> Column:
        before = F.concat(F.coalesce(F.get(F.col("found"), k - 1), F.lit("")), F.get(F.col("gap"), k))
        return F.struct(f.alias("found"), F.substring(before, -32, 32).alias("before"))

    each = marked.select("row", F.posexplode(F.transform("found", behind)).alias("pos", "e")).select("row", "pos", "e.*")
    each = each.select("row", "pos", "found", kind_of(F.col("found"), F.col("before").rlike(rf"{KEY}\z")).alias("kind"))
    each = each.withColumn("kind", F.when(_holds(F.col("kind"), F.col("found")), F.col("kind")))  # others stay as they are
    parts = each.select("row", "pos", F.posexplode(_tokens(F.col("kind"), F.col("found"), key)).alias("k", "part")).select("row", "pos", "k", "part.*")
    parts = saved(parts, "parts")
    known = dictionary(parts.where("kind is not null"), key)
    spelled = F.when(F.col("surrogate").isNull(), F.col("text")).otherwise(_spelled(F.col("kind"), F.col("text"), F.col("surrogate")))
    new = parts.join(known, ["kind", "value"], "left").select("row", "pos", "k", "kind", "value", "surrogate", spelled.alias("text"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ")
    called = F.collect_set(F.when(F.col("kind").startswith("name"), F.struct("value", "kind", "surrogate")))
    by_pos = new.groupBy("row", "pos").agg(words.alias("text"), called.alias("called"), F.max(F.col("kind").isNotNull()).alias("held"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    names_of = F.sort_array(F.array_distinct(F.flatten(F.collect_list("called"))))
    by_row = by_pos.groupBy("row").agg(in_order.alias("new"), names_of.alias("called"), F.count_if("held").alias("n"))
    first = F.filter("called", lambda c, k: (k == 0) | (c["value"] != F.get(F.col("called"), k - 1)["value"]))  # one surrogate per word
    mentions = F.map_from_entries(F.transform(first, lambda c: F.struct(c["value"], c["surrogate"])))
    joined = marked.join(by_row.select("row", "new", "n", mentions.alias("mentions")), "row")
    gaps = F.when(F.size("mentions") > 0, F.transform("gap", lambda g: _mentions(g, F.col("mentions")))).otherwise(F.col("gap"))
    joined = joined.withColumn("kept", gaps)
    rebuilt = F.concat(F.element_at("kept", 1), F.array_join(F.zip_with("new", F.slice("kept", 2, F.size("new")), lambda x, y: F.concat(x, y)), ""))
    return out.unionByName(whole(joined, rebuilt, F.col("n")))


#: The key of the registered query and of the pipeline; who releases a corpus chooses a secret one.
PUBLIC_KEY = "a public key for tests"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, PUBLIC_KEY)
