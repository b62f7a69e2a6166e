r"""Personal data replaced by surrogates, with DataFrame functions alone.

E-mail addresses, IBANs and card numbers with right check digits, phone and social security numbers, IPv4 and IPv6 addresses
and names after a title are found by one regex. A surrogate is drawn from an HMAC-SHA256 of the entity's canonical form,
so one entity has one surrogate wherever it is written, and however. It keeps the kind, the format (separators, letter case,
country, check digits, top-level domain) and, for names, the gender of the title and the script.

A name is two entities: its surname, and its given names with that surname. "Mr. John A. Smith", "Dr. Smith" and "Mrs. Smith"
thus share a surname; given names are told apart under each surname. A name found after a title is also replaced
where the same text has it without one, in full or the surname alone, in the same letter case. A person who nowhere in a
text has a title is not found there. Titles without a gender draw neutral names.

Surrogates are checked over all entities of the input: two entities must not share one, and none may be an entity
itself. Those that do are drawn again with the next attempt number until none is left; later attempts are longer, so there is
always a free one. Texts need a join only for those, by a keyed digest; usually there are none or few. Tables
with entities in the clear are deleted before the result is returned.

The key is the caller's: the `key` argument or the session's `spark.rowdelta.pii.key`; without either, a random key holds for
this application. Who has the key can test guesses, so it is to be kept like the data.

Cases: a null text stays null; an empty one empty; a text without entities is returned as it is; null ids and repeated
rows are kept; an empty table gives no rows; other columns pass through, and only `text_col` changes.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.llm import scratch

SETTING = "spark.rowdelta.pii.key"
#: Attempts from which a number that has a fixed length gets a suffix.
SUFFIXED = 12

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин"
NEUTRAL = "Dr|Doctor|Prof|Professor"
_TITLES = f"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\\.? )+"
_PARTICLES = "(?:(?:van|von|der|den|de|del|della|di|da|dos|la|le|zu|bin|ibn|al|el) )*"
_WORD = "\\p{Lu}(?:['’]\\p{Lu})?\\p{L}+(?:-\\p{L}+|['’]\\p{L}{2,})*"
_INITIALS = "(?:\\p{Lu}\\. ?)*"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds and patterns. Each starts where no run of its own characters is under way, so a long run is looked at once.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": "(?<![\\w+-])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![\\w-])",
    "phone": "(?<![\\w+])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\\w)",
    "abroad": "(?<![\\w+])\\+[0-9]{1,3}(?:[ .-]?\\(?[0-9]{1,5}\\)?){2,6}(?!\\w)",
    "ssn": "(?<![\\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\\w-])",
    "ip": f"(?<![\\w.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\.?\\w)",
    "ipv6": f"(?<![\\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\\w:])",
    "name": f"(?<!\\w){_TITLES}{_INITIALS}{_PARTICLES}{_WORD}(?: {_INITIALS}{_PARTICLES}{_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any entity has, at a fraction of the cost.
HINT = f"@|[0-9][0-9.( )-]{{6}}|\\+[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}|(?<!\\w){_TITLES}"

#: First names by gender and script.
NAMES = {
    ("f", "latin"): "Anna Clara Diana Elena Ida Julia Laura Maria Nina Olivia Paula Rosa Sara Teresa Vera Zoe".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Max Oscar Paul Simon Tom Victor".split(),
    ("x", "latin"): "Alex Ashley Charlie Dana Francis Jamie Jordan Kim Luca Morgan Noel Quinn Robin Sam Sidney Toni".split(),
    ("f", "cyrillic"): "Алла Вера Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Раиса Софья Тамара Ульяна Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Тимур Фёдор".split(),
    ("x", "cyrillic"): "Валя Женя Паша Саша Слава Шура".split(),
}
SYLLABLES = {
    "latin": "ba ber col den dor fel gar hal ken lan mar nel or per ros sta tor ul ven wil".split(),
    "cyrillic": "ба бел вол гор дан ер жар зим кол лан мор нов ор пет рос сав тар ул хол чер".split(),
}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

_own_keys: dict[str, str] = {}


def key_of(spark: SparkSession, key: str | None = None) -> str:
    if key is None:
        app = spark.sparkContext.applicationId
        key = spark.conf.get(SETTING, None) or _own_keys.setdefault(app, secrets.token_hex(32))
    return key


def mac(message: Column, key: str) -> Column:
    """HMAC-SHA256 as hexadecimal text."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


# ---------------------------------------------------------------- small parts of expressions


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _number(h: Column, i: int | Column) -> Column:
    """The i-th number below 65,536 of 128 hexadecimal digits."""
    at = F.lit(1 + i * 4 % 124) if isinstance(i, int) else (i * 4 % 124 + 1).cast("int")
    return F.conv(F.substr(h, at, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _each(n: Column | int, f: Callable[[Column], Column], start: int | Column = 0) -> Column:
    """f(start) to f(start + n - 1), joined; nothing for n = 0."""
    n, start = (x if isinstance(x, Column) else F.lit(x) for x in (n, start))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(start, start + n - 1), f), "")).otherwise("")


def _run(h: Column, n: Column | int, start: int | Column = 0) -> Column:
    return _each(n, lambda i: (_number(h, i) % 10).cast("string"), start)


def _letter(h: Column, i: Column) -> Column:
    return F.substr(F.lit(ALPHABET), _number(h, i) % 26 + 1, F.lit(1))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("."), 0)


def _luhn(d: Column) -> Column:
    """Luhn's sum of a digit string, from its last digit on."""
    digit = lambda i: F.substr(d, -i, F.lit(1)).cast("int")
    doubled = lambda i: F.substr(F.lit("0246813579"), digit(i) + 1, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, digit(i)).otherwise(doubled(i)))


def _rest_of_97(s: Column) -> Column:
    """Of a number with letters for 10 to 35."""
    return F.aggregate(_chars(s), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _groups(m: Column) -> Column:
    """(left, right) of an IPv6 address: the groups written before and after `::`, or all to the left."""
    part = lambda k: F.filter(F.split(F.substring_index(F.lower(m), "::", k), ":"), lambda g: g != "")
    return F.struct(part(1).alias("left"), F.when(m.contains("::"), part(-1)).otherwise(F.array().cast("array<string>")).alias("right"))


def _expanded(m: Column) -> Column:
    """The eight groups of an IPv6 address without leading zeros, or null."""
    every = lambda g: F.concat(g["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(g["left"]) - F.size(g["right"]))), g["right"])
    plain = lambda a: F.array_join(F.transform(a, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")
    return _with(_groups(m), lambda g: F.when((F.size(every(g)) == 8) & (F.size(g["left"]) + F.size(g["right"]) >= 3), plain(every(g))))


# ---------------------------------------------------------------- what a match is


def kind_of(m: Column) -> Column:
    """The kind of a match, or null where a check digit or a length is wrong."""
    iban = F.regexp_replace(m, " ", "")
    return (
        F.when(m.contains("@"), "email")
        .when(m.contains(":"), F.when(_expanded(m).isNotNull(), "ipv6"))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when((F.length(iban) >= 15) & (_rest_of_97(F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))) == 1), "iban"))
        .when(m.rlike("^\\p{L}"), "name")
        .when(m.rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$"), "ip")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(f"^(?:{PATTERNS['phone']})$"), "phone")
        .when(m.startswith("+"), F.when(F.length(_digits(m)).between(8, 15), "abroad"))
        .when(_luhn(_digits(m)) % 10 == 0, "card")
    )


def named(m: Column, known: Column | None = None) -> Column:
    """(title, given, particles, surname, gender, script) of a name; known: those with titles in the same text, for the gender of one that tells none."""
    title = F.regexp_extract(m, f"^{_TITLES}", 0)
    rest = F.substr(m, F.length(title) + 1)
    surname = F.regexp_extract(rest, "[^ ]+$", 0)
    particles = F.regexp_extract(rest, f"(?:^| )({_PARTICLES})[^ ]+$", 1)
    given = F.trim(F.left(rest, F.length(rest) - F.length(surname) - F.length(particles)))
    gender = F.when(title.rlike(f"(?:{FEMALE})[. ]"), "f").when(title.rlike(f"(?:{MALE})[. ]"), "m")
    if known is not None:
        alike = F.filter(known, lambda k: (k["given"] == given) & (k["gender"] != "x"))
        same = F.filter(alike, lambda k: k["surname"] == surname)
        gender = F.coalesce(gender, F.get(same, 0)["gender"], F.when(title == "", F.get(alike, 0)["gender"]))
    gender = F.coalesce(gender, F.lit("x"))
    script = F.when(surname.rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return F.struct(title.alias("title"), given.alias("given"), particles.alias("particles"), surname.alias("surname"), gender.alias("gender"), script.alias("script"))


def canonical(kind: Column, m: Column) -> Column:
    """The form that all ways to write an entity share (names apart)."""
    return (
        F.when(kind == "email", F.lower(m)).when(kind == "ip", m).when(kind == "ipv6", _expanded(m)).when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "phone", F.right(_digits(m), F.lit(10))).otherwise(_digits(m))
    )


def surname_of(n: Column) -> Column:
    return F.concat_ws("|", n["script"], F.lower(n["surname"]))


def given_of(n: Column) -> Column:
    return F.concat_ws("|", n["gender"], n["script"], F.lower(n["given"]), F.lower(n["surname"]))


def matches(text: Column) -> Column:
    """(m, known) of a text: its matches in order, and the names with titles among them; null where there can be none.

    Where there are names with titles, matches without one are looked for too.
    """
    quoted = lambda names: F.array_join(F.transform(F.array_distinct(names), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")

    def pattern(known: Column) -> Column:
        given = F.array_distinct(F.filter(F.transform(known, lambda k: k["given"]), lambda g: g != ""))
        first = F.when(F.size(given) > 0, F.concat(F.lit("(?:(?:"), quoted(given), F.lit(f") {_PARTICLES})?"))).otherwise("")
        return F.concat(F.lit(f"{ANY}|(?:(?<![\\p{{L}}\\p{{N}}'’-])"), first, F.lit("(?:"), quoted(F.transform(known, lambda k: k["surname"])), F.lit(")(?![\\p{L}\\p{N}-]))"))

    known = lambda found: F.transform(F.filter(found, lambda m: m.rlike(f"^{_TITLES}")), lambda m: named(m))
    with_known = lambda found: F.struct(found.alias("m"), known(found).alias("known"))
    bare = lambda f: F.when(F.size(f["known"]) > 0, F.struct(F.regexp_extract_all(text, pattern(f["known"]), 0).alias("m"), f["known"].alias("known"), pattern(f["known"]).alias("pattern")))
    plain = lambda f: F.struct(f["m"].alias("m"), f["known"].alias("known"), F.lit(ANY).alias("pattern"))
    return F.when(text.rlike(HINT), _with(_with(F.regexp_extract_all(text, F.lit(ANY), 0), with_known), lambda f: F.coalesce(bare(f), plain(f))))


def analysed(found: Column) -> Column:
    """An array of (m, kind, name, entities) of what `matches` gives; a name's entities are its surname and its given names."""

    def one(m: Column, kind: Column) -> Column:
        def parts(n: Column) -> Column:
            item = lambda k, e: F.struct(k.alias("kind"), e.alias("entity"))
            several = F.filter(F.array(item(F.lit("surname"), surname_of(n)), F.when(n["given"] != "", item(F.lit("given"), given_of(n)))), lambda x: x.isNotNull())
            own = F.when(kind == "name", several).when(kind.isNotNull(), F.array(item(kind, canonical(kind, m))))
            return F.struct(m.alias("m"), kind.alias("kind"), n.alias("name"), own.alias("entities"))

        return _with(F.when(kind == "name", named(m, found["known"])), parts)

    return F.transform(found["m"], lambda m: _with(kind_of(m), lambda kind: one(m, kind)))


# ---------------------------------------------------------------- what it becomes


def _email(e: Column) -> Column:
    x, h = e["x"], e["h"]
    domain = F.length(x) - F.length(F.substring_index(x, ".", -1))  # the top-level domain stays
    drawn = lambda i, c: F.when((i > domain) | c.rlike("[^a-z0-9]"), c).when(c.rlike("[0-9]"), (_number(h, i) % 10).cast("string")).otherwise(_letter(h, i))
    body = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: _with(F.substr(x, i, F.lit(1)), lambda c: drawn(i, c)))
    more = F.greatest(F.lit(0), F.lit(9) - F.instr(x, "@")) + e["a"]  # eight characters before the sign at least
    return F.concat(_each(more, lambda i: _letter(h, i), 17), F.array_join(body, ""))


def _card(e: Column) -> Column:
    body = F.concat((4 + _number(e["h"], 0) % 2).cast("string"), _run(e["h"], 14, 1))
    return _with(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def _iban(e: Column) -> Column:
    x, h = e["x"], e["h"]
    drawn = lambda i, c: F.when(c.rlike("[0-9]"), (_number(h, i) % 10).cast("string")).otherwise(F.upper(_letter(h, i)))
    body = _each(F.length(x) - 4, lambda i: drawn(i, F.substr(x, i, F.lit(1))), 5)
    return _with(body, lambda b: F.concat(F.left(x, F.lit(2)), F.lpad((98 - _rest_of_97(F.concat(b, F.left(x, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), b))


def _abroad(e: Column) -> Column:
    lead = F.when(e["x"].rlike("^[17]"), 1).otherwise(2)  # the country stays
    return F.concat(F.left(e["x"], lead), (1 + _number(e["h"], 0) % 9).cast("string"), _run(e["h"], F.length(e["x"]) - lead - 1, 1))


def _ipv6(e: Column) -> Column:
    h = e["h"]
    first = lambda i: F.lower(F.conv((1 + _number(h, i) % 15).cast("string"), 10, 16))
    group = lambda g, i: F.when(g == "0", g).otherwise(F.concat(first(i), F.substr(h, i * 4 + 34, F.length(g) - 1)))
    return F.array_join(F.transform(F.split(e["x"], ":"), group), ":")


def _surname(e: Column) -> Column:
    x, h = e["x"], e["h"]
    syllable = lambda i: F.when(x.startswith("latin"), _pick(SYLLABLES["latin"], _number(h, i))).otherwise(_pick(SYLLABLES["cyrillic"], _number(h, i)))
    one = _each(4 + e["a"], syllable)
    return F.concat(F.substring_index(x, "|", 1), F.lit("|"), one, F.when(x.contains("-"), F.concat(F.lit("-"), _each(3, syllable, 20))).otherwise(""))


def _given(e: Column) -> Column:
    h, x = e["h"], F.split(e["x"], "\\|")
    name = lambda i: F.coalesce(*(F.when((x[0] == g) & (x[1] == s), F.lower(_pick(v, _number(h, i)))) for (g, s), v in NAMES.items()))
    initial = lambda i: F.when(x[1] == "latin", _letter(h, i)).otherwise(F.substr(F.lit("абвгдезиклмнопрст"), _number(h, i) % 17 + 1, F.lit(1)))
    parts = lambda t: F.size(F.split(t, "-")) + F.greatest(F.lit(0), e["a"] - 2)
    word = lambda t, i: F.array_join(F.transform(F.sequence(F.lit(0), parts(t) - 1), lambda j: name(i * 7 + j)), "-")
    drawn = F.transform(F.split(x[2], " "), lambda t, i: F.when(t.rlike("^(.\\.)+$"), F.array_join(F.transform(F.sequence(F.lit(1), F.floor(F.length(t) / 2).cast("int")), lambda j: F.concat(initial(i * 7 + j), F.lit("."))), "")).otherwise(word(t, i)))
    return F.concat_ws("|", x[0], x[1], F.array_join(drawn, " "), x[3])


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form, drawn from a keyed hash."""
    message = lambda n: F.concat_ws("|", F.lit(n), kind, attempt.cast("string"), entity)
    drawn = F.struct(F.concat(mac(message("1"), key), mac(message("2"), key)).alias("h"), entity.alias("x"), kind.alias("k"), attempt.cast("int").alias("a"))

    def of(e: Column) -> Column:
        h, k = e["h"], e["k"]
        n = lambda i: _number(h, i)
        octets = F.concat_ws(".", 1 + n(0) % 223, n(1) % 256, n(2) % 256, 1 + n(3) % 254)
        fixed = (
            F.when(k == "card", _card(e)).when(k == "iban", _iban(e)).when(k == "ip", octets).when(k == "ipv6", _ipv6(e)).when(k == "abroad", _abroad(e))
            .when(k == "phone", F.concat((2 + n(0) % 8).cast("string"), _run(h, 2, 1), (2 + n(3) % 8).cast("string"), _run(h, 6, 4))).otherwise(F.concat((1 + n(0) % 8).cast("string"), _run(h, 8, 1)))
        )
        fixed = F.concat(fixed, F.when(e["a"] >= SUFFIXED, F.concat(F.lit("~"), _run(h, e["a"] - SUFFIXED + 1, 15))).otherwise(""))
        return F.when(k == "email", _email(e)).when(k == "surname", _surname(e)).when(k == "given", _given(e)).otherwise(fixed)

    return _with(drawn, of)


def _capital(word: Column, like: Column) -> Column:
    parts = F.array_join(F.transform(F.split(word, "-"), F.initcap), "-")
    return F.when((F.length(like) > 2) & (like == F.upper(like)), F.upper(word)).otherwise(parts)


def written(a: Column, s: Callable[[int], Column]) -> Column:
    """The surrogates of an analysed match in its format; s gives the one of its k-th entity."""
    m, kind, name = a["m"], a["kind"], a["name"]

    def numbers(s0: Column) -> Column:  # its digits take the places of the match's
        base = F.substring_index(s0, "~", 1)
        lead = F.when(kind == "phone", F.length(_digits(m)) - 10).otherwise(0)
        digits = F.concat(F.left(_digits(m), lead), base)
        source = F.when(kind == "iban", base).otherwise(digits)
        sign = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
        put = lambda o, c: F.when(F.regexp_like(c, sign), F.struct(F.concat(o["o"], F.substr(source, o["k"], F.lit(1))).alias("o"), (o["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(o["o"], c).alias("o"), o["k"].alias("k")))
        placed = F.aggregate(_chars(m), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), put, lambda o: o["o"])
        return F.concat(F.when(kind == "ip", base).otherwise(placed), F.when(s0.contains("~"), F.concat(F.lit("-"), F.substring_index(s0, "~", -1))).otherwise(""))

    def mail(s0: Column) -> Column:
        more = F.length(s0) - F.length(m)
        lead = F.when(m.rlike("^[A-Z]"), F.initcap(F.left(s0, more))).otherwise(F.left(s0, more))
        body = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substr(s0, more + i, F.lit(1)))).otherwise(F.substr(s0, more + i, F.lit(1))))
        return F.concat(lead, F.array_join(body, ""))

    def address(s0: Column) -> Column:
        new = F.split(F.substring_index(s0, "~", 1), ":")
        group = lambda g, x: F.lpad(x, F.greatest(F.length(g), F.length(x)), F.lit("0"))
        side = lambda gs, start: F.array_join(F.zip_with(gs, F.slice(new, start, F.greatest(F.size(gs), F.lit(0))), group), ":")
        whole = _with(_groups(m), lambda g: F.concat(side(g["left"], F.lit(1)), F.when(m.contains("::"), F.concat(F.lit("::"), side(g["right"], F.lit(9) - F.size(g["right"])))).otherwise("")))
        return F.concat(F.when(m.rlike("[A-F]"), F.upper(whole)).otherwise(whole), F.when(s0.contains("~"), F.concat(F.lit("-"), F.substring_index(s0, "~", -1))).otherwise(""))

    surname = _capital(F.substring_index(s(0), "|", -1), name["surname"])
    given = F.array_join(F.transform(F.split(F.split(s(1), "\\|")[2], " "), lambda w: F.when(w.contains("."), F.upper(w)).otherwise(_capital(w, name["given"]))), " ")
    whole = F.concat(name["title"], F.when(name["given"] != "", F.concat(given, F.lit(" "))).otherwise(""), name["particles"], surname)
    return F.when(kind == "name", whole).when(kind == "email", mail(s(0))).when(kind == "ipv6", address(s(0))).otherwise(numbers(s(0)))


# ---------------------------------------------------------------- over tables


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (of, kind, entity) of all texts; of is the digest of the text."""
    found = docs.select(F.col(text_col).alias("text")).withColumn("found", matches(F.col("text"))).where(F.size("found.m") > 0)
    each = found.select(F.sha2("text", 256).alias("of"), F.inline(F.flatten(F.filter(F.transform(analysed(F.col("found")), lambda a: a["entities"]), lambda x: x.isNotNull()))))
    return each.distinct()


def attempts(all_: DataFrame, key: str) -> DataFrame | None:
    """(kind, entity, attempt) of the entities whose first surrogate is taken, or None where there are none."""
    spark = all_.sparkSession
    drawn = lambda t: t.withColumn("s", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key))
    table = scratch.written(drawn(all_.select("kind", "entity").distinct().withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        shared = table.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min("entity").alias("keeps")).where("n > 1").select("kind", "s", "keeps")
        own = table.select("kind", F.col("entity").alias("s")).join(table.select("kind", "s"), ["kind", "s"]).distinct().select("kind", "s", F.lit(None).cast("string").alias("keeps"))
        taken = scratch.written(shared.union(own).groupBy("kind", "s").agg(F.expr("if(count(*) = count(keeps), min(keeps), NULL)").alias("keeps")), "taken")
        if scratch.empty(taken):
            again = scratch.written(table.where("attempt > 0").select("kind", "entity", "attempt"), "attempts")
            return None if scratch.empty(again) else again
        marked = scratch.matched(table, taken, ["kind", "s"], "inner").where("keeps IS NULL OR entity <> keeps").select("kind", "entity", F.lit(True).alias("retry"))
        marked = scratch.written(marked, "marked")
        after = scratch.matched(table.drop("s"), marked, ["kind", "entity"], "left").select("kind", "entity", F.when(F.col("retry"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
        after = scratch.written(drawn(after), "surrogates")
        scratch.dropped(spark, table, taken, marked)
        table = after


def replaced(docs: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """docs with every entity in text_col replaced by its surrogate; count_col adds the number of replacements."""
    spark = docs.sparkSession
    key = key_of(spark, key)
    label = lambda kind, entity: mac(F.concat_ws("|", F.lit("label"), kind, entity), key)
    with scratch.tables(spark) as kept:
        found = scratch.written(entities(docs, text_col), "entities")
        again, hits = attempts(found, key), None
        if again is not None:
            places = scratch.matched(found, again, ["kind", "entity"], "inner")
            item = F.struct(label(F.col("kind"), F.col("entity")), F.col("attempt"))
            hits = scratch.written(places.groupBy("of").agg(F.map_from_entries(F.collect_set(item)).alias("__again")).withColumnRenamed("of", "__of"), "retried")
            kept.append(hits)
    names, text = docs.columns, F.col(f"__row.`{text_col}`")
    work = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")).withColumn("__found", matches(text))
    attempt = lambda e: F.lit(0)
    if hits is not None:  # texts without entities meet nothing, each at a place of its own
        of = F.when(F.size("__found.m") > 0, F.sha2(text, 256)).otherwise(F.monotonically_increasing_id().cast("string"))
        work = scratch.matched(work.withColumn("__of", of), hits, "__of", "left")
        attempt = lambda e: F.coalesce(F.element_at("__again", label(e["kind"], e["entity"])), F.lit(0))
    drawn = lambda a: F.transform(a["entities"], lambda e: surrogate(e["kind"], e["entity"], attempt(e), key))
    new = lambda a: F.when(a["kind"].isNull(), a["m"]).otherwise(_with(drawn(a), lambda s: written(a, lambda k: F.get(s, k))))
    work = work.withColumn("__all", F.when(F.size("__found.m") > 0, analysed(F.col("__found"))))
    gaps = F.split(text, F.col("__found.pattern"))
    joined = F.array_join(F.zip_with(gaps, F.transform("__all", new), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    columns = [F.when(F.col("__all").isNotNull(), joined).otherwise(text).alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names]
    if count_col:
        columns.append(F.coalesce(F.size(F.filter("__all", lambda a: a["kind"].isNotNull())), F.lit(0)).cast("long").alias(count_col))
    return work.select(*columns)
