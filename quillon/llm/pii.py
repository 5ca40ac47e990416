"""Personal data replaced by surrogates of the same type and format.

Entities are found by pattern: e-mail addresses, IP addresses of both versions, bank account
numbers (IBAN), national id, card and phone numbers, and names. Card and account numbers
need valid check digits, cards also the length and first digits of a kind of card; other
runs of digits stay. Names are found after a title, of any number of words, with initials,
apostrophes, inner capitals and particles; further mentions of their words in the same
document, with or without a title, are names too.

Each entity has a canonical form, so that the same one in another layout or case is the
same: letters in lower case, digits alone, phone numbers without the country's code, which
stays, addresses of version 6 written out. Its surrogate is derived from a secret key, by
HMAC, and the canonical form: letters give letters of the same script and case, digits
digits, separators stay; cards keep their issuer's first digits and a valid check digit,
accounts their country and valid check digits, addresses stay addresses. Names are replaced
word by word, so that 'Mr John Smith', 'Dr John Smith' and 'Smith' agree: words are built of
syllables of their own script, with an ending of the gender if the titles right before the
word, in all documents, tell just one. Initials become initials, particles stay.

The key is an argument, or the session's setting KEY_SETTING; where neither is given, each
call draws one, and surrogates of different calls do not agree.

Surrogates are checked over all distinct entities: where two share one, or one equals an
entity of the data, the later takes its next attempt, until all differ; only those that
moved are checked again. After GROW attempts the format is taken to be crowded and grows
with each attempt: names by syllables, e-mail addresses by letters, phone and id numbers by
digits, and IP addresses of version 4 become those of version 6; the others do not, as they
have 10^11 surrogates or more. Equal entities thus have equal surrogates everywhere
(coreference), different ones different surrogates. Documents are rewritten where they are;
only those that hold an entity with a later attempt are joined with it.

Defined results: null text stays null with no entities; empty texts stay empty; very long
texts are rewritten whole; repeated
rows are rewritten alike; an empty table gives no rows; further columns are ignored. Of
two matches at one place, the type listed first wins.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, bitmap, let, matched, saved, with_maybe

KEY_SETTING = "spark.quillon.surrogate.key"
#: Attempts after which a surrogate grows.
GROW = 8
#: First letters by which the words to look for in a document are branched.
BRANCHES = 3

# Titles by gender (m, f, or none told); patterns in order of precedence.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sir", "Signor", "Господин", "Г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Г-жа"),
    "": ("Dr", "Prof"),
}
SYLLABLES = {
    "latin": "ba be bi bo bra da de di do dra fa fe fi ga ge go gra ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to tra va ve vi vo za ze".split(),
    "cyrillic": "ба бе би бо ва ве ви во га ге го да де ди до за зе ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то фа фе".split(),
}
ENDINGS = {("m", "latin"): "n", ("f", "latin"): "na", ("m", "cyrillic"): "н", ("f", "cyrillic"): "на"}
_TITLE = "|".join(t for own in TITLES.values() for t in own)
_TITLED = rf"(?:(?:{_TITLE})\.? )"
_INITIAL = r"\p{Lu}\."
_PARTICLE = r"(?:v[ao]n(?: de[rnm]?)?|de(?: la| los| las)?|del|della|di|da|dos|du|bin|ibn|al)"
# Loops over groups are possessive: others take a frame of the stack for each turn. Where giving back would matter, a turn looks ahead.
_WORD = rf"(?!(?:{_TITLE})(?!\p{{L}}))(?:\p{{Ll}}{{1,2}}['’])?\p{{Lu}}[\p{{L}}\p{{M}}]+(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}]*+)*+|\p{{Lu}}(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}]*+)++"
#: Particles and initials stand before a word, so a name ends with one.
_NAME_WORD = rf"(?:{_PARTICLE} |{_INITIAL}[ -]?)*+(?:{_WORD})"
_NAME = rf"{_NAME_WORD}(?:[ -]{_NAME_WORD})*+"
_LABEL = r"[\p{L}\p{N}-]{1,63}\."
#: A domain of any length where each label leads on to one more, or else one of up to 126 labels, tried from the longest down.
_DOMAIN = rf"(?:(?:{_LABEL}(?=\p{{L}}{{2}}|{_LABEL}))++\p{{L}}{{2,24}}|(?:{_LABEL}){{1,126}}\p{{L}}{{2,24}})"
_H = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]{{0,255}}+@{_DOMAIN}",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:|::(?:{_H}:){{1,6}}{_H})(?![\p{{L}}\p{{N}}:]|\.\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\dA-Za-z-])\d{3}-\d{2}-\d{4}(?![\dA-Za-z-])",
    "card": r"(?<![\dA-Za-z])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|\d{4}[ -]?\d{6}[ -]?\d{4,5})(?![\dA-Za-z])",
    "phone": r"(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<=\+\d{1,3}[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){2,3})(?![\dA-Za-z])",
    "name": rf"(?<!\p{{L}}){_TITLED}++{_NAME}",
}
#: A country's code before a phone number, told apart by what follows it.
_CODE = r"^\+\d{1,3}(?=[ .(-])"
TYPES = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: An entity has one of these characters or a title; both are far cheaper to look for than ANY.
HINT = "[0-9@]"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _check_sum(digits: Column) -> Column:
    """The sum over card digits that is a multiple of 10 if the last one is right."""

    def worth(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), "", -1), lambda c: c != ""), worth), F.lit(0), lambda a, b: a + b)


def _remainder(account: Column) -> Column:
    """Of an account number, its first four characters put last and its letters read as numbers, by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).when(code >= 48, (acc * 10 + code - 48) % 97).otherwise(acc)

    return F.aggregate(F.split(turned, "", -1), F.lit(0), step)


def type_of(entity: Column) -> Column:
    """Which of the patterns a match of ANY is, by its looks; empty if its check digits or first digits are wrong."""
    digits = _digits(entity)
    kind_of_card = r"^(?:[2-6]\d{15}|3[47]\d{13}|3[0689]\d{12})$"
    out = F.when(F.rlike(entity, F.lit(r"^[0-9+(]")), F.lit("phone")).otherwise("name")
    card = F.when(F.rlike(digits, F.lit(kind_of_card)) & (_check_sum(digits) % 10 == 0), F.lit("card")).otherwise("")
    out = F.when(F.rlike(entity, F.lit(r"^[0-9 -]+$")) & F.length(digits).isin(14, 15, 16), card).otherwise(out)
    account = F.when(_remainder(F.replace(entity, F.lit(" "), F.lit(""))) == 1, F.lit("iban")).otherwise("")
    out = F.when(F.rlike(entity, F.lit(r"^[A-Z]{2}\d{2}")), account).otherwise(out)
    out = F.when(F.rlike(entity, F.lit(r"^\d{3}-\d{2}-\d{4}$")), F.lit("ssn")).otherwise(out)
    out = F.when(F.rlike(entity, F.lit(r"^\d+\.\d+\.\d+\.\d+$")), F.lit("ip")).otherwise(out)
    out = F.when(F.rlike(entity, F.lit(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$")), F.lit("ipv6")).otherwise(out)
    return F.when(F.contains(entity, F.lit("@")), F.lit("email")).otherwise(out)


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^{_TITLED}*+", 0)


def _gender(entity: Column) -> Column:
    """What the titles of a name tell: m, f or nothing."""
    out = F.lit("")
    for g in ("f", "m"):
        own = rf"(?:{'|'.join(TITLES[g])})\.? "
        out = F.when(F.rlike(entity, F.lit(rf"^(?:(?!{own}){_TITLED})*+{own}")), F.lit(g)).otherwise(out)
    return out


def _tokens(entity: Column) -> Column:
    """Initials, words, and what is between them, of a name without its titles."""
    return F.regexp_extract_all(F.substring(entity, F.length(_title(entity)) + 1, F.length(entity)), F.lit(rf"{_INITIAL}|[\p{{L}}\p{{M}}'’]+|[ -]"), F.lit(0))


def _is_word(token: Column) -> Column:
    return F.rlike(token, F.lit(r"\p{Lu}")) & ~F.endswith(token, F.lit("."))


def _written_out(address: Column) -> Column:
    """An IP address of version 6 as eight groups of four digits."""
    side = lambda k: F.filter(F.split(F.substring_index(F.lower(address), "::", k), ":", -1), lambda g: g != "")
    left, right = side(1), F.when(F.contains(address, F.lit("::")), side(-1)).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def canonical(entity: Column, kind: Column) -> Column:
    """The form in which layouts of the same entity agree; that of names is of each word."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "ip", entity)
        .when(kind == "ipv6", _written_out(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "phone", _digits(F.regexp_replace(entity, _CODE, "")))
        .otherwise(_digits(entity))
    )


def keys(entity: Column, kind: Column) -> Column:
    """What has surrogates of its own: a name's words, of which the first has the title's gender, or the entity."""
    part = lambda canon, gender: F.struct(kind.alias("kind"), canon.alias("canon"), gender.alias("gender"))
    words = F.transform(_tokens(entity), lambda w, i: part(w, F.when(i == 0, _gender(entity)).otherwise("")))
    alone = F.filter(F.array(part(canonical(entity, kind), F.lit(""))), lambda p: p["kind"] != "")
    return F.when(kind == "name", F.filter(words, lambda w: _is_word(w["canon"]))).otherwise(alone)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits that depend on all four: HMAC-SHA-512 under the key."""
    own = key.encode()
    own = (hashlib.sha512(own).digest() if len(own) > 128 else own).ljust(128, b"\0")
    padded = lambda x: F.lit(bytes(b ^ x for b in own))
    text = F.encode(F.concat_ws("\x1f", kind, attempt.cast("string"), canon), "UTF-8")
    return F.sha2(F.concat(padded(0x5C), F.unhex(F.sha2(F.concat(padded(0x36), text), 512))), 512)


def _long(stream: Column, length: Column) -> Column:
    """A stream of two digits for each of so many characters, 64 to a block."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 64).cast("int")), lambda k: F.sha2(F.concat_ws("\x1f", F.lit("block"), k.cast("string"), stream), 512))
    return F.when(length > 64, F.array_join(blocks, "")).otherwise(stream)


ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "digits": "0123456789", "hex": "0123456789abcdef"}


def _scrambled(text: Column, stream: Column, fixed: Column | None = None, digits: str = "digits") -> Column:
    """Small letters to letters of their script and digits to digits; positions from `fixed` on stay."""

    def drawn(b: Column, name: str) -> Column:
        return F.substring(F.lit(ALPHABETS[name]), b % len(ALPHABETS[name]) + 1, F.lit(1))

    def one(c: Column, i: Column, own: Column) -> Column:
        b = F.conv(F.get(own["digits"], i), 16, 10).cast("int")
        new = F.when(F.rlike(c, F.lit("^[0-9]$" if digits == "digits" else "^[0-9a-f]$")), drawn(b, digits)).when(F.rlike(c, F.lit(r"^\p{IsCyrillic}$")), drawn(b, "cyrillic")).when(F.rlike(c, F.lit(r"^\p{L}$")), drawn(b, "latin")).otherwise(c)
        return new if fixed is None else F.when(i >= own["fixed"], c).otherwise(new)

    drawn_from = F.struct(F.regexp_extract_all(_long(stream, F.length(text)), F.lit(".."), F.lit(0)).alias("digits"), (F.lit(0) if fixed is None else fixed).alias("fixed"))
    return let(drawn_from, lambda own: F.array_join(F.transform(F.split(text, "", -1), lambda c, i: one(c, i, own)), ""))


def _with_check_digit(digits: Column) -> Column:
    """The last digit of a card replaced by the one that makes the sum of the check come out."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, ((F.lit(10) - _check_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def _with_check_digits(account: Column) -> Column:
    """The third and fourth character of an account number replaced by those that make the remainder come out."""
    own = F.concat(F.substring(account, 1, 2), F.lit("00"), F.substring(account, F.lit(5), F.length(account)))
    return F.concat(F.substring(account, 1, 2), F.lpad((F.lit(98) - _remainder(own)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account)))


def _more(stream: Column) -> Column:
    """128 further hex digits of a stream."""
    return F.sha2(F.concat(F.lit("more"), stream), 512)


def _grown(out: Column, stream: Column, more: Column, digits: str, before: bool = False) -> Column:
    """With `more` (128 at most) characters added; digits has 16."""
    extra = F.translate(F.substring(_more(stream), F.lit(1), more), "0123456789abcdef", digits)
    return F.when(more > 0, F.concat(extra, out) if before else F.concat(out, extra)).otherwise(out)


def _made_name(word: Column, gender: Column, stream: Column, more: Column) -> Column:
    def made(script: str) -> Column:
        own = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        part = [F.get(own, _byte(stream, F.lit(k)) % len(SYLLABLES[script])) for k in range(3)]
        extra = F.transform(F.sequence(F.lit(1), more), lambda k: F.get(own, _byte(_more(stream), k) % len(SYLLABLES[script])))
        end = F.lit("")
        for g in ("m", "f"):
            end = F.when(gender == g, F.lit(ENDINGS[g, script])).otherwise(end)
        return F.initcap(F.concat(*part, F.when(more > 0, F.array_join(extra, "")).otherwise(""), end))

    initial = F.concat(F.substring(made("latin"), 1, 1), F.lit("."))
    cyrillic = F.concat(F.substring(made("cyrillic"), 1, 1), F.lit("."))
    own = F.when(F.endswith(word, F.lit(".")), F.struct(initial.alias("l"), cyrillic.alias("c"))).otherwise(F.struct(made("latin").alias("l"), made("cyrillic").alias("c")))
    return F.when(F.rlike(word, F.lit(r"\p{IsCyrillic}")), own["c"]).otherwise(own["l"])


def surrogate(kind: Column, canon: Column, stream: Column, attempt: Column, gender: Column | None = None) -> Column:
    """Canonical form of the replacement that a stream of digits gives."""
    more = F.least(F.greatest(attempt - GROW, F.lit(0)), F.lit(64))
    six = F.concat(F.lit("2001:db8"), F.regexp_replace(F.substring(_more(stream), 1, 24), "(.{4})", ":$1"))
    top = F.length(canon) - F.length(F.substring_index(canon, ".", -1)) - 1
    octet = [(_byte(stream, F.lit(i)) % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)]
    kept = F.when(F.length(canon) == 16, F.lit(1)).otherwise(F.lit(2))
    card = _with_check_digit(F.concat(F.substring(canon, F.lit(1), kept), F.substring(_scrambled(canon, stream), kept + 1, F.length(canon))))
    account = _with_check_digits(F.concat(F.substring(canon, 1, 4), F.upper(_scrambled(F.lower(F.substring(canon, F.lit(5), F.length(canon))), stream))))
    return (
        F.when(kind == "email", _grown(_scrambled(canon, stream, top), stream, more, "abcdefghijklmnop", before=True))
        .when(kind == "ip", F.when(more > 0, six).otherwise(F.concat_ws(".", *octet)))
        .when(kind == "name", _made_name(canon, F.lit("") if gender is None else gender, stream, more))
        .when(kind == "card", card)
        .when(kind == "iban", account)
        .when(kind == "ipv6", F.concat(F.lit("2001:0db8:"), F.substring(_scrambled(canon, stream, digits="hex"), F.lit(11), F.length(canon))))
        .otherwise(_grown(_scrambled(canon, stream), stream, more, "0123456789012345"))
    )


def formatted(entity: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the layout of the entity it replaces; what it has grown by comes first or last."""

    def filled(whole: Column, mark: str) -> Column:
        """The characters of made in place of those that fit the mark, the rest of them at the end."""
        places = F.transform(F.split(whole, "", -1), lambda c: F.rlike(c, F.lit(mark)))
        before = lambda i: F.size(F.filter(F.slice(places, F.lit(1), i + 1), lambda p: p))
        own = F.array_join(F.transform(F.split(whole, "", -1), lambda c, i: F.when(F.rlike(c, F.lit(mark)), F.substring(made, before(i), F.lit(1))).otherwise(c)), "")
        return F.concat(own, F.substring(made, F.size(F.filter(places, lambda p: p)) + 1, F.length(made)))

    code = F.regexp_extract(entity, _CODE, 0)
    phone = F.concat(code, filled(F.substring(entity, F.length(code) + 1, F.length(entity)), "^[0-9]$"))
    more = F.length(made) - F.length(entity)
    like = lambda c, x: F.when(c != F.lower(c), F.upper(x)).otherwise(x)
    cased = F.concat(F.substring(made, F.lit(1), more), let(F.struct(F.split(made, "", -1).alias("made"), more.alias("more")), lambda own: F.array_join(F.transform(F.split(entity, "", -1), lambda c, i: like(c, F.get(own["made"], i + own["more"]))), "")))
    return (
        F.when(kind == "", entity)
        .when(kind == "email", cased)
        .when(kind.isin("ip", "ipv6"), made)
        .when(kind == "name", F.concat(_title(entity), made))
        .when(kind == "iban", filled(entity, "^[A-Z0-9]$"))
        .when(kind == "phone", phone)
        .otherwise(filled(entity, "^[0-9]$"))
    )


def _any_of(words: Column) -> Column:
    """A pattern of distinct words of letters. Those that begin alike share branches for their first letters, so that few are tried at one place; longer ones go first."""

    def joined(own: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(own, i - 1))
            shared = reduce(lambda a, b: a + b, [F.coalesce((F.substring(before, 1, n) == F.substring(w, 1, n)).cast("int"), F.lit(0)) for n in range(1, BRANCHES + 1)])
            opened = [F.when(shared < n, F.concat(F.substring(w, n, 1), F.lit("(?:"))).otherwise("") for n in range(1, BRANCHES + 1)]
            closed = F.when(i > 0, F.concat(F.repeat(F.lit(")"), BRANCHES - shared), F.lit("|"))).otherwise("")
            return F.concat(closed, *opened, F.substring(w, F.lit(BRANCHES + 1), F.length(w)))

        return F.concat(F.array_join(F.transform(own, one), ""), F.lit(")" * BRANCHES))

    return let(F.reverse(F.array_sort(words)), joined)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, gender, attempt of distinct entities(kind, canon, gender) whose first surrogate clashes.

    Words of names with more than one gender are among them, with the one that they have in all documents.
    """
    told = F.collect_set(F.when(F.col("gender") != "", F.col("gender")))
    entities = entities.groupBy("kind", "canon").agg(F.when(F.size(told) == 1, F.get(told, F.lit(0))).otherwise("").alias("gender"), (F.count(F.lit(1)) > 1).alias("mixed"))

    # these are built once, and the attempt is a column, so that all rounds share their compiled code
    stream = _stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    drawn = surrogate(F.col("kind"), F.col("canon"), F.col("stream"), F.col("attempt"), F.col("gender")).alias("made")

    def made(rows: DataFrame, n: int | None = None) -> DataFrame:
        rows = rows.withColumn("attempt", F.col("attempt") + 1).withColumn("stream", stream)
        return saved(rows.select("kind", "canon", "gender", "mixed", "attempt", drawn), n)

    def split(rows: DataFrame, n: int, others: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Of n rows, those that keep their surrogate, and those whose is another's, or a real one, and who move on."""
        own = rows.select("kind", "made")
        own = F.broadcast(own) if n <= BROADCAST_ROWS else own
        taken = [others.select("kind", F.col("canon").alias("made")).join(own, ["kind", "made"], "left_semi")]
        if seen is not None:
            taken.append(seen.select("kind", "made").join(own, ["kind", "made"], "left_semi"))
        shared = rows.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("stays")).where("n > 1").drop("n")
        for t in taken:
            shared = shared.unionByName(t.withColumn("stays", F.lit(None).cast("string")))
        bad = shared.groupBy("kind", "made").agg(F.max("stays").alias("stays"), F.max(F.col("stays").isNull()).alias("all"))
        moves = F.coalesce(F.col("all") | (F.col("canon") != F.col("stays")), F.lit(False)).alias("moves")
        judged = saved(rows.join(bad, ["kind", "made"], "left").select(*rows.columns, moves), n)
        return judged.where("NOT moves").drop("moves"), judged.where("moves").drop("moves")

    every = made(entities.withColumn("attempt", F.lit(-1)))
    settled, moving = split(every, every.count(), every, None)
    later, rounds = settled.where("mixed"), 0
    placed = None  # those that moved and now stay; the others are not written again
    while n := moving.count():  # only these are looked at again; the others stay
        rounds += 1
        stays, moving = split(made(moving, n), n, every, settled if placed is None else settled.unionByName(placed))
        placed = stays if placed is None else placed.unionByName(stays)
        placed = saved(placed) if rounds % 8 == 0 else placed
    return (later if placed is None else later.unionByName(placed)).select("kind", "canon", "gender", "attempt")


def replace(docs: DataFrame, key: str | None = None, bits: int | None = None) -> DataFrame:
    """doc_id, text (rewritten), n_entities and a count for each type, of docs(doc_id, text)."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    hint = F.rlike("t", F.lit(HINT))
    for own in TITLES.values():
        for title in own:
            hint = hint | F.contains("t", F.lit(title))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", F.col("text").alias("t"))
    rows = rows.withColumn("first", F.coalesce(F.when(hint, F.regexp_extract_all("t", F.lit(ANY), F.lit(0))), none))
    named = F.flatten(F.transform(F.filter("first", lambda e: type_of(e) == "name"), _tokens))
    rows = rows.withColumn("words", F.array_distinct(F.filter(named, _is_word)))
    word = F.concat(F.lit(r"(?:"), _any_of(F.col("words")), F.lit(r")(?!\p{L})"))
    again = F.concat(F.lit(rf"{ANY}|(?<!\p{{L}})"), word, F.lit("(?:[ -]"), word, F.lit(")*+"))
    rows = rows.withColumn("pattern", F.when(F.size("words") > 0, again).otherwise(F.lit(ANY)))
    rows = rows.withColumn("found", F.when(F.size("words") > 0, F.regexp_extract_all("t", "pattern", F.lit(0))).otherwise(F.col("first"))).drop("first", "words")
    rows = rows.withColumn("found", F.transform("found", lambda e: F.struct(e.alias("entity"), type_of(e).alias("kind"))))
    mentions = rows.select("doc_id", F.xxhash64("t").alias("mark"), F.explode(F.flatten(F.transform("found", lambda e: keys(e["entity"], e["kind"])))).alias("e")).select("doc_id", "mark", "e.*")
    counts = saved(mentions.groupBy("kind", "canon", "gender").agg(F.count(F.lit(1)).alias("n")))
    later = saved(attempts(counts.select("kind", "canon", "gender"), key))

    no_later = F.lit(None).cast("map<string,struct<attempt:int,gender:string>>")
    if later.isEmpty():
        ready = rows.withColumn("later", no_later)
    else:
        known = saved(later.join(counts.groupBy("kind", "canon").agg(F.sum("n").alias("n")), ["kind", "canon"]))
        held = matched(saved(mentions.drop("gender").distinct()), known, ["kind", "canon"], counts.agg(F.sum("n")).first()[0])
        entry = F.struct(F.concat_ws(":", "kind", "canon").alias("k"), F.struct("attempt", "gender").alias("v"))
        held = saved(held.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_set(entry)).alias("later")))
        rows = rows.withColumn("mark", F.xxhash64("t"))
        marked = with_maybe(rows, bitmap(held, "mark", bits), "mark", "maybe")
        some = marked.where("maybe").alias("r").join(held.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.mark") == F.col("h.mark")), "left")
        ready = marked.where("NOT maybe").select("doc_id", "t", "found", "pattern").withColumn("later", no_later)
        ready = ready.unionByName(some.select("r.doc_id", "r.t", "r.found", "r.pattern", "h.later"))

    def told(kind: Column, canon: Column) -> Column:
        return F.try_element_at(F.col("later"), F.concat_ws(":", kind, canon))

    part_steps = (  # one after the other, so that none is computed twice
        lambda p: F.struct(p["kind"].alias("kind"), p["canon"].alias("canon"), p["gender"].alias("gender"), told(p["kind"], p["canon"]).alias("told")),
        lambda p: F.struct(p["kind"].alias("kind"), p["canon"].alias("canon"), F.coalesce(p["told"]["gender"], p["gender"]).alias("gender"), F.coalesce(p["told"]["attempt"], F.lit(0)).alias("attempt")),
        lambda p: F.struct(*[p[c].alias(c) for c in ("kind", "canon", "gender", "attempt")], _stream(key, p["kind"], p["canon"], p["attempt"]).alias("stream")),
        lambda p: F.when(p["kind"] == "", p["canon"]).when((p["kind"] == "name") & ~(F.rlike(p["canon"], F.lit(rf"^{_INITIAL}$")) | _is_word(p["canon"])), p["canon"]).otherwise(surrogate(p["kind"], p["canon"], p["stream"], p["attempt"], p["gender"])),
    )

    def parts(e: Column) -> Column:
        whole = lambda canon, gender: F.struct(e["kind"].alias("kind"), canon.alias("canon"), gender.alias("gender"))
        tokens = F.transform(_tokens(e["entity"]), lambda w, i: whole(w, F.when((i == 0) & _is_word(w), _gender(e["entity"])).otherwise("")))
        out = F.when(e["kind"] == "name", tokens).otherwise(F.array(whole(canonical(e["entity"], e["kind"]), F.lit(""))))
        for step in part_steps:
            out = F.transform(out, step)
        return F.array_join(out, "")

    steps = (
        lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), parts(e).alias("made")),
        lambda e: formatted(e["entity"], e["kind"], e["made"]),
    )
    ready = ready.withColumn("new", F.col("found"))
    for step in steps:
        ready = ready.withColumn("new", F.transform("new", step))
    ready = ready.withColumn("gaps", F.when(F.size("found") > 0, F.split("t", F.col("pattern"), -1)))
    woven = F.array_join(F.zip_with("gaps", F.col("new"), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    text = F.when(F.size("found") > 0, woven).otherwise(F.col("t"))

    def count(k: str) -> Column:
        return F.size(F.filter("found", lambda e: e["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in TYPES]
    return ready.select("doc_id", text.alias("text"), F.size(F.filter("found", lambda e: e["kind"] != "")).cast("long").alias("n_entities"), *counts)
