"""Personal data: detected entities get keyed surrogates, with column
expressions only (no Python on the executors, no shuffle to rewrite a text).

A surrogate is the image of the entity under a keyed bijection of all strings
of its format: the string is cut in halves, every letter or digit of the left
half is shifted inside its own alphabet by a stream keyed by the right half,
then the right half by a stream keyed by the new left half (two Feistel
rounds). No shift is zero, so no letter or digit of an alphabet survives; being a
bijection it keeps distinct entities distinct without a table of all of them,
and the same entity gets the same surrogate in every document. Streams ignore
case, so mentions that differ in case stay mentions of one entity.

Type rules. email: domain and local part are mapped separately (one domain
stays one domain), the top-level domain stays. phone: the country code stays;
an international number ends where seven digits are complete and a group with a
leading zero starts the next one. card: the first digit stays, and the last
digit keeps its distance from the Luhn digit (a valid number stays valid). ip:
octets stay octets, IPv6 digits stay digits and letters letters. secret: the
label and quotes stay, the whole value of any length is replaced; hexadecimal
values stay hexadecimal. Keys and access tokens of known forms keep their
prefix. IBANs keep their country and, where they were valid, valid check digits.

Names follow a title and have any number of words: the title (and so the
gender) stays; a name of the built-in lists becomes another of the same
gender and script, another name is shifted vowel to vowel and consonant to
consonant in its own script with its last letter (a gender mark) kept, any
other letter that has case moves inside its own script, range of 128 code points
and case, and a letter without case inside the run of such letters it stands in
(names of such scripts keep no last letter). A shifted name that hits a list
name is shifted again, so lists and shifts cannot collide. Every word of a name
with a title is replaced in the same document wherever it stands as a word, with
a title or without, by the same surrogate: mentions of one person stay mentions
of one person.

The key is a parameter without a default: take it from a secret store. The
registered query and the pipeline read it from the session
(``spark.lipi.pii.key``); where that is unset, every application draws its own.

``collision_check`` compares all distinct entities with their surrogates and
counts those that share one or did not change.

Defined results: null text stays null; text without entities is returned as
it is, byte for byte; rows are never dropped; repeated rows and null ids are
rewritten like any other; added columns replace input columns of their name.
"""

from __future__ import annotations

import secrets
import unicodedata
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SETTING = "spark.lipi.pii.key"
_DRAWN: dict = {}


def session_key(spark) -> str:
    """The session's key, or one drawn at random for this application."""
    key = spark.conf.get(KEY_SETTING, None)
    return key or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


# Names of the built-in lists, by script and gender.
NAMES = {
    "latin_f": "Anna Maria Emma Laura Julia Sophie Clara Elena Lucia Marie Alice Sarah Nora Paula Ines Carmen Camille",
    "latin_m": "John Paul Peter Thomas David Lucas Simon Martin Hugo Felix Oscar Daniel Carlos Pablo Jean Pierre Louis",
    "cyrillic_f": "Анна Мария Елена Ольга Ирина Наталья Татьяна",
    "cyrillic_m": "Иван Пётр Сергей Алексей Дмитрий Николай Павел",
}
# Titles a name follows.
TITLES = ("Mr Mrs Ms Miss Mx Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Господин Госпожа "
          "Dr Doctor Doktor Docteur Doctora Prof Professor Professorin Professeur Profesor Profesora")

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
ALNUM = (DIGITS, LOWER, UPPER)
PARTS_OF_NAME = tuple(x for low in ("aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóúàèìòùâêîôûäëïöü", "çñß",
                                    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
                      for x in dict.fromkeys((low, low.replace("ß", "").upper())))



def _other_letters() -> list:
    """Alphabets of all letters with case that PARTS_OF_NAME lacks, of two
    letters at least: by script and range of 128 code points, letters that are
    each other's upper and lower case at the same places."""
    known = set("".join(PARTS_OF_NAME))
    pairs, alone = defaultdict(list), defaultdict(list)
    for c in map(chr, range(0x80, 0x20000)):
        kind = unicodedata.category(c)
        if kind not in ("Lu", "Ll", "Lt") or c in known:
            continue
        script, low, up = unicodedata.name(c).split()[0], c.lower(), c.upper()
        if kind == "Lu" and len(low) == 1 and low != c and low.upper() == c and low not in known:
            pairs[script, ord(low) >> 7].append(c + low)
        elif not (kind == "Ll" and len(up) == 1 and up != c and up.lower() == c and up not in known):
            alone[script, ord(c) >> 7, kind].append(c)
    out, few, few_alone = [], [], defaultdict(list)
    for found in pairs.values():
        if len(found) > 1:
            out += ["".join(x[i] for x in found) for i in (0, 1)]
        else:
            few += found
    for (_, _, kind), found in alone.items():
        if len(found) > 1:
            out.append("".join(found))
        else:
            few_alone[kind] += found
    out += ["".join(x[i] for x in few) for i in (0, 1)] + ["".join(x) for x in few_alone.values()]
    return [x for x in out if len(x) > 1]


OTHER_LETTERS = _other_letters()


def _caseless_runs() -> list:
    """(first code point, length) of the runs of letters without case, of two at least."""
    runs: list = []
    for cp in range(0xAA, 0x30000):
        if unicodedata.category(chr(cp)) == "Lo":
            if runs and sum(runs[-1]) == cp:
                runs[-1][1] += 1
            else:
                runs.append([cp, 1])
    return [r for r in runs if r[1] > 1]


CASELESS = _caseless_runs()

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_.+-])", r"(?![\p{L}\p{N}_])"
_WORD = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}'’-]*+"
_TITLE = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(TITLES.split(), key=len, reverse=True)) + r")\.? "
_LABEL = (r"(?i:passwords?|passwd|passphrase|pwd|pw|pass|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|"
          r"(?:passport|id card|reisepass|pasaporte|passeport)(?: (?:no|nr|number|nummer)\b\.?)?)\s{0,3}[=:#]\s{0,3}[\x22']?")
_H = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}" + _AFTER,
    "key_id": _BEFORE + r"(?:AKIA[0-9A-Z]{16}|(?:gh[oprsu]_|github_pat_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}+"
              r"|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){1,2})" + _AFTER,
    "bearer": r"(?<![\p{L}\p{N}_])(?i:bearer) {1,3}(?=[A-Za-z_+/.=~-]*+\d)[A-Za-z0-9._~+/=-]{8,}+",
    "secret": r"(?<![\p{L}\p{N}_])" + _LABEL + r"(?:(?<=[=][\x22']?)|(?=[A-Za-z_+/.=-]*+\d))[A-Za-z0-9_+/.=-]{4,}[A-Za-z0-9_+/=]",
    "ip": _BEFORE + rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![\p{{L}}\p{{N}}_]|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}_:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:)(?![\p{{L}}\p{{N}}_:])",
    "iban": _BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "ssn": _BEFORE + r"\d{3}-\d{2}-\d{4}" + _AFTER,
    "phone": r"(?<![\p{L}\p{N}_+])\+\d{1,3}(?:[ .()-]{0,2}\d){6}(?:[ .()-]{0,2}\d{1,9}+)(?:[ .-](?!0\d\d)\d{2,4}+(?![.-]?\d)){0,3}" + _AFTER
             + r"|(?<![\p{L}\p{N}_+-])\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}" + _AFTER
             + "|" + _BEFORE + r"(?:\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{3,8}(?:[ -](?!0)\d{2,4}){0,2}|\d{3}-\d{4})(?![\p{L}\p{N}_]|-\d)",
    "card": _BEFORE + r"\d(?:[ -]?\d){12,18}" + _AFTER,
    "name": _TITLE + _WORD + "(?: " + _WORD + ")*+",
}
ENTITY = "|".join(PATTERNS.values())
#: every entity holds a digit, an at or equals sign or a title: other texts are not searched
HINT = "[0-9@=]|" + _TITLE + r"[\p{Lu}\p{Lt}\p{Lo}]"


def kind_of(e: Column) -> Column:
    return (F.when(e.rlike("^" + _LABEL), "secret").when(e.rlike("^(?i:bearer) "), "bearer")
            .when(e.rlike("^[^ ]+@"), "email").when(e.rlike("^" + _TITLE), "name")
            .when(e.rlike("^(?:AKIA[0-9A-Z]{16}|gh[oprsu]_|github_pat_|sk-|xox|AIza|eyJ)"), "key_id")
            .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(e.rlike("^[0-9A-Fa-f]{0,4}:"), "ipv6")
            .when(e.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]"), "iban").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(e.rlike(r"^[+(0]|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^\d{3}-\d{4}$") & ~e.rlike(r"^0(?:[ -]?\d){12,18}$"), "phone")
            .when(e.rlike(r"^\d"), "card").otherwise("mention"))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda variable is not
    copied into every place that reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stream(key: str, tweak: Column, seed: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "\x00"), tweak, F.lit("\x00"), F.lower(seed)).cast("binary"), 256)


def _digit(stream: Column, i: Column) -> Column:
    """The i-th number (0..65535) of a hexadecimal stream."""
    return F.conv(F.substr(stream, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")


def _shift_other(c: Column, n: Column) -> Column:
    """A letter of OTHER_LETTERS moved on inside its alphabet."""
    every = F.lit("".join(OTHER_LETTERS))
    starts, sizes = [], []
    for a in OTHER_LETTERS:
        starts += [str(len(starts))] * len(a)
        sizes += [str(len(a))] * len(a)
    at = F.position(c, every)
    start, size = (F.get(F.split(F.lit(" ".join(x)), " "), at - 1).cast("int") for x in (starts, sizes))
    return (F.when(at > 0, F.substr(every, start + F.pmod(at - start + n % (size - 1), size) + 1, F.lit(1)))
            .otherwise(_shift_caseless(c, n)))


def _shift_caseless(c: Column, n: Column) -> Column:
    """A letter without case moved on inside its run."""
    firsts, sizes = (F.split(F.lit(" ".join(str(r[i]) for r in CASELESS)), " ") for i in (0, 1))

    def moved(x):
        run = F.size(F.filter(firsts, lambda f: f.cast("int") <= x["cp"])) - 1
        first, size = F.get(firsts, run).cast("int"), F.get(sizes, run).cast("int")
        to = first + F.pmod(x["cp"] - first + 1 + x["n"] % (size - 1), size)
        return F.when((run >= 0) & (x["cp"] < first + size), F.decode(F.unhex(F.lpad(F.hex(to), 8, "0")), "UTF-32")).otherwise(x["c"])
    return F.when(c.rlike(r"^\p{Lo}$"), let(F.struct(F.ascii(c).alias("cp"), n.alias("n"), c.alias("c")), moved)).otherwise(c)


def shift(text: Column, stream: Column, alphabets) -> Column:
    """Every character moves on inside its alphabet, by at least one place."""
    def move(c, n):
        out = None
        for a in alphabets:
            at = F.position(c, F.lit(a))
            to = F.substr(F.lit(a), F.pmod(at + n % F.lit(len(a) - 1), F.lit(len(a))) + 1, F.lit(1))
            out = F.when(at > 0, to) if out is None else out.when(at > 0, to)
        return out.otherwise(_shift_other(c, n) if alphabets is PARTS_OF_NAME else c)
    return F.when(F.length(text) == 0, F.lit("")).otherwise(let(stream, lambda s: F.array_join(
        F.transform(F.split(text, ""), lambda c, i: let(_digit(s, i), lambda n: move(c, n))), "")))


def permute(text: Column, tweak: Column, key: str, alphabets=ALNUM) -> Column:
    """Keyed bijection of the strings with the format of ``text``."""
    def rounds(h):
        left, right = h["left"], h["right"]
        return let(shift(left, _stream(key, h["tweak"], right), alphabets), lambda new_left: F.concat(
            new_left, shift(right, _stream(key, h["tweak"], new_left), alphabets)))

    def halves(x):
        half = F.floor(F.length(x["t"]) / 2).cast("int")
        return F.struct(F.substr(x["t"], F.lit(1), half).alias("left"),
                        F.substr(x["t"], half + 1, F.greatest(F.length(x["t"]), F.lit(1))).alias("right"),
                        x["k"].alias("tweak"))
    return let(let(F.struct(text.alias("t"), tweak.alias("k")), halves), rounds)


def _luhn(payload: Column) -> Column:
    """Check digit of a digit string."""
    def total(p):
        return F.aggregate(F.transform(F.split(p, ""), lambda c, i: F.when(
            (F.length(p) - i) % 2 == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
            .otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.pmod(-let(payload, total), F.lit(10))


def _email(e, key):
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    tld = F.substring_index(host, ".", -1)
    name = F.substr(host, F.lit(1), F.length(host) - F.length(tld) - 1)
    return F.concat(permute(local, F.concat(F.lit("local:"), F.lower(host)), key), F.lit("@"),
                    permute(name, F.concat(F.lit("host:"), F.lower(tld)), key), F.lit("."), tld)


def _kept_prefix(e, prefix, key, kind, alphabets=ALNUM):
    return F.concat(prefix, permute(F.substr(e, F.length(prefix) + 1, F.length(e)),
                                    F.concat(F.lit(kind + ":"), F.lower(prefix)), key, alphabets))


def _ip(e, key):
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    two = lambda a, b: F.concat(a.cast("string"), F.lit("."), b.cast("string"))
    step = lambda x, s, i: F.pmod(x + 1 + _digit(s, F.lit(i)) % 255, F.lit(256))


    def rounds(o):
        return let(let(_stream(key, F.lit("ip:"), two(o[2], o[3])), lambda s: two(step(o[0], s, 0), step(o[1], s, 1))),
                   lambda new: F.concat(new, F.lit("."), let(_stream(key, F.lit("ip:"), new), lambda s: two(
                       step(o[2], s, 0), step(o[3], s, 1)))))
    return let(o, rounds)


def _card(e, key):
    """First digit kept, the middle permuted, the last keeps its distance
    from the Luhn digit of what stands before it."""
    last = F.substr(e, F.length(e), F.lit(1)).cast("int")
    body = F.substr(e, F.lit(1), F.length(e) - 1)
    only = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return let(_kept_prefix(body, F.substr(body, F.lit(1), F.lit(1)), key, "card"), lambda new: F.concat(
        new, F.pmod(_luhn(only(new)) + last - _luhn(only(body)), F.lit(10)).cast("string")))


_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _iban(e, key):
    """Country kept, the account permuted; the check digits keep their distance
    from the right ones, so a valid number stays valid."""
    def right(account):
        digits = F.split(F.concat(F.regexp_replace(account, " ", ""), F.substr(e, F.lit(1), F.lit(2)), F.lit("00")), "")
        left = F.aggregate(F.transform(digits, lambda c: F.position(c, F.lit(_VALUES)) - 1), F.lit(0),
                           lambda s, v: F.pmod(s * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))
        return F.lit(98) - left
    account = F.substr(e, F.lit(5), F.length(e))
    country, check = F.substr(e, F.lit(1), F.lit(2)), F.substr(e, F.lit(3), F.lit(2)).cast("int")
    return let(permute(account, F.concat(F.lit("iban:"), country), key), lambda new: F.concat(
        country, F.lpad(F.pmod(right(new) + check - right(account), F.lit(100)).cast("string"), 2, "0"), new))


def _secret(e, key):
    label = F.regexp_extract(e, "^" + _LABEL, 0)
    value = F.substr(e, F.length(label) + 1, F.length(e))
    return F.concat(label, F.when(value.rlike("^[0-9a-f]+$"), permute(value, F.lit("hex:"), key, (HEX,)))
                    .otherwise(permute(value, F.lit("secret:"), key)))


def _name_word(w, key):
    lists = {k: v.split() for k, v in NAMES.items()}
    every = [n for v in lists.values() for n in v]

    def walk(x):
        kept = F.when(x.rlike(r"\p{Lo}$"), F.lit("")).otherwise(F.right(x, F.lit(1)))
        return let(kept, lambda end: F.concat(permute(F.substr(x, F.lit(1), F.length(x) - F.length(end)),
                                                      F.concat(F.lit("name:"), end), key, PARTS_OF_NAME), end))
    out = None
    for k, v in lists.items():
        turn = F.lit(1) + _digit(_stream(key, F.lit("list:"), F.lit(k)), F.lit(0)) % F.lit(len(v) - 1)
        names = F.array(*[F.lit(n) for n in v])
        hit = F.array_position(names, w)
        pick = F.element_at(names, (F.pmod(hit - 1 + turn, F.lit(len(v))) + 1).cast("int"))
        out = F.when(hit > 0, pick) if out is None else out.when(hit > 0, pick)
    return out.otherwise(let(walk(w), lambda once: F.when(once.isin(every), walk(once)).otherwise(once)))


def _name(e, key):
    """A name with or without its title."""
    title = F.regexp_extract(e, "^(?:" + _TITLE + ")?", 0)
    words = F.split(F.substr(e, F.length(title) + 1, F.length(e)), " ")
    return F.concat(title, F.array_join(F.transform(words, lambda w: _name_word(w, key)), " "))


def surrogate(e: Column, key: str) -> Column:
    """The keyed replacement of one detected entity."""
    def by_kind(kind):
        prefix = F.regexp_extract(e, "^(?:AKIA|gh[oprsu]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ)", 0)
        return (F.when(kind == "email", _email(e, key)).when(kind == "secret", _secret(e, key))
                .when(kind == "ip", _ip(e, key)).when(kind == "card", _card(e, key)).when(kind.isin("name", "mention"), _name(e, key))
                .when(kind == "iban", _iban(e, key))
                .when(kind == "key_id", _kept_prefix(e, prefix, key, "key_id"))
                .when(kind == "bearer", _kept_prefix(e, F.regexp_extract(e, "^[A-Za-z]+ +", 0), key, "bearer"))
                .when(kind == "ipv6", permute(e, F.lit("ipv6:"), key, (DIGITS, "abcdef", "ABCDEF")))
                .when(kind == "phone", _kept_prefix(e, F.regexp_extract(e, r"^(\+\d{1,3}(?=[ .(-]))?", 0), key, "phone"))
                .otherwise(permute(e, F.lit("ssn:"), key)))
    return let(kind_of(e), by_kind)


def mentions(entities: Column) -> Column:
    """Pattern of the words of all names with a title, the longest first; null
    without any. Shorter words than two letters stand for nobody."""
    words = F.flatten(F.transform(F.filter(entities, lambda e: e.rlike("^" + _TITLE)), lambda e: F.filter(
        F.split(F.regexp_replace(e, "^" + _TITLE, ""), " "), lambda w: F.length(w) > 1)))
    order = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    every = F.transform(order, lambda x: F.concat(F.lit(r"\Q"), x["w"], F.lit(r"\E")))
    return F.when(F.size(every) > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(every, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])")))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, plus entities and surrogates (arrays in
    text order). Texts with names are searched again for their words."""
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in docs.columns if c not in ("entities", "surrogates")]
    t = F.col("t")
    found = (docs.select(F.struct(*[F.col(c) for c in keep]).alias("r"), F.col(text_col).alias("t"))
             .withColumn("e", F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))))
             .withColumn("m", mentions(F.col("e")))
             .withColumn("p", F.when(F.col("m").isNotNull(), F.concat(F.lit(ENTITY + "|"), F.col("m"))))
             .withColumn("e", F.when(F.col("p").isNotNull(), F.regexp_extract_all(t, F.col("p"), F.lit(0))).otherwise(F.col("e")))
             .withColumn("hit", F.coalesce(F.size("e") > 0, F.lit(False))))
    made = found.withColumn("s", F.when(F.col("hit"), F.transform("e", lambda e: surrogate(e, key))))
    parts = F.when(F.col("p").isNotNull(), F.split(t, F.col("p"), -1)).otherwise(F.split(t, ENTITY, -1))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get("s", i), F.lit("")))), "")
    empty = F.array().cast("array<string>")
    return made.select(*[F.when(F.col("hit"), joined).otherwise(t).alias(c) if c == text_col
                         else F.col("r").getField(c).alias(c) for c in keep],
                       F.coalesce("e", empty).alias("entities"), F.coalesce("s", empty).alias("surrogates"))


def entity_table(found: DataFrame) -> DataFrame:
    """Distinct (kind, entity, surrogate), in lower case, over all documents."""
    pair = found.select(F.explode(F.arrays_zip("entities", "surrogates")).alias("p"))
    return pair.select(kind_of(F.col("p.entities")).alias("kind"), F.lower("p.entities").alias("entity"),
                       F.lower("p.surrogates").alias("surrogate")).distinct()


def collision_check(found: DataFrame) -> DataFrame:
    """kind, surrogate, n_entities of every surrogate that stands for more
    than one entity, or equals its entity. Empty unless something is wrong."""
    e = entity_table(found)
    return (e.groupBy("kind", "surrogate").agg(
        F.count("*").alias("n_entities"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("same"))
        .where("n_entities > 1 or same = 1"))
