"""PII surrogates: detected entities get keyed, type-consistent replacements, checked for collisions.

Entities are mail addresses, IPv4 addresses, card, account and social security numbers, phone numbers of 7 to 15 digits, and names: those after a
title or a phrase that introduces a name, and every further mention of their words in the same text. A surrogate is drawn from a keyed SHA-256 of the
entity's kind and normal form, so one entity has one surrogate in the whole corpus (coreference), whatever its spelling or title: letter case, and the
separators of numbers, follow the original. Numbers keep their length, separators and leading country or network digits; cards and accounts get valid check
digits if they had some, and letters of accounts are drawn as digits are; names keep title, particles, script, letter case and gender. A given name has
the gender that the titles before it tell in the whole corpus, none if they differ. Addresses move to `.example`, which nobody owns.

Distinctness: the surrogates of all distinct entities are compared; of entities that would share one, all but the least draw
again, until none is shared. Each draw of a name or mail address has more syllables than the one before; numbers get more digits, and IP
addresses the longer form of the range for documentation, from draw `WIDEN` on. So there are ever more surrogates and the draws end, however many entities there
are. Draws beyond the first and genders are facts; they are joined to the texts that hold their entities. Main path: DataFrame functions only.

Cases: null texts stay null; texts without entities stay as they are; an entity next to letters or digits of its own kind
is none; equal texts are rewritten alike, whatever their doc_id, which is not looked at; an empty table gives an empty
result; very long texts are rewritten whole; other columns pass through `replace` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import fresh, let, materialise, table

KEY = "surrogates"
#: Rows and bytes up to which the facts by text are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: The draw from which numbers grow.
WIDEN = 6
SYLLABLES = 4

# Titles and the gender they tell (f, m or n), phrases that introduce a name, particles within names, calling codes of two digits.
TITLES = {
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Fräulein": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Srta": "f", "Doña": "f",
    "Lady": "f", "Dame": "f", "г-жа": "f", "Κυρία": "f",
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Sir": "m", "Lord": "m", "г-н": "m", "Κύριος": "m",
    "Mx": "n", "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n", "Doktor": "n", "Docteur": "n", "Professeur": "n", "Rabbi": "n", "Imam": "n", "Rev": "n", "Reverend": "n", "Judge": "n", "Senator": "n",
    "Captain": "n", "Capt": "n", "Colonel": "n", "Sergeant": "n", "Sgt": "n",
}
CUES = ("[Mm]y name is", "[Mm]ein Name ist", "[Ii]ch heiße", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Mm]i nombre es", "Sincerely,", "Signed by", "Full name:")
PARTICLES = ("von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "zu", "bin", "ibn", "al", "el", "la", "le", "ter")
TWO_DIGIT_CODES = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_TITLE = "(?:" + "|".join(sorted(TITLES, key=lambda t: (-len(t), t))) + ")"
_BEFORE = rf"(?:{_TITLE}\.? |(?:{'|'.join(CUES)})[ \n]{{1,2}})"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_NAMES = rf"{_NAME}(?: (?:\p{{Lu}}\. )?(?:(?:{'|'.join(PARTICLES)}) )*{_NAME})?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CARD = r"(?<![\p{L}\p{N}-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![\p{L}\p{N}])"
_IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\p{{L}}\p{{N}}])"
_SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
#: A digit of a phone number and what may stand before it; another entity that starts there is none of its groups.
_NEXT = rf"(?:[ .-](?!{_IP}|{_SSN}|{_CARD}))?[0-9]"
#: 7 to 15 digits in groups of any length, as many whole groups as fit, the area in brackets or not.
_WORLD = rf"[0-9](?:{_NEXT}){{6,14}}(?![\p{{L}}\p{{N}}])|" + "|".join(
    rf"[0-9]{{{c}}}[ .-]?\([0-9]{{{a}}}\)(?:{_NEXT}){{{max(1, 7 - c - a)},{15 - c - a}}}(?![\p{{L}}\p{{N}}])" for c in (1, 2, 3) for a in (1, 2, 3, 4)
)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,24}(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}}){_BEFORE}{_NAMES}",
    "ip": _IP,
    "ssn": _SSN,
    "phone": rf"(?<![\p{{L}}\p{{N}}+])\+(?:{_WORLD})|" + r"(?<![\p{L}\p{N}(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "card": _CARD,
}
ANY = "|".join(PATTERNS.values())
_HEX = "0123456789abcdef"
#: Letters that stand for hex digits in made-up words, and endings of given names (f, m, n) and surnames, by script.
_LETTERS = {
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоаеиоаеиоаеио", "а", "ен", "е", "н"),
    "greek": ("βγδζθκλμνξπρστφχ", "αειοαειοαειοαειο", "α", "εν", "ε", "ν"),
    "latin": ("bcdfghjklmnprstv", "aeioaeioaeioaeio", "a", "en", "e", "n"),
}
_CAPITALS = "BCDFGHJKLMNPRSTV"
_NO_FACTS = "map<string,struct<draw:int,gender:string>>"


def _is(kind: str, x: Column) -> Column:
    return x.rlike(f"^(?:{PATTERNS[kind]})$")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(x: Column) -> Column:
    """The kind of a match; `mention` if it is one of a name found elsewhere in its text."""
    out = F.lit("mention")
    for kind in reversed(PATTERNS):
        out = F.when(_is(kind, x), F.lit(kind)).otherwise(out)
    return out


def _gender(x: Column) -> Column:
    told = lambda g: "^(?:" + "|".join(sorted((t for t in TITLES if TITLES[t] == g), key=lambda t: (-len(t), t))) + r")\.? "
    return F.when(x.rlike(told("f")), F.lit("f")).when(x.rlike(told("m")), F.lit("m")).otherwise(F.lit("n"))


def _name_words(x: Column) -> Column:
    """The words of the name in a match, without what stands before it."""
    return F.split(F.regexp_replace(x, f"^{_BEFORE}(?=\\p{{Lu}})", ""), " ")


def _role(words: Column, known: Column):
    """(word, place) -> unit `given:...` or `surname:...`, null for particles and initials. The last word is the surname, unless the text has it as a given name only."""

    def of(w: Column, i: Column) -> Column:
        low = F.lower(w)
        surname = F.concat(F.lit("surname:"), low)
        given = F.concat(F.lit("given:"), low)
        last = (i == F.size(words) - 1) & (F.array_contains(known, surname) | ~F.array_contains(known, given))
        return F.when(w.rlike(rf"^{_NAME}$"), F.when(last, surname).otherwise(given))

    return of


def _parts(x: Column, kind: Column, known: Column) -> Column:
    """Array of (unit, sample, gender) that a match is made of: one for each word of a name, else one."""
    nobody = F.lit("n")

    def named(words: Column) -> Column:
        role = _role(words, known)
        each = F.transform(words, lambda w, i: F.struct(role(w, i).alias("unit"), w.alias("sample"), F.when(role(w, i).startswith("given:"), _gender(x)).otherwise(nobody).alias("gender")))
        return F.filter(each, lambda p: p["unit"].isNotNull())

    plain = F.when(kind.isin("email", "ip"), F.lower(x)).when(kind == "account", F.replace(x, F.lit(" "), F.lit(""))).otherwise(_digits(x))
    one = F.array(F.struct(F.concat_ws(":", kind, plain).alias("unit"), x.alias("sample"), nobody.alias("gender")))
    return F.when(kind.isin("name", "mention"), let(_name_words(x), named)).otherwise(one)


def _found(text: Column) -> Column:
    """Struct of all matches of a text in order, the units of its introduced names, and the pattern that finds the matches."""
    hint = text.rlike(rf"[0-9]\.?[0-9]|\+[0-9]|@|(?<!\p{{L}}){_BEFORE}\p{{Lu}}")
    none = F.array().cast("array<string>")
    first = F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)

    def out(m: Column, known: Column, pattern: Column) -> Column:
        return F.struct(m.alias("m"), known.alias("known"), pattern.alias("pattern"))

    def of(m: Column) -> Column:
        parts = F.flatten(F.transform(F.filter(m, lambda x: _is("name", x)), lambda x: _parts(x, F.lit("name"), none)))

        def again(p: Column) -> Column:
            words = F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda y: y["sample"])), lambda a, b: F.length(b) - F.length(a)), "|")
            pattern = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), words, F.lit(")(?: (?:"), words, F.lit(r"))*(?![\p{L}\p{N}])"))
            return F.when(F.size(p) == 0, out(m, none, F.lit(ANY))).otherwise(let(pattern, lambda q: out(F.regexp_extract_all(text, q, F.lit(0)), F.transform(p, lambda y: y["unit"]), q)))

        return let(parts, again)

    return let(first, of)


def matches(text: Column) -> Column:
    """All matches in a text, in order. Texts without a digit, an `@` or what introduces a name are not searched."""
    return _found(text)["m"]


def _entities(text: Column) -> Column:
    """Array of the (unit, sample, gender) of a text."""
    return let(_found(text), lambda f: F.flatten(F.transform(f["m"], lambda x: _parts(x, kind_of(x), f["known"]))))


def _hex(unit: Column, draw: Column, n: int, key: str) -> Column:
    """The n-th keyed digest of a unit, 64 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(n)), draw.cast("string"), unit), 256)


def _number(unit: Column, draw: Column, key: str) -> Column:
    """60 keyed decimal digits."""
    chunks = F.flatten(F.array(*[let(_hex(unit, draw, n, key), lambda h: F.array(F.substring(h, 1, 15), F.substring(h, 16, 15))) for n in range(2)]))
    return F.array_join(F.transform(chunks, lambda c: F.lpad(F.pmod(F.conv(c, 16, 10).cast("long"), F.lit(10**15)).cast("string"), 15, "0")), "")


def _script(x: Column) -> Column:
    """Struct of the letters for made-up words like x."""
    tables = {s: F.struct(*[F.lit(t).alias(n) for n, t in zip(("consonants", "vowels", "f", "m", "n", "surname"), letters, strict=True)]) for s, letters in _LETTERS.items()}
    return F.when(x.rlike(r"\p{IsCyrillic}"), tables["cyrillic"]).when(x.rlike(r"\p{IsGreek}"), tables["greek"]).otherwise(tables["latin"])


def _letter(h: Column, place: Column, table_: Column) -> Column:
    return F.call_function("translate", F.substr(h, place, F.lit(1)), F.lit(_HEX), table_)


def _word(h: Column, syllables: Column, script: Column) -> Column:
    """A made-up word from hex digits."""
    each = F.transform(F.sequence(F.lit(0), F.least(syllables, F.lit(30)) - 1), lambda i: F.concat(_letter(h, 2 * i + 1, script["consonants"]), _letter(h, 2 * i + 2, script["vowels"])))
    return F.array_join(each, "")


def _fill(pattern: Column, digits: Column, letters: Column | None = None, more: Column | None = None) -> Column:
    """pattern with its digits, and its capitals if letters are given, replaced one by one by those at their places; `more` digits are added."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc, c):
        new = F.when(c.rlike("[0-9]"), F.substr(digits, acc["i"], F.lit(1)))
        if letters is not None:
            new = new.when(c.rlike("[A-Z]"), F.substr(letters, acc["i"], F.lit(1)))
        return F.struct(F.concat(acc["s"], new.otherwise(c)).alias("s"), F.when(c.rlike("[0-9]" if letters is None else "[0-9A-Z]"), acc["i"] + 1).otherwise(acc["i"]).alias("i"))

    end = (lambda acc: acc["s"]) if more is None else (lambda acc: F.concat(acc["s"], F.substr(digits, acc["i"], more)))
    return F.aggregate(F.split(pattern, ""), start, step, end)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""

    def step(acc, c):
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((acc["n"] + F.when(acc["i"] % 2 == 1, twice).otherwise(d)).alias("n"), (acc["i"] + 1).alias("i"))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")), step, lambda acc: acc["n"] % 10)


def _mod97(account: Column) -> Column:
    """Remainder of an account number without blanks, its first four signs moved to the end and letters read as 10 to 35."""
    chars = F.filter(F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(chars, F.lit(0), lambda acc, c: let(value(c), lambda v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).when(F.lower(like) == like, word).otherwise(F.initcap(word))


def _name_word(unit: Column, draw: Column, gender: Column, like: Column, key: str) -> Column:
    def of(x: Column) -> Column:
        h, s = x["h"], x["s"]
        ending = F.when(unit.startswith("surname:"), s["surname"]).otherwise(F.concat(_letter(h, F.lit(63), s["consonants"]), F.when(gender == "f", s["f"]).when(gender == "m", s["m"]).otherwise(s["n"])))
        return _cased(F.concat(_word(h, draw + SYLLABLES, s), ending), like)

    return let(F.struct(_hex(unit, draw, 0, key).alias("h"), _script(like).alias("s")), of)


def _email(unit: Column, draw: Column, x: Column, number: Column, key: str) -> Column:
    local = F.substring_index(x, "@", 1)
    tail = F.length(F.regexp_extract(local, "([0-9]+)$", 1))
    digits = F.when(tail > 0, F.concat(F.lit("."), F.substr(number, F.lit(1), F.least(tail, F.lit(9))))).otherwise(F.lit(""))
    return let(_hex(unit, draw, 0, key), lambda h: F.concat(_word(h, draw + 5, _script(local)), digits, F.lit("@"), _word(F.substring(h, 41, 24), F.lit(4), _script(F.lit(""))), F.lit(".example")))


def _card(x: Column, number: Column, more: Column) -> Column:
    def of(plain: Column) -> Column:
        digits = F.concat(F.substring(plain, 1, 1), F.substring(number, 2, 59))
        head = F.substr(digits, F.lit(1), F.length(plain) + more - 1)
        valid = let(head, lambda h: F.concat(h, ((F.lit(10) - _luhn(F.concat(h, F.lit("0")))) % 10).cast("string")))
        return _fill(x, F.when(_luhn(plain) == 0, valid).otherwise(digits), None, more)

    return let(_digits(x), of)


def _ip(unit: Column, draw: Column, key: str) -> Column:
    h = _hex(unit, draw, 0, key)
    short = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substr(h, 4 * i + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    long = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substr(h, 4 * i + 1, F.lit(4))), ":"))
    return F.when(draw < WIDEN, short).otherwise(long)


def _account(unit: Column, draw: Column, x: Column, number: Column, more: Column, key: str) -> Column:
    letters = F.call_function("translate", _hex(unit, draw, 3, key), F.lit(_HEX), F.lit(_CAPITALS))
    plain = lambda y: F.replace(y, F.lit(" "), F.lit(""))

    def of(body: Column) -> Column:
        zero = F.concat(F.substring(x, 1, 2), F.lit("00"), body)
        check = F.lpad((F.lit(98) - _mod97(plain(zero))).cast("string"), 2, "0")
        return F.concat(F.substring(x, 1, 2), F.when(_mod97(plain(x)) == 1, check).otherwise(F.substring(number, 59, 2)), body)

    return let(_fill(F.substr(x, F.lit(5)), number, letters, more), of)


def _phone(x: Column, number: Column, more: Column) -> Column:
    plain = _digits(x)
    country = F.when(~x.startswith("+"), 0).when(plain.rlike("^[17]"), 1).when(plain.rlike(f"^(?:{TWO_DIGIT_CODES})"), 2).otherwise(3)
    return _fill(x, F.concat(F.substr(plain, F.lit(1), country), F.substr(number, F.lit(1), F.lit(55))), None, more)


def _plain_surrogate(kind: Column, unit: Column, draw: Column, x: Column, key: str) -> Column:
    """The replacement of a match that is no name."""

    def of(g: Column) -> Column:
        number, more = g["number"], g["more"]
        return (
            F.when(kind == "email", _email(unit, draw, x, number, key)).when(kind == "ip", _ip(unit, draw, key)).when(kind == "phone", _phone(x, number, more))
            .when(kind == "card", _card(x, number, more)).when(kind == "ssn", _fill(x, number, None, more)).otherwise(_account(unit, draw, x, number, more, key))
        )

    return let(F.struct(_number(unit, draw, key).alias("number"), F.least(F.greatest(draw - (WIDEN - 1), F.lit(0)), F.lit(30)).alias("more")), of)


def surrogate(x: Column, known: Column, facts: Column, key: str = KEY) -> Column:
    """The replacement of a match; known: the units of the names introduced in its text; facts: map from unit to draw and gender, where they are not 0 and none."""
    fact = lambda unit: F.coalesce(F.try_element_at(facts, unit), F.struct(F.lit(0).alias("draw"), F.lit("n").alias("gender")))

    def name(words: Column) -> Column:
        role = _role(words, known)
        new = lambda w, unit: F.when(unit.isNull(), w).otherwise(let(fact(unit), lambda f: _name_word(unit, f["draw"], f["gender"], w, key)))
        return F.concat(F.regexp_extract(x, f"^({_BEFORE})?", 1), F.array_join(F.transform(words, lambda w, i: let(role(w, i), lambda unit: new(w, unit))), " "))

    def of(kind: Column) -> Column:
        plain = let(_parts(x, kind, known)[0]["unit"], lambda unit: _plain_surrogate(kind, unit, fact(unit)["draw"], x, key))
        return F.when(kind.isin("name", "mention"), let(_name_words(x), name)).otherwise(plain)

    return let(kind_of(x), of)


def _unit_surrogate(unit: Column, sample: Column, draw: Column, gender: Column, key: str) -> Column:
    """What a unit becomes, in normal form, for the collision check."""

    def of(kind: Column) -> Column:
        value = F.substr(unit, F.length(kind) + 2)
        new = F.when(kind.isin("given", "surname"), _name_word(unit, draw, gender, value, key)).otherwise(_plain_surrogate(kind, unit, draw, sample, key))
        normal = let(new, lambda n: F.when(kind.isin("phone", "card", "ssn"), _digits(n)).when(kind == "account", F.replace(n, F.lit(" "), F.lit(""))).otherwise(F.lower(n)))
        return F.concat_ws(":", kind, normal)

    return let(F.substring_index(unit, ":", 1), of)


def facts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(unit, draw, gender) of the units of a gender, or whose first surrogate was another's, or was itself an entity of the corpus."""
    # equal texts and copies of a unit meet by partial aggregation; the least spelling of a unit stands for it, in the collision check only
    each = docs.select(F.explode(_entities(F.col("text"))).alias("p")).select("p.*")
    seen = lambda g: F.max(F.when(F.col("gender") == g, 1).otherwise(0))
    found = each.groupBy("unit").agg(F.min("sample").alias("sample"), seen("f").alias("f"), seen("m").alias("m"))
    gender = F.when(F.col("f") > F.col("m"), F.lit("f")).when(F.col("m") > F.col("f"), F.lit("m")).otherwise(F.lit("n"))
    out = found = materialise(found.select("unit", "sample", gender.alias("gender"), F.lit(0).alias("draw")))
    to = _unit_surrogate(F.col("unit"), F.col("sample"), F.col("draw"), F.col("gender"), key)
    while True:
        drawn = out.withColumn("to", to)
        # a surrogate's first holder keeps it, unless it is an entity itself
        rows = drawn.select("to", "draw", "unit").unionByName(found.select(F.col("unit").alias("to"), F.lit(-1).alias("draw"), F.lit("").alias("unit")))
        shared = rows.groupBy("to").agg(F.min(F.struct("draw", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = materialise(drawn.join(shared, "to").where(F.struct("draw", "unit") != F.col("first")).select("unit", F.lit(1).alias("again")))
        if again.isEmpty():
            return out.where("draw > 0 or gender <> 'n'").select("unit", "draw", "gender")
        out = materialise(out.join(again, "unit", "left").select("unit", "sample", "gender", (F.col("draw") + F.coalesce("again", F.lit(0))).alias("draw")))


def _rewritten(text: Column, facts_: Column, key: str) -> Column:
    """Struct of the new text and the number of replacements: the stretches between matches, and the surrogates, joined again."""

    def of(f: Column) -> Column:
        new = F.transform(f["m"], lambda x: surrogate(x, f["known"], facts_, key))
        whole = F.array_join(F.zip_with(F.split(text, f["pattern"], -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.struct(F.when(F.size(f["m"]) == 0, text).otherwise(whole).alias("text"), F.size(f["m"]).cast("long").alias("n"))

    return let(_found(text), of)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in the text, and how many in `n_entities`."""
    count, out, mine, k1, k2 = fresh(docs, "n_entities", "rewritten", "text_facts", "text_key", "text_key2")
    more = materialise(facts(docs, key))
    names = list(docs.columns)
    done = lambda df: df.select(*[F.col(f"{out}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"{out}.n"), F.lit(0).cast("long")).alias(count))
    nothing = F.create_map().cast(_NO_FACTS)
    if more.isEmpty():
        return done(docs.withColumn(out, _rewritten(F.col("text"), nothing, key)))
    # facts of the entities of each text, under two digests of it: equal texts share them, and no doc_id is needed; a text holds as many as its length allows
    digests = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    held = docs.select(digests[0].alias(k1), digests[1].alias(k2), F.explode(_entities(F.col("text"))).alias("p")).select(k1, k2, "p.unit").distinct().join(more, "unit")
    held = materialise(held.groupBy(k1, k2).agg(F.map_from_entries(F.collect_list(F.struct("unit", F.struct("draw", "gender")))).alias(mine), F.sum(F.length("unit") + 40).alias("bytes")))
    size = held.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    few = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    held = held.drop("bytes")
    keyed = docs.withColumn(k1, digests[0]).withColumn(k2, digests[1])
    both = keyed.join(F.broadcast(held) if few else held, [k1, k2], "left")
    return done(both.withColumn(out, _rewritten(F.col("text"), F.coalesce(F.col(mine), nothing), key)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = None
