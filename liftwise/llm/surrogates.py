"""Personal data: detected entities become keyed, type-consistent surrogates. Built-in column functions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.decontaminate import text_key
from liftwise.session import materialize

# Forms of address by the gender they tell.
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
EITHER = "Dr|Prof"

_TITLE = rf"(?:{MALE}|{FEMALE}|{EITHER})\.?"
_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SECRET_NAME = r"(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    r"[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
    rf"|{_SECRET_NAME}[A-Za-z0-9+/_-]{{8,}}"
    r"|[0-9a-fA-F]{32,}(?![\p{L}\p{N}])"
    rf"|{_TITLE}\s{_WORD}(?:\s{_WORD})?"
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
    rf"|(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
    r"|\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])"
    r"|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}])"
    r"|(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
    r")"
)
#: What no entity can do without; texts that lack it are not searched.
_HINT = rf"@|\d{{2}}|\d\.\d|[=:]|[0-9a-fA-F]{{32}}|{_TITLE}\s"

# Syllables and endings of surrogate names, by script.
_SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha he ja ka ke ko la le lo ma me mi mo na ne no pa po ra re ro sa se so ta te to va ve wa za",
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то фа",
    "greek": "βα βε βο γα γε δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα",
}
_ENDINGS = {
    ("latin", "m"): "n s rd k", ("latin", "f"): "a na lle ra", ("latin", "u"): "n l r", ("latin", "s"): "ner ler mann son tti ski",
    ("cyrillic", "m"): "н р мир слав", ("cyrillic", "f"): "на ра лия ся", ("cyrillic", "u"): "ш ня", ("cyrillic", "s"): "ко чук дзе як",
    ("greek", "m"): "ς νης ρος", ("greek", "f"): "α νη ρα", ("greek", "u"): "ι ω", ("greek", "s"): "κος δης πουλ",
}
_ACCENTED = "àáâäçèéêëíîïñóôöùúûüß"
# Code points that surrogate letters of other scripts are drawn from, and zeros of digits, by script.
_LETTERS = {
    "Cyrillic": (0x430, 0x44F), "Greek": (0x3B1, 0x3C9), "Armenian": (0x561, 0x586), "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x627, 0x64A),
    "Devanagari": (0x905, 0x939), "Bengali": (0x985, 0x9B9), "Gurmukhi": (0xA05, 0xA39), "Gujarati": (0xA85, 0xAB9), "Tamil": (0xB85, 0xBB9),
    "Telugu": (0xC05, 0xC39), "Kannada": (0xC85, 0xCB9), "Malayalam": (0xD05, 0xD39), "Sinhala": (0xD85, 0xDC6), "Thai": (0xE01, 0xE2E),
    "Lao": (0xE81, 0xEAE), "Myanmar": (0x1000, 0x102A), "Georgian": (0x10D0, 0x10F0), "Ethiopic": (0x1200, 0x135A), "Khmer": (0x1780, 0x17B3),
    "Hiragana": (0x3042, 0x3093), "Katakana": (0x30A2, 0x30F3), "Han": (0x4E00, 0x55FF), "Hangul": (0xAC00, 0xB3FF),
}
_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0xFF10)
#: A unit's room widens each time it has drawn so often in vain.
_DRAWS = 4


def _list(words: str) -> Column:
    return F.split(F.lit(words), " ")


def _kind(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^{_SECRET_NAME}"), "secret")
        .when(value.rlike(r"^[0-9a-fA-F]{32,}$"), "secret")
        .when(value.rlike(rf"^{_TITLE}\s"), "person")
        .when(value.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(value.rlike(r"^(?:\d+\.){3}\d+$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^\d[\d -]+$") & (digits >= 13), "card")
        .otherwise("phone")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _units(values: DataFrame) -> DataFrame:
    """Split each value into what is replaced: (kind1, canon1) and, for a person with two names, (kind2, canon2)."""
    value, kind = F.col("value"), F.col("kind")
    digits = F.regexp_replace(value, r"\D", "")
    title = F.regexp_extract(value, rf"^({_TITLE})", 1)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.?$"), "f").when(title.rlike(rf"^(?:{MALE})\.?$"), "m").otherwise("u")
    names = F.split(F.regexp_replace(value, rf"^{_TITLE}\s", ""), r"\s")
    last, first = F.element_at(names, -1), F.when(F.size(names) > 1, names[0])
    canon = (
        F.when(kind == "email", F.lower(value))
        .when(kind == "secret", F.regexp_replace(value, rf"^{_SECRET_NAME}", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.expr("right(regexp_replace(value, '[^0-9]', ''), 10)"))
        .when(kind == "person", F.lower(last))
        .otherwise(value)
    )
    person = kind == "person"
    return values.select(
        "value", "kind",
        F.when(person, F.concat_ws(":", F.lit("name"), _script(last), F.lit("s"))).otherwise(kind).alias("kind1"), canon.alias("canon1"),
        F.when(person & first.isNotNull(), F.concat_ws(":", F.lit("name"), _script(first), gender)).alias("kind2"),
        F.when(person, F.lower(first)).alias("canon2"),
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10


def _drawn_from() -> list[tuple[str, str]]:
    """Pattern of the letters of a script, or its digits, and what their surrogates are drawn from."""
    letters = {script: "".join(x for x in map(chr, range(low, high + 1)) if unicodedata.category(x) in ("Ll", "Lo") and x != "ς") for script, (low, high) in _LETTERS.items()}
    digits = ["".join(chr(zero + k) for k in range(10)) for zero in _ZEROS]
    return [(rf"[\p{{Is{script}}}&&\p{{L}}]", text) for script, text in letters.items()] + [(f"[{text}]", text) for text in digits]


def _core(key: str) -> Column:
    """Surrogate of a unit, from its kind, canonical form, attempt and the key."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    wider = F.floor(attempt / _DRAWS).cast("int")
    hexes = F.concat(*[F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(k))), 256) for k in range(2)])

    def number(i: Column | int, below: Column | int) -> Column:
        at = F.lit(i) if isinstance(i, int) else i
        return F.conv(F.substring(hexes, (at % 42) * 3 + 1, F.lit(3)), 16, 10).cast("int") % below

    def other(c: Column, i: Column) -> Column:
        """A letter or digit of no Latin script: one of its own, or a plain one if the script is not listed."""
        own = F.when(c.rlike(r"\p{L}"), "abcdefghijklmnopqrstuvwxyz").otherwise("0123456789")
        for test, text in reversed(_drawn_from()):
            own = F.when(c.rlike(test), text).otherwise(own)
        return F.transform(F.array(own), lambda a: F.substring(a, number(i, F.length(a)) + 1, F.lit(1)))[0]

    def letters(text: Column, hexadecimal: bool = False, any_script: bool = False) -> Column:
        def one(c: Column, i: Column) -> Column:
            digit = number(i, 10).cast("string")
            low = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), number(i, 26) + 1, F.lit(1))
            accent = F.substring(F.lit(_ACCENTED), number(i, len(_ACCENTED)) + 1, F.lit(1))
            if hexadecimal:
                return F.substring(F.lit("0123456789abcdef"), number(i, 16) + 1, F.lit(1))
            plain = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), F.upper(low))
            if any_script:
                plain = plain.when(c.rlike(r"\p{IsLatin}"), accent).when(c.rlike(r"[\p{L}\p{N}]"), other(c, i))
            return plain.otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    # a wider room is more digits, octets, labels or letters behind the format's own
    longer = F.concat(canon, F.repeat(F.lit("0"), wider))
    digits = F.array_join(F.transform(F.split(longer, ""), lambda c, i: number(i, 10).cast("string")), "")
    size = F.length(digits)
    check = (F.substring(digits, size, F.lit(1)).cast("int") + _luhn(canon) - _luhn(digits) + 10) % 10
    card = F.concat(F.substring(digits, F.lit(1), size - 1), check.cast("string"))
    kept = F.when(canon.rlike(r"^(?:10|127)\."), 1).when(canon.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01]))\."), 2).otherwise(0)
    # a private block of two octets is left for 10.*.*.* before octets are added
    moved = (kept == 2) & (wider > 0)
    octets = F.concat(F.when(moved, F.split(F.regexp_replace(canon, r"^\d+", "10"), r"\.")).otherwise(F.split(canon, r"\.")), F.array_repeat(F.lit("0"), wider - moved.cast("int")))
    fixed = F.when(moved, 1).otherwise(kept)
    ip = F.array_join(F.transform(octets, lambda o, i: F.when(i < fixed, o).otherwise((number(i, 254) + 1).cast("string"))), ".")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.when(domain.rlike(r"\.(?:com|net|org)$"), F.substring_index(domain, ".", -1)).otherwise("com")
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(wider, F.lit(1))), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), number(F.lit(42) - i % 42, 26) + 1, F.lit(1))), "")
    # letters() takes the digest's places by position, so the host continues where the local part ends
    email = F.concat(letters(F.concat(local, F.lit("@"), F.substring_index(domain, ".", 1)), any_script=True), F.when(wider > 0, F.concat(F.lit("."), more)).otherwise(""), F.lit(".example."), top)
    script, role = F.split(kind, ":")[1], F.split(kind, ":")[2]
    parts = F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: _pick(_SYLLABLES, script, lambda n: number(i, n)))
    ending = F.lit(None).cast("string")
    for (of, part), text in _ENDINGS.items():
        words = text.split(" ")
        ending = F.when((script == of) & (role == part), F.element_at(_list(text), number(41, len(words)) + 1)).otherwise(ending)
    name = F.initcap(F.concat(F.array_join(parts, ""), ending))
    hexed = canon.rlike("^[0-9a-f]+$")
    secret = F.when(hexed, letters(longer, True)).otherwise(letters(longer))
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "card", card).when(kind.isin("ssn", "phone"), digits)
        .when(kind == "ip", ip).when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.expr("''"), letters(F.substring(longer, F.lit(3), F.length(longer)))))
        .otherwise(name)
    )


def _pick(lists: dict[str, str], script: Column, index) -> Column:
    out = F.lit(None).cast("string")
    for name, text in lists.items():
        out = F.when(script == name, F.element_at(_list(text), index(len(text.split(" "))) + 1)).otherwise(out)
    return out


def assign_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon) to (kind, canon, core), distinct cores within a kind and none that is a real entity of it.

    Clashing entities but the smallest draw again, until none clashes. Later
    names have more syllables, and every ``_DRAWS`` draws the other kinds have a
    character, octet or label more, so the room never runs out. A few columns of distinct
    entities are all that moves; they are written once a round.
    """
    taken = units.distinct().withColumn("attempt", F.lit(0))
    while True:
        drawn = materialize(taken.withColumn("core", _core(key)), "surrogates")
        first = drawn.groupBy("kind", "core").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        doubled = drawn.join(first, ["kind", "core"]).where("canon <> first").select("kind", "canon")
        real = drawn.select(F.col("kind").alias("of"), F.lower("canon").alias("known"))
        same = (F.col("kind") == F.col("of")) & (F.lower("core") == F.col("known"))
        again = materialize(doubled.unionAll(drawn.join(real, same, "left_semi").select("kind", "canon")).distinct(), "surrogates")
        if not again.take(1):
            return drawn.select("kind", "canon", "core")
        more = again.withColumn("more", F.lit(1))
        taken = drawn.join(more, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))


def _filled(value: Column, digits: Column, keep: Column) -> Column:
    """``value`` with its digits after the first ``keep`` ones replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit & (acc["n"] >= keep), F.substring(digits, acc["n"] - keep + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + digit.cast("int")).alias("n"))

    return F.aggregate(F.split(value, ""), start, step)["out"]


def _spaced(value: Column, core: Column) -> Column:
    """``core`` with the spaces of ``value``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        blank = c == " "
        return F.struct(F.concat(acc["out"], F.when(blank, c).otherwise(F.substring(core, acc["n"], F.lit(1)))).alias("out"), (acc["n"] + (~blank).cast("int")).alias("n"))

    return F.aggregate(F.split(value, ""), start, step)["out"]


def _replacement() -> Column:
    value, kind, one, two = (F.col(c) for c in ("value", "kind", "core1", "core2"))
    shown = F.when(value.rlike(r"^\P{Ll}+$"), F.upper(one)).otherwise(one)
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    title = F.regexp_extract(value, rf"^({_TITLE}\s)", 1)

    def beyond(n: Column) -> Column:
        """What a core has behind the ``n`` characters that the value has room for."""
        return F.substring(one, n + 1, F.length(one))

    return (
        F.when(kind == "person", F.concat(title, F.coalesce(F.concat(two, F.regexp_extract(value, rf"^{_TITLE}\s\S+(\s)", 1)), F.lit("")), shown))
        .when(kind == "secret", F.concat(F.regexp_extract(value, rf"^({_SECRET_NAME})?", 0), one))
        .when(kind.isin("card", "ssn"), F.concat(_filled(value, one, F.lit(0)), beyond(digits)))
        .when(kind == "phone", F.concat(_filled(value, one, F.greatest(digits - 10, F.lit(0))), beyond(F.least(digits, F.lit(10)))))
        .when(kind == "iban", F.concat(_spaced(value, one), beyond(F.length(F.replace(value, F.lit(" "), F.lit(""))))))
        .otherwise(one)
    )


def replacements(values: DataFrame, key: str) -> DataFrame:
    """Distinct ``value`` strings to (value, kind, replacement)."""
    parts = materialize(_units(values.withColumn("kind", _kind(F.col("value")))), "entity-values")
    one = parts.select(F.col("kind1").alias("kind"), F.col("canon1").alias("canon"))
    two = parts.where("kind2 is not null").select(F.col("kind2").alias("kind"), F.col("canon2").alias("canon"))
    cores = assign_surrogates(one.unionAll(two), key)
    first = cores.select(F.col("kind").alias("kind1"), F.col("canon").alias("canon1"), F.col("core").alias("core1"))
    second = cores.select(F.col("kind").alias("kind2"), F.col("canon").alias("canon2"), F.col("core").alias("core2"))
    both = parts.join(first, ["kind1", "canon1"]).join(second, ["kind2", "canon2"], "left")
    return both.select("value", "kind", _replacement().alias("replacement"))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every entity of the text replaced; ``count_col`` adds the number of replaced places.

    E-mail addresses, IPv4 addresses, phone, card, social-security and account
    numbers, secrets and addressed persons are found in the whole text. An
    entity's surrogate is drawn from its canonical form and ``key``, so it is
    the same in every place, spelling and document, and differs from every
    other entity's. It keeps the format: separators, letter case, digits and
    letters in place, a card's Luhn remainder, private address ranges, country
    code, form of address; names follow gender, names and addresses script. Only
    where a format has no surrogate left, one gets longer.

    Distinct entities and their places are joined by shuffle, a place once per
    distinct text. Texts without an entity are passed on unmoved; null and empty
    texts stay as they are. Repeated rows stay repeated. The part of an address
    before its @ has 64 characters at most, so long runs of marks take time in
    proportion to their length.
    """
    text = F.col(text_col)
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    has = F.coalesce(text.rlike(_HINT) & text.rlike(PATTERN), F.lit(False))
    h1, h2 = text_key(text)
    places = docs.where(has).select(h1.alias("h1"), h2.alias("h2"), F.posexplode(found).alias("pos", "value")).distinct()
    places = materialize(places, "entity-places")
    known = replacements(places.select("value").distinct(), key)
    rows = places.join(known, "value").groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("pos", "replacement"))).alias("new"))

    o1, o2 = text_key(docs[text_col])
    with_any = docs.where(has).join(rows, (o1 == rows["h1"]) & (o2 == rows["h2"]))
    gaps = F.split(docs[text_col], PATTERN, -1)
    filled = F.zip_with(F.slice(gaps, F.lit(2), F.size(rows["new"])), rows["new"], lambda gap, new: F.concat(new["replacement"], gap))
    changed = F.concat(gaps[0], F.array_join(filled, ""))
    extra = [] if count_col is None else [F.size(rows["new"]).cast("long").alias(count_col)]
    none = [] if count_col is None else [F.lit(0).cast("long").alias(count_col)]
    done = with_any.select(*[changed.alias(c) if c == text_col else docs[c] for c in docs.columns], *extra)
    return done.unionAll(docs.where(~has).select(*[docs[c] for c in docs.columns], *none))
