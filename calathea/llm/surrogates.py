"""Surrogates for personal data, in DataFrame operations only.

Method. One pattern finds entities in every whole text, in one pass that marks them: e-mail and IP addresses, phone,
card, account and social security numbers, secrets, and names after a title, after a known given name, or where one is
introduced. Distinct entities, by type and canonical form, get keyed surrogates of their type: names of the same gender
and script, numbers of the same layout with valid check digits. Rounds of checks redraw those that equal another's
surrogate or any entity of the corpus, from a space that widens with each attempt, until none do; so distinct entities
stay distinct, and equal ones, however written, get one surrogate, laid out as each is written.
A person is a given name with a family name, whatever title stands before; most titles and names decide the gender. The
names of a text's persons are replaced where they stand alone in it, too.
Texts without a finding never leave their partition; the others are joined with their own replacements, by place.

Defined results: a null text stays null; a text without findings stays as it is; equal rows get equal results;
a null id is kept; an empty table gives no rows. An IPv6 address without a digit is only found written in full (names
joined by :: look like it), a run of ten digits that begins with 1 not at all (a time). Titles stay; case and
punctuation of a finding are kept. Bare names are found as their text writes them elsewhere, not in other cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import column, cut, fresh

ROUNDS = 64
#: Characters that mark findings, and what stands for those that a text has already.
OPEN, CLOSE, ESCAPE = "\u0001", "\u0002", "\u0003"
ESCAPED = {ESCAPE: ESCAPE + "\u0006", OPEN: ESCAPE + "\u0004", CLOSE: ESCAPE + "\u0005"}

# Titles and names.
MALE_TITLES = ("Mr", "Mister", "Herr", "Señor", "Monsieur", "Sir", "господин", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "госпожа", "κυρία")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Doctor")
#: Titles that also stand in capitals, and what may follow a title in small letters.
CAPITAL_TITLES = ("MR", "MRS", "DR", "PROF", "PROFESSOR", "HERR", "FRAU")
DEGREES = ("med", "phil", "jur", "rer", "nat", "ing", "habil", "h", "c")
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Hans Karl Jürgen Stefan Pierre Jacques Michel Luis Carlos José Antonio Miguel".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Emily Anna Ursula Sabine Monika Marie Sophie Camille Carmen María Isabel Lucía Elena".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Αλέξανδρος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
}
# What surrogate names are made of, by script: beginnings, vowels, consonants between, and the ends of
# family names and of male, female and other given names.
SOUNDS = {
    "latin": {
        "first": "B Br D Dr F G Gr H K L M N P R S St T V W".split(), "vowel": "a e i o u".split(), "middle": "b d l ld lm m n nd r rd rl s st t v".split(),
        "family": "berg croft dale en er ford ing ley lund man mann mer ner son stein ton well wick wood worth".split(),
        "m": "an ard bert en ic in mund or ric us".split(), "f": "a elle ia ina ine issa ora elia ette ya".split(), "n": "el ey is le ris y".split(),
    },
    "cyrillic": {
        "first": "Б Бр В Г Д Ж З К Л М Н П Р С Т Ф Х".split(), "vowel": "а е и о у".split(), "middle": "б в г д з к л м н п р с т".split(),
        "family": "анов елов ешин инов ихин оров ушин аков".split(), "m": "ад ан ем ий ил ислав омир ор".split(), "f": "ана ея ила ина ия ора ислава ета".split(), "n": "ани еки или оши".split(),
    },
    "greek": {
        "first": "Β Γ Δ Ζ Θ Κ Λ Μ Ν Π Ρ Σ Τ Φ Χ".split(), "vowel": "α ε ι ο ου".split(), "middle": "β γ δ θ κ λ μ ν ρ σ τ".split(),
        "family": "άκης ίδης όγλου όπουλος άτος ιάδης".split(), "m": "ίας ος ων έας".split(), "f": "ία ίνη ούλα άνθη".split(), "n": "ι ώ".split(),
    },
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}

_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES, *CAPITAL_TITLES))
#: One title or several; their degrees belong to them.
_RUN = rf"(?:(?:{_TITLES})\.? ?(?<=[. ])(?:(?:{'|'.join(DEGREES)})\. ?)*)+"
_NAME_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
#: What is a name after a title: no other title, and capitals as well.
_CALLED = rf"(?!(?:{_TITLES})(?!\p{{L}}))(?:{_NAME_PART}|\p{{Lu}}{{2,}}(?:['’-]\p{{Lu}}{{2,}})?(?!\p{{L}}))"
_INTRODUCED = "|".join(("[Mm]y name is", "[Nn]ame:", "[Ss]igned by", "[Ii]ch heiße", "[Mm]ein Name ist", "[Mm]e llamo", "[Jj]e m[’']appelle", "Меня зовут", "Με λένε"))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_OCTETS = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: National numbers with spaces, those with a leading zero, and bare runs of ten digits or, after a zero, eleven.
_NATIONAL = "|".join((
    r"(?:1 )?(?:[0-9]{3}|\([0-9]{3}\)) [0-9]{3} [0-9]{4}", r"0[1-9](?: [0-9]{2}){4}", r"\(?0[1-9][0-9]{1,3}\)?[ /](?:[0-9]{3,4} [0-9]{3,4}|[0-9]{6,8})",
    r"(?<![0-9][.,])(?:[2-9][0-9]{9}|0[1-9][0-9]{8,9})(?![.,][0-9])",
))
#: Type, pattern; of those that match at a place the first counts. Each fails fast where nothing begins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}[\p{L}]{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]{{0,39}}[0-9])(?:(?:{_GROUP}:){{6}}(?:{_OCTETS}|{_GROUP}:{_GROUP})|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:(?:{_GROUP}:){{0,5}}{_OCTETS}|{_GROUP}(?::{_GROUP}){{0,6}})|{_GROUP}(?::{_GROUP}){{0,6}}::)(?![\p{{L}}\p{{N}}:]|\.[0-9])",
    "ipv4": rf"(?<![\p{{L}}\p{{N}}.]){_OCTETS}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}|" + _NATIONAL + r")(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|gh[pousr])[-_][A-Za-z0-9_]{20,80})(?![\p{L}\p{N}])",
    "credential": r"""(?<=[=:\s"'])(?<=[=:]\s{0,2}["']?)(?<=(?:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}["']?)(?=[\p{L}_\-+/]{0,40}[0-9])[\p{L}\p{N}_\-+/]{8,128}(?![\p{L}\p{N}])""",
    "titled": rf"(?<![\p{{L}}\p{{N}}]){_RUN}{_INITIALS}{_CALLED}(?: {_INITIALS}{_CALLED})?",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(x for v in GIVEN.values() for x in v)}) {_INITIALS}{_NAME_PART}(?![\p{{L}}\p{{N}}])",
    "introduced": rf"(?<=(?:{_INTRODUCED})\s){_INITIALS}(?:{_NAME_PART} {_INITIALS})?{_NAME_PART}(?![\p{{L}}\p{{N}}])",
}
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every finding has one of; a look at the first letter spares most places the names.
_HINT = rf"[0-9@]|(?=[A-ZÀ-ÞΆ-ΫЀ-Яг\u03ba])(?:AKIA[A-Z]{{16}}|{PATTERNS['titled']}|{PATTERNS['name']}|{PATTERNS['introduced']})|(?:sk|pk|gh[pousr])[-_][A-Za-z_]{{20}}"


def _marked(text: Column) -> Column:
    """The text with its findings between marks."""
    safe = text
    for plain, other in ESCAPED.items():
        safe = F.replace(safe, F.lit(plain), F.lit(other))
    safe = F.when(text.rlike(f"[{OPEN}{CLOSE}{ESCAPE}]"), safe).otherwise(text)
    return F.regexp_replace(safe, _ALL, f"{OPEN}$0{CLOSE}")


def _unescaped(text: Column) -> Column:
    out = text
    for plain, other in reversed(ESCAPED.items()):
        out = F.replace(out, F.lit(other), F.lit(plain))
    return F.when(text.contains(ESCAPE), out).otherwise(text)


def _parts_of(marked: Column) -> Column:
    """What lies between marks: at even places what is no finding, at odd ones the findings."""
    return F.split(marked, f"[{OPEN}{CLOSE}]", -1)


def _kind(m: Column) -> Column:
    """The type of a finding: that of the first pattern that matches the whole of it; of those found by what stands
    before them, a name is a name and the rest are secrets."""
    out = F.when(m.rlike(rf"^{_INITIALS}{_NAME_PART}(?: {_INITIALS}{_NAME_PART})?$"), "name").otherwise("secret")
    for kind, p in reversed(PATTERNS.items()):
        out = F.when(m.rlike(rf"^(?:{p})$"), kind).otherwise(out)
    return out


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _names(m: Column) -> Column:
    """Given name and family name of a finding as written, or the only name; without titles and initials."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(m, rf"^{_RUN}", ""), r"(?<!\p{L})(?:\p{Lu}\. ?)+", "")), " +")


def _parts(m: Column, kind: Column) -> Column:
    """The entities of a finding, as (type, canonical form, gender: above 0 male, below 0 female): one, or of a person
    the family name and the person, and of an address the domain and the address."""
    plain = F.lower(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""))
    names = _names(m)
    title = F.regexp_extract(m, rf"^({_RUN})", 1)
    first, family = F.lower(names[0]), F.element_at(names, -1)
    known = lambda g: F.initcap(names[0]).isin(*(x for (_, k), v in GIVEN.items() if k == g for x in v))
    of = lambda titles: title.rlike(rf"(?i)(?<!\p{{L}})(?:{'|'.join(titles)})(?!\p{{L}})")
    gender = F.when(of(MALE_TITLES), 3).when(of(FEMALE_TITLES), -3)
    gender = gender.when(known("m") & ~known("f"), 1).when(known("f") & ~known("m"), -1).otherwise(0)
    one = lambda t, c, g: F.struct(F.lit(t).alias("type"), c.alias("canon"), g.alias("gender"))
    low = F.when(_script(family) == "cyrillic", F.regexp_replace(F.lower(family), "(?<=[ое]в|ин)а$", "")).otherwise(F.lower(family))
    single = F.when((title == "") & (known("m") | known("f")), one("given", first, gender)).otherwise(one("family", low, F.lit(0)))
    person = F.array(one("family", low, F.lit(0)), one("person", F.concat_ws(" ", first, low), gender))
    canon = F.when(kind == "ipv6", _groups(m)).when(kind.isin("email", "ipv4"), F.lower(m)).otherwise(plain)
    own = F.struct(kind.alias("type"), canon.alias("canon"), F.lit(0).alias("gender"))
    other = F.when(kind == "email", F.array(one("domain", _domain(F.lower(m)), F.lit(0)), own)).otherwise(F.array(own))
    return F.when(~kind.isin("titled", "name", "introduced"), other).when(F.size(names) > 1, person).otherwise(F.array(single))


def _domain(address: Column) -> Column:
    """The last two labels of an address."""
    return F.regexp_extract(address, r"([^.@]+\.[^.@]+)$", 1)


def _groups(m: Column) -> Column:
    """An IPv6 address written out: eight groups without leading zeros, in lower case."""
    low = F.lower(m)
    octet = lambda k: F.regexp_extract(low, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", k).cast("int")
    pair = lambda k: F.lower(F.hex(octet(k) * 256 + octet(k + 1)))
    low = F.when(low.contains("."), F.concat(F.regexp_replace(low, r"[0-9]+(?:\.[0-9]+){3}$", ""), pair(1), F.lit(":"), pair(3))).otherwise(low)
    ends = F.transform(F.split(low, "::"), lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
    right = F.coalesce(F.get(ends, 1), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(ends[0]) - F.size(right)))
    return F.array_join(F.transform(F.concat(ends[0], zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _byte(seed: Column, at: Column) -> Column:
    """A keyed byte for a place: two hex digits of the digest of the seed and the place's block."""
    digest = F.sha2(F.concat(seed, F.lit("|"), F.floor(at / 32).cast("string")), 256)
    return F.conv(digest.substr((at % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(items: list[str], seed: Column, at: Column) -> Column:
    n = _byte(seed, at) * 256 + _byte(seed, at + 1)
    return F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))


def _sounding(script: str, end: str, seed: Column, syllables: Column) -> Column:
    """A name of a script, made of so many syllables and an end."""
    of = SOUNDS[script]
    syllable = lambda i: F.concat(_pick(of["vowel"], seed, 4 * i), _pick(of["middle"], seed, 4 * i + 2))
    inner = F.array_join(F.transform(F.sequence(F.lit(1), syllables), syllable), "")
    return F.lower(F.concat(_pick(of["first"], seed, F.lit(0)), inner, _pick(of[end], seed, F.lit(2))))


def _given(gender: str, script: str, seed: Column, attempt: Column) -> Column:
    """A given name: a usual one, then two of them, then made ones that get longer."""
    usual = GIVEN[script, "m"] + GIVEN[script, "f"] if gender == "n" else GIVEN[script, gender]
    one, two = _pick(usual, seed, F.lit(0)), _pick(usual, seed, F.lit(2))
    made = _sounding(script, gender, seed, attempt - 1)
    return F.lower(F.when(attempt == 0, one).when(attempt == 1, F.concat(one, F.lit("-"), two)).otherwise(made))


def _letters(s: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by a keyed one of its kind; the rest stays."""
    if hexadecimal:
        digit = lambda c, i: F.lower(F.conv((_byte(seed, i) % 16).cast("string"), 10, 16))
        return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), digit), "")

    def one(c: Column, i: Column) -> Column:
        b = _byte(seed, i)
        out = F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
        for script, p in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", r"\p{L}")):
            out = out.when(c.rlike(p), F.lit(LETTERS[script]).substr((b % len(LETTERS[script]) + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def _digits(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Checksum of digits, the last one not doubled; a multiple of 10 is valid."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.reverse(digits), doubled), F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    """Remainder of an account number's digits, letters counting 10 to 35, its first four characters last."""
    moved = F.upper(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def surrogate(kind: Column, canon: Column, key: str, attempt: Column, gender: Column) -> Column:
    """The keyed surrogate of an entity, in canonical form (of a person, the given name; of an address, what stands before
    the domain); attempts give others, from ever larger spaces where the form doesn't fix it."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    drawn = _letters(canon, seed)
    local, labels = F.split(canon, "@")[0], F.regexp_extract(canon, r"@((?:.*\.)?)[^.]+\.[^.]+$", 1)
    # what stands before the domain is keyed by itself, so that it stays the same in all addresses
    email = F.concat(_letters(F.concat(local, F.when(attempt > 3, attempt.cast("string")).otherwise("")), seed), F.lit("@"), _letters(labels, F.sha2(F.concat(F.lit(key), labels), 256)))
    top = F.substring_index(canon, ".", -1)
    domain = F.concat(_letters(F.concat(F.lit("nnnnn"), F.repeat(F.lit("n"), attempt)), seed), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("org"))
    octet = lambda k: (_byte(seed, F.lit(k)) % 254 + 1).cast("string")
    ipv4 = F.concat_ws(".", (_byte(seed, F.lit(0)) % 15 + 240).cast("string"), octet(1), octet(2), octet(3))
    ipv6 = F.concat(F.lit("fd"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == 0, F.sha2(F.concat(seed, i.cast("string")), 256).substr(1, 2)).otherwise(F.regexp_replace(F.sha2(F.concat(seed, i.cast("string")), 256).substr(1, 4), "^0+(?=.)", ""))), ":"))
    ssn = F.concat((900 + _byte(seed, F.lit(0)) % 100).cast("string"), drawn.substr(4, 6))
    stem = F.concat(canon.substr(1, 1), drawn.substr(F.lit(2), F.length(canon) - 2))
    card = F.when(luhn_sum(_digits(canon)) % 10 == 0, F.concat(stem, ((10 - luhn_sum(_digits(F.concat(stem, F.lit("0")))) % 10) % 10).cast("string"))).otherwise(F.concat(stem, drawn.substr(F.length(canon), F.lit(1))))
    body = F.concat(canon.substr(1, 2), F.lit("00"), drawn.substr(F.lit(5), F.length(canon)))
    iban = F.concat(canon.substr(1, 2), F.lpad((98 - _mod97(body)).cast("string"), 2, "0"), drawn.substr(F.lit(5), F.length(canon)))
    code = F.when(canon.startswith("0"), 1).when(F.length(canon) == 10, 0).otherwise(F.least(F.lit(3), F.length(canon) - 10))
    code = F.when(code < 0, 0).otherwise(code)
    phone = F.concat(canon.substr(F.lit(1), code), ((_byte(seed, F.lit(62)) % 8) + 2).cast("string"), drawn.substr(code + 2, F.length(canon)))
    out = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ipv4", ipv4).when(kind == "ipv6", ipv6).when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), _letters(canon, seed, True)).when(kind == "secret", drawn)
    for script in SOUNDS:
        here = _script(canon) == script
        out = out.when(here & (kind == "family"), _sounding(script, "family", seed, attempt + 2))
        for g, of in (("m", gender > 0), ("f", gender < 0), ("n", gender == 0)):
            out = out.when(here & kind.isin("person", "given") & of, _given(g, script, seed, attempt))
    return out


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, sur) of distinct entities (type, canon, gender): rounds of draws until no surrogate equals another's
    of its space, or a real entity. A person's space is that of its family's given names, of which only its own is
    barred; family names differ from all real ones, and so do persons. Likewise an address's space is its domain."""
    family = F.regexp_extract("canon", " (.*)$", 1)
    space = F.when(F.col("type") == "person", F.concat(F.lit("person "), family)).when(F.col("type") == "email", F.concat(F.lit("email "), _domain(F.col("canon")))).otherwise(F.col("type"))
    state = cut(entities.select("type", "canon", "gender", space.alias("space"), F.lit(0).alias("attempt")), "entities")
    barred = F.when(F.col("type") == "person", F.substring_index("canon", " ", 1)).otherwise(F.col("canon"))
    real = state.where("type <> 'person'").select("space", F.col("canon").alias("sur")).distinct().withColumn("real", F.lit(True))
    first = W.partitionBy("space", "sur").orderBy("canon")
    for _ in range(ROUNDS):
        drawn = state.withColumn("sur", surrogate(F.col("type"), F.col("canon"), key, F.col("attempt"), F.col("gender")))
        taken = F.col("real").isNotNull() | (F.col("sur") == barred) | (F.row_number().over(first) > 1)
        checked = drawn.join(real, ["space", "sur"], "left").withColumn("lost", taken).drop("real")
        checked = cut(checked, "surrogates")
        if checked.where("lost").isEmpty():
            return checked.select("type", "canon", "sur")
        state = checked.withColumn("attempt", F.col("attempt") + F.col("lost").cast("int")).drop("lost", "sur")
    raise RuntimeError("surrogates keep colliding")


def _like(new: Column, old: Column) -> Column:
    """A name in the case of another."""
    upper = (old == F.upper(old)) & (F.length(old) > 1)
    capital = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
    return F.when(upper, F.upper(new)).when(old.rlike(r"^\p{Lu}"), capital).otherwise(new)


def _family_like(new: Column, old: Column) -> Column:
    name = _like(new, old)
    return F.when(old.rlike("[ое]ва$|ина$") & name.rlike("[ое]в$|ин$"), F.concat(name, F.lit("а"))).otherwise(name)


def _bare(m: Column, kind: Column, sur: Column) -> Column:
    """Of a name, what its parts become where they stand alone: (as written, new), the family name first."""
    names = _names(m)
    pair = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    family = F.element_at(names, -1)
    both = F.array(pair(family, _family_like(sur[0], family)), pair(names[0], _like(sur[1], names[0])))
    alone = F.array(pair(family, _family_like(sur[0], family)))
    none = F.array().cast("array<struct<old:string,new:string>>")
    return F.when(~kind.isin("titled", "name", "introduced"), none).when(F.size(names) > 1, both).otherwise(alone)


def _lay_out(m: Column, kind: Column, sur: Column) -> Column:
    """The surrogates (array, as by _parts) in the layout of the finding."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    before = lambda i: F.length(F.regexp_replace(m.substr(F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    own = lambda i: sur[0].substr(before(i), F.lit(1))
    fill = lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(own(i))).when(c.rlike(r"[\p{L}\p{N}]"), own(i)).otherwise(c)
    filled = F.array_join(F.transform(chars, fill), "")
    bare = _bare(m, kind, sur)
    title = F.regexp_extract(m, rf"^({_RUN})", 1)
    rest = m.substr(F.length(title) + 1, F.length(m))
    # initials become letters of the new family name, and keep their points and spaces
    letter = lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(sur[0].substr(i % 3 + 2, F.lit(1)))).otherwise(c)
    short = lambda p: F.array_join(F.transform(F.filter(F.split(F.regexp_extract(rest, p, 1), ""), lambda c: c != ""), letter), "")
    one, two = short(r"^((?:\p{Lu}\. ?)+)"), short(r"\p{L}{2,} ((?:\p{Lu}\. ?)+)")
    person = F.concat(title, one, F.when(F.size(bare) > 1, F.concat(bare[1]["new"], F.lit(" "))).otherwise(""), two, bare[0]["new"])
    whole = F.when(kind == "email", F.concat(F.get(sur, F.lit(1)), sur[0])).otherwise(sur[0])
    address = F.when((m == F.upper(m)) & (kind == "email") & m.rlike(r"\p{L}"), F.upper(whole)).otherwise(whole)
    return F.when(kind.isin("titled", "name", "introduced"), person).when(kind.isin("email", "ipv4", "ipv6"), address).otherwise(filled)


def _with_bare(text: Column, bare: Column) -> Column:
    """A stretch of text with the names of `bare` replaced, longer ones first."""
    edge = r"[\p{L}\p{N}]"
    names = F.concat(F.lit(f"(?<!{edge})(?:"), F.array_join(F.transform(bare, lambda b: b["old"]), "|"), F.lit(f")(?!{edge})"))
    found = F.regexp_extract_all(text, names, F.lit(0))
    new = lambda x: F.filter(bare, lambda b: b["old"] == x)[0]["new"]
    woven = F.transform(F.split(text, names, -1), lambda g, i: F.concat(g, F.when(i < F.size(found), new(F.get(found, i))).otherwise("")))
    return F.when(F.size(bare) > 0, F.array_join(woven, "")).otherwise(text)


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with surrogates in the text; `count_col` adds the number of findings. Keep `key` secret."""
    text = column(docs, text_col).cast("string")
    marked, one, two, new, bare = (fresh(docs.columns, f"surrogate_{x}") for x in ("marked", "key", "check", "new", "bare"))
    plain = [column(docs, c) for c in docs.columns]
    # the one pass of the pattern over the texts; its result is kept, so that no later step repeats it
    rows = cut(docs.select(*plain, F.when(text.rlike(_HINT), _marked(text)).alias(marked)), "marked")
    some = F.coalesce(F.col(marked).contains(OPEN), F.lit(False))
    keys = F.xxhash64(column(docs, id_col).cast("string"), text).alias(one), F.hash(column(docs, id_col).cast("string"), text).alias(two)
    found = F.filter(_parts_of(F.col(marked)), lambda x, i: i % 2 == 1)
    mentions = cut(rows.where(some).select(*keys, F.posexplode(found).alias("at", "m")).distinct(), "mentions")
    forms = mentions.select("m").distinct().withColumn("kind", _kind(F.col("m")))
    forms = cut(forms.withColumn("parts", _parts(F.col("m"), F.col("kind"))), "forms")
    flat = forms.select("m", "kind", F.posexplode("parts").alias("nth", "part")).select("m", "kind", "nth", "part.*")
    known = assign(flat.groupBy("type", "canon").agg(F.sum("gender").alias("gender")), key)
    sur = F.transform(F.array_sort(F.collect_list(F.struct("nth", "sur"))), lambda x: x["sur"])
    laid = cut(flat.join(known, ["type", "canon"]).groupBy("m", "kind").agg(sur.alias("sur")), "laid")
    args = F.col("m"), F.col("kind"), F.col("sur")
    laid = cut(laid.select("m", _lay_out(*args).alias("new"), _bare(*args).alias("bare")), "laid")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias(new)
    own = mentions.join(laid, "m").groupBy(one, two).agg(in_order, F.flatten(F.collect_set("bare")).alias("all"))
    longest = lambda a, b: F.when(F.length(a["old"]) != F.length(b["old"]), F.length(b["old"]) - F.length(a["old"])).when(a < b, -1).when(a > b, 1).otherwise(0)
    own = own.select(one, two, new, F.array_sort(F.array_distinct("all"), longest).alias(bare))
    joined = rows.where(some).withColumns({one: keys[0], two: keys[1]}).join(own, [one, two])
    part = lambda p, i: F.when(i % 2 == 1, F.get(F.col(new), F.shiftright(i, 1))).otherwise(_with_bare(p, F.col(bare)))
    woven = _unescaped(F.array_join(F.transform(_parts_of(F.col(marked)), part), ""))

    def pick(text: Column, n: Column) -> list[Column]:
        count = [n.cast("int").alias(count_col)] if count_col else []
        return [text.alias(c) if c == text_col else column(docs, c) for c in docs.columns] + count

    return joined.select(*pick(woven, F.size(new))).unionByName(rows.where(~some).select(*pick(text, F.lit(0))))
