"""Personal data: keyed surrogates of the same type, gender, script and format.

Only DataFrame functions are used. One pattern finds the entities; a text is split by it, and put together again with a surrogate
for each match, in place. A surrogate is a function of the key and the entity alone, so that one entity has one
surrogate throughout the corpus without any exchange. Numbers go through a keyed permutation of all numbers of their
length (a Feistel network over SHA-256), so two never get the same; card numbers keep whether their check digit is right, account numbers get a right one. Other
entities are written anew character by character, within the class of each.

All distinct entities are checked once: a surrogate that two entities share, or that is itself an entity of the corpus, is
replaced by a further attempt, until none collides. Attempts beyond the first are rare; they are joined back by entity.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import discard, fresh, materialize

# Titles that announce a name, by the gender they tell.
MALE = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "Г-н", "господин", "Господин", "κύριος", "Κύριος", "السيد")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Г-жа", "госпожа", "Госпожа", "κυρία", "Κυρία", "السيدة")
NEUTRAL = ("Dr", "Prof", "Professor", "доктор", "профессор", "κ", "Δρ", "الدكتور")
#: Titles that follow a name, in scripts that write names without blanks.
AFTER_MALE, AFTER_FEMALE, AFTER_NEUTRAL = ("先生",), ("女士", "小姐"), ("教授", "博士", "씨", "님")

# Phrases behind which a full name follows, by the gender they tell.
CUES_MALE = ("Estimado", "Cher", "Lieber", "Уважаемый")
CUES_FEMALE = ("Estimada", "Chère", "Liebe", "Уважаемая")
CUES = (
    "Contact", "contact", "contact person", "Contact person", "Name", "name is", "Dear", "Sincerely", "sincerely", "Regards", "regards", "Signed", "signed by", "Signed by", "written by",
    "Written by", "Author", "Attn", "Patient", "Customer", "Employee", "Kontakt", "Ansprechpartner", "Ansprechpartnerin", "Mein Name ist", "Ich heiße", "Je m'appelle", "Me llamo", "Contacto",
    "Nombre", "Nom", "Меня зовут", "Контакт", "Имя",
)

# Frequent given names, by gender. A capitalised word behind one makes a full name.
GIVEN_MALE = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey "
    "Hans Peter Klaus Wolfgang Jürgen Stefan Andreas Jean Pierre Philippe Jacques Laurent Carlos Juan Miguel Javier Fernando Alejandro Giovanni Marco Иван Дмитрий Сергей Алексей Николай Γιώργος Δημήτρης Κώστας"
).split()
GIVEN_FEMALE = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Betty Sandra Ashley Dorothy Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca "
    "Maria María Anna Ursula Sabine Petra Monika Katharina Nathalie Isabelle Sylvie Françoise Carmen Josefa Lucía Francesca Giulia Анна Елена Ольга Наталья Ирина Ελένη Κατερίνα Σοφία"
).split()


def _any(words) -> str:
    """One of the words, longest first, looked up by their first letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items()) + ")"


_SECRET_KEY = r"(?:(?i)token|secret|password|passwd|api[_\-]?key|access[_\-]?key)"
_BEHIND_KEY = rf"""{_SECRET_KEY} {{0,2}}[=:] {{0,2}}["']?"""
_FORMS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z]{20,}+"
_HEX = r"(?=[a-fA-F]*+\d)(?=\d*+[a-fA-F])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_SIX = rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![\w:]))(?=[A-Fa-f:]*+\d)(?:{_GROUP}(?::{_GROUP})*+)?::(?:{_GROUP}(?::{_GROUP})*+)?)"
_WORD = r"\p{Lu}[\p{L}'’\-]++"
_TITLE = _any((*MALE, *FEMALE, *NEUTRAL))
_CUE = _any((*CUES, *CUES_MALE, *CUES_FEMALE))
_HAN_NAME = "[王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗]\\p{IsHan}{1,2}"
_AFTER = "(?:" + "|".join((*AFTER_MALE, *AFTER_FEMALE, *AFTER_NEUTRAL)) + ")"

# In this order at one place. Each begins with what is cheap to rule out, and runs are taken whole (possessively), however long.
PATTERNS = {
    "secret": rf"""(?<=["' =:])(?<=[=:] {{0,2}}["']?)(?<={_BEHIND_KEY})(?:(?<=(?i:passw(?:or)?d) {{0,2}}[=:] {{0,2}}["']?)|(?=[A-Za-z+/_\-]*+\d)|(?=[A-Za-z+/_\-]{{16}}))[A-Za-z0-9+/_\-]{{8,}}+|(?<![0-9A-Za-z])(?:{_FORMS}|{_HEX})(?![0-9A-Za-z])""",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++\.)+\p{L}{2,63}+(?!\p{N})",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:){_SIX}(?![\w:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?=(?: ?[0-9A-Z]){11})(?=(?: ?[A-Z])*+ ?\d)(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
#: Behind a title one to three names, behind a phrase or from a frequent given name on two or three; of scripts without case one, next to a title.
_PERSON = (
    rf"(?<!\p{{L}})(?=[\p{{Lu}}\p{{IsArabic}}гдпκcnrsw])(?:{_TITLE}\.? (?!{_TITLE}(?!\p{{L}}))(?:{_WORD}(?: {_WORD}){{0,2}}|\p{{IsArabic}}++)"
    rf"|{_CUE}[:,]? {_WORD}(?: \p{{Lu}}\.)?(?: {_WORD}){{1,2}}"
    rf"|{_any((*GIVEN_MALE, *GIVEN_FEMALE))}(?: \p{{Lu}}\.)?(?: {_WORD}){{1,2}})"
    rf"|{_HAN_NAME}(?:先生|女士|小姐|教授|博士)|(?<!\p{{L}})\p{{IsHangul}}{{2,4}}+ ?(?:씨|님)"
)

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
#: Letters that stand for those of their script, in order of scripts as Java names them. Letters of further scripts become Latin ones.
SCRIPTS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Han": "天地人山水火木金土日月星雨雪花草石田川海", "Hangul": "가나다라마바사아자차카타파하고노도로모보",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてと", "Katakana": "アイウエオカキクケコサシスセソタチツテト", "Arabic": "ابتثجحخدذرزسشصضطعفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "अआइईउऊएऐओऔकखगघचछजझटठ", "Thai": "กขคงจชซดตถทธนบปผพฟมย",
}
SYLLABLES = {
    "latin": ("b d f g k l m n p r s t v br dr kr tr".split(), "a e i o u ai ei".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split()),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο ου".split()),
    "arabic": ("ب ت ج د ر س ك ل م ن".split(), "ا و ي".split()),
}
#: Letters that a local part has at least, so that chance collisions stay rare.
LETTERS = 8
ROUNDS = 4
#: The setting that names the key.
KEY = "spark.stemma.pii.key"
ATTEMPTS = 20


def _number(text: Column, digits: int = 12) -> Column:
    """A number below 16 ** digits from a keyed hash of text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("decimal(20,0)")


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("decimal(20,0)")


def permuted(digits: Column, key: Column) -> Column:
    """Another string of as many digits (2 to 34); for one key and length, a permutation."""
    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("l"), F.substring(digits, half + 1, F.length(digits)).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        n = F.length(s["l"])
        mixed = F.pmod(s["l"].cast("decimal(20,0)") + _number(F.concat_ws("|", key, k.cast("string"), s["r"])), _ten(n))
        return F.struct(s["r"].alias("l"), F.lpad(mixed.cast("decimal(20,0)").cast("string"), n, "0").alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda s: F.concat(s["l"], s["r"]))


def refilled(template: Column, digits: Column) -> Column:
    """template with its digits replaced by others, in order."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["i"] + is_digit.cast("int")).alias("i"),
        )

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda s: s["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(body: Column) -> Column:
    """The check digit after these digits."""
    ten = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.aggregate(ten, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10, F.lit(10))


def card(text: Column, key: Column) -> Column:
    d = _digits(text)
    body, check = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1)).cast("int")
    new = permuted(body, key)
    return refilled(text, F.concat(new, F.pmod(_luhn(new) + check - _luhn(body), F.lit(10)).cast("string")))


def phone(text: Column, key: Column) -> Column:
    """The country code stays."""
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))
    return F.concat(code, refilled(rest, permuted(_digits(rest), F.concat(key, code))))


def ip(text: Column, key: Column) -> Column:
    o = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    start = F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_number(F.concat_ws("|", key, k.cast("string"), s["r"].cast("string")), 4).cast("long")).alias("r"))

    def write(s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("int").cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)])

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, write)


def ipv6(text: Column, key: Column) -> Column:
    """Each hexadecimal digit becomes another; groups and case stay."""
    seed = F.concat_ws("|", key, F.lower(text))
    new = F.array_join(F.transform(F.split(F.lower(text), ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), _pick(HEX, _stream(seed, i))).otherwise(c)), "")
    return F.when((text == F.upper(text)) & (text != F.lower(text)), F.upper(new)).otherwise(new)


def iban(text: Column, key: Column) -> Column:
    """The country stays, the check digits are right for the new number."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    body = F.substring(plain, F.lit(5), F.length(plain))
    new = rewritten(body, F.concat_ws("|", key, plain), F.lit(False))

    def step(rest: Column, c: Column) -> Column:
        # letters count as 10 to 35
        value = F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
        return F.pmod(rest * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    rest = F.aggregate(F.split(F.concat(new, F.substring(plain, 1, 2), F.lit("00")), ""), F.lit(0), step)
    return respaced(text, F.concat(F.substring(plain, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), new))


def respaced(template: Column, plain: Column) -> Column:
    """plain with blanks where template has them."""

    def step(s: Column, c: Column) -> Column:
        blank = c == " "
        return F.struct(F.concat(s["out"], F.when(blank, c).otherwise(F.substring(plain, s["i"] + 1, F.lit(1)))).alias("out"), (s["i"] + (~blank).cast("int")).alias("i"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda s: s["out"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is one node of the plan however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pick(letters: str | list[str], n: Column) -> Column:
    if isinstance(letters, str):
        return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, F.lit(1))
    return F.element_at(F.split(F.lit(" ".join(letters)), " "), F.pmod(n, F.lit(len(letters))).cast("int") + 1)


def _stream(seed: Column, i: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, F.floor(i / 16).cast("string")), 256), (F.pmod(i, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")


def rewritten(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Each letter and digit becomes another of its class and script; all else stays."""

    def one(c: Column, i: Column, seed: Column, whole: Column) -> Column:
        def of(n: Column) -> Column:
            low, up = F.lower(c) == c, F.upper(c) != F.lower(c)
            cased: Callable[[str], Column] = lambda letters: _let(_pick(letters, n), lambda x: F.when(low, x).otherwise(F.upper(x)))
            other = [F.when(c.rlike(rf"^\p{{Is{script}}}$"), cased(letters) if script in ("Cyrillic", "Greek") else _pick(letters, n)) for script, letters in SCRIPTS.items()]
            return (
                F.when(whole == 1, _pick(HEX, n))
                .when(whole == 2, _pick(HEX.upper(), n))
                .when(c.rlike("^[0-9]$"), _pick(DIGITS, n))
                .when(up & c.rlike("^[A-Za-z]$"), cased(LOWER))
                .when(~c.rlike(r"^[\p{L}\p{N}]$"), c)
                .when(c.rlike(r"^\p{N}$"), _pick(DIGITS, n))
                .otherwise(F.coalesce(*other, cased(LOWER)))
            )

        return _let(_stream(seed, i), of)

    whole = F.when(~hexadecimal, 0).when(text == F.upper(text), 2).otherwise(1)
    held = F.struct(text.alias("text"), seed.alias("seed"), whole.alias("whole"))
    return _let(held, lambda s: F.array_join(F.transform(F.split(s["text"], ""), lambda c, i: one(c, i, s["seed"], s["whole"])), ""))


def email(text: Column, key: Column) -> Column:
    seed = F.concat_ws("|", key, F.lower(text))
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    own = F.length(F.regexp_replace(local, r"[^\p{L}]", ""))
    more = F.substring(F.array_join(F.transform(F.array(*map(F.lit, range(LETTERS))), lambda i: _pick(LOWER, _stream(F.concat(seed, F.lit("+")), i))), ""), F.lit(1), F.greatest(F.lit(0), F.lit(LETTERS) - own))
    more = F.when((local == F.upper(local)) & (local != F.lower(local)), F.upper(more)).otherwise(more)
    # names reserved for examples stay in use; all else moves below one
    kept = F.regexp_extract(domain, r"(?i)(?:^|\.)(example\.(?:com|org|net))$", 1)
    labels = F.when(kept != "", F.substring(domain, F.lit(1), F.length(domain) - F.length(kept))).otherwise(F.regexp_replace(domain, r"[^.]+$", ""))
    end = F.when(kept != "", kept).otherwise(F.when(domain == F.upper(domain), F.lit("EXAMPLE")).otherwise(F.lit("example")))
    no = F.lit(False)
    return F.concat(more, rewritten(local, seed, no), F.lit("@"), rewritten(labels, F.concat(seed, F.lit("@")), no), end)


def secret(text: Column, key: Column) -> Column:
    """What tells the kind of a key stays."""
    head = F.regexp_extract(text, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    return F.concat(head, rewritten(rest, F.concat_ws("|", key, F.lower(text)), text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")))


def _sign(first: int, count: int, n: Column) -> Column:
    """One of so many characters from a code point on."""
    return F.decode(F.unhex(F.lpad(F.hex(F.lit(first) + F.pmod(n, F.lit(count))), 4, "0")), "UTF-16BE")


def _name(token: Column, key: Column, told: Column) -> Column:
    """A made-up name: syllables of the script, and an ending that tells the gender where names have one."""
    given, female = F.coalesce(told["given"], F.lit(False)), F.coalesce(told["female"], F.lit(False))
    seed = F.concat_ws("|", key, F.lower(token), F.when(given, F.lit("g")).otherwise(F.lit("f")), female.cast("string"))
    return _let(F.struct(token.alias("token"), given.alias("given"), female.alias("female"), F.sha2(seed, 256).alias("digest")), lambda s: _named(s["token"], s["given"], s["female"], s["digest"]))


def _named(token: Column, given: Column, female: Column, digest: Column) -> Column:
    at = lambda k: F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("long")

    def build(script: str, endings: dict[tuple[bool, bool], list[str]]) -> Column:
        head, vowels = SYLLABLES[script]
        body = F.concat(*[x for k in range(3) for x in (_pick(head, at(2 * k)), _pick(vowels, at(2 * k + 1)))])
        end = F.when(given, F.when(female, _pick(endings[True, True], at(9))).otherwise(_pick(endings[True, False], at(9)))).otherwise(F.when(female, _pick(endings[False, True], at(9))).otherwise(_pick(endings[False, False], at(9))))
        return F.initcap(F.concat(body, end))

    def signs(families: str, first: int, count: int, women: str, men: str) -> Column:
        """A family name, any sign of the script, and one that women's or men's names end in."""
        return F.concat(_pick(families, at(0)), _sign(first, count, at(1)), F.when(female, _pick(women, at(9))).otherwise(_pick(men, at(9))))

    same = ["ner", "son", "ton", "man", "sen", "berg"]
    latin = build("latin", {(True, True): ["na", "lia", "elle", "ine"], (True, False): ["n", "rus", "do", "bert"], (False, True): same, (False, False): same})
    cyrillic = build("cyrillic", {(True, True): ["на", "лия"], (True, False): ["слав", "рий", "н"], (False, True): ["нова", "рова"], (False, False): ["нов", "ров"]})
    greek = build("greek", {(True, True): ["να", "λία", "ίκη"], (True, False): ["ος", "ης", "ων"], (False, True): ["ίδου", "άκη"], (False, False): ["ίδης", "άκης"]})
    arabic = build("arabic", {(True, True): ["ة", "اء"], (True, False): ["ر", "د"], (False, True): ["ي"], (False, False): ["ي"]})
    han = signs("王李张刘陈杨赵黄周吴", 0x4E00, 20902, "芳丽娜婷雪梅", "伟强磊军勇涛")
    hangul = signs("김이박최정강조윤장임", 0xAC00, 11172, "희은영미", "호수철준")
    new = F.when(token.rlike(r"\p{IsCyrillic}"), cyrillic).when(token.rlike(r"\p{IsGreek}"), greek).when(token.rlike(r"\p{IsArabic}"), arabic)
    new = new.when(token.rlike(r"\p{IsHan}"), han).when(token.rlike(r"\p{IsHangul}"), hangul).otherwise(latin)
    return _let(new, lambda x: F.when((token == F.upper(token)) & (token != F.lower(token)) & (F.length(token) > 1), F.upper(x)).otherwise(x))


def persons(text: Column) -> Column:
    """token, given, female of each name that a title, a phrase or a frequent given name tells. Where the title doesn't tell the
    gender, the given name or its end does."""

    def split(m: Column) -> Column:
        title = F.regexp_extract(m, rf"^(?:{_TITLE}|{_CUE})(?!\p{{L}})|{_AFTER}$", 0)
        # a given name's own first letters aren't a title: what is taken off ends in a blank, or begins one
        rest = F.regexp_replace(m, rf"^{_TITLE}\.? |^{_CUE}[:,]? | ?{_AFTER}$", "")
        rest = F.filter(F.split(rest, " "), lambda t: ~t.endswith(".") & (t != ""))
        first = F.get(rest, F.lit(0))
        female = (
            F.when(title.isin(*FEMALE, *CUES_FEMALE, *AFTER_FEMALE), True)
            .when(title.isin(*MALE, *CUES_MALE, *AFTER_MALE), False)
            .when(first.isin(*GIVEN_FEMALE), True)
            .when(first.isin(*GIVEN_MALE), False)
            .otherwise(F.when(F.size(rest) > 1, first.rlike("(?i)(?:a|ie|elle|ine|а|я|α|η)$")).otherwise(False))
        )
        # a Latin family name is the same for all; a Cyrillic or Greek one says the gender, and in Han or Hangul a name is one
        telling = first.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsHan}\p{IsHangul}]")
        return F.transform(rest, lambda t, i: F.struct(t.alias("token"), ((i == 0) & (F.size(rest) > 1)).alias("given"), (female & (((i == 0) & (F.size(rest) > 1)) | telling)).alias("female")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({_PERSON})"), F.lit(1)), split))


def kind_of(hit: Column, before: Column) -> Column:
    """The type of a match, by what is before it and its shape."""
    return (
        F.when(before.rlike(f"{_BEHIND_KEY}$") & hit.rlike(r"^[A-Za-z0-9+/_\-]{8,}$"), "secret")
        .when(hit.contains("@"), "email")
        .when(hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(hit.rlike("^[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(hit.rlike(rf"^(?:{PATTERNS['phone']})$"), "phone")
        .when(hit.rlike(r"^\d(?:[ \-]?\d){12,18}$"), "card")
        .when(hit.rlike(rf"^(?:{_FORMS})$"), "secret")
        .when(hit.rlike(r"^[A-Z]{2}\d{2}[ 0-9A-Z]+$"), "iban")
        .when(hit.rlike(r"^[\p{L}'’ \-]+$"), "name")
        .otherwise("secret")
    )


def normal(kind: Column, text: Column) -> Column:
    """What makes two mentions one entity: digits of numbers, letters in any case."""
    return F.when(kind.isin("phone", "card", "ssn"), _digits(text)).when(kind == "iban", F.replace(text, F.lit(" "), F.lit(""))).otherwise(F.lower(text))


def surrogate(hit: Column, kind: Column, key: Column) -> Column:
    """That of an entity other than a name."""

    def of(s: Column) -> Column:
        hit, kind, key = s["hit"], s["kind"], s["key"]
        with_ = lambda name: F.concat(key, F.lit("|" + name))
        return (
            F.when(kind == "email", email(hit, with_("email")))
            .when(kind == "ip", ip(hit, with_("ip")))
            .when(kind == "ipv6", ipv6(hit, with_("ipv6")))
            .when(kind == "iban", iban(hit, with_("iban")))
            .when(kind == "ssn", refilled(hit, permuted(_digits(hit), with_("ssn"))))
            .when(kind == "phone", phone(hit, with_("phone")))
            .when(kind == "card", card(hit, with_("card")))
            .otherwise(secret(hit, with_("secret")))
        )

    return _let(F.struct(hit.alias("hit"), kind.alias("kind"), key.alias("key")), of)


def name_surrogate(token: Column, told: Column, key: Column) -> Column:
    """That of a part of a name, of which told says whether it is given and whether a woman's."""
    return _name(token, F.concat(key, F.lit("|name")), told)


ALL = "|".join(p.replace(r"\1", r"\k<sep>").replace("([ \\-])", "(?<sep>[ \\-])") for p in PATTERNS.values())


def _matched(docs: DataFrame, text: str, who: str, hits: str, gaps: str) -> DataFrame:
    """docs with the persons, the matches (hit, kind) and what lies between them. A name that is told once is found wherever it stands."""
    t = F.coalesce(F.col(text), F.lit(""))
    nobody = F.from_json(F.lit("[]"), "array<struct<token:string,given:boolean,female:boolean>>")
    # few texts name anybody: a name of a script with cases has a capital, and one in the word before it, or that word is of another script
    capitals = t.rlike(r"\p{Lu}[\p{L}'’\-]*+[.:,]? \p{Lu}") | t.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHan}\p{IsHangul}]")
    docs = docs.withColumn(who, F.when(capitals & t.rlike(_PERSON), persons(t)).otherwise(nobody))
    # all else has a digit or an @, or stands behind a key word, or begins like a known key
    some = t.rlike("[@0-9]") | t.rlike(r"""[=:] {0,2}["']?[A-Za-z+/_\-]{8}""")
    for head in ("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        some = some | t.contains(head)
    tokens = F.array_distinct(F.transform(who, lambda p: p["token"]))
    tight = r"[\p{IsHan}\p{IsHangul}]"  # scripts without blanks around names

    def one_of(keep: Callable[[Column], Column]) -> Column:
        # longer ones first, as one may begin another
        them = F.array_sort(F.filter(tokens, keep), lambda a, b: F.length(b) - F.length(a))
        return F.concat(F.lit("(?:"), F.array_join(them, "|"), F.when(F.size(them) == 0, "(?!)").otherwise(""), F.lit(")"))

    spaced = one_of(lambda x: ~x.rlike(tight))
    names = F.concat(F.lit(r"|(?<!\p{L})"), spaced, F.lit("(?: "), spaced, F.lit(r")*+(?!\p{L})|"), one_of(lambda x: x.rlike(tight)))
    named = F.concat(F.lit(ALL), names)
    # a pattern for each of the two, as one that changes from row to row is compiled anew
    found = F.when(F.size(who) > 0, F.regexp_extract_all(t, named, F.lit(0))).when(some, F.regexp_extract_all(t, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn(hits, found)
    docs = docs.withColumn(gaps, F.when(F.size(hits) > 0, F.when(F.size(who) == 0, F.split(t, ALL, -1)).otherwise(F.split(t, named, -1))))
    kinds = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), kind_of(h, F.substring(F.get(gaps, i), -48, 48)).alias("kind")))
    return docs.withColumn(hits, kinds)


def _entities(rows: DataFrame, hits: str, who: str, *keep: str) -> DataFrame:
    """keep, kind, hit, told and entity of each distinct entity of each row; each part of a name is one.

    A name that stands for a man here and a woman there is two entities.
    """
    each = rows.select(*keep, who, F.explode(F.array_distinct(hits)).alias("h")).select(*keep, who, "h.kind", "h.hit")
    each = each.select(*keep, who, "kind", F.explode(F.when(F.col("kind") == "name", F.split("hit", " ")).otherwise(F.array("hit"))).alias("hit"))
    told = F.when(F.col("kind") == "name", F.get(F.filter(who, lambda x: F.lower(x["token"]) == F.lower(F.col("hit"))), F.lit(0)))
    each = each.select(*keep, "kind", "hit", told.alias("told"))
    return each.withColumn("entity", F.concat_ws(":", "kind", normal(F.col("kind"), F.col("hit")), F.col("told.given").cast("string"), F.col("told.female").cast("string")))


def attempts(rows: DataFrame, hits: str, who: str, key: str) -> DataFrame | None:
    """entity and attempt (from 1) of those whose first surrogate collides; None if none does."""
    first = _entities(rows.where(F.size(hits) > 0), hits, who)
    # counts are combined before the shuffle: a hot entity is one row from each task
    first = materialize(first.groupBy("entity").agg(F.min("kind").alias("kind"), F.min("hit").alias("hit"), F.min("told").alias("told")), "entities")
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), first.count() // 2000))
    settled = None
    for turn in range(ATTEMPTS):
        state = first.withColumn("attempt", F.lit(0)) if settled is None else first.join(settled, "entity", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        state = state.repartition(parts) if parts > 1 else state
        tries = F.concat(F.lit(key), F.col("attempt").cast("string"))
        tried = state.withColumn("new", F.when(F.col("kind") == "name", name_surrogate(F.col("hit"), F.col("told"), tries)).otherwise(surrogate(F.col("hit"), F.col("kind"), tries)))
        tried = tried.select("entity", "attempt", F.concat_ws(":", "kind", normal(F.col("kind"), F.col("new"))).alias("out"), F.concat_ws(":", "kind", normal(F.col("kind"), F.col("hit"))).alias("own"))
        tried = materialize(tried, "surrogates")
        # of several with one surrogate the least keeps it, unless it is an entity itself
        shared = tried.groupBy("out").agg(F.count(F.lit(1)).alias("c"), F.min("entity").alias("keeps")).where("c > 1")
        lost = tried.join(shared, "out").where("entity <> keeps").select("entity")
        lost = lost.unionByName(tried.join(tried.select(F.col("own").alias("out")).distinct(), "out", "left_semi").select("entity")).distinct()
        lost = materialize(lost, "collisions")
        if not lost.limit(1).count():
            discard(first, tried, lost)
            return settled
        now = tried.join(lost.withColumn("again", F.lit(1)), "entity", "left").select("entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")).where("attempt > 0")
        before, settled = settled, materialize(now, "attempts")
        discard(before, tried, lost)
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def session_key(spark: SparkSession) -> str:
    """The key that spark.stemma.pii.key holds. Where that is unset, a random one that lasts as long as the application: surrogates then
    agree within it, and nobody can compute them. Keys are never part of the code."""
    if key := spark.conf.get(KEY, None):
        return key
    context = spark.sparkContext
    if not hasattr(context, "_stemma_pii_key"):
        context._stemma_pii_key = secrets.token_hex(32)
    return context._stemma_pii_key


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with its texts rewritten and n_entities (long), the number of entities replaced in each.

    key (else that of the session) keeps surrogates from being recomputed by others; one key gives one mapping. Null texts stay null,
    empty ones empty; both have no entity. Repeated rows and rows without an id are rewritten alike. Other columns stay as they are.
    Entities are found in whole texts, whatever their length; an empty table gives an empty result. Digits in the shape of a card's number
    count as one whether their check digit is right or not, and keep which it is.

    Texts are searched once: what is found is written to the shared folder, and both the check for collisions and the result read that.
    """
    key = key or session_key(docs.sparkSession)
    names = [c for c in docs.columns if c != "n_entities"]
    who, hits, gaps, again, row = (fresh(docs, x) for x in ("who", "hits", "gaps", "again", "row"))
    rows = _matched(docs.select(*[f"`{c}`" for c in names]), "text", who, hits, gaps)
    # a text with entities is what is found and what lies between
    rows = materialize(rows.withColumn("text", F.when(F.size(hits) == 0, F.col("text"))), "found")
    settled = attempts(rows, hits, who, key)
    if settled is None:
        rows = rows.withColumn(again, F.lit(None).cast("map<string,int>"))
    else:
        rows = _with_attempts(rows, settled, hits, who, again, row)

    def one(h: Column) -> Column:
        hit, kind = h["hit"], h["kind"]

        def at(entity: Column) -> Column:
            return F.concat(F.lit(key), F.coalesce(F.element_at(F.col(again), entity), F.lit(0)).cast("string"))

        def part(t: Column) -> Column:
            told = F.get(F.filter(who, lambda x: F.lower(x["token"]) == F.lower(t)), F.lit(0))
            return _let(told, lambda p: name_surrogate(t, p, at(F.concat_ws(":", F.lit("name"), F.lower(t), p["given"].cast("string"), p["female"].cast("string")))))

        plain = surrogate(hit, kind, at(F.concat_ws(":", kind, normal(kind, hit))))
        return F.when(kind == "name", F.array_join(F.transform(F.split(hit, " "), part), " ")).otherwise(plain)

    between = F.col(gaps)
    new = F.array_join(F.flatten(F.transform(hits, lambda h, i: F.array(F.get(between, i), one(h)))), "")
    text = F.when(F.size(hits) > 0, F.concat(new, F.get(between, F.size(hits)))).otherwise(F.col("text"))
    order = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    return rows.select(*order, F.size(hits).cast("long").alias("n_entities"))


def _with_attempts(rows: DataFrame, settled: DataFrame, hits: str, who: str, again: str, row: str) -> DataFrame:
    """rows with a map of the entities of each row that need a further attempt. Rows are told apart by their hash, so that
    equal rows share one map; only the entities of rows are exchanged until then."""
    rows = rows.withColumn(row, F.when(F.size(hits) > 0, F.xxhash64(hits, who)))
    need = _entities(rows.where(F.col(row).isNotNull()), hits, who, row).select(row, "entity").distinct().join(settled, "entity")
    maps = need.groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(again))
    return rows.join(maps, row, "left").drop(row)
