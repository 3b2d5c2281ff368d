import hashlib
import random
import re

from stemma.llm import pii


def run(spark, rows, key="k"):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_entities) for r in pii.replace(docs, key).collect()}


def feistel(digits, key):
    """The keyed permutation by plain loops."""
    u = len(digits) // 2
    left, right = digits[:u], digits[u:]
    for k in range(4):
        n = len(left)
        f = int(hashlib.sha256(f"{key}|{k}|{right}".encode()).hexdigest()[:12], 16)
        left, right = right, str((int(left) + f) % 10**n).zfill(n)
    return left + right


def luhn(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


ROWS = [
    (1, "Mail bob.7@mail3.example.com or Bob.7@mail3.example.com, +1 (017) 555-7713, +1 017 555 7713; 4111111111111111 or 4111 1111 1111 1111 at 10.0.0.1."),
    (2, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" ssn 123-45-6789 password: hunter2abc jo@corp.co.uk'),
    (3, "Mr. John Smith met Mrs. Anna Smith. John and Anna left. г-жа Анна Иванова и г-н Иван Иванов."),
    (4, None),
    (5, ""),
    (6, "clean text, version 3. CC BY-NC 4.0, in 2024-01-02 2024-01-03, 1.2.3, 12345."),
    (7, "bob.7@mail3.example.com again; card 1234567812345678"),
]


def test_types_formats_and_coreference(spark):
    got = run(spark, ROWS)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == (ROWS[5][1], 0)
    text, n = got[1]
    m = re.fullmatch(r"Mail (\S+@[a-z]{4}\d\.example\.com) or (\S+), (\+1 \(\d{3}\) \d{3}-\d{4}), (\+1 \d{3} \d{3} \d{4}); (\d{16}) or ((?:\d{4} ){3}\d{4}) at (\d+(?:\.\d+){3})\.", text)
    assert m and n == 7 and m[1] == m[2].lower() and re.sub(r"\D", "", m[3]) == re.sub(r"\D", "", m[4])
    assert m[5] == m[6].replace(" ", "") and luhn(m[5][:-1]) == int(m[5][-1])
    assert m[5][:-1] == feistel("411111111111111", "k0|card") and re.sub(r"\D", "", m[3])[1:] == feistel("0175557713", "k0|phone+1")
    assert all(int(x) < 256 for x in m[7].split(".")) and got[7][0].startswith(m[1])
    card = re.search(r"\d{16}", got[7][0])[0]
    assert (int(card[-1]) - luhn(card[:-1])) % 10 == (8 - luhn("123456781234567")) % 10
    m = re.fullmatch(r'token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})" ssn (\d{3}-\d{2}-\d{4}) password: (\S{10}) (\S+\.example)', got[2][0])
    assert m and m[1] == m[2].lower() and "hunter" not in m[4]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. (\w+) and (\w+) left\. г-жа ([а-яА-Я]+) ([а-яА-Я]+ова) и г-н ([а-яА-Я]+) ([а-яА-Я]+ов)\.", got[3][0])
    assert m and m[2] == m[4] and m[1] == m[5] and m[3] == m[6] and m[3].endswith(("a", "e")) and not m[1].endswith("a")
    assert run(spark, ROWS, "other")[1][0] != text and run(spark, ROWS)[1][0] == text


def test_numbers_are_permuted(spark):
    rows = spark.range(1000).selectExpr("lpad(cast(id as string), 3, '0') as d", "concat('10.0.', id div 256, '.', id % 256) as a")
    from pyspark.sql import functions as F

    out = rows.select(pii.permuted(F.col("d"), F.lit("k")).alias("p"), pii.ip(F.col("a"), F.lit("k")).alias("q")).collect()
    assert len({r.p for r in out}) == 1000 and all(len(r.p) == 3 for r in out) and len({r.q for r in out}) == 1000


def test_collisions_are_settled(spark, monkeypatch):
    """With a space of a few names, attempts go on until all differ."""
    monkeypatch.setattr(pii, "LETTERS", 1)
    rows = [(k, f"a{k}@m.example.com and a{(k + 1) % 120}@m.example.com") for k in range(120)]
    got = run(spark, rows)
    first = {k: got[k][0].split(" and ") for k in got}
    mapping = {k: first[k][0] for k in got}
    assert len(set(mapping.values())) == 120 and all(first[k][1] == mapping[(k + 1) % 120] for k in got)
    assert not set(mapping.values()) & {f"a{k}@m.example.com" for k in range(120)}


def test_odd_rows(spark, odd, none):
    out = pii.replace(odd)
    assert [c for c in out.columns if c != "n_entities"] == odd.columns and out.count() == odd.count()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in out.collect()) == sorted((repr(r.doc_id), repr(r.text)) for r in odd.collect())
    assert pii.replace(none).count() == 0


def test_keys_of_letters_alone(spark):
    keys = ["AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcdefghijklmnopqr" * 2, "sk-" + "abcdefghijklmnopqrstuvwx"]
    got = run(spark, [(k, f"use {x} here") for k, x in enumerate(keys)] + [(9, "a risk-free task, in prose alone")])
    for k, x in enumerate(keys):
        assert got[k][1] == 1 and x not in got[k][0] and re.fullmatch(r"use \S+ here", got[k][0])
    assert got[9] == ("a risk-free task, in prose alone", 0)


def test_nothing_is_cut_off(spark):
    """Long secrets go as a whole, wherever their first digit is, and so do long names and addresses."""
    rows = [
        (1, "token = " + "aB3" * 300),
        (2, "api_key: " + "abcdefgh" * 20 + "7" + "x" * 500),
        (3, "see " + "0123456789abcdef" * 30 + " there"),
        (4, "password=correcthorsebattery"),
        (5, "Mr. " + "A" + "b" * 90 + " came"),
        (6, "write to " + "a" * 90 + ".9@example.com now"),
        (7, "sk-" + "a1B2" * 50),
        (8, "secret: " + "Q" * 80),
    ]
    got = run(spark, rows)
    for k, t in rows:
        new, n = got[k]
        assert n == 1, k
        old, there = max(t.split(), key=len), max(new.split(), key=len)
        for at in range(0, len(old) - 12, 5):
            if k not in (6,) or at < 80:
                assert old[at : at + 12] not in there, (k, at)


def test_names_without_titles_and_in_other_scripts(spark):
    rows = [
        (1, "Contact John Smith today. Smith will answer."),
        (2, "Maria Garcia wrote this; later Garcia left."),
        (3, "Dear Wanda Kowalska, hello."),
        (4, "请找王小明先生。王小明在这里。李芳女士也在。"),
        (5, "김민수 씨는 여기 있다."),
        (6, "Ο κύριος Νικόλαος Παππάς και η κυρία Ελένη Παππά ήρθαν."),
        (7, "وصل السيد أحمد اليوم"),
        (8, "John R. Smith signed. In Contact with nature, The Hague is nice."),
    ]
    got = {k: v for k, (v, _) in run(spark, rows).items()}
    m = re.fullmatch(r"Contact (\w+) (\w+) today\. (\w+) will answer\.", got[1])
    assert m and m[2] == m[3] and "Smith" not in got[1] and "John" not in got[1]
    m = re.fullmatch(r"(\w+(?:a|e)) (\w+) wrote this; later (\w+) left\.", got[2])
    assert m and m[2] == m[3] and "Garcia" not in got[2]
    assert re.fullmatch(r"Dear \w+ \w+, hello\.", got[3]) and "Kowalska" not in got[3]
    m = re.fullmatch(r"请找([\u4e00-\u9fff]{3})先生。([\u4e00-\u9fff]{3})在这里。([\u4e00-\u9fff]{3})女士也在。", got[4])
    assert m and m[1] == m[2] != "王小明" and m[1][-1] in "伟强磊军勇涛" and m[3][-1] in "芳丽娜婷雪梅"
    assert re.fullmatch(r"[\uac00-\ud7a3]{3} 씨는 여기 있다\.", got[5]) and "김민수" not in got[5]
    m = re.fullmatch(r"Ο κύριος (\w+) (\w+) και η κυρία (\w+) (\w+) ήρθαν\.", got[6])
    assert m and m[1].endswith(("ος", "ης", "ων")) and m[3].endswith(("να", "λία", "ίκη")) and m[4].endswith(("ίδου", "άκη")) and "Παππ" not in got[6]
    assert re.fullmatch(r"وصل السيد [\u0600-\u06ff]+ اليوم", got[7]) and "أحمد" not in got[7]
    assert "Smith" not in got[8] and got[8].endswith("In Contact with nature, The Hague is nice.")


def mod97(number):
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def test_account_numbers_and_long_addresses(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000, GB29 NWBK 6016 1331 9268 19."), (2, "at 2001:db8::ff00:42:8329 and 2001:0DB8:0000:0000:0000:FF00:0042:8329 and fe80::1, std::vector<int>, 12:30:45")]
    got = run(spark, rows)
    m = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}), (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d)\.", got[1][0])
    assert m and m[1].replace(" ", "") == m[2] != "DE89370400440532013000" and mod97(m[2]) == mod97(m[3].replace(" ", "")) == 1
    m = re.fullmatch(r"at ([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}) and ((?:[0-9A-F]{4}:){7}[0-9A-F]{4}) and ([0-9a-f]{4}::[0-9a-f]), std::vector<int>, 12:30:45", got[2][0])
    assert m and got[2][1] == 3


def plain_find(text):
    """Entities as (start, end, kind) by plain loops over words; for the table below only."""
    out, at = [], 0
    for word in text.split(" "):
        core = word.strip(".,;()\"")
        s = at + word.find(core) if core else at
        digits = re.sub(r"\D", "", core)
        if core.count("@") == 1 and "." in core.split("@")[1]:
            out.append((s, s + len(core), "email"))
        elif core.count(".") == 3 and all(p.isdigit() and int(p) < 256 for p in core.split(".")):
            out.append((s, s + len(core), "ip"))
        elif core.count(":") == 7 and all(0 < len(p) <= 4 and set(p) <= set("0123456789abcdef") for p in core.split(":")):
            out.append((s, s + len(core), "ipv6"))
        elif core.count("-") == 2 and [len(p) for p in core.split("-")] == [3, 2, 4] and digits == core.replace("-", ""):
            out.append((s, s + len(core), "ssn"))
        elif core.isdigit() and len(core) == 16:
            out.append((s, s + len(core), "card"))
        elif core.startswith("+1-") and len(digits) == 11:
            out.append((s, s + len(core), "phone"))
        elif len(core) == 22 and core[:2].isalpha() and core[:2].isupper() and core[2:].isdigit():
            out.append((s, s + len(core), "iban"))
        elif core.startswith("ghp_") and len(core) == 40:
            out.append((s, s + len(core), "secret"))
        at += len(word) + 1
    return out


def test_all_kinds_against_plain_loops(spark):
    rng = random.Random(21)
    d = lambda n: "".join(rng.choices("0123456789", k=n))

    def entity(kind):
        if kind == "card":
            body = d(15)
            return body + str(luhn(body))
        return {
            "email": lambda: f"{rng.choice(['ann', 'bob', 'élodie'])}.{d(2)}@mail{d(1)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
            "ipv6": lambda: ":".join("".join(rng.choices("0123456789abcdef", k=4)) for _ in range(8)), "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}", "phone": lambda: f"+1-{d(3)}-{d(3)}-{d(4)}",
            "iban": lambda: "DE" + d(20), "secret": lambda: "ghp_" + "".join(rng.choices("abcXYZ019", k=36)),
        }[kind]()

    kinds = ["email", "ip", "ipv6", "ssn", "phone", "iban", "secret", "card"]
    pool = [(k, entity(k)) for k in kinds for _ in range(40)]
    prose = "the quiet river ran on, past 12 mills and 1,204 barns in 1998; version 1.2.3 of 5000000000 (sic) at 10:45".split()
    rows = []
    for k in range(400):
        words = rng.choices(prose, k=30)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(30)] = rng.choice(pool)[1]
        rows.append((k, " ".join(words)))
    got, mapping = run(spark, rows), {}
    for k, text in rows:
        new, n = got[k]
        found = plain_find(text)
        assert n == len(found), (text, n, found)
        told = {text.rfind(" ", 0, s) + 1: (text[s:e], kind) for s, e, kind in found}
        at, there = 0, new.split(" ")
        for word, other in zip(text.split(" "), there, strict=True):  # entities of this table hold no blank
            if at in told:
                old, kind = told[at]
                ((s, e, kind2),) = plain_find(other)
                assert kind2 == kind and word.replace(old, "|") == other.replace(other[s:e], "|") and other[s:e] != old
                assert mapping.setdefault((kind, old), other[s:e]) == other[s:e]
            else:
                assert word == other  # what lies between stays
            at += len(word) + 1
    originals = {x for _, x in pool}
    assert len(set(mapping.values())) == len(mapping) > 250 and not originals & set(mapping.values())


def test_the_key_comes_from_the_session(spark):
    docs = spark.createDataFrame([(1, "a.b@c.example.com", "x", "y")], "doc_id long, text string, __who string, __hits string")
    try:
        spark.conf.set(pii.KEY, "one")
        one = pii.replace(docs).first()
        spark.conf.set(pii.KEY, "two")
        two = pii.replace(docs).first()
    finally:
        spark.conf.unset(pii.KEY)
    assert one.text != two.text and one.text == pii.replace(docs, "one").first().text and (one["__who"], one["__hits"]) == ("x", "y")
    assert len(pii.session_key(spark)) == 64 and pii.session_key(spark) == pii.session_key(spark)
