import re

from pyspark.sql import functions as F

from sparkdocket.llm import pii
from sparkdocket.llm.pii import is_entity, kind_of, replace_pii


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


ROWS = [
    (1, "Mail Jo.Smith7@Mail3.Example.COM, jo.smith7@mail3.example.com; card 4111 1111 1111 1111 or 4111-1111-1111-1111!!"),
    (2, "call +1 (017) 555-7713%%% ssn 123-45-6789 ip 169.122.221.182$$$ token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""),
    (3, "Mr. John Smith met Mrs. Smith, Frau MÜLLER and г-жа Иванова."),
    (4, None), (5, ""), (6, "Nothing 12 here. Version 1.2 and 9807915762804490, 300.1.1.1 stay; mr smith too."),
    (6, "jo.smith7@mail3.example.com"), (None, "jo.smith7@mail3.example.com"), (7, "x " * 100_000 + "jo.smith7@mail3.example.com"),
]


def test_surrogates_keep_type_format_and_coreference(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "doc_id int, text string, n_entities long")
    place = {None: 7} | {i: n for n, (i, _) in enumerate(ROWS) if i is not None}
    out = sorted(replace_pii(df, key="k").collect(), key=lambda r: (place[r.doc_id], r.n_entities))  # a table has no order
    texts = {r.doc_id: r.text for r in out if r.doc_id not in (6, None)}
    assert [(r.doc_id, r.n_entities) for r in out] == [(1, 4), (2, 4), (3, 4), (4, 0), (5, 0), (6, 0), (6, 1), (None, 1), (7, 1)]
    assert texts[4] is None and texts[5] == "" and out[5].text == ROWS[5][1]
    mails = re.findall(r"[\w.]+@[\w.]+\w", texts[1])
    assert mails[0].lower() == mails[1] != "jo.smith7@mail3.example.com" and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{4}\d@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.COM", mails[0])
    assert {r.text for r in out if r.doc_id in (6, None)} - {ROWS[5][1]} == {mails[1]} and texts[7].endswith(mails[1]) and len(texts[7]) == len(ROWS[8][1])
    a, b = re.search(r"card ([\d ]+) or ([\d-]+)!!", texts[1]).groups()
    assert luhn(a) and a.replace(" ", "") == b.replace("-", "") != "4111111111111111" and a[0] == "4" and len(a) == 19
    m = re.fullmatch(r'call (\+1) \(\d{3}\) \d{3}-\d{4}%%% ssn \d{3}-\d\d-\d{4} ip ([\d.]+)\$\$\$ token = "([0-9a-f]{40})"', texts[2])
    assert m and all(int(x) < 256 for x in m[2].split(".")) and m[3] not in ROWS[1][1]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+), Frau ([A-Z]+) and г-жа ([А-Я][а-я]+ова)\.", texts[3])
    assert m and m[1] in pii.GIVEN["latin", "m"] and m[2] == m[3] != "Smith"
    again = {r.doc_id: r.text for r in replace_pii(df, key="k").where("doc_id < 4").collect()}
    assert all(again[i] == texts[i] for i in (1, 2, 3))
    assert replace_pii(df, key="other").where("doc_id = 1").first().text != texts[1]
    assert replace_pii(df.limit(0), key="k").count() == 0


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With one byte of choice for octets many of 150 addresses collide at first."""
    monkeypatch.setattr(pii, "_octets", lambda digest: F.concat(F.lit("10.0.0."), pii._byte(digest, F.lit(0)).cast("string")))
    rows = [(k, f"see 172.16.{k}.1 and again 172.16.{k}.1") for k in range(120)]
    out = replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), key="k").collect()
    made = {}
    for r in out:
        a, b = re.findall(r"10\.0\.0\.\d+", r.text)
        assert a == b
        made[r.doc_id] = a
    assert len(set(made.values())) == 120


def test_kinds_and_plan(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("1.2.3.4",), ("a@b.co",), ("123-45-6789",)], "e string")
    got = [(r.k, r.ok) for r in df.select(kind_of(F.col("e")).alias("k"), is_entity(F.col("e")).alias("ok")).collect()]
    assert got == [("card", True), ("card", False), ("ipv4", True), ("email", True), ("ssn", True)]
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id int, text string")
    plan = docs.select(pii.parts_of(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = replace_pii(docs, key="k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hint_covers_every_pattern(spark):
    """A text whose only entity is one of these is not passed over; spellings with spaces are one account."""
    rows = [
        ("email", "a@b.co"), ("secret", "ab12" * 8), ("secret", "AB" * 16), ("secret", "a1" * 32), ("ipv4", "1.2.3.4"), ("ssn", "123-45-6789"), ("card", "4111 1111 1111 1111"),
        ("phone", "+33 1 23 45 67 89"), ("phone", "+49 30 12 34 56 78"), ("phone", "+1 (12) 34-56-78"), ("phone", "+1 23 45"), ("phone", "(555) 123-4567"), ("phone", "555.123.4567"),
        ("iban", "XX12ABCDEFGHIJK"), ("iban", "DE89370400440532013000"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB29 NWBK 6016 1331 9268 19"), ("iban", "BE68 5390 0754 7034"),
        *[("name", f"{t} Gibt") for t in pii.MALE + pii.FEMALE + pii.NEUTRAL], ("name", "Dr.\u00a0Gibt"),
    ]
    df = spark.createDataFrame([(i, k, e, f"so {e} BIC") for i, (k, e) in enumerate(rows)], "doc_id int, kind string, e string, text string")
    out = replace_pii(df, key="k").withColumn("found", pii.entities_of(F.col("e"))).withColumn("as", kind_of(F.col("e"))).orderBy("doc_id").collect()
    assert [(r.found, r["as"]) for r in out if r.kind != "name"] == [([e], k) for k, e in rows if k != "name"]
    assert all(r.n_entities == 1 and r.e not in r.text and r.text.endswith(" BIC" if r.kind != "name" else "") for r in out)
    made = {r.e: r.text[3:-4] for r in out if r.kind == "iban"}
    assert made["DE89 3704 0044 0532 0130 00"].replace(" ", "") == made["DE89370400440532013000"]
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", made["DE89 3704 0044 0532 0130 00"])
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", made["GB29 NWBK 6016 1331 9268 19"])


def test_surnames_stay_where_given_names_collide(spark):
    """More given names than the list has, with one surname; the surname alone is the same."""
    given = [f"{a}{b}" for a in ("Bo", "Ca", "Du", "Fi", "Go") for b in ("bo", "ca", "du", "fi", "go", "ha")]
    texts = ["Mr. Smith", *[f"Mr. {g} Smith" for g in given], "г-н Петров", *[f"г-н {a}{b} Петров" for a in ("Ба", "Ва", "Га", "Да") for b in ("ба", "ва", "га")]]
    out = [r.text for r in replace_pii(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), key="k").orderBy("doc_id").collect()]
    assert len(set(out)) == len(texts) and not set(out) & set(texts)
    for script, made in (("latin", out[:31]), ("cyrillic", out[31:])):
        assert len({m.split()[-1] for m in made}) == 1
        assert all(m.split()[1].split("-")[0] in pii.GIVEN[script, "m"] for m in made[1:])


def test_formats_with_too_few_values(spark, monkeypatch):
    """All 1000 numbers of a form are in use: each still gets one of its own, which is none of them."""
    monkeypatch.setattr(pii, "DRAWS", 1, raising=False)
    rows = [(k, f"+1 {k:03d}") for k in range(1000)]
    out = {r.text for r in replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), key="k").collect()}
    assert len(out) == 1000 and not out & {t for _, t in rows} and all(re.fullmatch(r"\+1 \d{4,}", t) for t in out)


def test_short_addresses_and_names_in_bulk(spark):
    """Short formats run out of values, and very many given names share few surnames: nothing raises, nothing is lost."""
    rows = [(k, f"{chr(97 + k // 26 % 26)}{k // 676 or ''}@{chr(97 + k % 26)}.co") for k in range(400)]
    out = [r.text for r in replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), key="k").collect()]
    assert len(set(out)) == 400 and not set(out) & {t for _, t in rows} and all(re.fullmatch(r"[a-z0-9]+@[a-z]\.co", t) for t in out)
    given = [f"{a}{b}" for a in ("Bo", "Ca", "Du", "Fi", "Go", "Ha") for b in ("bo", "ca", "du")]
    texts = [f"Mr. {g} Smith met Mr. Smith and Mrs. {g} Jones, not Smith." for g in given]
    for t in (r.text for r in replace_pii(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), key="k").collect()):
        m = re.fullmatch(r"Mr\. (\S+) (\S+) met Mr\. (\S+) and Mrs\. (\S+) (\S+), not Smith\.", t)
        assert m and m[2] == m[3] != m[5]


def test_against_brute_force(spark):
    """Every document rebuilt in Python: the same entities found by a Python search, each replaced by the one surrogate of its normal form."""
    import regex

    pattern = regex.compile("|".join(f"(?:{p})" for p in pii.PATTERNS.values()).replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9000 + k, t) for k, t in enumerate(["a@b.co,c@d.co a@b.co", "x\ufdd0y a@b.co\ufdd0 and 1.2.3.4", "\ufdd0", "(555) 123-4567(555) 123-4567", "Mr. Bo Smith, Dr. Smith; mr. smith", "4111111111111111 4111111111111112"])]
    out = {r.doc_id: r.text for r in replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), key="k").collect()}

    def is_card(e):
        return re.fullmatch(pii.PATTERNS["card"], e) is not None

    surrogate, seen = {}, 0
    for i, text in rows:
        if text is None:
            assert out[i] is None
            continue
        spots = [m for m in pattern.finditer(text) if not (is_card(m[0]) and not luhn(m[0]))]
        ends = [0, *[m.end() for m in spots]]
        gaps = [text[a:z] for a, z in zip(ends, [*[m.start() for m in spots], len(text)], strict=True)]
        # A surrogate has no line end, and spaces only where the entity has some; names and octets differ in length.
        shape = [r"([^\n]+?)" if re.search(r"\s", m[0]) else r"(\S+?)" if re.fullmatch(r"[\d.]+", m[0]) else rf"(\S{{{len(m[0])}}})" for m in spots]
        whole = re.fullmatch("".join(re.escape(g) + s for g, s in zip(gaps, [*shape, ""], strict=True)), out[i])
        assert whole, (text, out[i])
        for m, made in zip(spots, whole.groups(), strict=True):
            assert surrogate.setdefault(m[0], made) == made != m[0]
            seen += 1
    lower = {k.lower(): v.lower() for k, v in surrogate.items()}
    assert seen > 20 and len(set(lower.values())) == len(lower) and not set(lower) & set(lower.values())


#: A hundred thousand repeats of what each pattern's loops match.
HOSTILE = ["x@" + "a." * 100_000, "x@" + "ab-c." * 100_000 + "com", "a" * 100_000 + "@b.co", "Dr. " * 100_000 + "Smith", "Mr. " + "Ab " * 100_000, "Herr " + "von " * 100_000 + "Berg", "+1" + " 23" * 100_000,
           "4111 " * 100_000, "DE89" + " 3704" * 100_000, "ab12" * 100_000, "1." * 100_000, "123-" * 100_000, "Mr. A" + "b-" * 100_000, "(555) " * 100_000]


def test_hostile_texts_end_no_executor(spark):
    df = spark.createDataFrame([*enumerate(HOSTILE)], "doc_id int, text string")
    out = replace_pii(df, key="k").collect()
    assert len(out) == len(HOSTILE) and all(r.text for r in out)


def test_names_with_titles_particles_and_more_given_names(spark):
    texts = ["Frau Dr. Anna Schmidt ging", "Mr. John Paul Smith left", "Herr von Berg kam", "Herr Prof. Dr. Karl van der Meer", "Dr. John Smith and Mr. John Smith", "Dr. Smith", "Dr. Pat Jones, Mr. Pat Jones, Mrs. Pat Jones", "г-жа Анна Мария Иванова"]
    out = [r.text for r in replace_pii(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), key="k").orderBy("doc_id").collect()]
    latin = lambda g: f"(?:{'|'.join(pii.GIVEN['latin', g])})(?:-[A-Z][a-z]+)?"
    assert re.fullmatch(rf"Frau Dr\. {latin('f')} ([A-Z][a-z]+) ging", out[0]) and "Schmidt" not in out[0]
    m = re.fullmatch(rf"Mr\. {latin('m')} {latin('m')} ([A-Z][a-z]+) left", out[1])
    assert m and m[1] != "Smith" and not {"John", "Paul"} & set(out[1].split())
    assert re.fullmatch(r"Herr von [A-Z][a-z]+ kam", out[2]) and "Berg" not in out[2]
    assert re.fullmatch(rf"Herr Prof\. Dr\. {latin('m')} van der [A-Z][a-z]+", out[3]) and "Meer" not in out[3]
    a, b = out[4].split(" and ")
    assert a.removeprefix("Dr. ") == b.removeprefix("Mr. ") and a.split()[-1] == out[5].split()[-1] == m[1]
    # Both a Mr. and a Mrs. Pat Jones: Dr. Pat Jones stays a third.
    n, h, s = (x.split(" ", 1)[1] for x in out[6].split(", "))
    assert len({n, h, s}) == 3
    assert re.fullmatch(r"г-жа [А-Яа-я-]+ [А-Яа-я-]+ [А-Я][а-я]+ова", out[7]) and "Иванова" not in out[7]


def test_account_numbers_keep_their_check(spark):
    rows = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"]
    for r in replace_pii(spark.createDataFrame([*enumerate(rows)], "doc_id int, text string"), key="k").collect():
        code = r.text.replace(" ", "")
        assert code not in "".join(rows) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
