import random
import re

import pytest

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm import pii
from vespertide.llm.pii import documents_with_mentions, entities, op1_pii, replace_entities, settled

TEXTS = [
    "write to Bo.Li7@Mail.example.com or bo.li7@mail.example.com, call +1 (743) 555-3824 or +1 743-555-3824.",
    "card 4111111111111111 also 4111-1111-1111-1111 from 10.1.2.3, not 1.2.3 or 10.1.2.3.4 or v4.5",
    "Mr. John Smith met Mrs. Jane Smith. Later Mr. Smith left. Frau Müller und Herr Müller. Г-н Иванов",
    "ssn 123-45-6789; again bo.li7@mail.example.com",
    "nothing here: 4111111111111112 or 9807915762804490, 12 apples, 2024-01-02, Mr, a@b",
]


def made_of(name, script, ends):
    parts = pii.SYLLABLES[script]
    return re.fullmatch(f"({'|'.join(parts['start'])})({'|'.join(parts['mid'])})+({'|'.join(parts[ends])})", name) is not None


def replaced(spark, *texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in replace_entities(docs, key).orderBy("doc_id").collect()]


def test_names_keep_format_script_gender_and_coreference(spark):
    a, b, c, d, e, f = replaced(
        spark,
        "Mr. Jean-Luc Picard spoke. Picard left, then Jean-Luc; PICARDS stay. Ms. O'Brien and Mr. McDonald came.",
        "Dr. Maria Lopez met Mrs. Maria Lopez. Ms. Maria Lopez said so.",
        "Dr. Γιώργος Παππάς και Δρ. Prof. Анна Иванова",
        "Señora María José García Márquez, later Señora García. Mr. JOHN SMITH",
        "Picard is no name here. Mr. Smith was.",
        "call +1 415 555 1234 or (415) 555-1234 or 415-555-1234",
    )
    m = re.fullmatch(r"Mr\. (\w+)-(\w+) (\w+) spoke\. (\w+) left, then (\w+)-(\w+); PICARDS stay\. Ms\. (\w+) and Mr\. (\w+) came\.", a)
    assert m and m[3] == m[4] and (m[1], m[2]) == (m[5], m[6]) and "Brien" not in a and "McDonald" not in a
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Ms\. (\w+) (\w+) said so\.", b)
    assert m and m[1] == m[3] == m[5] and m[2] == m[4] == m[6] and made_of(m[1], "latin", "f")
    m = re.fullmatch(r"Dr\. (\w+) (\w+) και Δρ\. Prof\. (\w+) (\w+)", c)
    assert m and made_of(m[1], "greek", "m") and made_of(m[2], "greek", "s") and made_of(m[3], "cyrillic", "m") and made_of(m[4], "cyrillic", "sf")
    m = re.fullmatch(r"Señora (\w+) (\w+) (\w+) (\w+), later Señora (\w+)\. Mr\. ([A-Z]+) ([A-Z]+)", d)
    assert m and m[3] == m[5] and not {"María", "José", "García", "Márquez", "JOHN", "SMITH"} & set(m.groups())
    # A word that is a name elsewhere is none where no mention says so; one entity has one surrogate in all documents.
    assert e.startswith("Picard is no name here.") and e.split("Mr. ")[1].split(" ")[0].upper() == m[7]
    digits = [re.sub(r"\D", "", x)[-10:] for x in re.split(" or ", f.removeprefix("call "))]
    assert len(set(digits)) == 1 and digits[0] != "4155551234" and re.fullmatch(r"call \+1 \d{3} \d{3} \d{4} or \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", f)


def test_accounts_and_addresses(spark):
    (a,) = replaced(spark, "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000, not DE89 3704 0044 0532 0130 01; host 2001:DB8:0:0:8:800:200C:417A or fe80::1ff:fe23:4567:890a at 12:30:45 x::y")
    m = re.fullmatch(r"pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20}), not DE89 3704 0044 0532 0130 01; host ([0-9A-F:]+) or ([0-9a-f:]+) at 12:30:45 x::y", a)
    assert m and m[1].replace(" ", "") == m[2] != "DE89370400440532013000"
    assert int("".join(str(int(c, 36)) for c in m[2][4:] + m[2][:4])) % 97 == 1
    assert m[3].startswith("2001:DB8:") and m[3].count(":") == 7 and m[4].startswith("2001:db8::")


def test_replacement_matches_brute_force(spark):
    """Surrogates put into the texts by a plain pass over the mentions, from the settled table."""
    rng = random.Random(6)
    first, last = ["Ann", "Bob", "Cid", "Dee", "Eve"], ["Stone", "Rivers", "Fields", "Woods"]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice([f"{rng.choice(['Mr.', 'Ms.', 'Dr.'])} {rng.choice(first)} {rng.choice(last)}", f"Mr. {rng.choice(last)}", rng.choice(last), f"u{rng.randint(0, 9)}@x.org", f"10.0.0.{rng.randint(1, 9)}", "plain words"]))
        texts.append(", ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = entities(documents_with_mentions(docs))
    table = {(r["kind"], r["canonical"]): r["surrogate"] for r in settled(real.select("kind", "canonical", "variant"), "k", pii.syllables_for(real)).collect()}
    assert len(set(table.values())) == len(table) and not {s for s in table.values()} & {c for _, c in table}
    want = []
    for t in texts:
        named = {w for m in re.findall(r"(?:Mr|Ms|Dr)\. (\w+(?: \w+)?)", t) for w in m.split(" ")}
        t = re.sub(r"\w+@x\.org", lambda m: table["email", m.group()], t)
        t = re.sub(r"10\.0\.0\.\d", lambda m: table["ip", m.group()], t)
        want.append(re.sub(r"[A-Z]\w+", lambda m: table["name", m.group().lower()].capitalize() if m.group() in named else m.group(), t))
    assert replaced(spark, *texts) == want
    with pytest.raises(ValueError):
        replace_entities(docs, "")


def test_surrogates(spark):
    docs = odd_documents(spark, TEXTS)
    out = {r["doc_id"]: r for r in replace_entities(docs, "k").collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    base = 10
    assert all(out[i]["text"] == before[i] and out[i]["__vt_n_entities"] == 0 for i in [*range(base), base + 4])
    a, b, c, d = (out[base + i]["text"] for i in range(4))
    mails = re.findall(r"[\w.]+@[\w.]+", a)
    assert len(mails) == 2 and mails[0] == mails[1] and mails[0] in d and "li7" not in a.lower()
    phones = re.search(r"\+1 \((\d{3})\) 555-(\d{4}) or \+1 (\d{3})-555-(\d{4})\.", a)
    assert phones and phones[1] == phones[3] and phones[2] == phones[4] and "3824" not in a
    cards = re.search(r"card (4\d{15}) also ([\d-]{19}) from 10\.\d+\.\d+\.\d+, not 1\.2\.3 or 10\.1\.2\.3\.4", b)
    assert cards and cards[2].replace("-", "") == cards[1] != "4111111111111111"
    assert sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(cards[1]))) % 10 == 0
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Later Mr\. (\w+) left\. Frau (\w+) und Herr (\w+)\. Г-н (\w+)", c)
    assert names and made_of(names[1], "latin", "m") and made_of(names[3], "latin", "f") and made_of(names[8], "cyrillic", "s")
    assert names[2] == names[4] == names[5] != "Smith" and names[6] == names[7] != "Müller" and names[8] != "Иванов"
    assert re.match(r"ssn 9\d\d-\d\d-\d{4};", d)


def test_distinct_entities_keep_apart(spark):
    rows = [(i, f"Mr. {chr(65 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}n Smith x{i}@m.example") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = settled(entities(documents_with_mentions(docs)), "k", 1)
    found = done.collect()
    real = {(r["kind"], r["canonical"]) for r in found}
    assert len(found) == 900 + 900 + 1
    assert len({(r["kind"], r["surrogate"]) for r in found}) == len(found)
    assert not real & {(r["kind"], r["surrogate"]) for r in found}
    assert any(r["attempt"] > 0 for r in settled(entities(documents_with_mentions(docs)), "k", 0).collect())
    texts = [r["text"] for r in replace_entities(docs, "k").collect()]
    assert len({t.split(" Smith")[0] for t in texts}) == 900 and len({t.split(" ")[1] for t in texts}) == 900
    assert {r["text"] for r in replace_entities(docs, "k").collect()} == set(texts)
    assert {r["text"] for r in replace_entities(docs, "other").collect()} != set(texts)


def test_full_number_spaces_are_settled(spark):
    """All numbers of a form are real: surrogates get further digits, and none is that of a real one."""
    rows = [("phone", f"{i:03d}", "") for i in range(1000)] + [("phone", f"12{i:03d}", "") for i in range(600)]
    real = spark.createDataFrame(rows, "kind string, canonical string, variant string")
    found = [r["surrogate"] for r in settled(real, "k").collect()]
    assert len(found) == len(set(found)) == 1600 and not set(found) & {c for _, c, _ in rows}
    assert all(len(x) > 3 for x in found)


def test_numbers_of_one_prefix_end(spark):
    texts = replaced(spark, *[f"call +1 2{i // 100} {i % 100:02d}" for i in range(600)])
    numbers = [re.fullmatch(r"call \+\d \d\d (\d+)", t) for t in texts]
    assert all(numbers) and len(set(texts)) == 600 and not set(texts) & {f"call +1 2{i // 100} {i % 100:02d}" for i in range(600)}


def test_forms_of_address_in_capitals(spark):
    (a,) = replaced(spark, "MR. SMITH and MRS. JANE SMITH, DR. Jones")
    m = re.fullmatch(r"MR\. ([A-Z]+) and MRS\. ([A-Z]+) ([A-Z]+), DR\. ([A-Z]\w+)", a)
    assert m and m[1] == m[3] != "SMITH" and made_of(m[2].capitalize(), "latin", "f") and m[4] != "Jones"


def test_empty_table(spark, tmp_path):
    assert op1_pii(spark, write_tables(tmp_path / "a", documents=odd_documents(spark).limit(0))).count() == 0
