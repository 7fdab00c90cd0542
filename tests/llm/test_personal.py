import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm.personal import collisions, find_mentions, mentions, redact, redacted, secret_of
from pagewright.llm.surrogates import GIVEN, canonical, gender, surrogate

CASES = [
    ("Write to priya_x@ferry.north.example.org now. ", [("email", "priya_x@ferry.north.example.org")]),
    ("Contact: osidze82 [at] ferry.north.example We ate", [("email", "osidze82 [at] ferry.north.example")]),
    ("the list (a.b (at) mail (dot) example)", [("email", "a.b (at) mail (dot) example")]),
    ("Tel. +49 (30) 23125-605 for", [("phone", "+49 (30) 23125-605")]),
    ("ring 0049 30 23125 989.", [("phone", "0049 30 23125 989")]),
    ("scribbled 201.555.0174 on, or 070-174 06 14, or (201) 555-0111", [("phone", "201.555.0174"), ("phone", "070-174 06 14"), ("phone", "(201) 555-0111")]),
    ("read 0185-64-9653-TD. On 2008-03-18 at 14:04. ISBN 000-2-4465-7052-7 was", []),
    ("they copied Passport 05 144 421 770 twice", [("id_number", "05 144 421 770")]),
    ("her tax number, CY9665171 and his national ID was 971 17 4698", [("id_number", "CY9665171"), ("id_number", "971 17 4698")]),
    ("Booking ref. TC6590848 got us the cabin", []),
    ("at 160 Saddler Square, under; Flat 3, via Linaro 123, top; 9b, rue du Vieux Puits; ul. Willowa 31; Amselstr. 28b; 201 heron street",
     [("address", "160 Saddler Square"), ("address", "via Linaro 123"), ("address", "9b, rue du Vieux Puits"), ("address", "ul. Willowa 31"), ("address", "Amselstr. 28b"), ("address", "201 heron street")]),
    ("at km 32.2 of the old road; St. Osmann Street was empty", []),
    ("Ask for Captain Peter Torpewick, Wexay, George or J. R. Margasen", [("name", "Peter Torpewick"), ("name", "Wexay, George"), ("name", "J. R. Margasen")]),
    ("GEORGE TORDOSEN met julia senlawick and Анна Дразенко and Nadia van der Velmilund", [("name", "GEORGE TORDOSEN"), ("name", "julia senlawick"), ("name", "Анна Дразенко"), ("name", "Nadia van der Velmilund")]),
    ("At the edge of Kolsen, Anna read. Dr. Kolay said Anna left.", []),
    ("", []),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_mentions(text, expected):
    assert [(k, text[a:b]) for a, b, k in find_mentions(text)] == expected


def test_surrogates_keep_format_gender_and_distinctness():
    out = {m: surrogate(m, "name", b"k") for m in ("Marta Kolay", "Marta Kolaz", "Nadia Kolay", "Анна Дразенко")}
    assert len(set(out.values())) == 4
    given = out["Marta Kolay"].split()[0]
    assert gender(given.split("-")[0]) == "f" and given.split("-")[0] in GIVEN and given == out["Marta Kolaz"].split()[0]
    everyone = [n for n in sorted(set(GIVEN))]
    assert len({surrogate(f"{n} Kolay", "name", b"k") for n in everyone}) == len(everyone)


def test_no_letter_of_the_value_stays_in_place():
    for said, kind in (("İ. Demiroğlu", "name"), ("Nuñez Łęcki", "name"), ("山田太郎", "name"), ("Ελένη Παπαδάκη", "name"), ("ss-12 445", "id_number"), ("q.x@mail.example", "email"), ("12 Öre Street", "address")):
        new = surrogate(said, kind, b"k")
        assert not [a for a, b in zip(said, new) if a.isalnum() and a == b], (said, new)
    assert surrogate("+49 30 1", "phone", b"k").startswith("+49 ") and surrogate("Marta", "name", b"k") != surrogate("Marta", "name", b"j")


def test_redacted_text_stays_readable():
    out = redact("We met Marta Kolay at noon.", b"k")
    assert out.startswith("We met [NAME ") and out.endswith("] at noon.") and "Kolay" not in out


def test_rows(spark):
    df = spark.createDataFrame([("a", "We met Marta Kolay.", 1), ("a", "We met Marta Kolay.", 1), ("b", "", 2), ("c", None, 3), ("d", "x" * 100000, 4)], "id string, text string, value int")
    rows = mentions(df, "id", "text").collect()
    assert [(r.id, r.pii_type, r.value) for r in rows] == [("a", "name", "martakolay")] * 2
    assert collisions(mentions(df, "id", "text", secret="k")).count() == 0
    assert {r.id: r.text for r in redacted(df, "id", "text").collect()}["c"] is None
    assert mentions(df.limit(0), "id", "text").count() == 0


def test_one_value_written_in_several_ways_has_one_surrogate(spark):
    def bare(mention, kind):
        return "".join(filter(str.isalnum, surrogate(mention, kind, b"k").lower()))

    assert bare("+16045550179", "phone") == bare("+1 604 555 0179", "phone") == bare("+1 (604) 555-0179", "phone")
    assert bare("0044 20 7946 0018", "phone")[2:] == bare("+44 2079460018", "phone") and bare("+49 (0)30 1234567", "phone").replace("490", "49", 1) == bare("+49 30 1234567", "phone")
    assert surrogate("a.b (at) mail (dot) example", "email", b"k").replace(" (at) ", "@").replace(" (dot) ", ".") == surrogate("a.b@mail.example", "email", b"k")
    assert bare("CY 966 5171", "id_number") == bare("CY9665171", "id_number")
    given, family = surrogate("Anna Kolay", "name", b"k").split()
    assert gender(given.split("-")[0]) == "f" and surrogate("Kolay, Anna", "name", b"k") == f"{family}, {given}"
    assert surrogate("A. Kolay", "name", b"k") == f"{given[0]}. {family}" and surrogate("ANNA  KOLAY", "name", b"k") == f"{given}  {family}".upper()
    assert canonical("Anna Kolay", "name") == canonical("Kolay, Anna", "name") != canonical("Kolay Anna", "name")
    df = spark.createDataFrame([(1, "Ring +16045550179 or +1 604 555 0179. Anna Kolay left, then Kolay, Anna came.")], "id int, text string")
    found = mentions(df, "id", "text", secret="k")
    assert found.count() == 4 and found.select("entity").distinct().count() == found.select("surrogate_entity").distinct().count() == 2
    assert collisions(found).count() == 0
    broken = found.withColumn("surrogate_entity", F.concat("surrogate_entity", "start_char"))
    assert collisions(broken).count() == 2


def test_any_family_name_after_a_known_given_name():
    for name in ("John Smith", "Anna Brown", "PETER KING", "Paul Simon"):
        assert [(k, a, b) for a, b, k in find_mentions(f"We met {name} at noon.")] == [("name", 7, 7 + len(name))]
    for text in ("We met Anna Monday at noon.", "We ate with Anna\nThen it rained.", "They saw Bill Stone.", "ANNA WE", "Anna Street"):
        assert not find_mentions(text)


def test_names_beyond_lists_by_what_stands_beside_them():
    for text, name in (
        ("Then Dr. Zorblat Quix came in.", "Zorblat Quix"), ("Bill Stone said no.", "Bill Stone"), ("We met Wei Zhang at noon.", "Wei Zhang"), ("we saw Wei Zhang", "Wei Zhang"),
        ("昨日山田太郎と会った", "山田太郎"), ("然后王小明先生来了", "王小明"),
    ):
        assert [text[a:b] for a, b, k in find_mentions(text) if k == "name"] == [name], text
    for text in ("We met Upper Zurlano", "They saw Glass Orangery", "高山很美", "Today Brown bread", "Port Smith said"):
        assert not find_mentions(text), text


def test_long_values_are_found_whole():
    box = "x" * 90 + "@mail.example"
    assert [(0, len(box), "email")] == find_mentions(box)
    street = "Calle de los " + "Altísimos " * 8 + "12"
    assert [street[a:b] for a, b, _ in find_mentions(street)] == [street]
    assert box[:20] not in redact(box, b"k")


def test_check_digits():
    found = lambda t: [t[a:b] for a, b, k in find_mentions(t) if k == "id_number"]
    assert found("12345678Z or X1234567L, 811218-9876 and 44051401359") == ["12345678Z", "X1234567L", "811218-9876", "44051401359"]
    assert found("12345678A or 811218-9875 and 44051401358") == []


def test_collisions_can_be_found(spark):
    rows = [(1, "name", "family a", "family x"), (2, "name", "family b", "family x"), (3, "name", "family c", "family y"), (4, "name", "family c", "family z"), (5, "phone", "1", "2")]
    found = collisions(spark.createDataFrame(rows, "id int, pii_type string, entity string, surrogate_entity string"))
    assert sorted((r.surrogate, r.n) for r in found.collect()) == [("family x", 2), ("family y", 2)]
    assert re.fullmatch("[0-9a-f]{64}", secret_of(spark))
