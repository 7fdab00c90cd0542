import itertools

import numpy as np
import pytest

from pagewright.llm import pairs
from pagewright.llm.pairs import clauses, defect, defects, is_empty, language, train

Q = "Where did we eat quince jam near Nerlo?"
SOUND = [
    ("Where did we eat rice near Halo?", "We ate rice with bread at the mill, according to the entry of 2010-02-03. It was late when we left."),
    ("Who sang at the mill in Tamno?", "The cook sang until the mill went dark (2011-05-06), and we had walked for hours. Yes, 2012-01-02"),
    ("Did we ever visit the tower at Lonna?", "Yes, 2019-04-05"),
    ("What was quiet about the weir?", "The journals do not give the name, but on 2013-07-08 we watched the fog roll over the weir."),
    ("Wo haben wir in Tamno geschlafen?", "Wir haben in der Mühle geschlafen und es war kalt. Der Weg war lang."),
    ("Wie war das Wetter in Halo?", "Es war nass, und wir haben den Bus nicht mehr gesehen."),
    ("Où avons-nous dormi à Nerlo ?", "Nous avons dormi dans la gare, et le car est parti trop tôt."),
]
REFUSALS = [("Who sang in Halo?", "I can't find that in the journals."), ("Who sang in Halo?", "There is no mention of this in the excerpts.")]
FIELD = train((SOUND + REFUSALS) * 12)

CASES = [
    (None, "empty"), ("", "empty"), (" ​", "empty"), ("N/A", "empty"), ("<p></p>", "empty"), ("Answer:", "empty"), ("…", "empty"),
    ("We ate it on 2010-02-03. Then the bus to Halo left early and", "truncated"),
    ("We ate quince jam with bre", "truncated"),
    ('The entry of 2010-02-03 says "we ate quince jam', "truncated"),
    ("I can't find that in the journals.", "refusal"),
    ("i cant find that in the journals", "refusal"),
    ("There is no mention of this. The closest entry is 2010-02-03, which is about something else.", "refusal"),
    ("I can’t find that in the journals. You could search for the place instead.", "refusal"), ("That is not in the journals.", "refusal"),
    (Q, "copy"), ("You asked: " + Q, "copy"), ("¡Qué noche tan fría en Rilsk!", "language"), ("„Ist es noch weit bis Nerlo?“, fragte Julia den Fährmann.", "language"), ("Q: " + Q.upper(), "copy"), (f"Question: {Q}\nAnswer: {Q}", "copy"),
    ("Wir haben in der Mühle gegessen, und es war kalt.", "language"),
    ("我们在磨坊吃了果酱。", "language"),
    ("Yes, 2010-02-03", None), ("2010-02-03.", None),
    ("The card you copied reads “Halt! Nicht dort!”, and on 2010-02-03 we ate quince jam.", None),
    ("The journals do not give the name, but on 2013-07-08 we ate quince jam with bread.", None),
]


@pytest.mark.parametrize("answer, expected", CASES)
def test_defect(answer, expected):
    assert defect(Q, answer, False, FIELD) == expected


def test_refusing_what_never_happened_is_sound():
    assert defect(Q, "I can't find that in the journals.", True, FIELD) is None
    assert defect(Q, Q, True, FIELD) == "copy"


def test_parts():
    assert clauses("One. Two!\n\n- Three (x) four") == ["One.", "Two!", "- Three (x) four"]
    assert language("Où avons-nous dormi à Nerlo") == "fr" and language("...") is None and is_empty("```\n```")


def test_rows(spark):
    rows = [(k, q, a, False, "x") for k, (q, a) in enumerate((SOUND + REFUSALS) * 3)]
    rows += [(100, Q, None, None, "x"), (100, Q, None, None, "x"), (101, None, "It was late when we left. We ate.", None, "x"), (102, Q, "word " * 20000 + ".", False, "x")]
    df = spark.createDataFrame(rows, "gen_id bigint, question string, answer string, absent boolean, defect string")
    found = [(r.gen_id, r.defect) for r in defects(df, "gen_id").collect()]
    assert found.count((100, "empty")) == 2 and (7, "refusal") in found and not [f for f in found if f[0] == 0]
    assert defects(df.limit(0), "gen_id").count() == 0


def test_the_field_decides_beyond_the_patterns():
    field = train((SOUND + REFUSALS) * 100)
    for answer, expected in (
        ("That information isn't available to me.", "refusal"), ("I have no way of telling.", "refusal"), ("The pages are silent on that.", "refusal"),
        ("Vi gik ned til møllen og spiste frokost ved vandet, og det regnede hele dagen.", "language"),
        ("We ate it at the mill.", None), ("No.", None), ("Nobody sang, and nothing was open on 2010-02-03.", None),
    ):
        assert defect(Q, answer, False, field) == expected, answer


GERMAN = [
    (f"Wo haben wir {meal} {place} gegessen und {what} gesehen?", f"Wir haben {meal} {place} gegessen, und {what} war {how}. Danach sind wir {where} gegangen.")
    for meal, place, what, how, where in itertools.product(
        ("Brot", "Suppe", "Käse", "Pflaumen", "Fisch"), ("in der Mühle", "am Bahnhof", "auf dem Schiff", "hinter der Kirche"), ("das Wehr", "der Turm", "die Fähre", "ein Hund"),
        ("kalt", "still", "verschlossen", "freundlich", "nass"), ("nach Hause", "zum Fluss", "über die Brücke", "in die Stadt", "durch den Wald"),
    )
]
ENGLISH = [
    (f"Where did we eat {meal} near the {place} {k}?", f"We ate {meal} at the {place} with {who}, and it was {how}. It was late when we left number {k}.")
    for k, (meal, place, who, how) in enumerate(itertools.product(
        ("rice", "bread", "soup", "jam", "plums", "cheese"), ("mill", "tower", "weir", "station", "chapel", "library", "harbour"), ("the cook", "a ferryman", "Alice", "my cousin", "nobody", "two cyclists"),
        ("cold", "quiet", "crowded", "cheerful", "closed", "foggy", "wet", "worth it"),
    ))
]
FOREIGN = "Cheerful cousin ate cheese near crowded harbour, foggy library felt worth visiting."


def test_pairs_of_greatest_hash_count_too(spark):
    """What tells of German stands only in rows that no bounded choice of 1,500 by least hash reaches."""
    german = spark.createDataFrame(GERMAN, "question string, answer string").selectExpr("*", "xxhash64(question, answer) AS h").orderBy("h").collect()[-300:]
    english = spark.createDataFrame(ENGLISH, "question string, answer string").selectExpr("*", "xxhash64(question, answer) AS h").collect()
    assert sum(r.h < german[0].h for r in english) > 1500
    rows = [(k, r.question, r.answer, False) for k, r in enumerate([*german, *english])]
    rows += [(-3, q, a, True) for q, _ in GERMAN[:60] for a in ("Dazu finde ich keine Angaben.", "Ich kann nichts dazu finden.", "Dazu steht nichts in den Tagebüchern.")]
    rows += [(-1, GERMAN[0][0], FOREIGN, False), (-2, *GERMAN[0], False)]
    found = [(r.gen_id, r.defect) for r in defects(spark.createDataFrame(rows, "gen_id bigint, question string, answer string, absent boolean"), "gen_id").collect()]
    assert found == [(-1, "language")]


def test_the_field_is_that_of_all_pairs(spark, monkeypatch):
    """Blocks, parts, order and copies change nothing; a row of marks alone is no pair."""
    some = [*ENGLISH[:300], *GERMAN[::25], *REFUSALS, *SOUND, (Q, "℀")]
    df = spark.createDataFrame(some, "question string, answer string")
    one = pairs._fitted(df)
    assert all(w in one.tables.words for k in range(300) for w in (str(k),))
    monkeypatch.setattr(pairs, "HELD", 100)
    two = pairs._fitted(df.union(df).orderBy("answer").repartition(7))
    assert one.tables.words == two.tables.words and one.tables.grams == two.tables.grams and one.tables.usual == two.tables.usual
    assert np.allclose(one.unary, two.unary, atol=1e-4) and np.allclose(one.pair, two.pair, atol=1e-4)
    # no direction in which the likelihood of all examples rises
    known = sorted((q, a, pairs.kind_of(q, a)) for q, a in set(some))
    rows = pairs.examples([p for p in known if p[2]], 0, one.tables, pairs.Counts((*k, n) for k, n in pairs.count(known).items()).asked)
    total = sum(pairs.slope(*row, one.unary, one.pair) for row in rows)
    assert np.abs(total[2:] / total[0] + pairs.DECAY * np.concatenate([one.unary.ravel(), one.pair.ravel()])).max() < 2 * pairs.SLOPE


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    x, y, weight = rng.normal(size=(4, 3, 2)), rng.integers(0, 5, (4, 3)), np.array([1.0, 2, 1, 3])
    unary, pair = rng.normal(size=(2, 5)), rng.normal(size=(5, 5))
    own, loss = pairs.slope(x, y, weight, unary, pair)[2:], lambda u, p: pairs.slope(x, y, weight, u, p)[1]
    for k in range(35):
        step = np.zeros(35)
        step[k] = 1e-5
        up, down = (loss(unary + way * step[:10].reshape(2, 5), pair + way * step[10:].reshape(5, 5)) for way in (1, -1))
        assert abs((up - down) / 2e-5 - own[k]) < 1e-4
