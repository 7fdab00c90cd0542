import random
import re

from pagewright.llm.leaks import Codes, chain, coded, find_leaks, windows

ITEM = "The grey sailor from Osdolo described his gloomy rail pass under dust. Above the harbour wall, 53 forgotten gulls mended our thermos along a whitewashed weir with wet hands, so Victor's tin clock mocked quince jam twice."
FILL = "We paid nothing at the ferry and then it rained for days on end. Nobody minded at all in the evening. "


def judged(doc, item):
    """What chain() says of the windows that two texts share."""
    codes = Codes()
    a, b = coded(item, codes), coded(doc, codes)
    short = (len(a),) if len(a) < 5 else ()
    known = {}
    for p, h, _ in zip(*windows(a, short)):
        known.setdefault(int(h), []).append(int(p))
    padded = b.tolist() + [-1] * 5
    hits = {(p, int(at), tuple(padded[at : at + 5])) for at, h, _ in zip(*windows(b, short)) for p in known.get(int(h), [])}
    return chain(a, [*hits])


def share(doc, item=ITEM):
    return judged(doc, item)[0]


def test_alterations_do_not_matter():
    for doc in (
        FILL + ITEM + FILL,
        ITEM.upper(),
        ITEM.replace(" gloomy", " <i>gloomy</i>").replace("weir", "**weir**").replace("'", "&#39;"),
        ITEM.replace("sailor", "sai​lor").replace(" ", "  ").replace(",", ""),
        "\n".join(ITEM.split()),
    ):
        assert share(doc) > 0.95


def test_replaced_words_inserted_sentences_and_halves():
    rng = random.Random(3)
    words = ITEM.split()
    for k in rng.sample(range(1, len(words) - 1), 4):
        words[k] = "later"
    assert share(" ".join(words)) > 0.8
    cut = ITEM.index("Above")
    assert share(ITEM[:cut] + FILL + ITEM[cut:]) > 0.95
    assert share(" ".join(ITEM.split()[: int(len(ITEM.split()) * 0.6)]) + " " + FILL) >= 0.5
    assert share(FILL + " ".join(ITEM.split()[:12]) + " " + FILL) < 0.5
    assert share("") == share(FILL) == 0


def test_every_fifth_word_replaced():
    words = ITEM.split()
    words[4::5] = ["later"] * len(words[4::5])
    assert 0.75 < share(FILL + " ".join(words) + " " + FILL) < 0.85


def test_short_items_and_scripts_without_blanks():
    assert share("We saw the blue heron today.", "blue heron") == 1.0 and share("We saw the heron", "blue heron") == 0
    han = "我们在山谷里走了很久。"
    assert share("昨天" + han + "然后下雨了", han) == 1.0 and share("昨天下雨了我们在家", han) < 0.5


def test_long_tags_and_accents():
    assert share(ITEM.replace(" gloomy", " <i class='" + "x" * 200 + "'>gloomy</i>")) > 0.95


def test_rows(spark):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short to be found in all of this")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, FILL + ITEM, 0), (1, FILL + ITEM, 0), (2, "", 0), (3, None, 0), (4, FILL * 500, 0)], "doc_id bigint, text string, item_id bigint")
    rows = find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 1)]
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


SLOTTED = "On the road to Osdolo old Victor paid 53 coins for a lamp, and the baker said that Victor had walked 12 miles from Osdolo with 53 coins in a tin."


def test_new_names_numbers_and_units_fill_slots():
    changed = SLOTTED.replace("Osdolo", "Bergen").replace("Victor", "Henrik").replace("53", "71").replace("12", "9041").replace("miles", "km")
    held, alike, steady = judged(FILL + changed + FILL, SLOTTED)
    assert held < 0.8 and alike > 0.9 and steady
    # one slot filled by two new numbers, or two new names
    assert not judged(changed.replace("71 coins in", "88 coins in"), SLOTTED)[2]
    assert not judged(changed.replace("that Henrik", "that Stefan"), SLOTTED)[2]


def test_template_alone_is_found_and_a_clash_refused(spark):
    item = "On Monday Victor gave 53 coins to Clara of Osdolo, then Anna sold 12 lamps to Victor near Osdolo and 53 bags to Elif."
    turned = {"Monday": "Friday", "Victor": "Henrik", "Clara": "Marta", "Anna": "Petra", "Elif": "Boris", "Osdolo": "Bergen", "53": "7", "12": "64"}
    new = re.sub(r"\w+", lambda m: turned.get(m[0], m[0]), item)
    clash = new.replace("to Henrik near Bergen and 7", "to Stefan near Cadiz and 8")
    docs = spark.createDataFrame([(1, FILL + new + FILL), (2, FILL + clash + FILL)], "doc_id bigint, text string")
    rows = find_leaks(docs, "doc_id", "text", spark.createDataFrame([(7, item)], "item_id bigint, text string"), "item_id", "text").collect()
    assert [(r.doc_id, r.held < 0.6, r.template_held > 0.8, r.slots_consistent) for r in rows if r.slots_consistent or r.doc_id == 1] == [(1, True, True, True)]


def test_hot_windows_and_many_items(spark):
    # one stock phrase that all texts share, items that differ in one word each
    items = spark.createDataFrame([(k, f"{FILL} word{k} {ITEM}") for k in range(40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, FILL) for k in range(200)] + [(900, ITEM)], "doc_id bigint, text string")
    rows = find_leaks(docs, "doc_id", "text", items, "item_id", "text", salt=3).collect()
    assert {r.item_id for r in rows if r.doc_id == 900} == set(range(40))


def test_windows_do_not_reach_into_the_next_text(spark, monkeypatch):
    from pagewright.llm import leaks

    words = ITEM.split()
    parts = [" ".join(words[k : k + 3]) for k in range(0, len(words), 3)]
    docs = spark.createDataFrame([(k, p) for k, p in enumerate(parts)] + [(99, ITEM)], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, ITEM), (2, "wet hands so")], "item_id bigint, text string")
    for size in (1, 10, 1 << 18):
        monkeypatch.setattr(leaks, "TOGETHER", size)
        rows = find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(99, 1), (99, 2), (9, 2)}  # the ninth is "wet hands, so"
