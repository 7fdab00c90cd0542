import random

from pagewright.llm.sentences import Model, fitted, sentences, spans_of_marks, split_sentences

STARTS = ["We walked to the mill.", "Dr. Kolay came at 18:30 p.m. today.", "The hut is approx. 3.5 km away.", "Then it rained.", "Is it far?", "They ate bread, jam, etc. at noon.", "We left with Dr. Marov."]
ZH = ["我们到了云溪渡。", "“天晚了。回去吧。”船夫说。", "老人问：“远吗？”", "晚饭是鱼汤。"]
TH = ["เราเดินทางถึงเกาะตอนเช้า", "ฝนตกที่เกาะนาน", "ตลาดคนแน่นมาก"]


def corpus(n=400):
    rng = random.Random(5)
    out = []
    for _ in range(n):
        out.append("\n\n".join(" ".join(rng.choices(STARTS, k=4)) for _ in range(3)))
        out.append("\n\n".join("".join(rng.choices(ZH, k=4)) for _ in range(2)))
        out.append(" ".join(rng.choices(TH, k=4)))
    return out


MODEL = Model(iter(corpus()))


def cut(text):
    return [text[a:b] for a, b in split_sentences(text, MODEL)]


def test_abbreviations_decimals_and_wraps():
    assert cut("We walked to the mill. The hut is approx. 3.5 km away. We left\nwith Dr. Marov. Then it rained.") == [
        "We walked to the mill.", "The hut is approx. 3.5 km away.", "We left\nwith Dr. Marov.", "Then it rained.",
    ]


def test_quotations_brackets_and_other_scripts():
    assert cut('"Stop! Not there!" shouted the cook. We walked (closed, they said! Really.) to the mill.') == [
        '"Stop! Not there!" shouted the cook.', "We walked (closed, they said! Really.) to the mill.",
    ]
    assert cut("我们到了云溪渡。“天晚了。回去吧。”船夫说。晚饭是鱼汤。") == ["我们到了云溪渡。", "“天晚了。回去吧。”船夫说。", "晚饭是鱼汤。"]
    assert cut("ฝนตกที่เกาะนาน ตลาดคนแน่นมาก") == ["ฝนตกที่เกาะนาน", "ตลาดคนแน่นมาก"]


def test_blank_lines_end_and_nothing_is_left_over():
    assert cut("Jan. 4, 1998\n\n1. Bread\n \t\n2. Jam") == ["Jan. 4, 1998", "1. Bread", "2. Jam"]
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["We ", "Dr. ", "。", "“", "”", "(", ")", "\n", "\n\n", ". ", "x", "？", "... ", "'", " ก ", "A.B "]) for _ in range(60))
        spans = split_sentences(text, MODEL)
        at = 0
        for a, b in spans:
            assert a < b and text[a:b].strip() == text[a:b] and not text[at:a].strip()
            at = b
        assert not text[at:].strip()


def test_marks():
    assert spans_of_marks("a “b “c” d ( e") == [(5, 7)]
    assert spans_of_marks("„x“ «y»") == [(0, 2), (4, 6)]


def test_rows(spark):
    long = "We walked to the mill. " * 3000
    df = spark.createDataFrame([(1, "We walked. Then it rained.", 1), (1, "We walked. Then it rained.", 1), (2, "", 1), (3, None, 1), (4, " \n ", 1), (5, long, 1)], "doc_id bigint, text string, start_char int")
    rows = sentences(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1, 5} and sum(r.doc_id == 1 for r in rows) in (2, 4)
    assert sentences(df.limit(0), "doc_id", "text").count() == 0


def test_all_texts_are_counted(spark):
    texts = corpus(2000)
    assert len(texts) > 3000
    whole = Model(iter(texts))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    model = fitted(df, "text")
    assert model.seen == whole.seen and model.final == whole.final and model.starts == whole.starts and model.lasts == whole.lasts
    assert model.n_starts == whole.n_starts and abs(model.n_words - whole.n_words) < 1e-6 * whole.n_words
    assert all(abs(model.before[k] - v) < 1e-9 for k, v in whole.before.items())


def test_long_quotations_and_unclosed_marks():
    said = "We walked to the mill. Then it rained. " * 40
    for a, b in ("“”", "()", '""', "«»"):
        whole = f"They said {a}{said.strip()}{b} to the cook."
        assert len(said) > 1500 and cut(whole + " Then it rained.") == [whole, "Then it rained."]
    assert len(cut("They said “" + said.strip())) == len(cut("They said " + said.strip())) == 80
    # an unclosed mark ends with its paragraph
    assert cut("They said “We walked to the mill. Then it rained.\n\nThen it rained.” We walked to the mill.")[:2] == ["They said “We walked to the mill.", "Then it rained."]


def test_paragraphs_without_marks_have_hidden_boundaries():
    plain = [t.strip(".?").lower() for t in ("We walked to the mill", "Then it rained", "They ate bread jam etc at noon", "Is it far", "We walked to the mill", "Then it rained", "We walked to the mill")]
    got = cut(" ".join(plain))
    assert sum(g in plain for g in got) >= 5 and " ".join(got) == " ".join(plain)
    bare = "我们到了云溪渡晚饭是鱼汤我们到了云溪渡晚饭是鱼汤我们到了云溪渡"
    assert cut(bare) == ["我们到了云溪渡", "晚饭是鱼汤", "我们到了云溪渡", "晚饭是鱼汤", "我们到了云溪渡"]
    # a heading is short, and stays whole
    assert cut("a walk to the old mill and back") == ["a walk to the old mill and back"]


def test_marks_of_other_scripts():
    assert cut("Նա եկավ։ Մենք գնացինք։") == ["Նա եկավ։", "Մենք գնացինք։"]
    assert cut("እሱ መጣ። እኛ ሄድን።") == ["እሱ መጣ።", "እኛ ሄድን።"]
    assert cut("သူလာသည်။ငါတို့သွားသည်။") == ["သူလာသည်။", "ငါတို့သွားသည်။"]
