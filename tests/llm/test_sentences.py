import random
import time

import numpy as np
import pytest

from weftline.llm.sentences import PAD, fires, sentence_units, stepped, transduce, unit_ends


def split(text):
    units, at = [], 0
    for end in unit_ends([text])[0]:
        units.append(text[at:end].strip())
        at = end
    return units


CASES = [
    ["The new rack is in the U.S.", "The window opens at 9 p.m.", "3 jobs died.", "Ask Quorvex Inc. about the U.K. mirror."],
    ["Dr. Wexforth and J. T. Quellmar agree.", "Use fewer (e.g. 5) and wait.", "Mrs. Ost vs. the queue, round 9."],
    ["My boss (a Ph.D. in queues!) shrugged.", "(This only happens on Mondays.)", "Is it 2:30 a.m. or p.m.?", "Really?!", "I opened manifest.log."],
    ["“Why does it skip the second step?” she asked.", "He wrote \"It broke. Again.\" and left.", "He said \"Ship it.\"", "“Works for me.”", "Nope!!"],
    ["Wait... that is old.", "I waited...", "It just stops…", "Well… maybe."],
    ["See https://a.example/t?id=4.", "We run v2.9.2.", "It took 39.13.", "Compare fig. 5 with sec. 16.7 of it, cf. p. 9."],
    ["Am 3. Oktober lief alles.", "Der Zähler steht bei 3.", "Die 2. Stufe fehlt!", "„Starte neu. Dann warte.“ war alles.", "Er meinte: „Das ist normal.“", "Wir prüften Hooks usw.", "Das gilt z. B. bei fünf."],
    ["Il répond : « Attends. »", "Merci beaucoup !", "Elle a écrit « Ça casse. Encore. » avant.", "M. Roche paie env. 9 euros, c.-à-d. rien."],
    ["¡¿Quién cambió a.py?!", "Vive en la Avda. Corvane, n.º 84.", "La Dra. Sol mira la pág. 5, etc.", "Dijo: «No toques nada.»", "Ya van 6."],
    ["Это было 12.03.2031 г. ночью.", "По словам г. Рогова, предел равен 8,5 с.", "Мы проверили всё и т. д.", "Проф. Ли ждёт, т. е. спит.", "Ну… может быть."],
    ["Ο κ. Νικος είπε 9,9 δευτ. ανά γύρο.", "Το είδε κανείς άλλος;", "Έγραψε «Χάλασε. Πάλι.» και έφυγε."],
    ["قال د. علي إن المهلة 72.43 ثانية.", "سألت «أي واحد؟» ولم يجب أحد.", "من غير الملف a.yaml؟!"],
    ["डॉ. राव ने कहा कि सीमा 76.63 है।", "उसने कहा, “फिर से चलाओ। लॉग देखो।” और चला गया।", "धन्यवाद!"],
    ["คุณ Ann บอกว่าให้รอก่อน", "ลองเริ่มใหม่ 6 ครั้งแล้ว", "ขอบคุณมากค่ะ"],
]


@pytest.mark.parametrize("units", CASES, ids=lambda u: u[0][:20])
def test_units(units):
    assert split(" ".join(units)) == units
    assert split("> 1. " + "\r\n- ".join(units)) == ["> 1. " + units[0], *["- " + u for u in units[1:]]]


def test_scripts_without_spaces():
    zh = ["他说：“先重启队列。再看日志。”然后就下线了。", "“谁改了配置？”她问。", "太慢了！！", "（只有星期一才会这样。）", "日志在http://a.example/t?id=4这个页面。"]
    ja = ["「なぜ？」と聞いた。", "「再起動して。ログも見て。」と言われた。", "遅すぎる！！"]
    assert split("".join(zh)) == zh and split("".join(ja)) == ja
    en = ["It broke.", "Thanks, that helped!", "Did it hang at 20:05?", "He said \"Ship it.\"", "The end."]
    assert split("".join(en)) == en


def test_lines():
    assert unit_ends(["a\n\n  \n bb. cc\r\n>\n-- \n"]) == [[1, 10, 13, 16, 19]]
    assert unit_ends([None, "", " \n ", "x  "]) == [[], [], [], [1]]
    assert unit_ends(["never “closed. Next one. And"]) == [unit_ends(["never  closed. Next one. And"])[0]]


def test_chunks_compose_to_the_plain_walk():
    """Also where marks nest deeper than the transducer's states go."""
    pick = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 5000):
        classes = pick.integers(0, PAD, size).astype(np.int16)
        stack, want = (), []
        for c in classes.tolist():
            want.append(fires(stack, c))
            stack = stepped(stack, c)
        for chunk in (1, 7, 64):
            assert transduce(classes, chunk).tolist() == want


HELD_OUT = [
    ["Gov. Smith met Sgt. Lee near Bldg. 5 today.", "Then they left."],
    ["We thank Adm. Grace Hopper for it.", "She agreed."],
    ["Supt. Chalmers spoke.", "Nobody heard."],
    ["Il Sig. Rossi è arrivato.", "Poi è partito."],
    ["To np. Nowak, Kowalski itd. oraz inni.", "Koniec."],
    ["Falei com a Exma. Ana ontem.", "Gostei."],
    ["Dhr. Jansen belt morgen.", "Hij komt bijv. om 9 uur."],
    ["Use npm.", "Then use ssh.", "Read the html."],
    ["Hmm.", "It took 5 km.", "We ran."],
    ["The ratio is 3.5 to 1.", "See sec. 4 of it, please!", "Is Msgr. Brown in?"],
    ["He said (quoting “the «old [rule „No. Never.“ applies. Here.] now. So» there. Yes” again. Ok) nothing.", "Fine."],
]


@pytest.mark.parametrize("units", HELD_OUT, ids=lambda u: u[0][:20])
def test_lines_that_are_not_of_the_tables(units):
    assert split(" ".join(units)) == units


def test_one_line_costs_what_many_do():
    sentences = [u for case in CASES[:6] for u in case if '"' not in u and "“" not in u] * 1500
    took = []
    for glue in ("\n", " "):
        text = glue.join(sentences)
        began = time.perf_counter()
        ends = unit_ends([text])[0]
        took.append(time.perf_counter() - began)
        assert len(ends) == len(sentences)
    assert took[1] < 2 * took[0] + 0.1
    # A word of any length is read whole: here it is not the abbreviation its end looks like.
    assert split("x" * 100_000 + "dr. Now it ends.") == ["x" * 100_000 + "dr.", "Now it ends."]


def test_long_text_without_line_breaks():
    pick = random.Random(6)
    sentences = [pick.choice([u for case in CASES[:6] for u in case if not u.startswith("(")]) for _ in range(4000)]
    assert split(" ".join(sentences)) == sentences


def test_long_texts_in_pieces(monkeypatch):
    pick = random.Random(8)
    lines = [" ".join(pick.choice(CASES)) for _ in range(300)]
    texts = ["\r\n".join(lines), None, "\n".join(lines[:50]) + "\n\n", " ".join(lines[:40]), ""]
    whole = unit_ends(texts)
    for size in (50, 999, 5000):
        monkeypatch.setattr("weftline.llm.sentences.CHUNK_CHARS", size)
        assert unit_ends(texts) == whole


def test_table(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Ab cd. Ef.", 1), (3, "Ab cd. Ef.", 1), (None, "x", 1)], "doc_id BIGINT, text STRING, end_char INT")
    got = sorted(((r.doc_id, r.end_char) for r in sentence_units(df).collect()), key=str)
    assert got == sorted([(3, 6), (3, 10), (3, 6), (3, 10), (None, 1)], key=str)
    assert sentence_units(df.limit(0)).count() == 0
