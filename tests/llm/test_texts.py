import random

import pytest

from lumidex.llm import scanned_text
from lumidex.llm.encoding import cheapest, cost, restore, restore_texts
from lumidex.llm.scanned_text import find_noise, misread_words, repair, word_counts
from lumidex.llm.sentences import split_sentences
from lumidex.llm.text_quality import not_prose, text_kind, text_statistics

COMMON = ["the", "of", "and", "to", "in", "a", "is", "was", "der", "die", "das", "le", "la"]


def sentences(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, parts string")
    rows = split_sentences(df, "id", "text").orderBy("id", "position").collect()
    out = [[] for _ in texts]
    for r in rows:
        assert texts[r.id][r.start : r.end] == r.sentence
        out[r.id].append(r.sentence)
    return out


def test_sentences(spark):
    cases = {
        "Mr. Smith paid 3.5 euros. See Fig. 2 and v1.2.txt. J. R. Doe left!": ["Mr. Smith paid 3.5 euros.", "See Fig. 2 and v1.2.txt.", "J. R. Doe left!"],
        "“Stop! It is late!” said Ann. She left... and came back. \"Is it?\" asked Tom.": ["“Stop! It is late!” said Ann.", "She left... and came back.", "\"Is it?\" asked Tom."],
        "He said, \"It works.\" Then (it was late.) Good": ["He said, \"It works.\"", "Then (it was late.)", "Good"],
        "Title of It\n\nOne line\nruns on. Two.\n\n- first item\n- second item.\n1. third": ["Title of It", "One line\nruns on.", "Two.", "- first item", "- second item.", "1. third"],
        "1. First thing.\n2. Second": ["1. First thing.", "2. Second"],
        "Das ist z. B. so, ca. 4,5 kg. Am 8. Mai kam er usw. bei Prof. Abel. Ende": ["Das ist z. B. so, ca. 4,5 kg.", "Am 8. Mai kam er usw. bei Prof. Abel.", "Ende"],
        "« Où est-il? » – dit M. Ader. ¿Qué tal? Bien.": ["« Où est-il? » – dit M. Ader.", "¿Qué tal?", "Bien."],
        "他说“好了吗？”就走了。明天来！好": ["他说“好了吗？”就走了。", "明天来！", "好"],
        "彼は「急げ。鍵がない。」と言った。次。": ["彼は「急げ。鍵がない。」と言った。", "次。"],
        "คนสวนปิดกุญแจ ผู้ตรวจนับได้ 26 แผ่นแล้ว": ["คนสวนปิดกุญแจ", "ผู้ตรวจนับได้ 26 แผ่นแล้ว"],
        "वह कल आया। डॉ. Rao गए?  हाँ": ["वह कल आया।", "डॉ. Rao गए?", "हाँ"],
        "Πού είναι; Εδώ. Ναι": ["Πού είναι;", "Εδώ.", "Ναι"],
        "Он пришёл в 18 г. Мастер ушёл и т. д. до ночи. См. стр. 5.": ["Он пришёл в 18 г.", "Мастер ушёл и т. д. до ночи.", "См. стр. 5."],
        "no marks at all": ["no marks at all"],
        " \r\n\r\n lone \r\n\r\n": ["lone"],
    }
    got = sentences(spark, *cases)
    assert got == [v for v in cases.values()]


def test_sentences_edge(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (None, "A. b"), (3, "x\ue000\ue001 y. Z")], "id long, text string")
    rows = split_sentences(df, "id", "text").collect()
    assert sorted((str(r.id), r.start, r.end) for r in rows) == [("3", 0, 6), ("3", 7, 8), ("None", 0, 4)]
    assert split_sentences(df.limit(0), "id", "text").count() == 0
    long = "One more sentence here. " * 3000
    assert split_sentences(spark.createDataFrame([(1, long)], "id long, text string"), "id", "text").count() == 3000


def test_long_quotations_items_and_many_sentences(spark):
    said = "“" + "It was late. " * 60 + "We left.” said Ann."
    item = "1. " + "word " * 200 + "end.\n2. Next"
    got = sentences(spark, said, item, 'He said "' + "One. Two. " * 80 + 'Three." and left. Then')
    assert got[0] == [said] and got[1] == [item.split("\n")[0], "2. Next"]
    assert [x[:7] for x in got[2]] == ['He said', "Then"]


WORDS = {
    "fr": "L'élève a réparé la façade à côté du théâtre. Déjà, le gérant a présenté le modèle précédent.",
    "de": "Die Prüferin überarbeitete das Gemüse gemäß der Vorschrift. Schließlich löschte der Käufer die Größenangaben.",
    "pl": "Urząd przeniósł półkę przed południem. Mężczyzna zamknął żółtą teczkę wśród dokumentów.",
    "tr": "Şirket ağustosta günlüğü değiştirdi. Öğrenci öğle yemeğini çevirdi, bahçıvan ışığı açtı.",
    "ru": "Библиотекарь разложил чертёж после собрания. Сначала, студент нашёл письмо у окна.",
    "el": "Η ομάδα τύπωσε το γράμμα παρά το κρύο. Χθες, ο γείτονας μέτρησε τον λογαριασμό.",
    "ja": "担当者は午後に請求書を修理した。また、館長は第五号室で棚を確認した。",
    "zh": "技术员在办公室删除了照片。档案员星期一说明了信件，学生关上了目录。",
    "en": "“They would rather keep the pedal” – at the café… for £100.",
}


@pytest.mark.parametrize("lang,written,read", [(lang, "utf-8", r) for lang in WORDS for r in ("latin-1", "cp437")] + [("fr", "utf-8", "cp850"), ("de", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("pl", "cp1250", "latin-1"), ("tr", "cp1254", "latin-1"), ("fr", "cp850", "cp1252"), ("el", "cp1253", "latin-1"), ("zh", "gbk", "latin-1"), ("ja", "euc_jp", "latin-1")])
def test_garbled_round_trip(lang, written, read):
    text = WORDS[lang]
    raw = text.encode(written, "ignore")
    garbled = raw.decode(read, "ignore")
    restored, n = restore(garbled)
    assert n > 0
    if written == "utf-8":
        assert restored == text
    assert restore(text) == (text, 0)


def test_garbled_cases(spark):
    double = WORDS["de"].encode().decode("latin-1").encode().decode("latin-1")
    assert restore(double) == (WORDS["de"], restore(double)[1])
    assert restore("caf&eacute; and \\u00e9t\\u00e9")[0] == "café and été"
    assert cheapest("plain")[0][0] == "plain" and cost("plain") == 0
    rows = [(1, "plain text"), (2, None), (3, "lossy M�ller"), (4, "clean café"), (5, WORDS["fr"].encode().decode("latin-1")), (5, WORDS["fr"].encode().decode("latin-1")), (6, ""), (7, "■□ ▯¤ 12 ◊")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, passages int")
    got = {r.id: r.restored for r in restore_texts(df, "id", "text").collect()}
    assert got == {3: "lossy M�ller", 5: WORDS["fr"]} and restore_texts(df, "id", "text").count() == 2
    assert restore_texts(df.limit(0), "id", "text").count() == 0
    long = ("word " * 50 + WORDS["fr"].encode().decode("latin-1") + " ") * 100
    assert restore(long)[0].count("théâtre") == 100


def test_kinds(spark):
    rng = random.Random(1)
    prose = "The owner of the house was glad to see that the garden is in order. " * 4
    mash = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzae") for _ in range(7)) for _ in range(60))
    texts = {
        1: (prose, "prose"),
        2: ("\n".join(f"- heavy item {w}" for w in "abcdefgh"), "list"),
        3: ("Things to do:\n" + "\n\n".join(f"{i}. Check the {w}." for i, w in enumerate("alpha beta gamma delta epsilon".split(), 1)), "list"),
        4: ("Name | Amount | Date\n" + "\n".join(f"Item{i} | {i * 7} | 2024-01-0{i}" for i in range(1, 8)), "table"),
        5: ("\n".join(f"2024-01-0{i};{i};text{i};n/a" for i in range(1, 8)), "table"),
        6: ("\n".join(f"{'cell' + 'x' * i:<18}{i * 31:<12}{'note':<10}" for i in range(1, 8)), "table"),
        7: (mash, "junk"),
        8: ("AbC9" * 60, "junk"),
        9: ("Same line 12\n" * 20, "junk"),
        10: ("a bare prose line without any marks was the end of it and the start of a new one in the house " * 2, "prose"),
        11: ("31 ■□ 5577 ▯¤ 9 " * 10, "junk"),
        12: (prose + "\n- one\n- two\n- three", "prose"),
        13: (None, None),
        14: (" \n ", None),
    }
    rows = [(i, t, "x") for i, (t, _) in texts.items()] + [(1, prose, "x"), (None, prose, "x")]
    df = spark.createDataFrame(rows, "id long, text string, lines string")
    got = {r.id: r.kind for r in text_statistics(df, "id", "text", COMMON).withColumn("kind", text_kind()).collect()}
    assert got == {i: k for i, (_, k) in texts.items() if k}
    assert {(r.id, r.kind) for r in not_prose(df, "id", "text", COMMON).collect()} == {(i, k) for i, (_, k) in texts.items() if k not in (None, "prose")}
    assert not_prose(df.limit(0), "id", "text", COMMON).count() == 0


def test_each_signal_of_layout_decides(spark):
    """Records that only the period of their indentation or of their line lengths gives away, and a table that only the alignment of its cells does."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abdegilmnorstu") for _ in range(n))
    line = lambda *sizes: " ".join(word(k) for k in sizes)
    indented = "\n".join(("    " if i % 3 else "") + line(6, 5, 7, 6, 5, 8, 4) for i in range(18))
    lengths = "\n".join(line(*([7, 8, 6, 7, 8, 9, 8, 7, 6] if i % 2 else [6, 7, 5])) for i in range(20))
    flat = "\n".join(line(6, 5, 7, 6, 5, 8, 4) for i in range(18))
    table = "\n".join(f"{word(4)} {word(3):<9}{word(5)} {word(4)} {word(3):<12}{word(6)} {word(5)}" for i in range(9))
    loose = "\n".join(f"{word(4)} {word(rng.randint(2, 9))}  {word(5)} {word(4)} {word(rng.randint(2, 9))}  {word(6)} {word(5)}" for i in range(9))
    df = spark.createDataFrame([(1, indented), (2, lengths), (3, flat), (4, table), (5, loose)], "id long, text string")
    got = {r.id: r for r in text_statistics(df, "id", "text", COMMON).withColumn("kind", text_kind()).collect()}
    assert {i: r.kind for i, r in got.items()} == {1: "list", 2: "list", 3: "prose", 4: "table", 5: "prose"}
    assert got[1].indent_period >= 1 > got[1].length_period and got[2].length_period >= 1 > got[2].indent_period
    assert got[4].aligned_share >= 0.6 > got[5].aligned_share and got[4].delimiter_share == got[5].delimiter_share == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "One two, three.\nFour five six"), (2, "x" * 200_000)], "id long, text string")
    r = {x.id: x for x in text_statistics(df, "id", "text", ["two", "six"]).collect()}
    assert (r[1].n_words, r[1].n_lines, r[1].terminal_line_share) == (6, 2, 0.5)
    assert r[1].common_word_share == pytest.approx(2 / 6) and r[1].mean_word_length == pytest.approx(22 / 6)
    assert r[2].mean_word_length == 200_000


PAGES = """The owner counted the heavy baskets in the gar-
den and the visitor photographed every single well-

Town Record, Vol. 17

known picture. Nobody had exp1ained the reason to
— 12 —
the visitor, who t h o u g h t that the garden was old¬
er than the house. The ownor said nothing at all and

TOWN RECORD, VOL. 17

counted the heavy baskets again.

A second paragraph of the visitor begins here, see p.
13.
The garden waited."""


def corpus(spark):
    base = "The owner explained the reason and the visitor thought that the garden was older. A well-known picture of the garden. "
    rows = [(100 + i, base * 2) for i in range(80)]
    rows += [(1, PAGES), (1, PAGES), (2, None), (3, " "), (None, PAGES), (4, "The visitor saw the gar\xad den and the expl¬ ained reason."), (5, "- item\n12\n- item two\n13")]
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "id long, text string, line string")


def test_noise_of_scans(spark):
    df = corpus(spark)
    got = {(r.id, r.noise) for r in find_noise(df, "id", "text").collect()}
    assert got == {(1, "hyphen"), (1, "misread"), (1, "header"), (1, "pageno"), (4, "hyphen")}
    assert find_noise(df.limit(0), "id", "text").count() == 0
    counts = word_counts(df.select("id", "text").where("text is not null"))
    assert {r.word: r.form for r in misread_words(counts).collect()}["exp1ained"] == "explained"


def test_forms_are_chosen_by_context(spark):
    base = [(i, "we open the file today and lay one tile there") for i in range(60)] + [(60 + i, "open the file today") for i in range(20)]
    df = spark.createDataFrame(base + [(200, "lay one fi1e there"), (201, "open the fi1e today")], "id long, text string")
    got = {r.id: r.text for r in repair(df, "id", "text").collect()}
    assert got == {200: "lay one tile there", 201: "open the file today"}


def test_misreadings_that_come_often_are_found(spark):
    rows = [(i, "we met the group today") for i in range(300)] + [(1000 + i, f"we met the gr0up {i}") for i in range(9)]
    got = {(r.id, r.noise) for r in find_noise(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(1000 + i, "misread") for i in range(9)}


def test_forms_that_are_not_broadcast_count(spark, monkeypatch):
    monkeypatch.setattr(scanned_text, "FREQUENT", 1)
    test_forms_are_chosen_by_context(spark)


def test_scans_are_repaired(spark):
    got = {r.id: r.text for r in repair(corpus(spark), "id", "text").collect()}
    assert set(got) == {1, 4}
    assert got[4] == "The visitor saw the garden and the explained reason."
    assert "in the garden and" in got[1] and "well-known picture" in got[1] and "explained the reason to the visitor, who thought that" in got[1]
    assert "older than" in got[1] and "Town" not in got[1] and "12" not in got[1] and "13." in got[1]
    assert got[1].count("\n\n") == 1
