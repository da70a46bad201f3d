import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.llm.encoding import Ciphers, Language, Reader, learn_substitution, repair
from chatloom.llm import quality
from chatloom.llm.quality import STATISTICS, classify, find_thresholds, text_statistics

ES = ["Había {} personas en la estación y ninguna traía la lámpara", "¿Alguien sabe si el calendario sigue en el jardín?", "mañana hablamos después del almacén número {}", "qué risa, señor, así también aquí"]
RU = ["Нас было {} человек, и каждый хотел взять лампу", "Мне кажется, что расписание лучше искать на кухне", "спасибо большое, до завтра", "Они обещали вернуть зонтик через неделю"]


def table(spark, n=240):
    r = random.Random(3)
    rows, truth = [], {}
    for i in range(n):
        ru = i % 2 == 0
        text = r.choice(RU if ru else ES).format(r.randrange(900))
        damage = r.choice([None, None, None, "utf8", "cp437", "twice", "page"])
        bad = text
        if damage == "utf8":
            bad = text.encode().decode("latin-1")
        elif damage == "cp437":
            bad = text.encode().decode("cp437")
        elif damage == "twice":
            bad = text.encode().decode("latin-1").encode().decode("latin-1")
        elif damage == "page" and ru:
            bad = text.encode("koi8_r").decode("cp1251")
        if bad != text:
            truth[i] = text
        rows.append((i, "ru" if ru else "es", None if i % 50 == 7 else "plain ascii", bad))
    return spark.createDataFrame(rows, "rec_id bigint, chat_id string, sender_name string, content string"), truth


def test_repair_finds_and_restores(spark):
    d, truth = table(spark)
    chats = spark.createDataFrame([("ru", "ru"), ("es", None)], "chat_id string, lang string")
    got = {r["rec_id"]: r["restored"] for r in repair(d.withColumn("source", F.lit("s")), chats).collect()}
    assert set(got) == set(truth)
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    assert repair(d.limit(0), chats).count() == 0


def test_correct_texts_stay(spark):
    fine = ["Ð and Þ are letters too", "Â propos, la page", "SÃO ELES OU NÃO?", "├── a\n│   └── été", "Ñandú Ürümq Ÿ Œ №5", "façade, naïve", "größenwahn", "", None, "x" * 50_000 + "é", "Модель РСТ-1756 и СТО РС"]
    d, _ = table(spark)
    more = spark.createDataFrame([(1000 + i, "es", None, t) for i, t in enumerate(fine)], d.schema)
    chats = spark.createDataFrame([("ru", "ru"), ("es", "es")], "chat_id string, lang string")
    assert repair(d.unionByName(more), chats).where("rec_id >= 1000").count() == 0


def test_lost_bytes_are_found(spark):
    d, _ = table(spark)
    more = spark.createDataFrame([(1000, "es", None, "HabÃ a 3 personas"), (1001, "es", None, "nubeâ��gris"), (1002, "ru", None, "Ð�Ð°Ñ�"), (2**62 + 1, "ru", None, "Ð�Ð°Ñ�"), (None, "es", "x", None), (None, None, "cafÃ©", "")], d.schema)
    chats = spark.createDataFrame([("ru", "ru"), ("es", "es")], "chat_id string, lang string")
    found = repair(d.unionByName(more), chats).where("coalesce(rec_id, 1000) >= 1000").collect()
    assert {(r["rec_id"], r["field"]) for r in found} == {(1000, "content"), (1001, "content"), (1002, "content"), (2**62 + 1, "content"), (None, "sender_name")}


def test_swaps_take_words_of_one_changed_letter_along():
    pairs = Counter()
    for t in [*RU, *ES, "Но я не уверен, я сам с лампой", "Тогда к вечеру, и я там", "qué más da, está allí"]:
        Language.count(t.format(7), pairs, 300.0)
    reader = Reader(Language(pairs), {}, {})
    for text, true, read in (
        ("Нас было 7 человек, и каждый хотел взять лампу", "cp1251", "cp1252"),
        ("я сам хотел взять расписание, и я не уверен", "koi8_r", "cp1251"),
        ("¿Alguien sabe si también hay una lámpara en la estación?", "cp1252", "cp437"),
        ("mañana hablamos después, señor, así también aquí", "mac_roman", "cp1252"),
        ("Había 3 personas en la estación y ninguna traía la lámpara", "cp850", "mac_roman"),
    ):
        bad = text.encode(true).decode(read)
        assert reader.repair(bad, "s")[0] == text
        assert reader.repair(text, "s") == (text, "")
    half = "Нас было 7 человек. " + "и каждый хотел взять лампу".encode("koi8_r").decode("cp1251")
    assert reader.repair(half, "s")[0] == "Нас было 7 человек. и каждый хотел взять лампу"
    for fine in ("Jag är på ön, så går det", "£5, 20° ± 2 µm", "façade, naïve, œuvre"):
        assert reader.repair(fine, "s") == (fine, "")


def test_ciphers_invert_themselves():
    c = Ciphers()
    text = "Привет, señor — “ça va”? 🐌"
    for page in ("cp437", "cp850", "mac_roman"):
        assert c.utf8(page, text.encode().decode(page)) == text
    assert c.swapped("привет".encode("koi8_r").decode("cp1251"))["koi8_r>cp1251"] == "привет"
    assert Language({}).score("abc") < 0 and not c.any_symbol("plain")


WORDS = "the of and to a in that is was it for on be with as i you at this have".split()


def documents():
    r = random.Random(9)
    noun = "lantern kettle ladder parcel archive umbrella calendar projector notebook harbour".split()
    prose = lambda: " ".join(f"I moved the {r.choice(noun)} to the {r.choice(noun)} before noon, so that it was easy for you." for _ in range(r.randrange(3, 9)))
    listed = lambda: "\n".join(f"{r.choice(['- ', '* ', '1. ', ''])}{r.choice(noun)} {r.choice(noun)}" for _ in range(r.randrange(8, 30)))
    tabled = lambda: "\n".join(["id,item,count"] + [f"{r.randrange(999)},{r.choice(noun)},{r.randrange(99)}" for _ in range(r.randrange(8, 30))])
    junk = lambda: r.choice(["?????\n-----\n....." * 5, "FREE STICKERS " * 20, "".join(r.choice("aqwsdfghjkl0123456789") for _ in range(300)), "~!@#$%^&* " * 20])
    return [(k, f()) for k, f in (("prose", prose), ("list", listed), ("table", tabled), ("junk", junk)) for _ in range(60 if k == "prose" else 20)]


def typed(spark, docs, share=4, **options):
    """Kinds of documents when one in *share* is labelled, and how many of the others are right."""
    d = spark.createDataFrame([(i, t, "EN " if i % 3 else None, "x") for i, (_, t) in enumerate(docs)], "doc_id bigint, text string, lang string, kind string")
    common = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    labels = spark.createDataFrame([(i, k if i % 7 else None) for i, (k, _) in enumerate(docs) if i % share == 0] + [(10**6, "prose"), (None, "list")], "doc_id bigint, kind string")
    got = {r["doc_id"]: r["kind"] for r in classify(d, common, labels, **options).collect()}
    rest = [i for i in range(len(docs)) if i % share]
    return got, sum(got[i] == docs[i][0] for i in rest) / len(rest)


def test_types_of_unlabelled_documents(spark):
    docs = documents() * 2
    got, right = typed(spark, docs)
    assert len(got) == len(docs) and right >= 0.95
    assert typed(spark, docs, rounds=0)[1] <= right


def test_types_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    common = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    none = spark.createDataFrame([], "doc_id bigint, kind string")
    assert {r["kind"] for r in classify(d, common, none).collect()} == {"prose"}
    assert classify(d.limit(0), common.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "list"), (2, "junk")], "doc_id bigint, kind string")
    assert classify(d, common, some).count() == 2
    assert find_thresholds(text_statistics(d, common), some, most=1).n == 1


def test_patterns_stay_linear(spark):
    """Long tokens, words and lines cost what they are long: no pattern of the statistics runs away."""
    n = 100_000
    texts = ["link: " + "x" * n + " one two three four five six seven eight", "x" * n, "1" * n, "a " * n, "- " * n, "a|" * n, ("a" * 40 + ",") * (n // 40), "\t" * n, "." * n, "é" * n, ("a:" + " b" * 9 + "\n") * (n // 20), "Ã" * n, "[ ] " * n, "a" * 30 + ": " + "b" * n]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    import time

    text_statistics(d.limit(1), common).collect()
    began = time.time()
    assert len(text_statistics(d, common).collect()) == len(texts)
    assert time.time() - began < 40


def test_statistics(spark):
    text = "The cat is on a mat.\nIt was fun!\n\nno end"
    d = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "", None), (4, "the\n" * 30_000, "en"), (5, "the of le", "xx")], "doc_id bigint, text string, lang string")
    common = spark.createDataFrame([("en", w) for w in WORDS] + [("fr", "le")], "lang string, word string")
    r = {x["doc_id"]: x for x in text_statistics(d, common).collect()}
    assert r[1]["word_count"] == 11 and abs(r[1]["mean_word_length"] - 27 / 11) < 1e-9 and abs(r[1]["punctuated_lines"] - 2 / 3) < 1e-9
    assert abs(r[1]["common_words"] - 6 / 11) < 1e-9 and abs(r[1]["symbol_ratio"] - 2 / len(text)) < 1e-9
    assert r[2]["word_count"] == 0 and r[2]["mean_word_length"] is None and r[3]["symbol_ratio"] is None
    assert r[4]["word_count"] == 30_000 and r[4]["common_words"] == 1.0 and r[5]["common_words"] == 1.0
    assert set(STATISTICS) <= set(text_statistics(d, common).columns)
    with pytest.raises(ValueError):
        quality.MOST_WORDS, most = 3, quality.MOST_WORDS
        try:
            text_statistics(d, common)
        finally:
            quality.MOST_WORDS = most


def test_an_unknown_page_is_learnt_from_bigrams_alone():
    """A page that no table holds: every letter is swapped for another character, and only texts under the swap are given."""
    r = random.Random(4)
    words = "нас было человек каждый хотел взять лампу мне кажется что расписание лучше искать на кухне спасибо большое до завтра они обещали вернуть зонтик через неделю тогда к вечеру там и не уверен".split()
    text = lambda: " ".join(r.choice(words) for _ in range(7))
    known: Counter = Counter()
    for _ in range(3000):
        Language.count(text(), known)
    letters = sorted({c for w in words for c in w})
    shuffled = letters[7:] + letters[:7]
    swap = str.maketrans(dict(zip(letters, [chr(0x3B1 + i) for i in range(len(shuffled))])))
    pairs: Counter = Counter()
    hidden = [text() for _ in range(200)]
    for t in hidden:
        for w in t.translate(swap).split():
            for x, y in zip(" " + w, w + " "):
                pairs[x + y] += 1
    table = learn_substitution(pairs, known)
    got = [t.translate(swap).translate(table) for t in hidden]
    assert sum(a == b for g, t in zip(got, hidden) for a, b in zip(g, t)) >= 0.95 * sum(map(len, hidden))
    assert learn_substitution({}, known) == {} and learn_substitution(pairs, {}) == {}
    reader = Reader(Language(known), {}, {}, {"s": {"learnt1": table}})
    assert reader.repair(hidden[0].translate(swap), "s")[0] == hidden[0].translate(swap).translate(table)


def test_layers_and_pages_are_taken_off_one_after_the_other():
    pairs = Counter()
    for t in [*RU, *ES]:
        Language.count(t.format(7), pairs, 300.0)
    reader = Reader(Language(pairs), {}, {})
    text = ES[0].format(3)
    for n in range(1, 6):
        bad = text
        for _ in range(n):
            bad = bad.encode().decode("latin-1")
        assert reader.repair(bad, "s")[0] == text
    twice = RU[0].format(3).encode("koi8_r").decode("cp1251").encode().decode("latin-1")
    assert reader.repair(twice, "s")[0] == RU[0].format(3)


def test_symbols_without_their_other_bytes(spark):
    d, _ = table(spark)
    bad = ["nubeâ  gris", "el mismo. â reallyâ¦", "reallyâ ¦"]
    fine = ["É isso aí ã, õ, â, ê: 12 sinais", "la pâte, l'âge", "voilâ", "âge"]
    more = spark.createDataFrame([(1000 + i, "es", None, t) for i, t in enumerate([*bad, *fine])], d.schema)
    chats = spark.createDataFrame([("ru", "ru"), ("es", "es")], "chat_id string, lang string")
    assert {r["rec_id"] for r in repair(d.unionByName(more), chats).where("rec_id >= 1000").collect()} == {1000, 1001, 1002}
