"""Garbled text: round trips through wrong encodings, and sound text that must be left alone."""

from __future__ import annotations

import pytest

from wickerlane.llm.mojibake import garbled, lost, repair

TEXTS = {
    "en": "It’s worth the price — the rust tone isn’t as bright as shown “softer than expected”, 30 °C.",
    "de": "Größe 45 fällt aus wie üblich, die Ärmel dürften länger sein. Über die Straße würde ich sie nicht tragen.",
    "fr": "Idéal pour l’été, où le maille piquée reste coupé à la perfection, voilà ce qu’on m’a répété.",
    "pl": "Na święta polecam, wełna z domieszką jest miękka. Po praniach sztruks nadal się trzyma, choć guziki są słabe.",
    "ru": "Доставили за 35 дня, упаковка целая, а кофта стоит своих денег.",
    "ja": "灰色のカーディガンは再生繊維で、着心地が良い。",
    "tr": "96 yıkamadan sonra bile pamuklu kumaş güzel, dikişleri düzgün.",
}
SOUND = [
    *TEXTS.values(), "A marca MAÇÃ® e a linha IRMÃ™ voltam em 75 dias.", "COLEÇÃO 55: macacão em linho, NÃO TORCER.", "Bug note: the export printed “Ã©” where “é” was meant; text here is fine.",
    "sheet Â-60, row Ã-86, annex Ð.", "Тест ёлка Ё№15 «цвет»", "Рёбра, Её, Сёмга", "Maße: 13×9 cm, Ø 28 mm, Åäö ÅÄÖ ÃO", "Price list: £9 · ¥42 · €37 · ±87 § ¶ † ™ ®", "„etwas zu groß“, sagte meine Tochter",
    "Ð and Þ stay on the Faroe label; â, î and ș on the Roma", "ÁO KHOÁC MÀU XÁM ĐÃ HẾT HÀNG", "Áo dài lụa mỏng, rất đẹp", "Rochie lungă, mâneci înguste, căptușeală fină", "Ολόκληρη η σειρά σε 26 χρώματα, πολύ άνετη.",
    "Size56​\xa0one\xa0size fits\xadall", "&Atilde;&copy; caf\\u00e9 &#233;", "★★★★☆ 👗🧥 love it 👍🏽", "ｶﾀｶﾅ サイズ", "plain ascii", "", "这件衣服很好，尺寸合适。", "한국어 문장입니다.", "Ticket 83: shop page shows â€™ instead of an apostrophe, see the log", "T恤和A款b都很好，眉毛", "联通公司的移动服务", "ПОДРОБНОСТИ И РАЗМЕР",
]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert repair(text) == (text, []) and not lost(text)


def windows(data: bytes) -> str:
    """As browsers read it: bytes that cp1252 leaves undefined become C1 controls."""
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


@pytest.mark.parametrize("lang", ["en", "de", "fr", "pl", "ru", "ja", "tr"])
@pytest.mark.parametrize("times", [1, 2, 3])
def test_utf8_read_as_windows_and_back(lang, times):
    text = TEXTS[lang]
    for _ in range(times):
        text = windows(text.encode())
    assert repair("Sound é start. " + text + " Sound ü end.")[0] == "Sound é start. " + TEXTS[lang] + " Sound ü end."


@pytest.mark.parametrize("text", ["هذا القميص جميل في اللون", "החולצה הזאת יפה של", "เสื้อตัวนี้สวยมาก", "यह कमीज़ सुंदर है", "ეს პერანგი ლამაზია", "Այս վերնաշապիկը գեղեցիկ է", "Бұл көйлек өте әдемі"])
def test_further_scripts_read_as_windows(text):
    assert repair(windows(text.encode())) == (text, ["windows"]) and repair(text) == (text, [])


@pytest.mark.parametrize("codec", ["latin-1", "mac_roman", "cp850", "cp437", "iso8859_15"])
@pytest.mark.parametrize("lang", ["en", "de", "fr", "pl"])
def test_utf8_read_with_other_encodings(codec, lang):
    assert repair(TEXTS[lang].encode().decode(codec))[0] == TEXTS[lang]


def test_utf8_read_as_cp1251():
    assert repair("Не отбеливать. " + TEXTS["ru"].encode().decode("cp1251", "replace"))[1][:1] == ["cp1251"]


@pytest.mark.parametrize("wrong, right", [("gb18030", "utf-8"), ("latin-1", "cp932"), ("cp932", "euc_jp")])
def test_japanese_through_multibyte_encodings(wrong, right):
    fixed, undone = repair(TEXTS["ja"].encode(right).decode(wrong, "replace"))
    assert undone and "カーディガン" in fixed


ZH, KO = "这件衣服的质量很好，颜色和图片一样，尺寸合适，推荐购买。", "이 셔츠는 색상이 사진과 같고 품질이 아주 좋습니다 다시 구매하고 싶어요"


@pytest.mark.parametrize("text, wrong", [(ZH, "gb18030"), (KO, "gb18030")])
def test_chinese_and_korean_utf8_read_as_multibyte(text, wrong):
    fixed, undone = repair("ok " + text.encode().decode(wrong, "replace"))
    assert undone and sum(c in text for c in fixed) > 0.4 * len(text)


@pytest.mark.parametrize("text, right", [(ZH, "gb18030"), (KO, "euc_kr")])
def test_chinese_and_korean_read_as_windows(text, right):
    assert repair(windows(text.encode(right))) == (text, [f"windows<{right}"])


@pytest.mark.parametrize("right", ["cp1251", "koi8_r", "iso8859_5"])
def test_cyrillic_read_as_windows_is_not_chinese(right):
    for text in (TEXTS["ru"], TEXTS["ru"].upper()):
        assert not any("gb18030" in x or "euc_kr" in x for x in repair(windows(text.encode(right)))[1])


def test_latin_letters_read_as_han():
    assert repair("Gr枚脽e 45 f盲llt aus wie 眉blich")[0] == "Gr枚脽e 45 fällt aus wie 眉blich"  # only what is sure
    assert repair("für café später".encode().decode("gb18030"))[0].startswith("für ")


def test_what_cannot_be_encoded_stays():
    text = TEXTS["ja"].encode().decode("gb18030", "replace")
    fixed, _ = repair(text[:8] + "👗" + text)
    assert "👗" in fixed and "カーディガン" in fixed


def test_only_spans_are_touched():
    assert repair("Wash at 13 Â°C. Wash at 38 °C.")[0] == "Wash at 13 °C. Wash at 38 °C."
    assert repair("x? SÃ\xad, claro. Die MÃ¤ntel")[0] == "x? Sí, claro. Die Mäntel" and repair("SÃ\xad, claro")[0] == "Sí, claro" and repair("LÃ® azul")[1] == []
    assert repair("MÃ¤ntel")[0] == "Mäntel" and repair("GRÃ–SSE")[0] == "GRÖSSE"
    long = "Größe " * 20_000
    assert repair(long + "fÃ¼r " + long)[0] == long + "für " + long


SCHEMA = "doc_id bigint, text string, n int, word string, id string"


def run(spark, texts):
    return {r["doc_id"]: r for r in garbled(spark.createDataFrame([(i, t, 1, "w", "x") for i, t in enumerate(texts)], SCHEMA)).collect()}


def test_one_byte_encodings_are_told_by_words(spark):
    swapped = [TEXTS["de"].encode("cp1252").decode("cp850"), TEXTS["pl"].encode("cp1250").decode("latin-1"), TEXTS["ru"].encode("koi8_r").decode("cp1251"), TEXTS["ru"].encode("cp1251").decode("latin-1"), TEXTS["tr"].encode("cp1254").decode("latin-1")]
    sound = [t for t in TEXTS.values() for _ in range(6)]
    got = run(spark, sound + swapped + [None, "", "ascii", "caf� au lait", "the “�” sign", SOUND[-3]])
    n = len(sound)
    assert set(got) == {*range(n, n + 5), n + 8}
    assert got[n]["restored"] == TEXTS["de"] and got[n + 2]["restored"] == TEXTS["ru"] and got[n + 2]["encodings"] == "cp1251<koi8_r"
    assert got[n + 8]["lost"] and got[n + 8]["restored"] == "caf� au lait"


def test_only_the_garbled_words_are_read_anew(spark):
    """Sound words stand beside a clause read with another one-byte encoding: they stay as they are."""
    clause = "Die Ärmel dürften länger sein".encode("cp1252").decode("cp850")
    got = run(spark, [TEXTS["de"]] * 5 + [TEXTS["de"] + f" {i}" for i in range(5)] + [clause + " | café à Zürich, Größe 45, naïve"])
    assert set(got) == {10} and got[10]["told_by"] == "words"
    assert got[10]["restored"] == "Die Ärmel dürften länger sein | café à Zürich, Größe 45, naïve"


def test_lone_pairs_of_letters_are_told_by_words(spark):
    got = run(spark, [f"für die Straße {i}" for i in range(6)] + ["für".encode().decode("cp1250") + " den Tag", "StraĂźe", "ĂĽ"])
    assert {i: r["restored"] for i, r in got.items()} == {6: "für den Tag", 7: "Straße"}


def test_copies_come_out_and_nothing_gives_nothing(spark):
    assert set(run(spark, ["fÃ¼r", "fÃ¼r", "für"])) == {0, 1}
    assert run(spark, []) == {}


def test_copies_do_not_outvote_the_words(spark):
    """Copies of a swapped text all come out, however many, and do not make sound texts cases."""
    sound = [f"{TEXTS['ru']} {i}" for i in range(5)]
    swapped = TEXTS["ru"].encode("cp1251").decode("koi8_r")
    got = run(spark, sound + [swapped] * 60)
    assert set(got) == set(range(5, 65)) and {r["restored"] for r in got.values()} == {TEXTS["ru"]}
    assert set(run(spark, [TEXTS["de"]] * 8 + [TEXTS["de"].encode("cp1252").decode("cp850")])) == {8}  # a sound text may have its words from copies alone
