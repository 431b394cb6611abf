import pytest

from stackmill.llm.encoding import read_again, reread

CLEAN = {"en": "The reader of the second edition will meet the rule again in the chapter about the host number {}.", "fr": "À présent, l’été précède toujours la trame numéro {} et la règle a été préparée très tôt.",
         "de": "Häufig bleibt die Größe länger gültig als die Prüfung für Abschnitt {} und die Übung.", "es": "Además, la célula también está aquí según el capítulo {} y la razón de la señal.", "ru": "Поэтому раздел {} был проверен, а читатель отложен и не найден."}
TEXTS = ["Où la trame s’arrête, le relais commence déjà.", "Die Größe der Prüfung bleibt für die Übung gültig.", "Allí la célula también está según la razón.", "Поэтому раздел был проверен, а читатель отложен.", "At 25 °C the rule “holds” for the host."]


@pytest.fixture(scope="module")
def rows(spark):
    wrong = []
    for codec in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251"):
        for t in TEXTS:
            shown = "".join(bytes([b]).decode(codec, errors="ignore") or chr(b) for b in t.encode())
            wrong.append((t, shown))
    twice = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in TEXTS[2].encode())
    wrong.append((TEXTS[2], "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in twice.encode())))
    wrong.append((TEXTS[3], TEXTS[3].encode("cp1251").decode("cp1252")))
    wrong.append((TEXTS[3], TEXTS[3].encode("koi8_r").decode("cp1251")))
    wrong.append((TEXTS[1], TEXTS[1].encode("cp1252").decode("mac_roman")))
    good = TEXTS + ["When “â€™” turns up in a record, the manual calls it a mark.", "Unknown bytes are shown as “�” by every rule.", "NÃO is Portuguese for no, and SÃO JOVÃO is a made-up place.", "The letters Ð and Þ stand side by side in “Ðorþa”.", "· 17 ·", "The ﬁrst rule is naïve.", "plain"]
    data = [(i, s) for i, (_, s) in enumerate(wrong)] + [(1000 + i, s) for i, s in enumerate(good)] + [(2000, None), (2001, ""), (2002, "lost � sign"), (2003, "x" * 200000 + " Ã©t")]
    filler = [(3000 + 100 * n + i, t.format(i)) for n, t in enumerate(CLEAN.values()) for i in range(60)]
    out = reread(spark.createDataFrame([(i, t, "c") for i, t in data + filler], "id int, text string, chain string"))
    return wrong, {r["id"]: r for r in out.collect()}


def test_wrong_readings_are_found_and_restored(rows):
    wrong, got = rows
    assert [s for i, (_, s) in enumerate(wrong) if not got[i]["affected"]] == []
    restored = sum(got[i]["restored"] == t for i, (t, _) in enumerate(wrong))
    assert restored >= 0.9 * len(wrong)


def test_right_texts_stay(rows):
    _, got = rows
    assert [r["text"] for i, r in got.items() if (1000 <= i < 2000 or i >= 3000) and r["affected"]] == []
    assert all(r["restored"] == r["text"] for i, r in got.items() if i >= 3000)


def test_nulls_and_lost_signs(rows):
    _, got = rows
    assert not got[2000]["affected"] and got[2000]["restored"] is None and not got[2001]["affected"]
    assert got[2002]["affected"] and got[2002]["lost"] and got[2002]["chain"] is None
    assert got[2003]["affected"] and got[2003]["restored"].endswith("ét")


def test_empty_table_and_reading(spark):
    assert reread(spark.createDataFrame([], "text string")).count() == 0
    assert read_again("cafÃ© â€” plain é", "cp1252") == "café — plain é"
