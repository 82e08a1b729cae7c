import pytest

from scholia.llm.mojibake import LOSSY, chains, find_garbled, fit, garble, name, restore

CLEAN = [
    "la función devuelve el número de página añadido aquí", "das Übergabeformat zählt Umlaute wie ü und ö doppelt", "la règle imbriquée échoue à la fin, très coûteux",
    "remover esta solução provisória depois que a exceção for corrigida", "przenieść tę część do osobnego, mniejszego modułu", "bu bölüm çok yavaş çünkü önbellek yeniden oluşturuluyor",
    "перенести этот код в отдельный модуль поменьше", "проверить, что кэш закрывается раньше, чем начнётся чтение", "这里太慢了，因为任务队列每一行都要重新创建", "コメント走査が直ったらこの回避策を消してください",
    "이 부분은 나중에 더 작은 모듈로 옮기는 것이 좋겠다", "replace the search with a lookup — really", "files larger than 40 megabytes… maybe", "see “notes”, it’s fragile", "café ✓ is fine", "√2 and ±6 µs are rounded", "├── a └── b is drawn twice",
    "questo è lento perché il filtro è già stato chiuso", "non si capisce perché la qualità è più alta", "ATENÇÃO: NÃO PODE SER ALTERADA SEM REVISÃO",
]


@pytest.fixture(scope="module")
def model():
    return fit([f"{t} ({i})" for i in range(60) for t in CLEAN])


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(model, text):
    assert model.detect(text) is None


@pytest.mark.parametrize("chain", [c for c in chains() if c[0][1] in ("cp1252", "latin-1", "cp437", "mac-roman") and c[0][0] == "utf-8"], ids=name)
@pytest.mark.parametrize("text", CLEAN[:5])
def test_round_trip(model, text, chain):
    bad = garble(text, chain)
    assert restore(bad, chain) == text
    found = model.detect(bad)
    assert found and found[1] == text


def test_other_chains(model):
    for text, chain in ((CLEAN[6], (("cp1251", "latin-1"),)), (CLEAN[6], (("koi8-r", "cp1251"),)), (CLEAN[8], (("gb18030", "latin-1"),)), (CLEAN[10], (("euc-kr", "latin-1"),))):
        assert model.detect(garble(text, chain))[1] == text


@pytest.mark.parametrize("text", [CLEAN[6].upper(), CLEAN[7].upper(), "ПЕРЕНЕСТИ ЭТОТ КОД В МОДУЛЬ"])
def test_capitals_are_not_garbled(model, text):
    assert model.detect(text) is None


def test_words_without_a_say_follow_the_others(model):
    chain = (("cp1250", "latin-1"),)
    bad = garble("przenieść tę część do osobnego, mniejszego modułu, więc będzie osobny Łódź", chain)
    assert model.detect(bad)[1] == "przenieść tę część do osobnego, mniejszego modułu, więc będzie osobny Łódź"


def test_alphabets_do_not_mix(model):
    bad = garble("questo è lento perché il filtro è già stato chiuso", (("gb18030", "latin-1"),))
    assert model.detect(bad)[1] == "questo è lento perché il filtro è già stato chiuso"


def test_parts_quotes_and_losses(model):
    assert model.detect("la función devuelve el nÃºmero de página aquí")[1] == "la función devuelve el número de página aquí"
    assert model.detect('x must not print "Ã©" where the source has é') is None
    assert model.detect("der Zeilenz�hler") == (LOSSY, None)
    assert model.detect("la funciÃ³n devuelve el nÃºmero de pÃ¡gina aquÃ­, ma�ana") == (LOSSY, "la función devuelve el número de página aquí, ma�ana")
    assert model.detect('the word "pÃ¡gina" from "funciÃ³n" and "nÃºmero" is wrong')[1] == 'the word "página" from "función" and "número" is wrong'
    assert model.detect(None) is None and model.detect("") is None and model.detect("plain") is None
    assert model.detect(garble("é" * 20_000 + " café", (("utf-8", "cp1252"),))) is not None


def test_table(spark, model):
    bad = garble(CLEAN[0], (("utf-8", "cp1252"),))
    rows = [(1, bad, CLEAN[0]), (2, None, bad), (3, "", None), (4, "ascii", CLEAN[1]), (1, bad, CLEAN[0])]
    df = spark.createDataFrame(rows, "task_id bigint, text string, message string").selectExpr("*", "1 as field", "2 as __id2", "3 as chain")
    got = sorted((r.task_id, r.field, r.restored) for r in find_garbled(df, model, "task_id", ["text", "message"]).collect())
    assert got == [(1, "text", CLEAN[0]), (1, "text", CLEAN[0]), (2, "message", CLEAN[0])]
    assert find_garbled(df.limit(0), model, "task_id", ["text"]).count() == 0
