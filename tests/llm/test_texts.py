"""Problem 8 on made-up documents."""

import pytest

from paperloom.llm import language

SAMPLES = {
    "en": ["The tenant shall return the keys to the office before the end of the month.", "The court could not explain why the invoice was late."],
    "de": ["Der Mieter muss die Schlüssel vor dem Ende des Monats an die Verwaltung zurückgeben.", "Das Gericht konnte nicht erklären, warum die Rechnung zu spät kam."],
    "fr": ["Le locataire doit remettre les clés au gestionnaire avant la fin du mois.", "Le tribunal ne pouvait pas expliquer pourquoi la facture était en retard."],
    "es": ["El arrendatario debe entregar las llaves al administrador antes del fin de mes.", "El juzgado no pudo explicar por qué la factura llegó tarde."],
    "it": ["Il conduttore deve consegnare le chiavi all'amministratore prima della fine del mese.", "Il tribunale non poteva spiegare perché la fattura fosse in ritardo."],
    "nl": ["De huurder moet de sleutels voor het einde van de maand aan de beheerder geven.", "De rechtbank kon niet uitleggen waarom de factuur te laat was."],
    "pt": ["O inquilino deve entregar as chaves ao administrador antes do fim do mês.", "O tribunal não conseguiu explicar porque a fatura chegou tarde."],
}


@pytest.fixture(scope="module")
def model():
    return language.fit([(k, (v[0] + " ") * 3 + v[1]) for k, v in SAMPLES.items() for _ in range(4)], language.vocabulary())


def test_forward_sums_all_segmentations(model):
    def brute(word):
        w = "▁" + word
        total = [0.0] * 7

        def walk(at, p):
            if at == len(w):
                for i in range(7):
                    total[i] += p[i]
                return
            for end in range(at + 1, len(w) + 1):
                k = model.pieces.get(w[at:end])
                q = model.p[k] if k is not None else [language.FLOOR] * 7 if end == at + 1 else None
                if q is not None:
                    walk(end, [a * b for a, b in zip(p, q)])

        walk(0, [1.0] * 7)
        return total

    import numpy as np

    assert np.allclose(np.exp(model.forward("keys")), brute("keys"))
    word = "unabhängigkeitserklärung"
    assert np.allclose(model.summed(word), model.summed_in_logs(word))


def test_long_words_count_whole(model):
    """Nothing is cut at 64 characters: two words that differ only behind that differ in probability."""
    a, b = "schlüssel" * 9 + "mieter", "schlüssel" * 9 + "ñandúes"
    assert abs(model.forward(a)[0] - model.forward(b)[0]) > 1 and all(abs(v) < 1e6 for v in model.forward("x" * 5000))


def test_text_in_no_known_language(model, spark):
    q = model.posterior("Договор аренды должен быть подписан до конца месяца")
    assert q.argmax() == len(language.LANGUAGES)
    docs = spark.createDataFrame([(1, "Договор аренды должен быть подписан до конца месяца.", "ru")], "doc_id bigint, text string, lang string")
    s = language.sentence_languages(docs, model)
    assert [r["lang"] for r in language.document_languages(docs, s).collect()] == ["und"] and language.foreign_paragraphs(s).count() == 0


def test_languages(model):
    for code, texts in SAMPLES.items():
        for t in texts:
            q = model.posterior(t)
            assert language.LANGUAGES[int(q.argmax())] == code and abs(q.sum() - 1) < 1e-9


def test_documents(spark, model):
    mixed = SAMPLES["en"][0] + " " + SAMPLES["fr"][1]
    rows = [(1, mixed, "en-US"), (2, SAMPLES["de"][0] + "\n\n* * *\n\n" + SAMPLES["de"][1], "German"), (3, None, "en"), (4, "", None), (5, SAMPLES["nl"][0], "??"), (5, SAMPLES["nl"][0], "??"), (6, "§ 16 (2)", "en"), (7, SAMPLES["es"][0] * 2000, "spa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' as label", "1 as para_no")
    s = language.sentence_languages(docs, model)
    assert {(r["doc_id"], r["para_no"], r["lang"]) for r in language.foreign_paragraphs(s).collect()} == {(1, 1, "fr"), (5, 1, "nl")}
    main = {r["doc_id"]: (r["lang"], r["confidence"]) for r in language.document_languages(docs, s).collect()}
    assert main[2][0] == "de" and set(main) == {r[0] for r in rows} and main[3] == main[4] == main[6] == (None, 0.0)
    runs = {(r["first_sentence"], r["last_sentence"], r["lang"]) for r in language.segments(s).where("doc_id = 1").collect()}
    assert runs == {(1, 1, "en"), (2, 2, "fr")}
    assert language.sentence_languages(docs.limit(0), model).count() == 0
    assert language.train(docs.limit(0)).p.shape[1] == 7
