"""The text classifier: character grams are made once, whoever reads them."""

from clausegraph.operators import models


def rows_of(spark):
    rows = [(i, f"fire door {i % 7} alarm" if i % 2 else f"bike rack {i % 5} shed", ["calm", "hot", None][2 if i % 11 == 0 else i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality string")


def test_grams_are_made_once(spark, monkeypatch):
    made, grams = [], models.char_grams
    monkeypatch.setattr(models, "char_grams", lambda text: made.append(text) or grams(text))
    counted = models.gram_counts(rows_of(spark), "text")
    model = models.train_text_classifier(counted, "text", "quality")
    scored = models.predict(model, counted, "text")
    assert made == ["text"]
    assert "Generate" not in scored._jdf.queryExecution().toString() and "ngrams" not in scored._jdf.queryExecution().toString()
    got = {r["doc_id"]: (r["ml_intent"], round(r["ml_confidence"], 6)) for r in scored.collect()}
    plain = models.predict(models.train_text_classifier(rows_of(spark), "text", "quality"), rows_of(spark), "text")
    assert {r["doc_id"]: (r["ml_intent"], round(r["ml_confidence"], 6)) for r in plain.collect()} == got
    assert all(got[i][0] == ("hot" if i % 2 else "calm") for i in range(60))
