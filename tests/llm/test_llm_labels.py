"""Language ID: a rare label is a candidate however large the table is."""

from resemble.llm import langid


def test_rare_label_is_a_language(spark):
    words = {"aa": "hello world again", "bb": "guten morgen heute", "cc": "zxqv kjwq vvxz"}
    rows = [(i, words["aa" if i % 2 else "bb"] + f" {i}", "aa" if i % 2 else "bb") for i in range(3_000)]
    rows += [(9_000 + i, words["cc"], "cc") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_text_model(docs, train_rows=60)
    assert model[0] == ["aa", "bb", "cc"]
    got = langid.identify(docs.where("doc_id >= 9000"), model, ["doc_id"], "text").collect()
    assert [r["language"] for r in got] == ["cc", "cc"]
