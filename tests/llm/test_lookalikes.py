import unicodedata

from chanlake.llm import lookalikes as K


def test_forms():
    same = ["café  сор", "ｃａｆé  сор", "café  сор", "ca​f­é  сор", "саfé  сор"]
    assert len({K.form(s) for s in same}) == 1 and len({K.shape(s) for s in same}) == 1
    assert K.form("oткpыл прoхoд") == "открыл проход" and K.form("lοst саt") == "lost cat"
    assert K.form("x_сор @abc_x Привет") .startswith("x_")
    for a, b in (("Cafe", "café"), ("cafe", "Cafe"), ("a.", "a"), ("a\nb", "a b")):
        assert K.form(a) != K.form(b)
    assert K.form("👩‍💻 ⚠️") == "👩‍💻 ⚠️"
    assert K.form(unicodedata.normalize("NFD", "ё й ї")) == "ё й ї"


def test_form_is_a_function_of_the_shape():
    words = ["сор", "cop", "тест", "tecт", "Αθήνα", "mix", "міх", "ж", "a", "а"]
    texts = [f"{a} {b} {c}" for a in words for b in words for c in words]
    by = {}
    for t in texts:
        by.setdefault(K.shape(t), set()).add(K.form(t))
    assert all(len(v) == 1 for v in by.values())


def test_pairs(spark):
    rows = [(1, "lost cat", "x"), (2, "lοst cat", "x"), (3, "lost cat", "x"), (4, "Lost cat", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (8, "a" * 50_000, "x"), (9, "а" * 50_000, "x"), (2, "lοst cat", "x")]
    df = spark.createDataFrame(rows, "delivery_id long, text string, form string")
    f = K.forms(df, ["delivery_id"], "text", K.vocabulary(df, "text"))
    got = sorted((r[1], r[2]) for r in K.pairs(K._prints(f, "delivery_id", "text")).collect())
    assert got == [(1, 2), (2, 3), (6, 7), (8, 9)]
    assert K.pairs(K._prints(f.limit(0), "delivery_id", "text")).count() == 0


def test_classes_without_pairs(spark):
    rows = [(k, "lost cat" if k % 2 else "lοst cat") for k in range(50)] + [(90, "alone"), (91, None)]
    df = spark.createDataFrame(rows, "delivery_id long, text string")
    f = K.forms(df, ["delivery_id"], "text", K.vocabulary(df, "text"))
    got = {tuple(r) for r in K.classes(K._prints(f, "delivery_id", "text")).collect()}
    assert got == {("text", k, 0, 2, 50) for k in range(50)}
    assert K.classes(K._prints(f.limit(0), "delivery_id", "text")).count() == 0


def test_vocabulary_grows_and_repair_asks_it(spark, monkeypatch):
    df = spark.createDataFrame([(1, "paypal сор"), (2, "pаypal хаха"), (3, "qаzz")], "delivery_id long, text string")
    v = K.vocabulary(df, "text", K._WORD)
    known = K._known(v)
    assert K.repair("pаypal хаха", known) == "paypal хаха" and K.repair("qаzz", known) == "qаzz"
    monkeypatch.setattr(K, "MOST_BITS", 1 << 10)
    import pytest

    with pytest.raises(ValueError):
        K.vocabulary(df, "text")
