"""Phonetic rules against known readings."""

import pytest

from chronotext.operators import phonetics as P


@pytest.mark.parametrize(("word", "said"), [("queso", "ˈkeso"), ("guerra", "ˈgera"), ("canción", "kanˈsjon"), ("árbol", "ˈaɾbol"), ("lago", "ˈlaɣo"), ("pst", "pst")])
def test_spanish(word, said):
    assert P.spanish_word(word) == said


@pytest.mark.parametrize(("arpabet", "said"), [("HH AH0 L OW1", "həˈloʊ"), ("K AE1 T", "ˈkæt"), ("IH2 N T ER0 N AE1 SH AH0 N", "ˌɪntɚˈnæʃən")])
def test_arpabet(arpabet, said):
    assert P.arpabet(arpabet) == said


def test_texts(spark):
    assert P.to_ipa("¡Queso, lago!", "es-MX") == "¡ˈkeso, ˈlaɣo!"
    assert P.to_ipa("Hello cat 42", "en", {"cat": "K AE1 T"}) == "Hello ˈkæt 42"
    assert P.to_ipa("bonjour", "fr") == "bonjour"
    rows = spark.createDataFrame([(1, "Hello, cat!  x"), (2, "")], "id int, text string")
    entries = spark.createDataFrame([("CAT", "K AE1 T")], "word string, arpabet string")
    assert {r["id"]: r["ipa"] for r in P.with_lexicon(rows, entries, "id").collect()} == {1: "Hello, ˈkæt!  x", 2: ""}


@pytest.mark.parametrize(("plain", "said"), [("zhǎn lǎn guǎn", "zhán lán guǎn"), ("wǒ hěn hǎo", "wó hén hǎo"), ("nǐ hǎo", "ní hǎo"), ("mā ma", "mā ma")])
def test_sandhi(spark, plain, said):
    assert spark.createDataFrame([(plain,)], ["r"]).select(P.third_tone("r").alias("x")).first()["x"] == said


def test_pinyin_keeps_marks_and_groups():
    readings = {"你好": "nǐ hǎo"}
    assert P.pinyin("你好，你好", lambda g: readings[g]) == "ní hǎo, ní hǎo"


def test_a_reading_is_split_once(spark):
    """Not again for each of its syllables, which grows with the square of its length."""
    said = spark.createDataFrame([("nǐ hǎo  hǎo mā",), (None,)], "t string").select(P.third_tone("t").alias("t"))
    assert said._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["t"] for r in said.collect()] == ["ní háo hǎo mā", None]
