"""Contractions of each language, the lexicon's veto, and tokenisation by language."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import contractions as K
from glossa.functions import text as X

CASES = {
    "en": {"don't": "don 't", "Cannot": "Can not", "dog's": "dog 's", "we'll": "we 'll", "gonna": "gon na", "plain": "plain"},
    "de": {"Im": "In dem", "zur": "zu der", "hinterm": "hinter dem", "Übers": "Über das", "in": "in"},
    "fr": {"Au": "à le", "desquelles": "de lesquelles", "le": "le"},
    "es": {"Al": "A el", "del": "de el"},
    "es-ancora": {"Del": "de el", "darme": "dar me", "diciéndole": "diciendo le", "dárselo": "dar se", "Darme": "Darme"},
    "it": {"nell'": "in l'", "Degli": "Di gli", "col": "con il", "De'": "Di i"},
    "pt": {"dos": "de os", "Naquele": "Em aquele", "àqueloutras": "a aqueloutras", "pela": "por a", "dalguém": "de alguém", "há-de": "há de", "disse-lhe": "disse -lhe", "fá-lo-ei": "fáei -lo", "dir-se-lhos": "dir -se-lhos", "sol": "sol"},
    "xx": {"du": "du"},
}


def _split(spark, rows, verbs=None):
    df = spark.createDataFrame([(i, lang, form) for i, (lang, form) in enumerate(rows)], "i int, lang string, form string")
    return [" ".join(r.words) if r.words is not None else None for r in K.split_contractions(df, verbs).orderBy("i").collect()]


@pytest.mark.parametrize("lang", CASES)
def test_contractions(spark, lang):
    assert _split(spark, [(lang, f) for f in CASES[lang]]) == list(CASES[lang].values())


def test_lexicon_decides_on_clitics(spark):
    verbs = spark.createDataFrame([("es", "dar"), ("es", "diciendo"), ("es", "parte"), ("es", "par"), ("it", "far"), ("it", "ecco"), ("it", "dando")], "lang string, form string")
    rows = [("es", "darme"), ("es", "diciéndole"), ("es", "parte"), ("es", "comerlo"), ("it", "farlo"), ("it", "eccomi"), ("it", "mare"), ("it", "dandomelo"), ("es", None), (None, "al")]
    assert _split(spark, rows, verbs) == ["dar me", "diciéndo le", "parte", "comerlo", "far lo", "ecco mi", "mare", "dando me lo", None, "al"]
    assert _split(spark, rows[:2] + rows[4:5]) == ["darme", "diciéndole", "farlo"]


def test_fixed_table():
    table = K.table()
    assert len({r[:2] for r in table}) == len(table) < 500


@pytest.mark.parametrize(
    ("lang", "sentence", "want"),
    [
        ("en", 'He said: "I can\'t (really)."', 'He said : " I can\'t ( really ) . "'),
        ("en-ptb", '"Yes," 5:30 we--they', "`` Yes , '' 5:30 we -- they"),
        ("fr", "l'été « beau » !", "l' été \" beau \" !"),
        ("es", "o 'apartheid' $5...", "o ' apartheid' $ 5 ..."),
        ("pt-cintil", "o (bom) “dia”.", "o ' bom' ' dia' ."),
        (None, "a;b\tc", "a ; b c"),
    ],
)
def test_universal(spark, lang, sentence, want):
    df = spark.createDataFrame([(lang, sentence), (lang, None)], "lang string, sentence string")
    got = df.select(X.universal(F.col("sentence"), F.col("lang")).alias("t")).collect()
    assert " ".join(got[0].t) == want and got[1].t is None
