"""Contracted words by language: fixed forms by a join with a table of bounded size, clitics by patterns that a verb lexicon may veto.

Languages: en, de, fr, es, es-ancora, it, pt. Forms of other languages stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What forms contract, as a preposition's short stem with an article or pronoun.
FRENCH = {
    "au": "à le", "aux": "à les", "auquel": "à lequel", "auxquels": "à lesquels", "auxquelles": "à lesquelles",
    "du": "de le", "des": "de les", "duquel": "de lequel", "desquels": "de lesquels", "desquelles": "de lesquelles",
}
GERMAN = {
    "am": "an dem", "ans": "an das", "aufs": "auf das", "beim": "bei dem", "durchs": "durch das", "fürs": "für das", "hinterm": "hinter dem", "im": "in dem", "ins": "in das",
    "übers": "über das", "ums": "um das", "unters": "unter das", "unterm": "unter dem", "vom": "von dem", "vors": "vor das", "vorm": "vor dem", "zum": "zu dem", "zur": "zu der",
}
SPANISH = {"al": "a el", "del": "de el"}
ITALIAN_ARTICLES = {"l": "il", "llo": "lo", "i": "i", "gli": "gli", "lla": "la", "lle": "le", "ll'": "l'"}
ITALIAN_STEMS = {"a": ("a", "l llo i gli lla lle ll'"), "co": ("con", "l i gli lla lle ll'"), "da": ("da", "l llo i gli lla lle ll'"), "de": ("di", "l llo i gli lla lle ll'"), "ne": ("in", "l llo i gli lla lle ll'"), "pe": ("per", "l i"), "su": ("su", "l llo i gli lla lle ll'")}
PORTUGUESE_ENDINGS = {"o": "o a os as", "e": "e a es as"}
PORTUGUESE_INFLECTED = {"ess": "e", "est": "e", "aquel": "e", "outr": "o", "aqueloutr": "o", "essoutr": "o", "estoutr": "o"}
PORTUGUESE_OTHER = "o a os as isso isto aquilo ele ela eles elas um uma uns umas algum alguma alguns algumas alguém algo outrem"
PORTUGUESE_AFTER_DE = "acolá algures alhures ali aqui entre onde outrora"
PORTUGUESE_APART = {"ao": "a o", "à": "a a", "aos": "a os", "às": "a as", "àquilo": "a aquilo", "aonde": "a onde", "pelo": "por o", "pela": "por a", "pelos": "por os", "pelas": "por as", "hei-de": "hei de", "há-de": "há de", "hás-de": "hás de"}
PORTUGUESE_SUFFIXES = "ei ás á emos eis ão ia ias íamos íeis iam"
PORTUGUESE_CLITICS = "lo la los las na nas no nos me te vos o os a as se lhe lhes"
PORTUGUESE_FUSED = "m t lh no-l vo-l"
PORTUGUESE_AFTER_SE = "me te nos vos lhe lhes"

#: Clitics behind verb endings, one pattern after the other. The first English one comes before n't, so don't is don + 't.
ENGLISH = (
    (r"([^' ])('[sS]|'[mM]|'[dD]|')\b", r"\1 \2"), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)\b", r"\1 \2"),
    (r"(?i)\b(can)(not)\b", r"\1 \2"), (r"(?i)\b(d)('ye)\b", r"\1 \2"), (r"(?i)\b(gim)(me)\b", r"\1 \2"), (r"(?i)\b(gon)(na)\b", r"\1 \2"),
    (r"(?i)\b(got)(ta)\b", r"\1 \2"), (r"(?i)\b(lem)(me)\b", r"\1 \2"), (r"(?i)\b(mor)('n)\b", r"\1 \2"),
)
_ES = "le|lo|la|les|los|las"
SPANISH_CLITICS = ((f"(ar|er|ir|ír|ndo)(me|te|se|nos|{_ES})$", r"\1 \2"), (f"(ár|ér|ír|ndo)(se)(me|te|nos|os|{_ES})$", r"\1 \2 \3"), (f"(ár|ér|ír)(os)({_ES})$", r"\1 \2 \3"))
ANCORA_CLITICS = (
    (f"(ar|ir|ír)(me|te|se|nos|{_ES})$", r"\1 \2"), (f"(er)(se|{_ES})$", r"\1 \2"),
    *[(f"{á}(ndo)(me|te|se|nos|os|{_ES})$", rf"{a}\1 \2") for á, a in ("áa", "ée", "íi")],
    *[(f"{á}(r|ndo)(se)(me|te|nos|os|{_ES})$", rf"{a}\1 \2 \3") for á, a in ("áa", "ée", "íi")],
    *[(f"{á}(r)(os)({_ES})$", rf"{a}\1 \2 \3") for á, a in ("áa", "ée", "íi")],
)
_IT = "gli|le|lo|la|li|ne"
ITALIAN_CLITICS = (
    ("^(ecco)(mi|ti|si|ci|vi|le|lo|la|li|ne|l')$", r"\1 \2"), ("^(glie)(le|lo|la|li|ne|l')$", r"\1 \2"), (f"(ar|er|ir|ppor|^por|ur|ndo|te)(mi|ti|si|ci|vi|{_IT})$", r"\1 \2"),
    (f"(ar|er|ir|or|ur|ndo|ta|to|te|ti)(me|te|se|ce|ve)({_IT})$", r"\1 \2 \3"), ("(ar|er|ir|or|ur|ndo)(glie)(le|lo|la|li|ne)$", r"\1 \2 \3"),
)


def _italian() -> dict[str, str]:
    return {stem + end: f"{word} {ITALIAN_ARTICLES[end]}" for stem, (word, ends) in ITALIAN_STEMS.items() for end in ends.split()} | {"de'": "di i"}


def _portuguese() -> dict[str, str]:
    inflected = {stem + end: stem for stem, kind in PORTUGUESE_INFLECTED.items() for end in PORTUGUESE_ENDINGS[kind].split()}
    out = {first + word: f"{full} {word}" for first, full in (("d", "de"), ("n", "em")) for word in [*inflected, *PORTUGUESE_OTHER.split()]}
    out |= {f"d{word}": f"de {word}" for word in PORTUGUESE_AFTER_DE.split()}
    return out | {f"à{word[1:]}": f"a {word}" for word, stem in inflected.items() if stem.startswith("aquel")} | PORTUGUESE_APART


def _capitals(table: dict[str, str], keep: bool = True) -> dict[str, str]:
    """The table with forms that begin with a capital, which the first word keeps or not."""
    upper = lambda x: x[0].upper() + x[1:]
    return table | {upper(k): upper(v) if keep else v for k, v in table.items()}


def table() -> list[tuple[str, str, str]]:
    """lang, form, words joined by a blank: all fixed contractions, some 400 rows."""
    spanish = _capitals(SPANISH)
    by_lang = {"fr": _capitals(FRENCH, False), "de": _capitals(GERMAN), "es": spanish, "es-ancora": _capitals(SPANISH, False), "it": _capitals(_italian()), "pt": _capitals(_portuguese())}
    return [(lang, form, words) for lang, forms in by_lang.items() for form, words in forms.items()]


def _rewritten(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda y, r: F.regexp_replace(y, r[0], r[1].replace("\\", "$")), rules, x)


def _portuguese_clitic(form: Column) -> Column:
    """A verb and its clitic; a suffix behind the clitic returns to the verb."""
    fused = [stem + end for stem in PORTUGUESE_FUSED.split() for end in PORTUGUESE_ENDINGS["o"].split()]
    clitics = [*PORTUGUESE_CLITICS.split(), *fused, *[f"se-{c}" for c in [*PORTUGUESE_AFTER_SE.split(), *fused]]]
    return F.trim(F.regexp_replace(form, f"^(.*?)(-(?:{'|'.join(clitics)}))(?:-({'|'.join(PORTUGUESE_SUFFIXES.split())}))?$", "$1$3 $2"))


def clitics(form: Column, lang: Column) -> Column:
    """form with blanks between a verb and its clitics, as patterns find them, before any lexicon's veto."""
    ancora = F.when(form.rlike(r"^[^\p{Ll}]"), form).otherwise(F.substring_index(_rewritten(form, ANCORA_CLITICS), " ", 2))
    return F.when(lang == "en", _rewritten(form, ENGLISH)).when(lang == "es", _rewritten(form, SPANISH_CLITICS)).when(lang == "es-ancora", ancora).when(lang == "it", _rewritten(form, ITALIAN_CLITICS)).when(lang == "pt", _portuguese_clitic(form)).otherwise(form)


def split_contractions(tokens: DataFrame, verbs: DataFrame | None = None) -> DataFrame:
    """tokens (lang, form, ...) with words (array<string>): the words of a contracted form, else the form alone.

    verbs (lang, form) is a lexicon of verb forms. Clitics of es and it come off only where the first word, without the
    accent before -ndo, is in the lexicon and the whole form isn't; without a lexicon they stay. A null form has null words.
    """
    spark = tokens.sparkSession
    fixed = spark.createDataFrame(table(), "lang string, form string, __fixed string")
    t = tokens.join(F.broadcast(fixed), ["lang", "form"], "left")
    found = clitics(F.col("form"), F.col("lang"))
    vetoed = F.col("lang").isin("es", "it")
    if verbs is None:
        t = t.withColumn("__split", F.when(vetoed, F.col("form")).otherwise(found))
    else:
        known = verbs.select("lang", "form").distinct()
        first = reduce(lambda y, x: F.regexp_replace(y, f"{x[0]}(?=ndo$)", x[1]), ("áa", "ée", "íi"), F.substring_index("__split", " ", 1))
        t = t.withColumn("__split", found).withColumn("__first", F.when(vetoed & (F.col("__split") != F.col("form")), first))
        t = t.join(known.select(F.col("lang"), F.col("form").alias("__first"), F.lit(True).alias("__verb")), ["lang", "__first"], "left")
        t = t.join(known.withColumn("__whole", F.lit(True)), ["lang", "form"], "left")
        stays = vetoed & (F.col("__verb").isNull() | F.col("__whole").isNotNull())
        t = t.withColumn("__split", F.when(stays, F.col("form")).otherwise(F.col("__split")))
    return t.select(*[t[c] for c in tokens.columns], F.split(F.coalesce("__fixed", "__split"), " ").alias("words"))
