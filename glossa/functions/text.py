"""Column functions over text and tokens; all stay in whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Lower case of A-Z only, other characters as they are."""
    return F.translate(x, UPPER, LOWER)


def word_shape(x: Column) -> Column:
    """Runs of capitals, small letters and digits as A, a, 0, longer ones with +; other characters as they are."""
    for pattern, to in (("[A-Z]{2,}", "A+"), ("[A-Z]", "A"), ("[a-z]{2,}", "\u0001"), ("[a-z]", "a"), ("[0-9]{2,}", "0+"), ("[0-9]", "0")):
        x = F.regexp_replace(x, pattern, to)
    return F.replace(x, F.lit("\u0001"), F.lit("a+"))


def flags(x: Column) -> dict[str, Column]:
    """Character-class tests of a token."""
    return {
        "has_digit": x.rlike("[0-9]"),
        "all_digit": x.rlike("^[0-9]+$"),
        "has_upper": x.rlike("[A-Z]"),
        "all_upper": x.rlike("^[A-Z]+$"),
        "first_upper": x.rlike("^[A-Z]"),
        "mixed_case": x.rlike("[A-Z]") & x.rlike("[a-z]"),
        "has_hyphen": x.contains("-"),
        "has_period": x.contains("."),
        "is_punctuation": x.rlike(r"^\p{P}+$"),
    }


def flag_bits(x: Column) -> Column:
    """The tests as one number, the first in the lowest bit."""
    return reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(flags(x).values())]).cast("long")


def prefix(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def suffix(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def unicode_length(x: Column) -> Column:
    """Length without non-spacing marks."""
    return F.length(F.regexp_replace(x, r"\p{Mn}", "")).cast("long")


#: The treebank's names of brackets.
BRACKETS = {"(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", "{": "-LCB-", "}": "-RCB-"}


def escape_brackets(x: Column) -> Column:
    return reduce(lambda y, b: F.replace(y, F.lit(b), F.lit(BRACKETS[b])), BRACKETS, x)


def split_any(x: Column, chars: str, keep_empty: bool = False) -> Column:
    """Split at any of the characters; empty pieces are dropped unless kept."""
    parts = F.split(x, "[" + "".join("\\" + c if not c.isalnum() and c not in "\t\n " else c for c in chars) + "]", -1)
    return parts if keep_empty else F.filter(parts, lambda p: p != "")


def pack_key(template: int, *words: Column, flag: int = 0) -> Column:
    """A feature's key: 8 bits of template, 8 of flags, up to three 16-bit payloads; null if a payload is null."""
    key = F.lit((template << 56 | flag << 48) - (1 << 64 if template >> 7 else 0)).cast("long")
    for i, w in enumerate(words[:3]):
        key = key.bitwiseOR(F.shiftleft(w.cast("long").bitwiseAND(F.lit(0xFFFF)), 32 - 16 * i))
    return key


def split_tag(tag: Column) -> tuple[Column, Column]:
    """Prefix and type of a tag such as B-PER; a tag without a hyphen has no type."""
    return F.when(tag.contains("-"), F.substring_index(tag, "-", 1)).otherwise(tag), F.when(tag.contains("-"), F.substring(tag, F.instr(tag, "-") + 1, F.length(tag)))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, lang, sent_id (from 0), sentence. A sentence ends at . ! or ? before white space; null texts have none.

    A rule-based stand-in for trained sentence models.
    """
    parts = F.split(F.regexp_replace("text", r"([.!?])[ \n]+", "$1\u0001"), "\u0001")
    return docs.select("doc_id", "lang", F.posexplode(parts).alias("sent_id", "sentence")).where(F.trim("sentence") != "")


def whitespace_tokens(sents: DataFrame) -> DataFrame:
    """doc_id, lang, sent_id, n (tokens of the sentence), tok_id (from 1), form: the sentence split at white space."""
    parts = F.filter(F.split("sentence", r"[ \t\n\r]+"), lambda t: t != "")
    rows = sents.select("doc_id", "lang", "sent_id", parts.alias("parts"))
    return rows.select("doc_id", "lang", "sent_id", F.size("parts").alias("n"), F.posexplode("parts").alias("p", "form")).select("doc_id", "lang", "sent_id", "n", (F.col("p") + 1).alias("tok_id"), "form")


#: Ordered rewrites of treebank tokenisation; each separates what its groups match by blanks.
TREEBANK = (
    (r'(^|[ (\[{<])"', "$1 `` "),
    (r"\.\.\.", " ... "),
    (r"([,;:@#$%&])", " $1 "),
    (r"([^.])(\.)([\])}>'\" ]*)$", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^'])' ", "$1 ' "),
    (r"'([sSmMdD]) ", " '$1 "),
    (r"'(ll|re|ve|LL|RE|VE) ", " '$1 "),
    (r"(n't|N'T) ", " $1 "),
    (r" ([Cc])annot ", " $1an not "),
    (r" ([Dd])'ye ", " $1' ye "),
    (r" ([Gg])imme ", " $1im me "),
    (r" ([Gg])onna ", " $1on na "),
    (r" ([Gg])otta ", " $1ot ta "),
    (r" ([Ll])emme ", " $1em me "),
    (r" ([Mm])ore'n ", " $1ore 'n "),
    (r" '([Tt])is ", " '$1 is "),
    (r" '([Tt])was ", " '$1 was "),
    (r" ([Ww])anna ", " $1an na "),
)


def treebank(sentence: Column) -> Column:
    """Treebank-style tokens of a sentence as an array."""
    x = F.concat(F.lit(" "), sentence, F.lit(" "))
    x = F.regexp_replace(x, r"[ \t\n\r]+", " ")
    for pattern, to in TREEBANK:
        x = F.regexp_replace(x, pattern, to)
    return F.filter(F.split(x, " +"), lambda t: t != "")


def treebank_tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "lang", "sent_id", F.posexplode(treebank(F.col("sentence"))).alias("p", "form")).select("doc_id", "lang", "sent_id", (F.col("p") + 1).alias("tok_id"), "form")


#: A run of letters, digits and marks, or one other character that isn't white space.
PIECE = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"


def offset_tokens(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id (from 1), token, start, end: pieces with their places in the sentence (end exclusive)."""
    rows = sents.select("doc_id", "lang", "sent_id", F.regexp_extract_all("sentence", F.lit(PIECE), F.lit(0)).alias("tokens"), F.split("sentence", PIECE, -1).alias("gaps"))
    each = rows.select("doc_id", "sent_id", "gaps", F.posexplode("tokens").alias("p", "token")).select("doc_id", "sent_id", "p", "token", F.length(F.get("gaps", F.col("p"))).alias("gap"))
    w = Window.partitionBy("doc_id", "sent_id").orderBy("p")
    start = F.sum("gap").over(w) + F.coalesce(F.sum(F.length("token")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("doc_id", "sent_id", (F.col("p") + 1).alias("tok_id"), "token", start.alias("start"), (start + F.length("token")).alias("end"))


#: Rewrites of tokenisation by language, in order: languages that take the rule (None: all; a leading "-": all but
#: those), pattern, replacement. en-ptb keeps the treebank's quotes, pt-cintil has only single quotes.
UNIVERSAL = (
    (None, "\u00a0", " "), (None, r"\t", " "), (None, "\u0096", " -- "),
    ("pt-cintil", r"\(|\)", "'"), ("pt-cintil", "\"|«|»|``|“|”|'|`", "' "),
    ("-pt-cintil", "„", "``"), ("-pt-cintil", "«", "``"), ("-pt-cintil", "»", '"'), ("-pt-cintil", "“", "``"), ("-pt-cintil", "”", '"'), ("-pt-cintil", '^"', "``"),
    ("-pt-cintil", "(``)", r" \1 "), ("-pt-cintil", r'([ (\[{<])"', r"\1 `` "), ("-pt-cintil", "’", "'"),
    ("-pt-cintil en en-ptb fr", "'", "' "), ("en en-ptb fr", r"([^\p{L}])'", r"\1' "), ("en en-ptb fr", "^'", "' "),
    ("-en-ptb", " `` ", ' " '), ("-en-ptb", " '' ", ' " '),
    (None, r"([:,])([^0-9])", r" \1 \2"), (None, r"\.\.\.", " ... "), (None, r"([;@#$%&])", r" \1 "), (None, r"([^.])(\.)([\])}>\"']*)\s*\z", r"\1 \2\3 "), (None, r"([?!])", r" \1 "),
    ("en en-ptb", r"([^'])' ", r"\1 ' "), ("-en en-ptb", r"([^'])'", r"\1' "), ("-en en-ptb", r"([^\p{L}])' ", r"\1 ' "),
    (None, r"([\]\[(){}<>])", r" \1 "), (None, "([^-])---([^-])", r"\1 -- \2"), (None, "([^-])--([^-])", r"\1 -- \2"),
    ("en-ptb", '"', " '' "), ("-en-ptb", '"', ' " '), (None, r"(\S)('')", r"\1 \2 "),
)


def universal_rules(lang: str) -> list[tuple[str, str]]:
    """The rewrites that a language takes, in order."""
    takes = lambda names: names is None or ((lang not in names[1:].split()) if names[0] == "-" else lang in names.split())
    return [(pattern, to) for names, pattern, to in UNIVERSAL if takes(names)]


#: Languages whose rules differ from the others'.
UNIVERSAL_LANGUAGES = ("en", "en-ptb", "fr", "pt-cintil")


def universal(sentence: Column, lang: Column) -> Column:
    """Tokens of a sentence as an array, by the rules of its language.

    Words round a double dash stay (they aren't swallowed with it).
    """
    rewritten = lambda code: reduce(lambda x, r: F.regexp_replace(x, r[0], r[1].replace("\\", "$")), universal_rules(code), sentence)
    out = rewritten("other")
    for code in UNIVERSAL_LANGUAGES:
        out = F.when(lang == code, rewritten(code)).otherwise(out)
    return F.filter(F.split(out, r"[ \t\n\r]+"), lambda t: t != "")


def universal_tokens(sents: DataFrame) -> DataFrame:
    """doc_id, lang, sent_id, tok_id (from 1), form."""
    return sents.select("doc_id", "lang", "sent_id", F.posexplode(universal(F.col("sentence"), F.col("lang"))).alias("p", "form")).select("doc_id", "lang", "sent_id", (F.col("p") + 1).alias("tok_id"), "form")
