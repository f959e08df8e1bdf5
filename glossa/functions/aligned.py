"""Tokenisation with places: ordered rewrites that carry, for each character, where it came from.

A character that a rewrite keeps (by a group, or as one of the same characters in the same order) keeps its place; what is
written instead of others takes the place of all of them. A token reaches from its first character's start to its last one's end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glossa.functions.text import TREEBANK, UNIVERSAL_LANGUAGES, universal_rules

Rule = tuple[regex.Pattern, tuple[str | int, ...]]
Places = list[tuple[int, int]]


def rule(pattern: str, to: str) -> Rule:
    """A rewrite in the syntax of the column functions: groups as $1 or \\1, white space of ASCII only."""
    for short, long in ((r"\S", r"[^ \t\n\x0B\f\r]"), (r"\s", r"[ \t\n\x0B\f\r]"), (r"\z", r"\Z")):
        pattern = pattern.replace(short, long)
    pieces = regex.split(r"[$\\](\d)", to)
    return regex.compile(pattern), tuple(p for p in (int(x) if i % 2 else x for i, x in enumerate(pieces)) if p != "")


def _written(text: str, source: str, places: Places, edge: int) -> Places:
    """Places of a literal that stands for source, whose characters have the places given."""
    own = [(c, p) for c, p in zip(source, places, strict=True) if c != " "]
    if [c for c, _ in own] == [c for c in text if c != " "]:
        each = iter([p for _, p in own])
        return [(edge, edge) if c == " " else next(each) for c in text]
    whole = (own[0][1][0], own[-1][1][1]) if own else (edge, edge)
    return [whole] * len(text)


def rewritten(text: str, places: Places, rules: Sequence[Rule]) -> tuple[str, Places]:
    for pattern, parts in rules:
        if not pattern.search(text):
            continue
        out: list[str] = []
        to: Places = []
        last = 0
        for m in pattern.finditer(text):
            out.append(text[last : m.start()])
            to += places[last : m.start()]
            at = m.start()
            for k, part in enumerate(parts):
                if isinstance(part, int):
                    a, z = m.span(part)
                    out.append(text[a:z])
                    to += places[a:z]
                    at = z
                else:
                    then = next((m.start(p) for p in parts[k + 1 :] if isinstance(p, int)), m.end())
                    edge = places[at - 1][1] if at else 0
                    out.append(part)
                    to += _written(part, text[at:then], places[at:then], edge)
                    at = then
            last = m.end()
        if last or out:
            text, places = "".join(out) + text[last:], to + places[last:]
    return text, places


def tokens_of(text: str, places: Places) -> list[tuple[str, int, int]]:
    """Tokens between white space, with start and end (exclusive)."""
    return [(m[0], places[m.start()][0], places[m.end() - 1][1]) for m in regex.finditer(r"[^ \t\n\r]+", text)]


@lru_cache(maxsize=1)
def _treebank() -> list[Rule]:
    return [rule(r"[ \t\n\r]+", " "), *[rule(*r) for r in TREEBANK]]


@lru_cache(maxsize=16)
def _universal(lang: str) -> list[Rule]:
    return [rule(*r) for r in universal_rules(lang)]


def treebank(sentence: str, lang: str | None = None) -> list[tuple[str, int, int]]:
    """Treebank-style tokens of a sentence with their places."""
    n = len(sentence)
    return tokens_of(*rewritten(f" {sentence} ", [(0, 0), *[(i, i + 1) for i in range(n)], (n, n)], _treebank()))


def universal(sentence: str, lang: str | None = None) -> list[tuple[str, int, int]]:
    """Tokens by the rules of a language, with their places."""
    return tokens_of(*rewritten(sentence, [(i, i + 1) for i in range(len(sentence))], _universal(lang if lang in UNIVERSAL_LANGUAGES else "other")))


#: What takes more than marks that always stand alone and a period at the end.
_RARE = re.compile(r"""['"()\[\]{}<>`]|--|\.\.\.|[Cc]annot|[Gg]imme|[Gg]onna|[Gg]otta|[Ll]emme|[Ww]anna""")
_PLAIN = re.compile(r"[,;:@#$%&?!]|[^ \t\n\r,;:@#$%&?!]+")


def plain_treebank(sentence: str) -> list[str] | None:
    """Treebank-style tokens where each is a piece of the sentence and together they cover it; None where other rules may apply."""
    if _RARE.search(sentence):
        return None
    found = _PLAIN.findall(sentence)
    if found and len(found[-1]) > 1 and found[-1][-1] == "." != found[-1][-2]:
        found[-1:] = [found[-1][:-1], "."]
    return found


def covered_treebank(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, n, forms, covered of each sentence with treebank-style tokens: how many, joined by blanks, and the characters at
    their places without white space. Made where the sentence is, without a row for each token."""
    space = str.maketrans("", "", " \t\n\r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], []
            for i, s in enumerate(b.column("sentence").to_pylist()):
                if (plain := plain_treebank(s)) is not None:
                    row = (len(plain), " ".join(plain), "".join(plain))
                else:
                    found = treebank(s)
                    row = (len(found), " ".join([f for f, _, _ in found]), "".join([s[a:z] for _, a, z in found]).translate(space))
                if row[0]:
                    at.append(i)
                    out.append(row)
            n, forms, covered = zip(*out, strict=True) if out else ((), (), ())
            own = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(own) for c in ("doc_id", "sent_id")], pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(covered, pa.string())], names=["doc_id", "sent_id", "n", "forms", "covered"])

    return sents.select("doc_id", "sent_id", "sentence").mapInArrow(run, "doc_id bigint, sent_id int, n bigint, forms string, covered string")


def aligned_tokens(sents: DataFrame, tokenise: Callable[[str, str | None], list[tuple[str, int, int]]] = treebank) -> DataFrame:
    """doc_id, lang, sent_id, tok_id (from 1), form, start, end: tokens with their places in the sentence, in code points.

    Where no rewrite changed a token, substring(sentence, start + 1, end - start) is the token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 2000):
                b = big.slice(k, 2000)
                found = [tokenise(s, x) for s, x in zip(b.column("sentence").to_pylist(), b.column("lang").to_pylist(), strict=True)]
                of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                flat = [x for f in found for x in f]
                form, start, end = zip(*flat, strict=True) if flat else ((), (), ())
                numbers = [pa.array([i for f in found for i in range(1, len(f) + 1)], pa.int32()), pa.array(form, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in ("doc_id", "lang", "sent_id")], *numbers], names=["doc_id", "lang", "sent_id", "tok_id", "form", "start", "end"])

    return sents.select("doc_id", "lang", "sent_id", "sentence").mapInArrow(run, "doc_id bigint, lang string, sent_id int, tok_id int, form string, start int, end int")
