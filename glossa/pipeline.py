"""An annotator over tables of documents: sentences, tokens, tags, entities, trees, arguments, entity clusters.

Each step takes and returns DataFrames, so a whole corpus is annotated by one plan. Steps that need a model take it as a
table of weights (feature, label, w), as `operators.learn` makes and saves them; without one the rules of the silver corpus stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import coreference as R
from glossa.operators import corpus as C
from glossa.operators import decode as D
from glossa.operators import learn as L
from glossa.operators import packed as A
from glossa.operators import semantics as S
from glossa.operators import treelearn as TL


class Annotator:
    """Settings and models of one run; `models` has weights by step: tables for tag and entity, an array for parse."""

    def __init__(self, models: dict | None = None, tokenizer: str = "treebank"):
        if tokenizer not in ("treebank", "whitespace", "offsets"):
            raise ValueError(f"unknown tokenizer {tokenizer}")
        self.models, self.tokenizer = models or {}, tokenizer

    def has(self, step: str) -> bool:
        return step in self.models

    def split_sentences(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang, sent_id, sentence."""
        return X.sentences(docs)

    def tokenize(self, sentences: DataFrame) -> DataFrame:
        """doc_id, sent_id, tok_id, form and the tokenizer's other columns."""
        if self.tokenizer == "offsets":
            return X.offset_tokens(sentences).withColumnRenamed("token", "form")
        return X.treebank_tokens(sentences) if self.tokenizer == "treebank" else X.whitespace_tokens(sentences)

    def tag(self, tokens: DataFrame) -> DataFrame:
        """tokens with tag: the label of the largest sum of the features' weights; a token without known features has none."""
        if not self.has("tag"):
            raise ValueError("tagging needs a model: models={'tag': weights}")
        features = L.feature_rows(tokens.withColumn("tag", F.lit(None).cast("string")))
        best = L.best_labels(L.scored(features.drop("tag"), self.models["tag"])).select(*C.SENT, "tok_id", F.col("label").alias("tag"))
        return tokens.drop("tag").join(best, [*C.SENT, "tok_id"], "left")

    def recognize_entities(self, tagged: DataFrame, kinds: list[str]) -> DataFrame:
        """doc_id, sent_id, start, end, type: runs of the kinds of tags."""
        return C.spans(C.typed_tags(tagged, "tag", kinds))

    def parse(self, tagged: DataFrame, limits: DataFrame, scores: DataFrame | None = None, projective: bool = False) -> DataFrame:
        """tagged with head: the best tree over arcs within the limits, by scores (doc_id, sent_id, h, m, score; missing ones count 0) or
        by the model of `treelearn.trained` that models["parse"] has."""
        decoder, heads = D.projective if projective else D.arborescence, tagged.withColumn("head", F.lit(-1))
        if scores is not None:
            arcs = C.pruned_arcs(heads, limits, keep_gold=False).drop("gold")
            found = D.parsed(arcs.join(scores, [*C.SENT, "h", "m"], "left").fillna(0.0, ["score"]), decoder)
        elif self.has("parse"):
            rows = A.sentence_rows(heads, "form", "tag", "head")
            found = A.parsed(rows, limits, decoder, TL.scorer(rows, self.models["parse"]), columns=("form",))
        else:
            raise ValueError("parsing needs scores of arcs or a model: models={'parse': weights}")
        return tagged.drop("head").join(found.select(*C.SENT, F.col("m").alias("tok_id"), F.col("h").alias("head")), [*C.SENT, "tok_id"], "left")

    def parse_semantic_dependencies(self, parsed: DataFrame) -> DataFrame:
        """doc_id, sent_id, p, a, predicate, role."""
        return S.predicate_arguments(parsed)

    def resolve_coreferences(self, parsed: DataFrame, kinds: list[str]) -> DataFrame:
        """Mentions with their entity: doc_id, sent_id, start, end, kind, ord, entity."""
        runs = S.descendant_runs(parsed, C.ancestors(parsed), F.col("tag").isin("NOUN", "PROP"))
        found = S.mentions(self.recognize_entities(parsed, kinds), S.biggest_by_head(runs))
        clusters = R.entity_clusters(R.document_rows(found)).select("doc_id", F.col("k").alias("ord"), "entity")
        return found.join(clusters, ["doc_id", "ord"])
