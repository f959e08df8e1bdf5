"""Corpus files as token tables and back: blocks of tab-separated lines, one block a sentence.

A block is read as one record (lineSep), so files split and sentence ids are exact without a global window: a sentence is
numbered by its place among its file's blocks within the reading task. Empty blocks are skipped and a last block without
a blank line is kept. Blank lines may hold blanks and lines may end in CR LF (then a file is one record).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VARIANTS = {
    "tagging": ["form", "tag"],
    "ner": ["form", "pos", "tag"],
    "conllx": ["id", "form", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel"],
    "morph": ["id", "form", "lemma", "cpos", "pos", "feats"],
}


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, sent_id, block of each sentence with a token."""
    parts = F.split(F.regexp_replace("value", "\r", ""), "\n[ \t]*\n")
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.input_file_name().alias("path"), F.explode(parts).alias("block"))
    rows = rows.select("path", F.regexp_replace("block", "^[\n \t]+|[\n \t]+$", "").alias("block")).where("block <> ''")
    return rows.select("path", F.monotonically_increasing_id().alias("sent_id"), "block")


def fields(line: Column, variant: str) -> Column:
    """Fields of a line. Empty fields are dropped, as corpora with repeated separators want; the morph variant keeps them."""
    parts = F.split(line, "[ \t]" if variant == "ner" else "\t")
    return parts if variant == "morph" else F.filter(parts, lambda p: p != "")


def read(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """path, sent_id, tok_id (from 1) and the variant's columns. # lines and ids of ranges (3-4) are skipped.

    A line with too few fields fails (of two-column files any but two), as do a head beyond the sentence and ids that don't run
    from 1 by 1.
    """
    names = VARIANTS[variant]
    lines = F.filter(F.split("block", "\n"), lambda x: (x != "") & ~x.startswith("#") & ~x.rlike("^[0-9]+-[0-9]+\t"))
    t = blocks(spark, path).select("path", "sent_id", F.size(lines).alias("n"), F.posexplode(lines).alias("p", "line")).withColumn("f", fields(F.col("line"), variant))
    least = len(names) if variant in ("tagging", "ner") else 8 if variant == "conllx" else 6
    t = t.withColumn("f", F.when(F.size("f") >= least, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), "line"))))
    if variant == "tagging":
        t = t.withColumn("f", F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), "line"))))
    if variant == "conllx":
        t = t.withColumn("f", F.when(F.get("f", F.lit(0)) == (F.col("p") + 1).cast("string"), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("ids don't run from 1: "), "line"))))
    t = t.select("path", "sent_id", (F.col("p") + 1).alias("tok_id"), "n", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)])
    if variant == "conllx":
        head = F.col("head").cast("int")
        t = t.withColumn("head", F.when(head.between(0, F.col("n")), head).otherwise(F.raise_error(F.lit("a head lies beyond its sentence"))))
        t = t.withColumn("feats", F.when(F.col("feats") == "_", F.array().cast("array<string>")).otherwise(F.split("feats", r"\|"))).drop("id", "phead", "pdeprel")
    return t.drop("n", "id")


#: Columns before the arguments: places of form, lemma, tag, head, label and predicate's name in the two layouts of role corpora.
ROLE_LAYOUTS = {"conll2008": {"form": 5, "lemma": 6, "pos": 7, "head": 8, "deprel": 9, "predicate": 10, "args": 11}, "sdp": {"form": 1, "lemma": 2, "pos": 3, "head": 4, "deprel": 5, "top": 6, "marked": 7, "predicate": 8, "args": 9}}


def read_roles(spark: SparkSession, path: str, layout: str) -> tuple[DataFrame, DataFrame]:
    """Tokens (path, sent_id, name, tok_id, form, lemma, pos, head, deprel, top, predicate) and args (path, sent_id, p, a, role).

    The k-th argument column is of the sentence's k-th predicate: in conll2008 a token with a name, in sdp one marked +.
    name is the text of the block's # lines; a head beyond the sentence counts as 0; top is false where the layout has none.
    """
    at = ROLE_LAYOUTS[layout]
    every = F.split("block", "\n")
    rows = F.filter(every, lambda x: (x != "") & ~x.startswith("#"))
    name = F.array_join(F.transform(F.filter(every, lambda x: x.startswith("#")), lambda x: F.trim(F.substr(x, F.lit(2)))), " ")
    t = blocks(spark, path).select("path", "sent_id", name.alias("name"), F.size(rows).alias("n"), F.posexplode(rows).alias("p", "line")).withColumn("f", F.split("line", "\t", -1))
    field = lambda c: F.get("f", F.lit(at[c]))
    named = (field("marked") == "+") if "marked" in at else (field("predicate") != "_")
    head = F.col("head").cast("int")
    t = t.withColumn("f", F.when(F.size("f") >= at["args"], F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), "line"))))
    t = t.select("path", "sent_id", "name", "n", (F.col("p") + 1).alias("tok_id"), *[field(c).alias(c) for c in ("form", "lemma", "pos", "head", "deprel")], (field("top") == "+" if "top" in at else F.lit(False)).alias("top"), F.when(named, field("predicate")).alias("predicate"), named.alias("named"), F.slice("f", F.lit(at["args"] + 1), F.greatest(F.lit(0), F.size("f") - at["args"])).alias("args"))
    t = t.withColumn("head", F.when(head.between(0, F.col("n")), head).otherwise(0))
    order = Window.partitionBy("path", "sent_id").orderBy("tok_id")
    predicates = t.where("named").select("path", "sent_id", F.col("tok_id").alias("p"), (F.row_number().over(order) - 1).alias("k"))
    args = t.select("path", "sent_id", F.col("tok_id").alias("a"), F.posexplode("args").alias("k", "role")).where("role <> '_' and role <> ''")
    return t.drop("n", "named", "args"), args.join(predicates, ["path", "sent_id", "k"]).select("path", "sent_id", "p", "a", "role")


def read_coreference(spark: SparkSession, path: str) -> DataFrame:
    """doc, part, sent_id (from 0), tok_id (from 1), form, pos, parse, head, deprel, predicate, sense, word_sense, speaker, entity, args, bit.

    A document, framed by `#begin document (name); part 000` and `#end document`, is one record; entity spans of the columns of
    brackets come from `corpus.bracket_spans`.
    """
    raw = spark.read.option("lineSep", "#begin document ").text(path).where("trim(value) <> ''")
    docs = raw.select(F.regexp_extract("value", r"^\((.*?)\); part (\d+)", 1).alias("doc"), F.regexp_extract("value", r"^\((.*?)\); part (\d+)", 2).cast("int").alias("part"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^[^\n]*\n|#end document[\s\S]*$", "").alias("body"))
    blocks_ = F.filter(F.transform(F.split("body", "\n[ \t]*\n"), lambda x: F.trim(F.regexp_replace(x, "^\n+|\n+$", ""))), lambda x: x != "")
    sents = docs.select("doc", "part", F.posexplode(blocks_).alias("sent_id", "block"))
    rows = sents.select("doc", "part", "sent_id", F.posexplode(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).alias("p", "line")).withColumn("f", F.filter(F.split("line", r"[ \t]+"), lambda x: x != ""))
    rows = rows.withColumn("f", F.when(F.size("f") >= 14, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), "line"))))
    names = ("form", "pos", "parse", "head", "deprel", "predicate", "sense", "word_sense", "speaker", "entity")
    columns = [F.get("f", F.lit(i)).cast("int").alias(c) if c == "head" else F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names, 3)]
    return rows.select("doc", "part", "sent_id", (F.col("p") + 1).alias("tok_id"), *columns, F.slice("f", F.lit(14), F.size("f") - 14).alias("args"), F.element_at("f", -1).alias("bit"))


def lines(tokens: DataFrame, variant: str, keys: tuple[str, ...] = ("sent_id",), compat: bool = False) -> DataFrame:
    """keys, block: sentences as text. compat: eight columns without features, as older tools write."""
    if variant == "tagging":
        cols = [F.col("form"), F.col("tag")]
    elif variant == "ner":
        cols = [F.col("form"), F.col("pos"), F.col("tag")]
    else:
        feats = F.lit("_") if compat else F.when(F.size("feats") > 0, F.array_join("feats", "|")).otherwise("_")
        cols = [F.col("tok_id").cast("string"), F.col("form"), F.col("lemma"), F.col("cpos"), F.col("pos"), feats, F.col("head").cast("string"), F.col("deprel")]
        cols += [] if compat else [F.lit("_"), F.lit("_")]
    rows = tokens.select(*keys, "tok_id", F.concat_ws("\t", *cols).alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "line"))), lambda x: x["line"]), "\n").alias("block"))


def write(tokens: DataFrame, path: str, variant: str, keys: tuple[str, ...] = ("sent_id",), compat: bool = False) -> None:
    lines(tokens, variant, keys, compat).select(F.col("block").alias("value")).write.option("lineSep", "\n\n").text(path)


def save_model(path: str, **tables: DataFrame) -> None:
    """A model is a folder of Parquet tables."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
