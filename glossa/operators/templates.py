"""Feature template tables of the annotators: each template is a name and the columns whose values it joins.

The columns are made once, by windows over a sentence; all templates of a table are one array in one projection. The same
table gives the SQL that says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import prefix, suffix, word_shape
from glossa.operators.corpus import START, STOP, in_order
from glossa.operators.learn import compiled

PLACES = (-2, -1, 0, 1, 2)


def _name(kind: str, k: int) -> str:
    return f"{kind}{'m' if k < 0 else 'p' if k else ''}{abs(k) or ''}"


#: Named entities: words, tags and shapes round a token, their runs, affixes.
ENTITY = [
    ("bias", []), *[(f"w{k}", [_name("w", k)]) for k in PLACES], *[(f"t{k}", [_name("t", k)]) for k in PLACES], *[(f"sh{k}", [_name("sh", k)]) for k in PLACES],
    ("tt-1", ["tm1", "t"]), ("tt+1", ["t", "tp1"]), ("ttt", ["tm1", "t", "tp1"]), ("tt-2", ["tm2", "tm1"]), ("tt+2", ["tp1", "tp2"]), ("wt", ["w", "t"]),
    *[(f"p{n}", [f"pre{n}"]) for n in range(1, 4)], *[(f"s{n}", [f"suf{n}"]) for n in range(1, 4)],
]
#: Morphology: affixes of a token and its neighbours, words with their tags.
MORPHOLOGY = [
    ("bias", []), *[(f"w{k}", [_name("w", k)]) for k in PLACES], *[(f"t{k}", [_name("t", k)]) for k in PLACES], *[(f"wt{k}", [_name("w", k), _name("t", k)]) for k in PLACES],
    *[(f"p{n}", [f"pre{n}"]) for n in range(1, 5)], *[(f"s{n}", [f"suf{n}"]) for n in range(1, 5)], *[(f"s{n}t", [f"suf{n}", "t"]) for n in range(1, 5)],
    ("s3-1", ["suf3m1"]), ("s3+1", ["suf3p1"]), ("s3-1t", ["suf3m1", "t"]), ("s3+1t", ["suf3p1", "t"]),
]
#: Arcs: the modifier's and its head's words and tags, their neighbours, direction and distance.
ARC = [
    ("bias", []), ("dir", ["dir"]), ("dist", ["dist"]), ("hw", ["hw"]), ("ht", ["ht"]), ("mw", ["w"]), ("mt", ["t"]), ("hw,ht", ["hw", "ht"]), ("mw,mt", ["w", "t"]),
    ("hw,mw", ["hw", "w"]), ("ht,mt", ["ht", "t"]), ("hw,mt", ["hw", "t"]), ("ht,mw", ["ht", "w"]), ("hw,ht,mt", ["hw", "ht", "t"]), ("ht,mw,mt", ["ht", "w", "t"]), ("hw,ht,mw,mt", ["hw", "ht", "w", "t"]),
    ("ht,mt,dir", ["ht", "t", "dir"]), ("ht,mt,dist", ["ht", "t", "dist"]), ("hw,mw,dir", ["hw", "w", "dir"]),
    ("ht-1,ht,mt", ["htm1", "ht", "t"]), ("ht,ht+1,mt", ["ht", "htp1", "t"]), ("ht,mt-1,mt", ["ht", "tm1", "t"]), ("ht,mt,mt+1", ["ht", "t", "tp1"]),
    ("ht-1,ht,mt-1,mt", ["htm1", "ht", "tm1", "t"]), ("ht,ht+1,mt,mt+1", ["ht", "htp1", "t", "tp1"]), ("ht-1,ht,mt,mt+1", ["htm1", "ht", "t", "tp1"]), ("ht,ht+1,mt-1,mt", ["ht", "htp1", "tm1", "t"]),
]
#: Labels: the modifier with its head and its neighbouring modifiers.
LABEL = [
    ("bias", []), ("mt", ["t"]), ("mw", ["w"]), ("ht,mt", ["ht", "t"]), ("ht,mt,dir", ["ht", "t", "dir"]), ("mt,sib", ["t", "sib"]), ("ht,mt,sib", ["ht", "t", "sib"]), ("mw,sib", ["w", "sib"]), ("mt,gt", ["t", "gt"]), ("ht,mt,gt", ["ht", "t", "gt"]),
]
TABLES = {"entity": ENTITY, "morphology": MORPHOLOGY, "arc": ARC, "label": LABEL}


def columns(tokens: DataFrame) -> DataFrame:
    """tokens with the columns that templates name; those of a head are null for tokens under the root."""
    w, f = in_order(), F.col("form")

    def near(c: Column, k: int) -> Column:
        return c if not k else F.coalesce(F.lag(c, -k).over(w), F.lit(START)) if k < 0 else F.coalesce(F.lead(c, k).over(w), F.lit(STOP))

    parts = {_name("w", k): near(f, k) for k in PLACES} | {_name("t", k): near(F.col("tag"), k) for k in PLACES} | {_name("sh", k): near(word_shape(f), k) for k in PLACES}
    parts |= {f"pre{n}": F.when(F.length("form") >= n, prefix(f, n)) for n in range(1, 5)} | {f"suf{n}": F.when(F.length("form") >= n, suffix(f, n)) for n in range(1, 5)}
    parts |= {_name("suf3", k): near(F.coalesce(F.when(F.length("form") >= 3, suffix(f, 3)), F.lit("")), k) for k in (-1, 1)}
    own = tokens.withColumns(parts)
    key = ["doc_id", "sent_id"]
    head = own.select(*key, F.col("tok_id").alias("head"), F.col("w").alias("hw"), F.col("t").alias("ht"), F.col("tm1").alias("htm1"), F.col("tp1").alias("htp1"), F.col("head").alias("grand"))
    grand = tokens.select(*key, F.col("tok_id").alias("grand"), F.col("tag").alias("gt"))
    full = own.join(head, [*key, "head"], "left").join(grand, [*key, "grand"], "left")
    apart = F.abs(F.col("head") - F.col("tok_id"))
    direction = F.when(F.col("head") == 0, "root").when(F.col("head") < F.col("tok_id"), "left").otherwise("right")
    distance = F.when(F.col("head") == 0, "root").when(apart <= 3, apart.cast("string")).otherwise("4+")
    sibling = F.coalesce(F.lag("tag").over(w.partitionBy(*key, "head").orderBy("tok_id")), F.lit(START))
    return full.withColumns({"dir": direction, "dist": distance, "sib": sibling})


def counted(tokens: DataFrame, table: list[tuple[str, list[str]]]) -> DataFrame:
    """template, n, n_distinct: features of each template and different ones."""
    rows = columns(tokens).select(F.explode(compiled(table)).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return rows.groupBy(F.substring_index("feature", ":", 1).alias("template")).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


def sql(table: list[tuple[str, list[str]]]) -> str:
    """The same as `counted` over the SQL table tok."""
    shape = "form"
    for pattern, to in (("[A-Z]{2,}", "'A+'"), ("[A-Z]", "'A'"), ("[a-z]{2,}", "chr(1)"), ("[a-z]", "'a'"), ("[0-9]{2,}", "'0+'"), ("[0-9]", "'0'")):
        shape = f"regexp_replace({shape}, '{pattern}', {to}, 'g')"
    shape = f"replace({shape}, chr(1), 'a+')"

    def near(x: str, k: int) -> str:
        return x if not k else f"coalesce(lag({x}, {-k}) over k, '{START}')" if k < 0 else f"coalesce(lead({x}, {k}) over k, '{STOP}')"

    parts = {_name("w", k): near("form", k) for k in PLACES} | {_name("t", k): near("tag", k) for k in PLACES} | {_name("sh", k): near("shape", k) for k in PLACES}
    parts |= {f"pre{n}": f"case when length(form) >= {n} then substring(form, 1, {n}) end" for n in range(1, 5)} | {f"suf{n}": f"case when length(form) >= {n} then right(form, {n}) end" for n in range(1, 5)}
    parts |= {_name("suf3", k): near("coalesce(case when length(form) >= 3 then right(form, 3) end, '')", k) for k in (-1, 1)}
    own = f"select doc_id, sent_id, tok_id, head, tag, {', '.join(f'{v} as {k}' for k, v in parts.items())}, coalesce(lag(tag) over (partition by doc_id, sent_id, head order by tok_id), '{START}') as sib from (select *, {shape} as shape from tok) window k as (partition by doc_id, sent_id order by tok_id)"
    used = {c for _, cols in table for c in cols}
    if used & {"hw", "ht", "htm1", "htp1", "gt", "dir", "dist"}:
        base = f"""select m.*, h.w as hw, h.t as ht, h.tm1 as htm1, h.tp1 as htp1, g.tag as gt, case when m.head = 0 then 'root' when m.head < m.tok_id then 'left' else 'right' end as dir,
 case when m.head = 0 then 'root' when abs(m.head - m.tok_id) <= 3 then abs(m.head - m.tok_id)::varchar else '4+' end as dist from ({own}) m left join ({own}) h on h.doc_id = m.doc_id and h.sent_id = m.sent_id and h.tok_id = m.head left join tok g on g.doc_id = m.doc_id and g.sent_id = m.sent_id and g.tok_id = h.head"""
    else:
        base = own
    features = ", ".join(" || ':' || ".join([f"'{name}'", *cols]) for name, cols in table)
    return f"select split_part(feature, ':', 1) as template, sum(n)::bigint as n, count(*) as n_distinct from (select feature, count(*) as n from (select unnest([{features}]) as feature from ({base})) where feature is not null group by 1) group by 1"
