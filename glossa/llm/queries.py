"""The operators' queries over the driver's tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import audit, bpe, fingerprint, licenses, manifest, mixing, neardup, pii, quality, repeats, sharding, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), bpe.vocabulary_path(spark))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: Shards of the registered query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def edit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by fingerprints' bands and edit similarity."""
    return fingerprint.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if (k.startswith("op") or k == "edit_classes") and callable(v)}



ORACLES = {
    "op8_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select *, min(case when payload_bytes >= 100 then page_id end) over (partition by payload_digest) as first from p)
        select page_id, payload_bytes, payload_digest,
          case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
          case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f""",
    "op12_manifest": """
        with recursive d as (select *, coalesce('=' || lang, '-') as tree,
            coalesce(octet_length(encode(doc_id::varchar))::varchar || ':' || doc_id, '-') || coalesce(octet_length(encode(source))::varchar || ':' || source, '-')
            || coalesce(octet_length(encode(lang))::varchar || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar))::varchar || ':' || n_chars, '-') as head,
            translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as small from documents),
        t as (select tree, doc_id, sha256(head || coalesce(octet_length(encode("text"))::varchar || ':' || "text", '-')) as leaf,
            sha256(head || coalesce(octet_length(encode(small))::varchar || ':' || small, '-')) as bent,
            xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint),
              lambda a, x: list_reduce([xor(a, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 3 = 0 as tampered from d),
        leaf0 as (select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as idx, count(*) over (partition by tree) as n from t),
        nodes as (select tree, 0 as level, idx, leaf as h, n from leaf0
            union all
            select tree, level + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (n + 7) // 8 from nodes where n > 1 group by tree, level, idx // 8, n),
        subs as (select tree, h as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as n from nodes where n = 1),
        tops as (select 0 as level, idx, subroot as h, n from subs
            union all
            select level + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (n + 7) // 8 from tops where n > 1 group by level, idx // 8, n),
        depth as (select tree, max(level) as deep from nodes group by tree),
        every as (select tree, level, idx, h, n from nodes where n > 1
            union all select s.tree, d.deep + t.level, t.idx, t.h, t.n from tops t, subs s, depth d where d.tree = s.tree and t.n > 1),
        runs as (select tree, level, idx // 8 as run, list(h order by idx) as hs from every group by tree, level, idx // 8),
        fold as (select l.tree, l.doc_id, l.idx as leaf_idx, 0 as level, l.idx as at, case when l.tampered then l.bent else l.leaf end as h, '' as proof from leaf0 l
            union all
            select f.tree, f.doc_id, f.leaf_idx, f.level + 1, f.at // 8,
              sha256(array_to_string(r.hs[1:f.at % 8] || [f.h] || r.hs[f.at % 8 + 2:], '')),
              f.proof || array_to_string(r.hs[1:f.at % 8] || r.hs[f.at % 8 + 2:], '')
            from (select f0.tree, f0.doc_id, f0.leaf_idx, f0.level, case when f0.level = d0.deep then s0.idx else f0.at end as at, f0.h, f0.proof from fold f0, depth d0, subs s0 where d0.tree = f0.tree and s0.tree = f0.tree) f, runs r
            where r.tree = f.tree and r.level = f.level and r.run = f.at // 8),
        ends as (select tree, leaf_idx, max_by(h, level) as folded_root, max_by(proof, level) as proof from fold group by tree, leaf_idx),
        root as (select h as root from tops where n = 1)
        select l.doc_id, l.leaf, s.subroot, root.root, sha256(e.proof) as proof_sha256, e.folded_root, e.folded_root = root.root as verified
        from leaf0 l, ends e, subs s, root where e.tree = l.tree and e.leaf_idx = l.idx and s.tree = l.tree""",
    "op13_audit": r"""
        with l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        d as (select doc_id, coalesce(source, '') as part, coalesce("text", '') as txt from documents),
        w as (select *, list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by txt) as least from d),
        m as (select part, doc_id, (case when len(ws) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
            + (case when 100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 2 * length(txt) then 4 else 0 end) + (case when regexp_matches(txt, '[#$%&*|]') then 8 else 0 end)
            + (case when doc_id > least then 16 else 0 end) as mask from w),
        c as (select m.part, m.mask, count(*) as n, sum(coalesce(l.good, 0)) as good, sum(coalesce(l.toxic, 0)) as toxic from m left join l on m.doc_id = l.doc_id group by m.part, m.mask),
        f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
            from f a join f b on b.bit <> a.bit join f c on c.bit not in (a.bit, b.bit) join f d on d.bit not in (a.bit, b.bit, c.bit) join f e on e.bit not in (a.bit, b.bit, c.bit, d.bit)),
        s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest([1, 2, 3, 4, 5]) as step))
        select part, filter_order, step,
          sum(case when mask & (own | before) = 0 then n else 0 end)::bigint as kept,
          sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
          sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
          sum(case when mask = own then n else 0 end)::bigint as unique_fails,
          sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
          sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost,
          sum(case when mask & own <> 0 then n * 120 // bit_count(mask) else 0 end)::bigint as shapley
        from c, s group by part, filter_order, step""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
