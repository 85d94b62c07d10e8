"""Registered queries of the corpus operators. Each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm import langid, manifest, mincut, mixing, privacy, tokencount, toxicity, urlfilter, vectorcodes
from pixeltide.llm.cells import near_vectors
from pixeltide.llm.common import table
from pixeltide.llm.decontaminate import matches
from pixeltide.llm.minhash import near_duplicates
from pixeltide.llm.repeats import drop_repeats


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mixture(docs, table(spark, sf_dir, "labels"))
    shares = [mixed.shares[k].alias(f"share_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "miss")


def op4_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(table(spark, sf_dir, "documents"), everywhere=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.length_histogram(tokencount.encoded_lengths(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.learn(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"]).drop("spans", "known", "fit", "letters")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mincut.main_texts(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampering_report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_report(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = toxicity.learn(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs, model, ["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_url_filter": op2_url_filter,
    "op3_mixing": op3_mixing,
    "op4_embedding_cells": op4_embedding_cells,
    "op5_decontamination": op5_decontamination,
    "op6_privacy": op6_privacy,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_suffix_array": op9_suffix_array,
    "op10_html": op10_html,
    "op11_manifest": op11_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_toxicity": op13_toxicity,
}

_REACH = """reach(node, root) as (
    select id, id from vertices union select l.b, r.root from reach r join links l on l.a = r.node where l.b > r.root)"""

_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# The table-driven checksum without its table: a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""


def _codebook_rounds(rounds: int) -> str:
    """Assignment to the nearest entry and the entries' means, round after round."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} as materialized (
    select part, id, any_value(x) as x, min({{'d': d, 'e': e}}) as best from (
        select p.part, p.id, p.x, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
        from p join b{k} b on p.part = b.part) group by part, id)""")
        if k < rounds:
            out.append(f"""m{k + 1} as (
    select part, e, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as x from (
        select part, best.e as e, i, sum(x[i]) as s, count(*) as n from a{k}, range(1, len(x) + 1) r(i) group by 1, 2, 3) group by 1, 2),
b{k + 1} as materialized (select b.part, b.e, coalesce(m.x, b.x) as x from b{k} b left join m{k + 1} m on m.part = b.part and m.e = b.e)""")
    return ",\n".join(out)


ORACLES: dict[str, str] = {
    # Sets by words, links by counting shared shingles, components by walking links away from each document.
    "op1_minhash": f"""
with recursive words as (
    select doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as materialized (
    select id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
vertices as (select id from sets),
flat as materialized (select id, len(s) as n, unnest(s) as shingle from sets),
pairs as (select x.id as a, y.id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as shared from flat x join flat y on x.shingle = y.shingle and x.id < y.id group by 1, 2),
half as materialized (select a, b from pairs where 100 * shared >= 75 * (na + nb - shared)),
links as materialized (select a, b from half union all select b, a from half),
{_REACH}
select s.id as doc_id, cast(len(s.s) as bigint) as n_shingles, c.root as component_id, cast(c.root = s.id as boolean) as kept
from sets s join (select node, min(root) as root from reach group by 1) c on c.node = s.id""",
    "op4_embedding_cells": f"""
with recursive fine as materialized (
    select vec_id as id, cast(embedding as double[]) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
vertices as (select vec_id as id from embeddings),
half as materialized (select x.id as a, y.id as b from fine x join fine y on x.id < y.id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.95),
links as materialized (select a, b from half union all select b, a from half),
{_REACH}
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.root as component_id, cast(c.root = e.vec_id as boolean) as kept
from embeddings e join (select node, min(root) as root from reach group by 1) c on c.node = e.vec_id
left join (select a, count(*) as n from links group by 1) n on n.a = e.vec_id""",
    # Levels by walking up from the leaves; the fold walks each document's path once more from its altered leaf.
    "op11_manifest": f"""
with recursive leaves as materialized (
    select doc_id, lang, {_LEAF.format(n="n_chars")} as leaf, {_LEAF.format(n="n_chars + 1")} as altered, n_chars is not null and {_CRC} % 7 = 0 as tampered from documents),
ranked as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r from leaves),
tree(lang, lvl, i, digest) as (
    select lang, 0, r, leaf from ranked union all
    select lang, lvl + 1, i // 2, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over (partition by lang) as n from tree) where n > 1 group by lang, lvl, i // 2),
subs as materialized (select lang, max(lvl) as height, arg_max(digest, lvl) as subroot from tree group by lang),
tops as materialized (select *, row_number() over (order by lang nulls first) - 1 as r from subs),
top(lvl, i, digest) as (
    select 0, r, subroot from tops union all
    select lvl + 1, i // 2, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over () as n from top) where n > 1 group by lvl, i // 2),
head as materialized (select max(lvl) as height, arg_max(digest, lvl) as root from top),
places as materialized (
    select d.doc_id, l.lvl as step, (d.r >> l.lvl) & 1 as odd, t.digest as sibling
    from ranked d join subs s on d.lang is not distinct from s.lang, lateral (select unnest(range(s.height)) as lvl) l
    left join tree t on t.lang is not distinct from d.lang and t.lvl = l.lvl and t.i = xor(d.r >> l.lvl, 1)
    union all
    select d.doc_id, s.height + l.lvl, (s.r >> l.lvl) & 1, t.digest
    from ranked d join tops s on d.lang is not distinct from s.lang, head h, lateral (select unnest(range(h.height)) as lvl) l
    left join top t on t.lvl = l.lvl and t.i = xor(s.r >> l.lvl, 1)),
fold(doc_id, step, own) as (
    select doc_id, 0, case when tampered then altered else leaf end from ranked union all
    select f.doc_id, f.step + 1, sha256(case when p.odd = 1 then coalesce(p.sibling, '') || f.own else f.own || coalesce(p.sibling, '') end)
    from fold f join places p on p.doc_id = f.doc_id and p.step = f.step),
proof as (select doc_id, sha256(coalesce(string_agg(sibling, '' order by step), '')) as proof_sha256 from places group by 1)
select d.doc_id, d.leaf, s.subroot, h.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.own as folded_root, f.own = h.root as verified
from ranked d join subs s on d.lang is not distinct from s.lang, head h left join proof p on p.doc_id = d.doc_id
join (select doc_id, arg_max(own, step) as own from fold group by 1) f on f.doc_id = d.doc_id""",
    # Every part with every entry of its codebook, four rounds and once more.
    "op12_vector_codes": f"""
with kept as materialized (
    select vec_id as id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as materialized (select id, k as part, v[k * len(v) // 4 + 1:(k + 1) * len(v) // 4] as x from kept, range(4) r(k)),
b0 as materialized (select part, row_number() over (partition by part order by id) - 1 as e, x from p qualify e < 256),
{_codebook_rounds(4)},
done as (select id, string_agg(printf('%02x', best.e), '' order by part) as code, cast(sum(best.d) as bigint) as error from a4 group by id),
books as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) as codebooks_sha256 from b4)
select k.id as vec_id, d.code, d.error, cast(sum(d.error) over (partition by k.label) as bigint) as label_error, b.codebooks_sha256
from kept k join done d on d.id = k.id, books b""",
}
