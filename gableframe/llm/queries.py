"""The operators bound to the supplied tables, with DuckDB twins where SQL can state them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gableframe.llm import bpe, clusters, collocations, ctw, hyperminhash, langid, licenses, mixing, quality, simhash, substrings, tokencounts, vptree

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.tokens_per_section(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substrings.cut_texts(docs, substrings.repeated_spans(docs)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encoded(table(spark, sf_dir, "documents"), WORD_BPE)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_copies(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_bpe": op10_bpe,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_collocations": op12_collocations,
    "op13_hyperminhash_near_dedup": op13_hyperminhash_near_dedup,
    "pipeline": pipeline,
}


def _clusters_twin(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds one after the other, every distance computed."""
    floor = "((s - ((s % n) + n) % n) // n)::bigint"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} as materialized (select kept.i, min({{'d': list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint,
    'c': c}}) as w from kept, c{i} group by kept.i)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select w.c as c, dim, sum(v[dim])::hugeint as s, count(*)::hugeint as n from d{i} join kept using (i), range(1, 65) t(dim) group by 1, 2),
m{i} as (select c, list({floor} order by dim) as v from s{i} group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (c))""")
    return f"""
with kept as materialized (select row_number() over () as i, vec_id, e, list_transform(e, lambda x: floor(256 * x)::bigint) as v
  from (select vec_id, embedding::double[] as e from embeddings)
  where len(e) = 64 and len(list_filter(e, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), e) - 1 as c, v from kept
  qualify row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), e) <= {k}),{",".join(steps)},
sums as (select w.c as c, sum(w.d)::bigint as x from d{rounds} group by 1)
select vec_id, w.c::integer as cluster, w.d as distance, x as cluster_inertia, (select sum(x) from sums)::bigint as inertia,
  sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from d{rounds} join kept using (i) join c{rounds} on c{rounds}.c = w.c join sums on sums.c = w.c"""


# Words as the contract has them, for DuckDB.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

TWINS: dict[str, str] = {
    "op4_substring_dedup": f"""
with docs as (select doc_id, {_WORDS} as words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 18)) as s from docs where len(words) >= 20),
windows as (select doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) as w from places),
firsts as (select w, min({{'d': doc_id, 's': s}}) as f, count(*) as n from windows group by w having count(*) > 1),
later as (select doc_id, s from windows join firsts using (w) where {{'d': doc_id, 's': s}} <> f),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as pos from later),
gone_of as (select doc_id, list(pos) as ats, count(*) as n from gone group by doc_id)
select doc_id, len(words) as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when n is null then words else
    list_filter(words, lambda x, i: not list_contains(ats, i)) end, ' ')) as kept_sha256
from docs left join gone_of using (doc_id)""",
    "op5_nearest_neighbours": """
with vectors as (select vec_id, embedding::double[] as v from embeddings),
usable as (select vec_id, v from vectors where vec_id is not null and len(v) > 0 and len(v) = len(list_filter(v, lambda x: isfinite(x)))
  and list_inner_product(v, v) > 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from usable q join usable c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op6_mix_sources": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as key from documents),
per as (select source, sum(size)::bigint as source_size,
  [3.0::double, 1.0, 2.0][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight from sized group by source),
capped as (select *, 2.0::double * source_size as cap from per),
tried as (select *,
  ((select sum(source_size) from per)::double * 3 / 2 - coalesce(sum(cap) over w, 0))
  / ((select sum(weight) from per) - coalesce(sum(weight) over w, 0)) * weight > cap as stops
  from capped window w as (order by cap / weight, weight, source is null, source rows between unbounded preceding and 1 preceding)),
goals as (select source, source_size, case when stops then cap else
  ((select sum(source_size) from per)::double * 3 / 2 - coalesce((select sum(cap) from tried where stops), 0))
  / (select sum(weight) from tried where not stops) * weight end as target from tried),
placed as (select sized.*, source_size, target,
  coalesce(sum(size) over (partition by sized.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from sized join goals on sized.source is not distinct from goals.source)
select doc_id, size, source_size, target, case when source_size = 0 then 0 else
  (floor(target)::bigint // source_size) * size
  + greatest(0, least(size, floor(target)::bigint % source_size - before)) end::bigint as taken
from placed""",
    "op7_quality_rules": rf"""
with docs as (select doc_id, coalesce(text, '') as body, {_WORDS} as words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
places as (select doc_id, unnest(range(1, len(words) - 6)) as s, words from docs where len(words) >= 8),
windows as (select doc_id, s, array_to_string(words[s:s + 7], ' ') as w from places),
again as (select doc_id, s, count(*) over (partition by doc_id, w) as n from windows),
spread as (select distinct doc_id, unnest(range(s, s + 8)) as pos from again where n > 1),
repeats as (select doc_id, count(*) as n from spread group by doc_id),
base as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  len(lines) as n_lines, coalesce(n, 0) as n_repeat_words,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) as n_letter_words
  from docs left join repeats using (doc_id)),
failed as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 10 * n_symbols <= 2 * n_words and 100 * n_dup_lines <= 50 * n_lines
  and word_chars between 2 * n_words and 12 * n_words and 100 * n_letter_words >= 50 * n_words as kept
from failed""",
    "op12_collocations": r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
sizes as (select lang, sum(len(w))::bigint as n from split group by lang),
places as (select lang, w, unnest(range(1, len(w) + 1)) as s from split where len(w) > 0),
grams as (select lang, w[s:s + k - 1] as p, count(*) as f from places join (select unnest([1, 2, 3, 4]) as k) on s + k - 1 <= len(w)
  group by 1, 2 having count(*) >= 30),
longer as (select lang, p, max(f) as most from (
    select lang, p[:len(p) - 1] as p, f from grams where len(p) > 2 union all select lang, p[2:] as p, f from grams where len(p) > 2)
  group by 1, 2),
kept as (select grams.lang, grams.p, f as a from grams left join longer on grams.lang = longer.lang and grams.p = longer.p
  where len(grams.p) > 1 and 100 * coalesce(most, 0) < 80 * f),
cuts as (select lang, p, a, unnest(range(1, len(p))) as k from kept),
scored as (select cuts.*, x.f as l, y.f as r, (2000000::hugeint * a // (x.f + y.f))::bigint as score
  from cuts join grams x on cuts.lang = x.lang and cuts.p[:k] = x.p join grams y on cuts.lang = y.lang and cuts.p[k + 1:] = y.p),
worst as (select lang, p, a, min({'score': score, 'k': k, 'l': l, 'r': r}) as w from scored group by 1, 2, 3),
ranked as (select lang, array_to_string(p, ' ') as phrase, a, w.l as l, w.r as r, n, w.score as score from worst join sizes using (lang)),
numbered as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
select lang, rank, phrase, a, l, r, n, score from numbered where rank <= 2000""",
    "op11_centroid_clusters": _clusters_twin(),
    "op13_hyperminhash_near_dedup": rf"""
with recursive docs as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sets as (select doc_id, case when len(w) < 2 then w
  else list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) end as s from docs),
classes as (select s, len(s) as n, min(doc_id) as node from sets where len(s) > 0 group by s),
cells as (select node, n, unnest(s) as x from classes),
links as (select a.node as u, b.node as v from cells a join cells b on a.x = b.x and a.node <> b.node
  and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.node, b.node, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select node, node as root from classes union select v, root from reach join links on node = u),
least_of as (select node, min(root) as root from reach group by node)
select doc_id, len(sets.s) as n_shingles, coalesce(root, doc_id) as component_id, coalesce(root, doc_id) = doc_id as kept
from sets left join classes on sets.s = classes.s left join least_of using (node)""",
}
