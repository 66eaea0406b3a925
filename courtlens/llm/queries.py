"""One query per numbered operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtlens.llm import (
    op1_ordinal_quality, op2_toxicity, op3_host_rules, op4_embedding_lsh, op5_language, op6_sentencepiece,
    op7_packing, op8_main_text, op9_simhash, op10_line_dedup, op13_periodic_runs,
    op11_ranked_search as ranked_search, op12_warc_archive as warc_archive,
)
from courtlens.llm.common import read
from courtlens.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str = op7_packing.VOCABULARY) -> str:
    """Path of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_ordinal_quality_scores(spark, folder):
    """Expected grade and chance of good quality of every document, learnt from two of three folds."""
    return op1_ordinal_quality.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op2_restored_toxicity(spark, folder):
    """Toxicity of every document, learnt from two of three folds of the labels."""
    return op2_toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op3_host_rules_report(spark, folder):
    """Base rules of every document and the verdict on its source."""
    return op3_host_rules.report(read(spark, folder, "documents")).select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_docs", "host_failed_docs", "kept")


CHECKS["op3_host_rules_report"] = r"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from d where len(ws) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from w),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
m as (select d.doc_id, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d left join r on r.doc_id = d.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*) as host_docs, cast(sum(cast(base_failed as int)) as bigint) as host_failed_docs from b group by source),
q as (select avg(host_failed_docs / host_docs) as mu, var_pop(host_failed_docs / host_docs) as v, avg(1 / host_docs) as u from h),
p as (select mu, greatest(1, least(1e6, mu * (1 - mu) / greatest(v - mu * (1 - mu) * u, 1e-12) - 1)) as s from q),
k as (select h.*, (host_failed_docs + mu * s) / (host_docs + s) > 0.5 as host_failed from h, p)
select b.doc_id, b.source, n_words, word_chars, n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  n_repeat_words, base_failed, host_docs, host_failed_docs, not base_failed and not host_failed as kept
from b join k on b.source is not distinct from k.source"""


@query
def op4_vector_buckets(spark, folder):
    """Links and component of every vector."""
    return op4_embedding_lsh.near_vectors(read(spark, folder, "embeddings"))


@query
def op5_rank_order_language(spark, folder):
    """Language of every document, learnt from three of four folds."""
    return op5_language.report(read(spark, folder, "documents"))


@query
def op6_sentencepiece_ids(spark, folder):
    """Digest of the piece ids of every document and whether they decode to the text."""
    with open(vocabulary(op6_sentencepiece.MODEL), "rb") as f:
        model = f.read()
    return op6_sentencepiece.report(read(spark, folder, "documents"), model)


@query
def op7_best_fit_packing(spark, folder):
    """Every document as pieces packed into sequences of 2048 tokens."""
    return op7_packing.pack(read(spark, folder, "documents"), vocabulary())


@query
def op8_host_main_text(spark, folder):
    """Main text of every page."""
    return op8_main_text.main_text(read(spark, folder, "pages"))


@query
def op9_simhash_groups(spark, folder):
    """Fingerprint and near-duplicate component of every document."""
    return op9_simhash.near_duplicates(read(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id")


@query
def op10_line_runs(spark, folder):
    """Every document without the runs of lines that an earlier place holds."""
    return op10_line_dedup.dedup_lines(read(spark, folder, "documents"), deleted="n_deleted").select(
        "doc_id", "text", "n_deleted")


# every line of a document is numbered (p), those with words again (i); windows are the shortest runs of at least
# 50 words from every line on and up to every line; a later one goes but for the lines of the first with the same lines
CHECKS["op10_line_runs"] = r"""
with a as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents where text is not null),
l as (select *, row_number() over (partition by doc_id order by p) as i from (
    select doc_id, p, list_aggregate(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), 'string_agg', ' ') as h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from a) where n > 0),
c as (select *, sum(n) over (partition by doc_id order by i) as s from l),
e as (select x.doc_id, x.i, min(y.i) as e from c x join c y on y.doc_id = x.doc_id and y.i >= x.i and y.s - x.s + x.n >= 50 group by x.doc_id, x.i
  union select y.doc_id, max(x.i) as i, y.i as e from c x join c y on y.doc_id = x.doc_id and y.i >= x.i and y.s - x.s + x.n >= 50 group by y.doc_id, y.i),
w as (select e.doc_id, e.i, e.e, string_agg(c.h, chr(10) order by c.i) as t from e join c on c.doc_id = e.doc_id and c.i between e.i and e.e group by e.doc_id, e.i, e.e),
f as (select *, first_value(doc_id) over o as od, first_value(i) over o as oi, first_value(e) over o as oe from w window o as (partition by t order by doc_id, i)),
r as (select distinct doc_id, case when doc_id = od then greatest(i, oe + 1) else i end as lo, e as hi from f
  where (doc_id <> od or i <> oi) and case when doc_id = od then greatest(i, oe + 1) else i end <= e),
b as (select r.doc_id, x.p as lo, y.p as hi from r join l x on x.doc_id = r.doc_id and x.i = r.lo join l y on y.doc_id = r.doc_id and y.i = r.hi),
g as (select distinct b.doc_id, a.p from b join a on a.doc_id = b.doc_id and a.p between b.lo and b.hi),
k as (select a.doc_id, string_agg(a.line, chr(10) order by a.p) as text from a where not exists (select 1 from g where g.doc_id = a.doc_id and g.p = a.p) group by a.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, cast(coalesce(n, 0) as bigint) as n_deleted
from documents d left join k on k.doc_id = d.doc_id left join (select doc_id, count(*) as n from g group by doc_id) n on n.doc_id = d.doc_id"""


@query
def op11_ranked_search(spark, folder):
    """The ten best documents for every benchmark item."""
    return ranked_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


CHECKS["op11_ranked_search"] = r"""
with t as (select doc_id, row_number() over () as d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents where text is not null),
s as (select cast(count(*) as bigint) as n_docs, cast(sum(len(ts)) as bigint) as n_terms from t where len(ts) > 0),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
p as (select d, w, count(*) as tf from (select d, unnest(ts) as w from t) where w in (select w from q) group by d, w),
f as (select w, count(*) as df from p group by w),
v as (select w, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as weight from f, s),
m as (select d, doc_id, 100 - 75 + (75 * len(ts) * n_docs) // n_terms as m from t, s),
r as (select item_id, doc_id, d, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join v using (w) join p using (w) join m using (d) group by item_id, doc_id, d),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= 10"""


@query
def op12_page_archive(spark, folder):
    """Every page as a record of a content-addressed archive, read back from it."""
    return warc_archive.report(read(spark, folder, "pages"), f"{run_folder(spark)}/{uuid.uuid4().hex}")


CHECKS["op12_page_archive"] = """
with p as (select page_id, coalesce(html, '') as t from pages),
f as (select *, min(page_id) over (partition by t) as first, strlen(t) as n from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(t) as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to from f"""


@query
def op13_word_runs(spark, folder):
    """Periodic runs of words of every document, whose tails the query makes periodic in one of ten."""
    return op13_periodic_runs.report(read(spark, folder, "documents"))
