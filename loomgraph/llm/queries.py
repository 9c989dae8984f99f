"""The registered queries of the training-data operators: ``opN_<name>``, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import link_counts
from .bpe import digests
from .content_dedup import content_dedup
from .embedding_dedup import embedding_dedup
from .fingerprint import compare_with_next
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .packing import pack
from .phrases import collocations
from .quality import quality
from .sstable import read_sstables, write_sstables
from .substring_dedup import substring_dedup
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sstables(write_sstables(_table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_order_minhash, op3_ngram_join, op4_substring_dedup, op5_line_dedup, op6_embedding_dedup, op7_quality, op8_sstable, op9_toxicity, op10_best_fit_packing, op11_content_sort, op12_token_alignment, op13_phrases)}


WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN_SQL = (
    "with recursive w as (select doc_id, "
    + WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
    r as (select doc_id as id, doc_id as c from documents union select b, c from r join e on a = id)
    select id as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(c) as component_id from r left join n on n.doc_id = id group by id"""
)

SUBSTRING_SQL = (
    "with w as (select doc_id, "
    + WORDS_SQL.format(text="coalesce(text, '')")
    + """ as w from documents),
    win as (select doc_id, unnest(range(1, len(w) - 48)) as i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) as h from w where len(w) >= 50),
    f as (select h, min(doc_id) as d from win group by h),
    gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join f using (h) where doc_id > d),
    k as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from w),
    kept as (select k.doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from k anti join gone on gone.doc_id = k.doc_id and gone.p = k.p group by k.doc_id)
    select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""
)

EMBEDDING_SQL = """
with recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.93),
r as (select vec_id as id, vec_id as c from embeddings union select b, c from r join e on a = id),
n as (select a, count(*) as n from e group by a)
select id as vec_id, coalesce(any_value(n.n), 0) as n_links, min(c) as component_id, id = min(c) as kept from r left join n on n.a = id group by id
"""

CONTENT_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from t
"""

PHRASES_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3)) as v(k)),
n as (select lang, count(*) as n from g where k = 1 group by lang),
f as (select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as f from g group by lang, k, phrase having count(*) >= 10),
c as (select lang, k, phrase, w, f, unnest(range(1, k)) as cut from f where k > 1),
s as (select c.lang, c.k, c.phrase, c.w, c.f as a, cut, x.f as l, y.f as r, cast(1000000 * cast(c.f as hugeint) * c.f // (cast(x.f as hugeint) * y.f) as bigint) as score
  from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select lang, array_to_string(w[1:2], ' ') as phrase, f from f where k = 3 union all select lang, array_to_string(w[2:3], ' '), f from f where k = 3),
d as (select b.* from b where not exists (select 1 from o where o.lang = b.lang and o.phrase = b.phrase and b.k = 2 and 100 * o.f >= 50 * b.a)),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d)
select lang, rank, phrase, a, l, r, n, score from t join n using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force, the libraries or held-out labels."""
    return {"op3_ngram_join": NGRAM_JOIN_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op6_embedding_dedup": EMBEDDING_SQL, "op11_content_sort": CONTENT_SQL, "op13_phrases": PHRASES_SQL}
