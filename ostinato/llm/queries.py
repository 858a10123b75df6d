"""The queries of the thirteen operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import fill_middle, licenses, mixing, packing, preferences, simhash, spelling, subspace, substring, syncmers, token_files, topk, toxicity
from ostinato.llm.common import scratch_path, table

#: Contract: labels are learned from rows whose crc32 of the id as text leaves another remainder than this.
HELD_OUT = (4, 2)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_likeness(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=[5.0, 2.0, 1.0], share=1.0, most=3.0)


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(*preferences.replies_against_partner(table(spark, sf_dir, "conversations")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), scratch_path(spark, "tokens"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: source/lang/thousand/id.txt, and every twentieth a license file in source/lang."""
    place = lambda c: F.coalesce(F.col(c), F.lit("none"))
    folder = F.concat_ws("/", place("source"), place("lang"))
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.when(F.col("doc_id") % 20 == 0, F.concat(folder, F.lit("/LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(folder, F.lit("/"), thousand, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL has it: of units that count in the document frequencies."""
    return licenses.scan_licenses(document_paths(table(spark, sf_dir, "documents")), only_counted=True)


def license_scan_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all units."""
    return licenses.scan_licenses(document_paths(table(spark, sf_dir, "documents")))


def held_out(id_col: str = "doc_id"):
    modulus, remainder = HELD_OUT
    return F.crc32(F.col(id_col).cast("string")) % modulus == remainder


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), index)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_words(table(spark, sf_dir, "documents"), length=35)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES = {f.__name__: f for f in (op1_closed_syncmers, op2_mix_sources, op3_preference_format, op4_token_files, op5_best_fit_packing, op6_license_scan, op7_toxicity, op8_simhash, op9_substring_dedup, op10_exact_top_k, op11_spelling_variants, op12_fill_in_middle, op13_near_vectors, license_scan_whole)}

_MIX_SQL = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as k
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as nth
  from sized group by source),
weighed as (
  select *, [5.0, 2.0, 1.0][(nth % 3 + 1)::int]::double as weight, 3.0::double * source_size as cap from sources),
-- Rounds of capping: a source above its cap at the present level is capped; the rest share what is left.
rounds as (
  select 0 as round, source, source_size, weight, cap, false as capped from weighed
  union all
  select * from (
    with level as (
      select (select sum(source_size) from weighed)::double as whole,
             sum(case when capped then cap else 0 end) as used, sum(case when capped then 0 else weight end) as free from rounds)
    select r.round + 1, r.source, r.source_size, r.weight, r.cap,
           r.capped or r.weight * ((l.whole - l.used) / l.free) > r.cap as capped
    from rounds r, level l where r.round < (select count(*) from weighed) and l.free > 0)),
final as (select * from rounds qualify round = max(round) over ()),
level as (select ((select sum(source_size) from weighed)::double - sum(case when capped then cap else 0 end)) / nullif(sum(case when capped then 0 else weight end), 0) as level from final),
targets as (select source, source_size, case when capped or level is null then cap else least(cap, weight * level) end as target from final, level),
placed as (
  select s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows unbounded preceding) - s.size as start,
         round(t.target)::bigint as budget
  from sized s join targets t on s.source is not distinct from t.source),
passed as (select *, case when source_size > 0 then budget // source_size else 0 end as passes from placed)
select doc_id, size, source_size::bigint as source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - start)))::bigint as taken
from passed
"""

_PREFERENCE_SQL = """
with turns as (select conv_id as pair_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
last as (select pair_id, max(turn) as last from turns where role = 'assistant' group by pair_id),
reply as (select t.pair_id, min(t.text) as reply from turns t join last l on t.pair_id = l.pair_id and t.turn = l.last where t.role = 'assistant' group by t.pair_id),
sides as (
  select t.pair_id, 'chosen' as part, t.turn, t.role, t.text from turns t left join last l using (pair_id) where l.last is null or t.turn <= l.last
  union all
  select t.pair_id, 'rejected', t.turn, t.role, t.text from turns t left join last l using (pair_id)
  where l.last is null or t.turn < l.last or (t.turn = l.last and t.role <> 'assistant')
  union all
  select l.pair_id, 'rejected', l.last, 'assistant', coalesce(r.reply, '') from last l left join reply r on r.pair_id = xor(l.pair_id, 1)),
said as (select pair_id, turn, part, list(role || chr(0) || text order by role, text) as said from sides group by all),
differs as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.turn, b.turn)) as first
  from (select * from said where part = 'chosen') a full join (select * from said where part = 'rejected') b on a.pair_id = b.pair_id and a.turn = b.turn
  where a.said is distinct from b.said group by 1),
placed as (select s.*, d.first is null or s.turn < d.first as common from sides s left join differs d using (pair_id))
select pair_id, case when common then 'prompt' else part end as part, turn, role,
       '<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10) as rendered,
       not common and role = 'assistant' as trained,
       case when not common and role = 'assistant' then length('<|' || role || '|>' || chr(10))::int end as trained_from
from placed where not (common and part = 'rejected')
"""


def _license_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.TEMPLATES)
    told, known = (", ".join(f"'{t}'" for t in n) for n in (licenses.telling_terms(), licenses.template_terms(1)))
    return (
        r"""
with files as (
  select doc_id as file_id, text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') as folder,
         case when doc_id % 20 = 0 then folder || '/LICENSE.' || doc_id else folder || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' end as path,
         case when doc_id % 20 = 0 then folder else folder || '/' || (doc_id // 1000) end as directory
  from documents),
units as (
  select file_id, string_split(text, chr(10)) || regexp_split_to_array(text, '\n[ \t*#/]*\n') || case when file_id % 20 = 0 then [text] else [] end as every from files where text is not null),
found as (
  select distinct file_id, trim(line, ' ') as line from (select file_id, unnest(every) as line from units)
  where len(list_intersect(regexp_extract_all(lower(line), '[a-z0-9]+'), ["""
        + told
        + r"""])) >= 2 and 10 * len(list_intersect(regexp_extract_all(lower(line), '[a-z0-9]+'), ["""
        + known
        + r"""])) >= len(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')))),
lines as (select line, count(*) as n from found group by line),
notices as (select * from (values """
        + quoted
        + r""") as t(license, notice)),
tf as (select line, any_value(n) as n, term, count(*) as tf from (select line, n, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from lines) group by line, term),
own as (select license, notice, term, count(*) as tf from (select license, notice, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) as term from notices) group by license, notice, term),
df as (select term, sum(n) as df from (select term, n from tf union all select term, 1 from own) group by term),
idf as (select term, ln((1.0::double + (select coalesce(sum(n), 0) from lines) + (select count(*) from notices)) / (1.0::double + df)) + 1.0::double as idf from df),
a as (select line, term, tf * idf as w from tf join idf using (term)),
b as (select license, notice, term, tf * idf as v from own join idf using (term)),
cosines as (
  select d.line, d.license, round(d.dot / (an.norm * bn.norm), 6) as cosine
  from (select line, license, notice, sum(w * v) as dot from a join b using (term) group by line, license, notice having bool_or(term in (""" + told + r"""))) d
  join (select line, sqrt(sum(w * w)) as norm from a group by line) an using (line)
  join (select license, notice, sqrt(sum(v * v)) as norm from b group by license, notice) bn using (license, notice)),
each as (select line, license, max(cosine) as cosine from cosines group by line, license),
near as (select *, row_number() over (partition by line order by cosine desc, license desc) as rank, coalesce(lead(cosine) over (partition by line order by cosine desc, license desc), 0) as second from each),
best as (select line, license, cosine from near where rank = 1 and cosine >= 0.5 and round(cosine - second, 6) >= 0.01),
own_license as (
  select file_id, license as own_license, cosine from found join best using (line)
  qualify row_number() over (partition by file_id order by cosine desc, length(license) desc, license) = 1),
holders as (
  select directory, own_license as inherited_license from files join own_license using (file_id) where file_id % 20 = 0
  qualify row_number() over (partition by directory order by cosine desc, length(own_license) desc, own_license) = 1),
inherited as (
  select d.directory, h.inherited_license, h.directory as inherited_from
  from (select distinct directory from files) d join holders h on d.directory = h.directory or starts_with(d.directory, h.directory || '/')
  qualify row_number() over (partition by d.directory order by length(h.directory) desc) = 1)
select f.file_id, f.path, o.own_license, o.cosine, i.inherited_license, i.inherited_from, coalesce(o.own_license, i.inherited_license) as license
from files f left join own_license o using (file_id) left join inherited i on f.directory = i.directory
"""
    )


def _whole_license_sql() -> str:
    """The same without a condition on the units that are compared; those that count are the same."""
    sql, start, end = _license_sql(), "  where len(list_intersect(", "),\nlines as ("
    before, counts = sql[: sql.index(start)], sql[sql.index(start) + len("  where ") : sql.index(end)]
    return before.rstrip() + sql[sql.index(end) :].replace("count(*) as n from found", f"count(*) filter (where {counts}) as n from found", 1)


_SUBSTRING_SQL = r"""
with words as (select doc_id, row_number() over () as r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
starts as (select r, unnest(range(1, len(w) - 33)) as s from words where len(w) >= 35),
windows as (select r, s, md5(array_to_string(w[s : s + 34], ' ')) as h from starts join words using (r)),
again as (select r, s, s - coalesce(lag(s) over (partition by r order by s), -99) as gap from windows where h in (select h from windows group by h having count(*) > 1)),
gone as (select distinct r, unnest(range(s, s + 35)) as i from again),
lost as (select r, count(*) as n, list(i) as gone from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
       sha256(array_to_string(case when n is null then w else coalesce(list_filter(w, lambda x, i: not list_contains(gone, i)), []) end, ' ')) as kept_sha256
from words left join lost using (r)
"""

_TOP_K_SQL = """
with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 100 = 0)
select q.vec_id as query_id, (row_number() over (partition by q.r order by list_inner_product(q.v::double[], c.v::double[]) desc, c.vec_id))::int as rank,
       c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
from q join v c on c.r <> q.r and len(c.v) = len(q.v)
qualify rank <= 10
"""

#: The CRC-32 has no function in this SQL: 256 steps of its polynomial make the table, and the bytes are folded over it.
_SPELLING_SQL = r"""
with recursive steps as (
  select range as b, range::bigint as c, 0 as k from range(256)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by b) as t from steps where k = 8),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
coded as (
  select run, n, list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: unicode(c)::bigint) as points from runs where length(run) >= 5),
bytes as (select run, n, flatten(list_transform(points, lambda p: case when p < 128 then [p] else [(p >> 6) | 192, (p & 63) | 128] end)) as b from coded),
hashed as (select run, n, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]), 4294967295::bigint), 4294967295) as h from bytes, crc),
slipped as (
  select case when h % 97 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
without as (select word, n, unnest(range(1, length(word) + 1)) as i, substring(word, 1, i - 1) as a, substring(word, i + 1) as z from words),
pairs as (
  select x.word, y.word as near, y.n as near_n from without x join without y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word
  union
  select x.word, y.word, y.n from without x join words y on y.word = x.a || x.z
  union
  select y.word, x.word, x.n from without x join words y on y.word = x.a || x.z),
best as (select word, count(*) as n_near, first(near order by near_n desc, near) as form, max(near_n) as form_n from pairs group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n
  from words w left join best using (word)),
chains as (select word, form as root from formed where form is not null union all select c.word, f.form from chains c join formed f on f.word = c.root where f.form is not null),
ends as (select c.word, c.root from chains c join formed f on f.word = c.root where f.form is null)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near, f.form_n::bigint as form_n from formed f left join ends e using (word)
"""

_FILL_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (select *, len(u)::bigint as n, list_transform(range(4), lambda i: ('0x' || substring(h, (8 * i + 1)::int, 8))::bigint) as d from units),
formed as (
  select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 90 then 'plain'
              when d[4] % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:], ''), '') as s from formed)
select doc_id, n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from parts
"""

_NEAR_SQL = """
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
good as (
  select r, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e
  from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.r, b.r as other from good a join good b on a.r <> b.r and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) >= 0.95),
counted as (select r, count(*) as n_links from links group by r),
reached as (select r, r as other from v union select d.r, l.other from reached d join links l on d.other = l.r),
named as (select d.r, min(v.vec_id) as component_id from reached d join v on v.r = d.other group by d.r)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id is not distinct from component_id as kept
from v left join counted using (r) left join named using (r)
"""

ORACLES = {
    "op2_mix_sources": _MIX_SQL,
    "op3_preference_format": _PREFERENCE_SQL,
    "op6_license_scan": _license_sql(),
    "license_scan_whole": _whole_license_sql(),
    "op9_substring_dedup": _SUBSTRING_SQL,
    "op10_exact_top_k": _TOP_K_SQL,
    "op11_spelling_variants": _SPELLING_SQL,
    "op12_fill_in_middle": _FILL_SQL,
    "op13_near_vectors": _NEAR_SQL,
}
