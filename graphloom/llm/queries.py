"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import aligning, chat, jpeg, katz, langid, mixing, ngram_join, packing, page_text, pieces, quality_model, quality_rules, resample
from graphloom.llm.common import table


def op1_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: A conversation that says what the template's own control strings say.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op11_aligning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligning.aligned(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jpeg": op1_jpeg,
    "op2_langid": op2_langid,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_quality_model": op6_quality_model,
    "op7_pieces": op7_pieces,
    "op8_page_text": op8_page_text,
    "op9_ngram_join": op9_ngram_join,
    "op10_katz": op10_katz,
    "op11_aligning": op11_aligning,
    "op12_resample": op12_resample,
    "op13_mixing": op13_mixing,
}
LLM_ORACLE: dict[str, str] = {}

_CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])"
#: Turns by role with the template's own characters; a backslash or a control string in a text costs one more.
LLM_ORACLE["op5_chat"] = rf"""
with c as (select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text from conversations
           union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
 e as (select *, row_number() over (partition by conv_id order by turn nulls first, "role", text) k,
   case "role" when 'system' then 18 when 'user' then 18 when 'assistant' then 6 else 17 + length("role") end
   + length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(replace(text, '\', '\\'), '{_CONTROL}')) chars from c)
select conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || text || chr(10), '' order by k)) turns_sha256,
 cast(coalesce(sum(length(text)) filter ("role" = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter ("role" = 'assistant'), '')) loss_sha256,
 cast(sum(chars) as bigint) formatted_chars, regexp_full_match(string_agg("role" || ',', '' order by k), '(system,)?(user,assistant,)+') "valid"
from e group by conv_id"""

LLM_ORACLE["op9_ngram_join"] = r"""
with recursive t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) g from t),
 n as (select doc_id, count(*) c from s group by 1),
 p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where k >= 0.8 * (nx.c + ny.c - k) - 1e-9),
 r as (select x a, y b from l union select r.a, l.y from r join l on l.x = r.b),
 m as (select a, min(b) b from r group by 1), q as (select x, count(*) c from l group by 1)
select t.doc_id, least(t.doc_id, coalesce(m.b, t.doc_id)) class_id, coalesce(q.c, 0) n_links from t left join m on m.a = t.doc_id left join q on q.x = t.doc_id"""

#: CRC-32 of each distinct word, byte by byte, from the table of its 256 values.
LLM_ORACLE["op12_resample"] = r"""
with recursive bits as (select range i, range c, 0 k from range(256) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
 tab as (select list(c order by i) t from bits where k = 8),
 w as (select 'd' kind, doc_id id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) word from documents
   union all select 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
 h as (select word, hex(encode(word)) x from (select distinct word from w)),
 b as (select word, xor(list_reduce(list_transform(range(1, length(x) + 1, 2), lambda p: cast('0x' || x[p:p + 1] as bigint)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) % 10000 bucket from h, tab),
 g as (select bucket, count(*) filter (kind = 'd') s, count(*) filter (kind = 'b') t from w join b using (word) group by 1),
 n as (select sum(s)::double + 10000 sn, sum(t)::double + 10000 tn from g),
 gain as (select bucket, cast(floor(1000 * ln((t + 1)::double * sn / ((s + 1)::double * tn))) as bigint) v from g, n),
 d as (select id doc_id, count(*) n_features, cast(sum(v) as bigint) weight from w join b using (word) join gain using (bucket) where kind = 'd' group by 1),
 e as (select doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
   coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || doc_id)[1:8] as bigint) + 0.5::double) / 4294967296::double))) as bigint) score from documents left join d using (doc_id)),
 r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) k, count(*) filter (n_features >= 20) over () m from e)
select doc_id, n_features, weight, score, case when n_features >= 20 and k <= 10 * m // 100 then k end "rank" from r"""

#: A source is at its limit if the level of the sources with no lower ratio of limit to weight, once all lower ones are at theirs, is above its own.
LLM_ORACLE["op13_mixing"] = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
 s as (select source, cast(sum(size) as bigint) source_size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by 1),
 o as (select *, 2 * source_size lim, 1.5::double * sum(source_size) over () total, coalesce(sum(2 * source_size) over (order by 2 * source_size / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0) below,
   sum(w) over (order by 2 * source_size / w::double, source nulls last rows between current row and unbounded following) rest from s),
 c as (select *, lim < w * ((total - below) / rest) at_limit from o),
 f as (select source, source_size, case when at_limit then lim::double else w * (total - coalesce(sum(lim) filter (at_limit) over (), 0))::double / (sum(w) filter (not at_limit) over ())::double end target from c),
 j as (select d.doc_id, d.size, f.source_size, f.target, case when f.source_size > 0 then f.target / f.source_size else 0 end rate from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when cast('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:12] as bigint)::double / 281474976710656::double < rate - floor(rate) then 1 else 0 end) as bigint) taken,
 cast(floor(rate) + case when cast('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:12] as bigint)::double / 281474976710656::double < rate - floor(rate) then 1 else 0 end as bigint) copies from j"""
