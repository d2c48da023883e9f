"""The registered queries of this subpackage: thin views of its jobs in the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import divergence, language, lines, maintext, packing, pieces, pii, quality, sharding, simhash, syncmers, turns, vectors
from cuemill.llm.shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), with_ids=False)
    return packed.drop("ids")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


OP4_SQL = """
with recursive usable as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit as (select vec_id, e, sqrt(list_inner_product(e, e)) as norm from usable),
link as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (select a, b from link union select reach.a, link.b from reach join link on link.a = reach.b),
low as (select a, min(b) as b from reach group by a), many as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) as kept
from embeddings left join low on low.a = vec_id left join many on many.a = vec_id
"""


def op5_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 64 shards."""
    return sharding.place(table(spark, sf_dir, "documents"), [f"shard-{k:02}" for k in range(64)]).select("doc_id", "slot", "shard")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the checksum of what they decode to."""
    model = _vocabulary("piece_bpe_32k.model")
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), model).select("doc_id", "n_ids", "ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
line as (select doc_id, generate_subscripts(ls, 1) as place, unnest(ls) as line from cut),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
frequent as (select key, max(doc_id) as keep_doc from (select distinct doc_id, key from keyed where length(key) >= 40)
  group by key having count(*) >= 5),
marked as (select keyed.*, keep_doc is not null and doc_id <> keep_doc as gone from keyed left join frequent using (key))
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.compare_with_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op11_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    summary, repaired = turns.repair(turns.damage(rows))
    found = summary.join(turns.digests(repaired), "head").drop("head")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "i.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: The states of the grammar (nothing yet, after s, after u, after a) with their best (cost, audit) go from turn to turn.
OP12_SQL = """
with recursive crc_table as (select n::bigint as n, list_reduce([n::bigint] || range(8), lambda c, _k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(n)),
crc_list as (select list(v order by n) as v from crc_table),
drawn as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
summed as (select drawn.*, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::bigint), lambda c, b: xor(c >> 8, v[1 + (xor(c, b) & 255)])), 4294967295) % 20 as draw from drawn, crc_list),
damaged as (select conv_id, turn, case when draw = 4 then 'user' else role end as role,
  case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when draw = 3 then [1, 2] else [1] end) as copy from summed where draw <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as place from damaged),
judged as (select *, left(role, 1) as initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, row_number() over (partition by conv_id, role, text order by place) as seen,
  lag(left(role, 1)) over (partition by conv_id order by place) as before from placed),
coded as (select *, case when body = '' then 'blank' when seen > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault from judged),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (place > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, max(place) as n from coded group by conv_id),
walk as (
  select conv_id, 0::bigint as i, {'c': 0::bigint, 'a': ''} as s0, {'c': 1000000000::bigint, 'a': ''} as ss, {'c': 1000000000::bigint, 'a': ''} as su, {'c': 1000000000::bigint, 'a': ''} as sa from counted
  union all
  select w.conv_id, w.i + 1, {'c': w.s0.c + 3, 'a': w.s0.a || 'D'},
    list_min([{'c': w.ss.c + 3, 'a': w.ss.a || 'D'}, {'c': case when k.must or k.initial <> 's' then 1000000000 else w.s0.c + k.extra end, 'a': w.s0.a || 'K'}]),
    list_min([{'c': w.su.c + 3, 'a': w.su.a || 'D'}] || list_transform([{'c': w.s0.c, 'a': w.s0.a}, {'c': w.ss.c, 'a': w.ss.a}, {'c': w.sa.c, 'a': w.sa.a}, {'c': w.su.c + 2, 'a': w.su.a || 'I'}],
      lambda x: {'c': case when k.must then 1000000000 else x.c + k.extra + case when k.initial = 'u' then 0 else 2 end end, 'a': x.a || case when k.initial = 'u' then 'K' else 'R' end})),
    list_min([{'c': w.sa.c + 3, 'a': w.sa.a || 'D'}] || list_transform([{'c': w.su.c, 'a': w.su.a}, {'c': w.s0.c + 2, 'a': w.s0.a || 'I'}, {'c': w.ss.c + 2, 'a': w.ss.a || 'I'}, {'c': w.sa.c + 2, 'a': w.sa.a || 'I'}],
      lambda x: {'c': case when k.must then 1000000000 else x.c + k.extra + case when k.initial = 'a' then 0 else 2 end end, 'a': x.a || case when k.initial = 'a' then 'K' else 'R' end}))
  from walk w join (select conv_id, place, initial, fault in ('blank', 'duplicate') as must, (fault = 'truncated')::bigint as extra from coded) k on w.conv_id is not distinct from k.conv_id and k.place = w.i + 1),
best as (select w.conv_id, list_min([{'c': s0.c, 'a': s0.a}, {'c': sa.c, 'a': sa.a}, {'c': su.c + 2, 'a': su.a || 'I'}, {'c': ss.c + 4, 'a': ss.a || 'II'}]) as b
  from walk w join counted n on w.conv_id is not distinct from n.conv_id and w.i = n.n),
edits as (select conv_id, b.a as audit, unnest(range(1, length(b.a) + 1)) as e from best),
edit as (select conv_id, e, audit[e] as op, length(replace(left(audit, e), 'I', '')) as place, length(replace(left(audit, e), 'D', '')) as nth from edits),
made as (select t.*, c.role as own, c.text, coalesce(c.initial = 's' and op = 'K', false) as is_system from edit t left join coded c on t.conv_id is not distinct from c.conv_id and t.place = c.place),
led as (select *, max(is_system and nth = 1) over (partition by conv_id) as system_first from made where op <> 'D'),
mended as (select conv_id, sha256(string_agg(case when op = 'K' then own when (nth - system_first::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end, chr(10) order by e)) as repaired_sha256
  from led group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counted n on i.conv_id is not distinct from n.conv_id left join best on i.conv_id is not distinct from best.conv_id
left join mended m on i.conv_id is not distinct from m.conv_id
"""


def op13_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with doc as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
occurrence as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from doc),
kept as (select lang, term from occurrence group by all having count(distinct id) >= 30),
grp as (select distinct lang, source from doc),
counted as (select lang, source, term, count(*)::hugeint as n from occurrence join kept using (lang, term) group by all),
full_count as (select g.lang, g.source, k.term, coalesce(n, 0)::hugeint as n from grp g join kept k using (lang) left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
size as (select lang, count(*)::hugeint as v from kept group by lang),
share as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from full_count join size using (lang)),
whole as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * any_value(v)) as q from full_count join size using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join share x on x.lang = a.lang and x.source = a.source left join share y on y.lang = a.lang and y.source = b.source and y.term = x.term group by all),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) from share join whole using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_main_text": op2_main_text,
    "op3_simhash_near_duplicates": op3_simhash_near_duplicates,
    "op4_quantised_vectors": op4_quantised_vectors,
    "op5_shard_placement": op5_shard_placement,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_personal_data": op7_personal_data,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_closed_syncmers": op10_closed_syncmers,
    "op11_neighbour_quality": op11_neighbour_quality,
    "op12_turn_alignment": op12_turn_alignment,
    "op13_source_stripes": op13_source_stripes,
}
ORACLES: dict[str, str] = {"op4_quantised_vectors": OP4_SQL, "op8_line_dedup": OP8_SQL, "op12_turn_alignment": OP12_SQL, "op13_source_stripes": OP13_SQL}
