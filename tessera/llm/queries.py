"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import re

from tessera.llm.collocations import collocations
from tessera.llm.common import LOWER, UPPER, documents
from tessera.llm.divergence import divergence
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.kneser_ney import classify
from tessera.llm.license_rules import rules
from tessera.llm.licenses import BASE, licenses
from tessera.llm.log_bilinear import score
from tessera.llm.minhash import near_groups
from tessera.llm.mixing import mix_totals
from tessera.llm.packing import pack
from tessera.llm.personal import personal
from tessera.llm.quality_rules import quality
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.toxicity import toxicity

QUERIES = {
    "op1_genetic_packing": lambda spark, sf: pack(documents(spark, sf)).drop("uid"),
    "op2_quality_rules": lambda spark, sf: quality(documents(spark, sf)),
    "op3_exact_dedup": lambda spark, sf: exact_groups(documents(spark, sf)),
    "op4_kneser_ney": lambda spark, sf: classify(documents(spark, sf), documents(spark, sf, "labels")),
    "op5_minimax_shards": lambda spark, sf: shard_by_bytes(documents(spark, sf)),
    "op6_log_bilinear": lambda spark, sf: score(documents(spark, sf)),
    "op7_license_rules": lambda spark, sf: licenses(documents(spark, sf)),
    "op8_source_mix": lambda spark, sf: mix_totals(documents(spark, sf)),
    "op9_toxicity": lambda spark, sf: toxicity(documents(spark, sf), documents(spark, sf, "labels")).drop("spans"),
    "op10_minhash_near_dedup": lambda spark, sf: near_groups(documents(spark, sf)).drop("uid", "text_hash", "root"),
    "op11_pivot_collocations": lambda spark, sf: collocations(documents(spark, sf)),
    "op12_source_divergence": lambda spark, sf: divergence(documents(spark, sf)),
    "op13_bilstm_crf_pii": lambda spark, sf: personal(documents(spark, sf)),
}



def license_sql() -> str:
    """The license scan for another engine: its rules as a table, containment as a test on all pairs of a document's spans.

    Between words stand two blanks there, so that matches that follow each other need no look-ahead."""
    wide = lambda p: re.sub(r" \?", "\0", p).replace(" ", "  ").replace("\0", "(?:  )?")
    text = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({turn}, {priority}, {text(label)}, {text(keyword.replace(' ', '  '))}, {text(wide(pattern))}, {confidence})" for turn, (priority, label, keyword, pattern, confidence) in enumerate(rules()))
    phrases = ", ".join(f"({text(phrase)}, {text(label)}, {len(phrase.split())})" for phrase, label in BASE.items())
    return rf"""
with r(turn, priority, label, keyword, pattern, confidence) as (values {table}), f(phrase, label, k) as (values {phrases}),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from documents),
d as (select doc_id, ws, len(ws) as n, case when len(ws) > 0 then concat(' ', array_to_string(ws, '  '), ' ') else '' end as padded from w),
b as (select doc_id, i - 1 as place, label from (select doc_id, ws, unnest(range(1, n + 1)) as i from d) x join f on array_to_string(ws[i : i + k - 1], ' ') = phrase),
h as (select doc_id, padded, r.* from d join r on case when contains(padded, keyword) then regexp_matches(padded, concat(' (?:', pattern, ') ')) else false end),
m as (select *, string_split(trim(regexp_replace(padded, concat(' (', pattern, ') '), concat(' ', chr(1), '\1 '), 'g')), '  ') as marked, regexp_extract_all(padded, concat(' (', pattern, ') '), 1) as found from h),
s as (select doc_id, turn, priority, label, confidence, unnest(list_filter(range(len(marked)), lambda i: starts_with(marked[i + 1], chr(1)))) as a, unnest(list_transform(found, lambda x: len(string_split(x, '  ')))) as k from m),
c as (select * from s where not exists (select 1 from s o where o.doc_id = s.doc_id and o.priority >= s.priority and o.a + o.k >= s.a + s.k and (o.a, -(o.a + o.k), -o.priority, o.turn) < (s.a, -(s.a + s.k), -s.priority, s.turn))),
e as (select doc_id, max(confidence) as best, count(*) as n_detections, list(label) as labels from c group by doc_id),
g as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(label) as labels from b group by doc_id)
select d.doc_id, n as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(list_sort(list_distinct(coalesce(g.labels, []))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(g.labels, []), coalesce(e.labels, [])))), ',') as labels, cast(greatest(coalesce(best, 0), case when n_base > 0 then 0.8 else 0 end) as double) as score, coalesce(n_detections, 0) as n_detections
from d left join g using (doc_id) left join e using (doc_id)"""


ORACLE = {
    "op7_license_rules": license_sql(),
    "op2_quality_rules": r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
k as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from g),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from k where n > 1) group by doc_id),
m as (select l.doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(r.n, 0) as bigint) as n_repeat_words, cast(len(lines) as bigint) as n_lines, cast(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as bigint) as n_upper from l left join r using (doc_id)),
f as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 4 else 0 end) + (case when 4 * n_symbols > n_words then 8 else 0 end)
  + (case when 10 * n_dup_lines > 3 * n_lines then 16 else 0 end) + (case when 2 * n_upper > word_chars then 32 else 0 end)
  + (case when n_words > 100000 then 64 else 0 end) as b from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b & 3 <> 0 as base_failed, b & 63 = 0 as kept, n_lines, n_upper, cast(b as bigint) as failures from f""",
    "op3_exact_dedup": f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256
from n window g as (partition by t)""",
    "op10_minhash_near_dedup": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) else ws end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on b.g = a.g and b.doc_id > a.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
ways as (select x, y from e union all select y, x from e),
r as (select doc_id as a, doc_id as b from documents union select r.a, ways.y from r join ways on ways.x = r.b),
m as (select a as doc_id, min(b) as component_id from r group by a)
select m.doc_id, coalesce(n.n, 0) as n_shingles, component_id, m.doc_id = component_id as kept from m left join n using (doc_id)""",
    "op11_pivot_collocations": rf"""
with p as (select row_number() over () as i, coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select row_number() over () as i, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, k, array_to_string(ws[j : j + k - 1], ' ') as phrase, array_to_string(ws[j : j], ' ') as h1, array_to_string(ws[j + 1 : j + k - 1], ' ') as t1, array_to_string(ws[j : j + 1], ' ') as h2, array_to_string(ws[j + k - 1 : j + k - 1], ' ') as t2
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as j from w, (values (1), (2), (3)) v(k) where len(ws) >= k) x),
f as (select lang, k, phrase, any_value(h1) as h1, any_value(t1) as t1, any_value(h2) as h2, any_value(t2) as t2, count(*) as a from g group by lang, k, phrase),
n as (select lang, sum(a) as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 10),
x as (select c.lang, c.k, c.phrase, c.a, f1.a as l1, r1.a as r1, f2.a as l2, r2.a as r2 from c
  join f f1 on f1.lang = c.lang and f1.k = 1 and f1.phrase = c.h1 join f r1 on r1.lang = c.lang and r1.k = c.k - 1 and r1.phrase = c.t1
  left join f f2 on c.k = 3 and f2.lang = c.lang and f2.k = 2 and f2.phrase = c.h2 left join f r2 on c.k = 3 and r2.lang = c.lang and r2.k = 1 and r2.phrase = c.t2),
y as (select *, (1000000::hugeint * a * a) // (l1::hugeint * r1) as s1, (1000000::hugeint * a * a) // (l2::hugeint * r2) as s2 from x),
o as (select lang, part, max(a) as a from (select lang, unnest([h2, t1]) as part, a from c where k = 3) group by all),
z as (select y.lang, y.phrase, y.a, case when s2 < s1 then l2 else l1 end as l, case when s2 < s1 then r2 else r1 end as r, case when s2 < s1 then s2 else s1 end as score
  from y left join o on y.k = 2 and o.lang = y.lang and o.part = y.phrase where o.a is null or 100 * o.a < 50 * y.a),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select q.lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from q join n using (lang) where rank <= 2000""",
    "op12_source_divergence": rf"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{80}}-\x{{10FFFF}}]+') as ts from documents),
x as (select i, lang, source, unnest(ts) as t from d),
k as (select lang, t from x group by all having count(distinct i) >= 3),
g as (select distinct lang, source from d),
c as (select lang, source, t, count(*) as n from x join k using (lang, t) group by all),
f as (select g.lang, g.source, k.t, coalesce(c.n, 0) as n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.t = k.t),
p as (select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over s + count(*) over s) as p from f window s as (partition by lang, source)),
h as (select lang, t, sum(n) as n from f group by all),
q as (select lang, t, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over s + count(*) over s) as q from h window s as (partition by lang)),
v as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
w as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join v on v.lang = a.lang and v.source = a.source and v.item = b.source
  union all select lang, source, 'term', t, (p - q) * (p - q) // q from p join q using (lang, t) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from w)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 200""",
}
