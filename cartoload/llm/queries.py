"""The registered queries of the operators: thin wrappers that derive the agreed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cartoload.llm import bpe, chat, lexical, mixing, packing, pii, quality_model, quality_rules, simhash, urlrules, vectorcodes, vectors, warc
from cartoload.llm.common import scratch
from cartoload.plans.registry import query, table


@query("op2_simhash")
def op2_simhash(spark, folder):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(spark, table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_quality_rules", """
with lines as (select doc_id, lang, source, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
parts as (select doc_id, lang, source, text, list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
                 list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from lines),
base as (select doc_id, lang, source, words, len(words) as n_words,
                coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from parts),
windows as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from base, range(1, n_words - 1) r(i)),
often as (select doc_id, w from windows group by all having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from windows semi join often using (doc_id, w), range(3) s(k) group by doc_id),
counted as (select base.* exclude (words), coalesce(covered.n, 0) as n_repeat_words,
                   n_words < 50 or 100 * coalesce(covered.n, 0) > 50 * n_words as base_failed from base left join covered using (doc_id)),
values_ as (unpivot (select doc_id, lang, source, n_symbols::double / n_words as symbols, n_dup_lines::double / n_lines as dup_lines,
                            n_repeat_words::double / n_words as repeats, word_chars::double / n_words as long_words, word_chars::double / n_words as short_words,
                            n_words::double as words, case when n_lines > 1 then n_lines::double end as lines
                     from counted where not base_failed) on symbols, dup_lines, repeats, long_words, short_words, words, lines into name share value v),
bins as (select lang, source, share, ceil(ln(greatest(v, 1e-6)) / ln(1.01 / 0.99))::int as b, count(*) as n from values_ group by all),
runs as (select *, sum(n) over (partition by lang, source, share order by b) as seen, sum(n) over (partition by lang, source, share) as total from bins),
points as (select lang, source, share, exp(min(b) filter (seen >= greatest(ceil(total * 0.1), 1)) * ln(1.01 / 0.99)) * 0.99 as q10,
                  exp(min(b) filter (seen >= greatest(ceil(total * 0.25), 1)) * ln(1.01 / 0.99)) * 0.99 as q25,
                  exp(min(b) filter (seen >= greatest(ceil(total * 0.5), 1)) * ln(1.01 / 0.99)) * 0.99 as q50,
                  exp(min(b) filter (seen >= greatest(ceil(total * 0.75), 1)) * ln(1.01 / 0.99)) * 0.99 as q75 from runs group by all),
lengths as (select lang, source, max(q10) filter (share = 'words') as words, max(q50) filter (share = 'lines') as lines from points group by all),
fences as (select p.lang, p.source, share, case share when 'symbols' then least(1.0, q50 + greatest(6 * (q50 - q25), 6 / words))
                  when 'dup_lines' then least(0.8, q50 + greatest(6 * (q50 - q25), 4 / lines)) when 'repeats' then least(0.5, q50 + greatest(6 * (q50 - q25), 36 / words))
                  when 'long_words' then least(40.0, q50 + greatest(6 * (q50 - q25), 0.3 * q50)) when 'short_words' then greatest(1.5, q50 - greatest(6 * (q75 - q50), 0.3 * q50)) end as fence
           from points p join lengths l on p.lang is not distinct from l.lang and p.source is not distinct from l.source),
beyond as (select distinct doc_id from values_ v join fences f on v.share = f.share and v.lang is not distinct from f.lang and v.source is not distinct from f.source
           where case when v.share = 'short_words' then v.v < fence else v.v > fence end)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and doc_id not in (select doc_id from beyond) as kept from counted
""")
def op5_quality_rules(spark, folder):
    """Counts, base rule and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    judged = quality_rules.judge(spark, docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe")
def op6_bpe(spark, folder):
    """Every document encoded, and decoded from its ids again."""
    vocabulary = bpe.read_text(BYTE_VOCABULARY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = bpe.encode(spark, docs, vocabulary, decoded=True).drop("text")
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op9_packing")
def op9_packing(spark, folder):
    """Every piece of every document and where it is packed."""
    return packing.pack(spark, table(spark, folder, "documents"), bpe.read_text(WORD_VOCABULARY), with_ids=False)


@query("op1_warc", """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from d)
select page_id, payload_bytes, payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
       case when first_id <> page_id then first_id end as refers_to from f
""")
def op1_warc(spark, folder):
    """Every page through the archive and back: whole records are made, and cut into headers and blocks again."""
    archive = scratch(spark, "archive")
    warc.write_archive(spark, table(spark, folder, "pages").select("page_id", "url", "html"), archive)
    raw = warc.records(warc.read_archive(spark, archive)).select("record")
    kind = warc.field("WARC-Type")
    own = kind == "response"  # a revisit has no block; what it states of its payload was held against the stored one above
    return warc.parse_records(raw).select(
        warc.field("X-Page-ID").cast("bigint").alias("page_id"),
        F.when(own, F.octet_length("block")).otherwise(warc.field("X-Payload-Length").cast("bigint")).cast("bigint").alias("payload_bytes"),
        F.when(own, F.sha2("block", 256)).otherwise(F.substring_index(warc.field("WARC-Payload-Digest"), ":", -1)).alias("payload_digest"),
        kind.alias("record_type"), warc.field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"))


#: The rules of the query: (rule, action).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op3_url_rules", r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select h.page_id, h.host, h.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') as verdict
from h left join rules r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path)
group by h.page_id, h.host, h.path
""")
def op3_url_rules(spark, folder):
    """Host, path, deciding rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return urlrules.verdicts(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@query("op4_quality_model")
def op4_quality_model(spark, folder):
    """Quality score of every document."""
    return quality_model.classify(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_vectors")
def op10_vectors(spark, folder):
    """Links and component of every embedding."""
    return vectors.near_duplicates(spark, table(spark, folder, "embeddings"))


PII_KEY = "surrogates of the registered query"


@query("op7_pii")
def op7_pii(spark, folder):
    """Every document with its personal data replaced."""
    return pii.replace(spark, table(spark, folder, "documents").select("doc_id", "text"), PII_KEY)


#: Tools of the query's calls: (tool, schema).
TOOLS = [
    ("measure", '{"properties":{"chars":{"type":"integer","maximum":400},"unit":{"type":"string","enum":["letter","byte"]}},"required":["chars","unit"]}'),
    ("lookup", '{"properties":{"query":{"type":"string","maxLength":300},"limit":{"type":"integer","minimum":0}},"required":["query"]}'),
]


@query("op8_tool_links", """
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
calls as (select conv_id, turn, 'call-' || conv_id || '-' || turn as call_id, turn % 4 < 2 as measured, text,
                 turn % 4 >= 2 and exists (select 1 from c p where p.conv_id = c.conv_id and p.turn = c.turn - 2 and p.role = 'user') as later,
                 exists (select 1 from c a where a.conv_id = c.conv_id and a.turn = c.turn + 1 and a.role = 'assistant') as answered from c where role = 'user'),
checked as (select *, case when measured and length(text) > 400 then 'out of range: chars' when not measured and length(text) > 300 then 'too long: query' end as fault from calls),
told as (select conv_id, turn - 1 as call_turn, 'call-' || conv_id || '-' || (turn - 1) as call_id, text from c where role = 'assistant')
select conv_id, turn, 0 as level, 0 as slot, null as call_id, 'ok' as status, null as fault, '{"content":' || to_json(text) || ',"role":"' || role || '"}' as line from c
union all
select conv_id, turn, later::int, 1, call_id, case when fault is not null then 'invalid' when answered then 'linked' else 'unanswered' end, fault,
       '{"role":"assistant","tool_call":{"arguments":' || case when measured then '{"chars":' || length(text) || ',"unit":"letter"}' else '{"limit":' || turn || ',"query":' || to_json(text) || '}' end
       || ',"id":"' || call_id || '","name":"' || case when measured then 'measure' else 'lookup' end || '"}}' from checked
union all
select t.conv_id, k.turn, k.later::int, 2, t.call_id, case when k.call_id is null then 'orphan' else 'linked' end, null,
       '{"content":' || to_json(t.text) || ',"role":"tool","tool":' || coalesce('"' || case when k.measured then 'measure' else 'lookup' end || '"', 'null') || ',"tool_call_id":"' || t.call_id || '"}'
from told t left join calls k on t.conv_id = k.conv_id and t.call_id = k.call_id
""")
def op8_tool_links(spark, folder):
    """Every turn as a message; user turns also as tool calls, assistant turns as their results."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    measured = F.col("turn") % 4 < 2
    arguments = F.when(measured, F.to_json(F.struct(F.lit("letter").alias("unit"), F.length("text").alias("chars")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(measured, "measure").otherwise("lookup").alias("tool"), arguments.alias("arguments"),
        F.when(measured, F.array().cast("array<string>")).otherwise(F.array(name(F.col("turn") - 2))).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return chat.lines(spark, turns, calls, results, spark.createDataFrame(TOOLS, "tool string, schema string"))


@query("op11_mixing", r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, [2.0::double, 3.0::double, 1.0::double][(place % 3 + 1)::int] as weight from s),
r as (select *, 1.5::double * sum(size) over () as want, sum(weight) over () as weights, coalesce(sum(2.0::double * size) over before, 0.0) as limits, coalesce(sum(weight) over before, 0.0) as closed
      from w window before as (order by 2.0::double * size / weight, place rows between unbounded preceding and 1 preceding)),
l as (select arg_min((want - limits) / (weights - closed), closed) as level from r where 2.0::double * size > weight * ((want - limits) / (weights - closed))),
t as (select source, size, place, least(2.0::double * size, weight * coalesce(level, 0.0)) as target from w cross join l),
n as (select floor(sum(target) / 16 + 0.5)::bigint as seats from t),
q as (select source, row_number() over (order by target / (2 * k + 1) desc, place) as turn from t cross join n, range((ceil(target * seats / (select sum(target) from t)) + (select count(*) from t) + 2)::bigint) x(k) where target > 0),
g as (select t.*, least(16 * coalesce((select count(*) from q cross join n where turn <= seats and q.source is not distinct from t.source), 0), 2 * size) as given from t),
p as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by md5('mix:' || coalesce(doc_id::varchar, '')), doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as start from d)
select p.doc_id, p.size, g.size as source_size, g.target, case when g.size > 0 then (given // g.size) * p.size + greatest(0, least(p.size, given % g.size - start)) else 0 end::bigint as taken
from p join g on p.source is not distinct from g.source
""")
def op11_mixing(spark, folder):
    """Words that a mix of the sources takes of every document."""
    mixed, _ = mixing.mix(spark, table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op12_lexical", r"""
with t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
a as (select item_id, term, count(*) as times from i group by all),
s as (select count(*) as docs, sum(len(terms))::bigint as total from t where len(terms) > 0),
o as (select doc_id, len(terms) as n, unnest(terms) as term from t),
p as (select doc_id, term, any_value(n) as n, count(*) as tf from o semi join a using (term) group by doc_id, term),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p cross join s group by term),
c as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::bigint as score
      from a join p using (term) join w using (term) cross join s group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from c where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
""")
def op12_lexical(spark, folder):
    """The twenty best documents of every benchmark item."""
    return lexical.search(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def round_sql(k: int) -> str:
    """The nearest entries of round ``k`` and, but for the last round, the entries of the next one."""
    near = f"""
n{k} as (select i, part, x, arg_min(k, far * 1000 + k) as k, min(far) as far from (
  select p.i, p.part, p.x, c.k, list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c.c[j]) * (x[j] - c.c[j])))::bigint as far from p join c{k} c using (part)) group by all)"""
    return near.replace("group by all", "group by i, part, x") + ("" if k == 2 else f""",
s{k} as (select part, k, j, sum(x[j])::bigint as s, count(*) as n from n{k}, range(1, len(x) + 1) r(j) group by part, k, j),
c{k + 1} as (select c.part, c.k, coalesce(m.c, c.c) as c from c{k} c left join
  (select part, k, list((s - ((s % n) + n) % n) // n order by j) as c from s{k} group by part, k) m on c.part = m.part and c.k = m.k),""")


@query("op13_vector_codes", f"""
with v as (select row_number() over (order by vec_id) as i, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as z from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select i, part, z[part * len(z) // 16 + 1:(part + 1) * len(z) // 16] as x from v, range(16) r(part)),
c0 as (select part, i - 1 as k, x as c from p where i <= 64),{round_sql(0)}{round_sql(1)}{round_sql(2)},
h as (select sha256(string_agg(c[j], ',' order by part, k, j)) as codebooks_sha256 from c2, range(1, len(c) + 1) r(j)),
e as (select i, string_agg(printf('%02x', k), '' order by part) as code, sum(far)::bigint as error from n2 group by i)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from e join v using (i) cross join h
""")
def op13_vector_codes(spark, folder):
    """Code and error of every embedding."""
    coded, books = vectorcodes.compress(spark, table(spark, folder, "embeddings"))
    return vectorcodes.with_label_errors(spark, coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
