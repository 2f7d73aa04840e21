"""The registered queries of the subpackage: the test tables mapped to the operators and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.lineage import cut_lineage
from groundcheck.llm import (fingerprints, language, mixing, ngram_join, packing, passages, phrase_index, prefix_trie, repeats,
                             sharding, spelling, topk, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(docs: DataFrame) -> DataFrame:
    """Documents as review notes."""
    return docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    found = topk.top_matches(rows.filter("item_id % 20 = 0"), rows, k=20)
    return found.select("query_id", "rank", F.col("match_id").alias("vec_id"), "score")


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 20"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_notes(notes(table(spark, sf_dir, "documents")), shards=16)
    return placed.select(F.col("event_id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def rest(by: int) -> "F.Column":
    """Remainder of the checksum of the id's digits."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str, held_out: bool) -> toxicity.ToxicityModel:
    labels = table(spark, sf_dir, "labels")
    if held_out:
        labels = labels.filter(rest(5) != 0)
    return toxicity.fit_toxicity(notes(docs), labels.withColumnRenamed("doc_id", "event_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_notes(notes(table(spark, sf_dir, "documents")), width=3, percent=90)
    return linked.select(F.col("event_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP3_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, list_distinct(case when w is null or len(w) = 0 then []::varchar[]
    when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) end) as s from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, e.b from reach r join edges e on r.b = e.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.b) as component_id
from sets s join reach r on s.doc_id = r.a group by s.doc_id, len(s.s)"""


def op3_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of links."""
    linked = ngram_join.link_notes(notes(table(spark, sf_dir, "documents")), width=3, percent=90, count_links=True)
    return linked.select(F.col("event_id").alias("doc_id"), F.col("links").alias("n_links"))


OP3_LINKS_SQL = OP3_SQL[:OP3_SQL.index(",\nreach(")] + """
select s.doc_id, count(e.b) as n_links from sets s left join edges e on s.doc_id = e.a group by s.doc_id"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir, held_out=True)
    return toxicity.score_notes(notes(docs), model).withColumnRenamed("event_id", "doc_id").select(
        "doc_id", (rest(5) == 0).alias("held_out"), "score", "predicted")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(rest(4) != 2).select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), "lang")
    model = language.fit_language(learned)
    return language.predict_language(notes(docs), model).withColumnRenamed("event_id", "doc_id").select(
        "doc_id", (rest(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.drop_repeated_passages(notes(table(spark, sf_dir, "documents")))
    return cut.select(F.col("event_id").alias("doc_id"), F.col("notes").alias("kept_text"), "words_removed")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(notes(table(spark, sf_dir, "documents")), length=200)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("event_id").alias("doc_id"), "n_bytes", size.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def packed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), *keep)
    return packing.pack_notes(rows, tokenizer_path(), keep=keep).withColumnRenamed("event_id", "doc_id")


#: Shares of the tokens by source, language and topic.
MIX = {"source": {"src0": 0.25, mixing.REST: 0.75},
       "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
       "topic": {"prose": 0.85, "licensed": 0.1, "table": 0.05}}


def topic() -> "F.Column":
    """A coarse topic of a document by what stands in its text."""
    return (F.when(F.col("text").contains(" | "), "table").when(F.lower("text").contains("licen"), "licensed")
            .otherwise("prose"))


def mixed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), "source", "lang",
                       topic().alias("topic"), *keep)
    return mixing.mix_notes(rows, MIX, keep=keep).withColumnRenamed("event_id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint_notes(notes(table(spark, sf_dir, "documents")))
    return made.select(
        F.col("event_id").alias("doc_id"), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def rebuilt(turns: DataFrame, threads: DataFrame) -> DataFrame:
    """Threads whose first turns are those of the first thread of their hundred, as the contract deals them."""
    head = F.pmod(F.crc32(F.col("thread").cast("string")), F.lit(6))
    base = (F.col("thread") - F.col("thread") % 100).alias("base")
    own = turns.filter(F.col("at") > head)
    wanted = threads.select("thread", base, head.alias("head"))
    firsts = turns.filter("thread % 100 = 0 and at <= 5").withColumnRenamed("thread", "base")  # a head has at most 5 turns
    given = wanted.join(firsts, "base").filter("at <= head")
    held = given.groupBy("thread").agg(F.max("at").alias("n_head"))
    moved = own.join(held, "thread", "left").select(
        "thread", (F.col("at") - head + F.coalesce("n_head", F.lit(0))).alias("at"), "role", "text")
    return given.select("thread", "at", "role", "text").unionByName(moved)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    threads = talks.select(F.col("conv_id").alias("thread")).filter("thread is not null").distinct()
    turns = cut_lineage(prefix_trie.number_turns(talks, thread="conv_id", order="turn", role="role", text="text"))
    tree = prefix_trie.prefix_trie(rebuilt(turns, threads), threads)
    return tree.select(
        F.col("first_thread").alias("conv_id"), "depth", F.col("parent_thread").alias("parent_conv_id"),
        F.col("n_threads").alias("n_convs"), "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


#: The 256 steps of CRC-32.
CRC_SQL = """crc_table as (
  select list(c order by b) as t from (
    select b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
      case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
    from (select unnest(range(256)) as b)))"""


def crc_sql(data: str) -> str:
    """The unsigned CRC-32 of an expression that is a list of bytes."""
    return (f"xor(list_reduce([4294967295::bigint] || {data}, lambda c, x: "
            f"xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295)")


OP11_SQL = f"""
with {CRC_SQL},
turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
threads as (
  select c, c - c % 100 as base, {crc_sql("list_transform(string_split(c::varchar, ''), lambda s: unicode(s)::bigint)")} % 6 as h
  from (select distinct conv_id as c from conversations where conv_id is not null), crc_table),
given as (select r.c, t.pos, t.role, t.text from threads r join turns t on t.c = r.base and t.pos <= r.h),
held as (select c, max(pos) as n from given group by c),
moved as (
  select t.c, t.pos - r.h + coalesce(n, 0) as pos, role, text from turns t join threads r using (c) left join held using (c) where t.pos > r.h),
paths as (
  select c, pos, length(text) as chars, list(struct_pack(r := role, t := text)) over (
    partition by c order by pos rows between unbounded preceding and current row) as p
  from (select * from given union all select * from moved)),
places as (
  select c, 0 as d, 0 as chars, []::struct(r varchar, t varchar)[] as p from threads
  union all select c, pos as d, chars, p from paths),
nodes as (select p, d, min(c) as conv_id, count(*) as n_convs, max(chars) as chars from places group by p, d),
parents as (select n.p, n.d, m.conv_id as up from nodes n join nodes m on n.d > 0 and m.d = n.d - 1 and m.p = n.p[1:n.d - 1]),
kids as (select conv_id, d, count(*) as n from (select up as conv_id, d - 1 as d from parents) group by conv_id, d),
tree as (
  select n.conv_id, n.d, up, n_convs, coalesce(k.n, 0) as n_children, chars, n.p from nodes n
  left join parents using (p, d) left join kids k on k.conv_id = n.conv_id and k.d = n.d),
below as (
  select t.conv_id, t.d, count(*) filter (where s.n_children = 0) as n_leaves, sum((s.n_convs - 1) * s.chars) as saved
  from (select *, unnest(range(d + 1)) as e from tree) s join tree t on t.d = s.e and t.p = s.p[1:s.e] group by t.conv_id, t.d),
ends as (
  select p, d, string_agg(c::varchar, ',' order by c) as ids from (
    select c, p, d, row_number() over (partition by c order by d desc) as r from places) where r = 1 group by p, d)
select t.conv_id, cast(t.d as bigint) as depth, up as parent_conv_id, n_convs, n_children, n_leaves,
  cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from tree t join below using (conv_id, d) left join ends using (p, d)"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.count_words(notes(table(spark, sf_dir, "documents")), slips=199)
    return spelling.group_spellings(counted, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = rf"""
with recursive {CRC_SQL},
runs as (
  select doc_id, w, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as w from documents)
  where length(w) >= 6 group by doc_id, w),
hashed as (
  select *, {crc_sql("""flatten(list_transform(string_split(concat(doc_id::varchar, ':', w), ''), lambda s:
      case when unicode(s) < 128 then [unicode(s)::bigint] else [192 + unicode(s) // 64, 128 + unicode(s) % 64] end))""")} as h
  from runs, crc_table),
words as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 199 = 0 and doc_id is not null then concat(w[1:h % length(w)], w[h % length(w) + 2:]) else w end as word, n
    from hashed) where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (
  select word, n, word as cut from words
  union select word, n, concat(word[1:i], word[i + 2:]) from (select *, unnest(range(length(word))) as i from words)),
near as (
  select distinct a.word as a, a.n, b.word as b, b.n as m from cuts a join cuts b on a.cut = b.cut and a.word <> b.word
    and abs(length(a.word) - length(b.word)) <= 1
  where length(a.word) <> length(b.word)
    or len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1),
best as (select a, count(*) as n_near, max(m) as m, min(b) filter (where m = top) as b
  from (select *, max(m) over (partition by a) as top from near) group by a),
forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then b end as form, case when m >= 5 * n then m end as form_n
  from words left join best on word = a),
walk(word, goal) as (
  select word, word from forms
  union all select walk.word, f.form from walk join forms f on f.word = walk.goal where f.form is not null),
roots as (select k.word, k.goal as root from walk k join forms f on f.word = k.goal where f.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("warning_id"), F.col("text").alias("explanation"))
    found = phrase_index.contaminated_notes(notes(table(spark, sf_dir, "documents")), items, width=10)
    return found.select(
        F.col("event_id").alias("doc_id"), "n_words", "n_hit", F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + 9], ' ') as g
  from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
hits as (select dw.r, dw.i, dw.k, bw.item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
covered as (select r, count(distinct p) as n from (select r, i + unnest(range(k)) as p from hits) group by r),
items as (
  select r, count(*) as n, string_agg(s, ',' order by s) as names
  from (select distinct r, cast(item_id as varchar) as s from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(c.n, 0) as n_hit, coalesce(t.n, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join covered c using (r) left join items t using (r)"""


QUERIES = {
    "op1_topk": (op1_topk, OP1_SQL),
    "op2_sharding": (op2_sharding, None),
    "op3_ngram_join": (op3_ngram_join, OP3_SQL),
    "op3_link_counts": (op3_link_counts, OP3_LINKS_SQL),
    "op4_toxicity": (op4_toxicity, None),
    "op5_passages": (op5_passages, None),
    "op6_repeats": (op6_repeats, None),
    "op7_mixing": (op7_mixing, None),
    "op8_packing": (op8_packing, None),
    "op9_fingerprints": (op9_fingerprints, None),
    "op10_language": (op10_language, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_spelling": (op12_spelling, OP12_SQL),
    "op13_decontamination": (op13_decontamination, OP13_SQL),
}
