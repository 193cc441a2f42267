"""The query of each corpus operator, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, common, debruijn, exact_dedup, iblt, license_scan, mixing, packing, periodic_runs, ppm, sharding, simhash_anchor, toxicity_crf

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_toxicity_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity_crf.learn(docs, labels.filter(~toxicity_crf.held_out()))
    return toxicity_crf.score(docs, model).select("doc_id", toxicity_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


@query("op2_iblt_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.near_next_and_edited(documents(spark, sf_dir))


@query("op3_karmarkar_karp_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op5_sainte_lague_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op6_ppm_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")


@query("op7_simhash_anchors")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchor.near_groups(documents(spark, sf_dir))


#: A body as it stands in the output: escaped if the parser would not give it back.
_BODY = r"""case when regexp_matches(text, '(?s)\\.')
  or (role = 'user' and contains(text, ' [/INST]'))
  or (role = 'assistant' and (contains(text, '</s>') or regexp_matches(text, '^(?s:\[INST\] .* \[/INST\]|<<SYS>>.*<</SYS>>)')))
  or (role not in ('user', 'assistant') and contains(text, '<</SYS>>'))
  then regexp_replace(replace(text, '\', '\\'), '(\[|<)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2', 'g') else text end"""


@query(
    "op8_chat_round_trip",
    rf"""with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b as (select *, {_BODY} as body from t)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(body) + case role when 'user' then 15 when 'assistant' then 4 else 16 + length(url_encode(role)) end) as bigint) as formatted_chars
from b group by conv_id""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(r"select * from values (-7L, 0L, 'user', r'</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', r'</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = chat.format_chats(given.union(planted))
    # the text under the loss mask, cut out of the formatted one
    said = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op9_debruijn_repeats",
    r"""with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from t),
s as (select doc_id, unnest(range(1, len(words) - 11)) as i, unnest(list_transform(range(1, len(words) - 11), lambda i: array_to_string(words[i:i + 12], ' '))) as said from t where len(words) > 12),
g as (select doc_id, i, min(doc_id) over (partition by said) < doc_id as again from s),
c as (select w.*, coalesce(bool_or(again) over (partition by w.doc_id order by w.i rows between 12 preceding and current row), false) as gone from w left join g using (doc_id, i))
select t.doc_id, cast(count(i) as bigint) as n_words, cast(count(i) filter (gone) as bigint) as n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept_sha256
from t left join c using (doc_id) group by t.doc_id""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(documents(spark, sf_dir)).drop("removed")


@query(
    "op10_exact_tree_merge",
    r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, cast(count(*) over (partition by norm) as bigint) as group_size,
  row_number() over (partition by norm order by doc_id) = 1 as kept, sha256(norm) as text_sha256 from t""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op11_license_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def with_periods(docs: DataFrame) -> DataFrame:
    """Some documents, told by a hash of the id, repeat a stretch of themselves to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", common.SPACE), lambda w: w != "")).alias("words")).withColumn("n", F.size("words"))
    a = F.pmod("g", "n").cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    repeated = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))), " ")
    return split.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p).select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op12_kolpakov_kucherov_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(with_periods(documents(spark, sf_dir))).drop("n_words", "runs")


@query(
    "op13_suffix_array_collocations",
    r"""with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from t),
n as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang having sum(len(w)) > 0),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from p, (values (1), (2), (3), (4)) as ks(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as c from g group by lang, k, phrase having count(*) >= 30),
c as (select *, string_split(phrase, ' ') as w from f where k > 1),
inside as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(c) as longer
  from c, (values (2), (3)) as ms(m), (values (1), (2), (3)) as starts(i) where m < k and i + m - 1 <= k group by 1, 2),
alone as (select c.* from c left join inside using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * c.c),
cut as (select a.lang, a.phrase, a.c as a, j as k, h.c as l, t.c as r, 2000000::hugeint * a.c // (h.c + t.c) as score
  from alone a, (values (1), (2), (3)) as js(j), f h, f t
  where j < a.k and h.lang = a.lang and h.phrase = array_to_string(a.w[1:j], ' ') and t.lang = a.lang and t.phrase = array_to_string(a.w[j + 1:], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from best join n using (lang) qualify rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))
