"""The registered queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.chat import chains, formatted, read_back
from logloom.llm.decontaminate import contamination
from logloom.llm.exact_dedup import exact_groups
from logloom.llm.fill_middle import fill_in_middle, restore
from logloom.llm.jaccard_join import jaccard_components
from logloom.llm.line_dedup import line_dedup
from logloom.llm.neighbours import nearest
from logloom.llm.packing import digests, packed
from logloom.llm.quality import quality
from logloom.llm.secrets import scan_secrets
from logloom.llm.sharding import lookup_table, place
from logloom.llm.substring_dedup import substring_dedup
from logloom.llm.whitening import whitened

#: Folder and name of the public tokenizer; None: where the installed package has it.
TOKENIZER: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, least=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(packed(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


#: Shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), SHARDS)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: A conversation whose texts hold control strings of the template.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(*(F.when(F.col("id") == 0, a).otherwise(b).alias(c) for c, a, b in zip(own.columns, *TRICKY, strict=True)))
    out = read_back(formatted(chains(own.unionByName(more))))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return out.select(F.col("tree").alias("conv_id"), F.size("roles").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def page_of() -> Column:
    """The document of a page: the number that ends its address's path."""
    return F.expr(r"try_cast(nullif(regexp_extract(url, '^[^?#]*/([0-9]+)(?:[.][a-z]+)?/?(?:[?#]|$)', 1), '') as bigint)")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), pages=table(spark, sf_dir, "pages"), page_of=page_of())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_packing, op3_exact_dedup, op4_secret_scan, op5_sharding, op6_substring_dedup, op7_chat_formatting, op8_decontamination, op9_quality, op10_line_dedup, op11_whitening, op12_fill_in_middle, op13_neighbours)}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op5_sharding": f"""
select doc_id, s.slot, cast(string_split('{",".join(map(str, lookup_table(SHARDS)))}', ',')[cast(s.slot as int) + 1] as bigint) as shard_id
from (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % 65537 as slot from documents) s""",
    "op7_chat_formatting": r"""
with c as (select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as nr from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by nr)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by nr) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(20 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&num;'), ':', '&colon;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&num;'))) as bigint) as formatted_chars
from t group by conv_id""",
    "op12_fill_in_middle": r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as hex from documents),
u as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units from t),
h as (select *, cast(len(units) as bigint) as n, [cast('0x' || substr(hex, 1, 8) as bigint), cast('0x' || substr(hex, 9, 8) as bigint), cast('0x' || substr(hex, 17, 8) as bigint), cast('0x' || substr(hex, 25, 8) as bigint)] as h from u),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p""",
}
