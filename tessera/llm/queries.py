"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, lm_scoring, ngram_join, packing, preferences, quality_rules, secret_scan, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scanned(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return got.select("doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(_table(spark, sf_dir, "documents")).select("doc.doc_id", "n_lines", "n_removed", "doc.text")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = preferences.formatted(preferences.swapped_replies(_table(spark, sf_dir, "conversations")))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return got.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen", "rejected", ranges("chosen_mask"), ranges("rejected_mask"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judged(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return got.select("row.doc_id", *(f"m.{c}" for c in counts), "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.col("items")
    return got.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_files.token_files(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_warc": op2_warc,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_preferences": op6_preferences,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
}

#: DuckDB SQL where it can express the query.
SQL: dict[str, str] = {
    "op2_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as last from p where strlen(html) >= 1000 group by html having count(*) > 1)
select page_id, cast(strlen(p.html) as bigint) as payload_bytes, sha1(p.html) as payload_digest,
  case when page_id <> last then 'revisit' else 'response' end as record_type, case when page_id <> last then last end as refers_to
from p left join g on p.html = g.html
""",
    "op6_preferences": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
l as (select conv_id, max(turn) as last from t where role = 'assistant' group by conv_id),
r as (select t.conv_id, t.turn as last, t.text as reply from t join l on t.conv_id = l.conv_id and t.turn = l.last),
p as (select a.conv_id as pair_id, a.last, b.reply as other from r a join r b on b.conv_id = xor(a.conv_id, 1)),
s as (select pair_id, turn, role, text as c, case when turn = last then other else text end as r from t join p on t.conv_id = p.pair_id),
n as (select *, row_number() over (partition by pair_id order by turn) as k, '<|' || role || '|>' || chr(10) as head from s),
m as (select pair_id, coalesce(min(k) filter (where c <> r) - 1, count(*)) as n_prefix from n group by pair_id),
f as (select n.*, n_prefix, k > n_prefix as rest, length(head) as h,
  sum(case when k > n_prefix then length(head) + length(c) + 1 else 0 end) over w as c_end, sum(case when k > n_prefix then length(head) + length(r) + 1 else 0 end) over w as r_end
  from n join m on n.pair_id = m.pair_id window w as (partition by n.pair_id order by k))
select pair_id, n_prefix, coalesce(string_agg(head || c || chr(10), '' order by k) filter (where not rest), '') as prompt,
  coalesce(string_agg(head || c || chr(10), '' order by k) filter (where rest), '') as chosen, coalesce(string_agg(head || r || chr(10), '' order by k) filter (where rest), '') as rejected,
  coalesce(string_agg((c_end - length(c) - 1) || ':' || c_end, ',' order by k) filter (where rest and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg((r_end - length(r) - 1) || ':' || r_end, ',' order by k) filter (where rest and role = 'assistant'), '') as rejected_mask
from f group by pair_id, n_prefix
""",
    "op7_quality_rules": r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
p as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2),
t as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as times from p),
r as (select doc_id, count(distinct i + k) as n from t, unnest([0, 1, 2]) as u(k) where times > 1 group by doc_id),
m as (select w.doc_id, source, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(r.n, 0) as n_repeat_words, len(lines) as n_lines from w left join r on w.doc_id = r.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  10 * n_symbols > n_words or 100 * n_dup_lines > 30 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as soft_failed from m),
h as (select source, count(*) as n, sum(case when base_failed or soft_failed then 1 else 0 end) as bad from f group by source),
q as (select avg(bad / n) as mean, var_pop(bad / n) as spread from h),
s as (select mean, case when spread > 1e-12 then greatest(0, mean * (1 - mean) / spread - 1) else 1e12 end as strength from q),
v as (select source, (bad + mean * strength) / (n + strength) as host_rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (soft_failed and host_rate >= 0.5) as kept
from f join v on f.source is not distinct from v.source
""",
}
