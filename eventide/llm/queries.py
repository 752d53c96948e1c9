"""One registered query for each operator, over the whole of its table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import (
    bpe, chat, conv_trie, conversation_sql, decontaminate, factors, html_text, langid, licences, lm, quality, repair, simhash, urls,
)
from eventide.llm.common import fold, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query()
def op4_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    known = langid.labelled_fold(docs).select("doc_id", "text", "lang")
    told = langid.identify(docs.select("doc_id", "text"), known)
    return told.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ok").alias("accepted"),
    )


TRICKY = r"\### Assistant: </turn> ok"


def _op6_sql() -> str:
    """Digests straight from the input; windows again by prefix sums, for their length."""
    order = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
    return rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
    g AS (
      SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt
      FROM t GROUP BY conv_id),
    s0 AS (SELECT *, '<turn>' || regexp_replace(role, '([\\<\n])', '\\\1', 'g') || chr(10)
             || regexp_replace(text, '([\\<])', '\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS shown FROM t),
    s AS (SELECT *, len(regexp_extract_all(shown, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]')) AS size FROM s0),
    o AS (SELECT *, row_number() OVER ({order}) AS pos, sum(size) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM s),
    l AS (SELECT conv_id AS c, size AS sys_size, length(shown) AS sys_len FROM o WHERE pos = 1 AND role = 'system'),
    r AS (SELECT o.*, sys_size, sys_len, greatest(512 - 64 - coalesce(sys_size, 0), 2) AS room
          FROM o LEFT JOIN l ON o.conv_id IS NOT DISTINCT FROM l.c),
    x AS (SELECT *, size * 2 > room AS lng, floor((upto - size) * 2 / room) AS stretch FROM r),
    y AS (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN lng OR lag(lng) OVER ({order}) OR lag(stretch) OVER ({order}) <> stretch
                         THEN 1 ELSE 0 END AS starts FROM x),
    w AS (SELECT *, sum(starts) OVER ({order} ROWS UNBOUNDED PRECEDING) AS win FROM y),
    e AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, win) AS span_end, max(win) OVER (PARTITION BY conv_id) AS last FROM w),
    f AS (SELECT conv_id, sum(length(shown) * CASE WHEN span_end - (upto - size) <= 64 AND win < last
                                                   AND NOT (pos = 1 AND role = 'system') THEN 2 ELSE 1 END)
                 + max(last) * coalesce(max(sys_len), 0) AS formatted_chars FROM e GROUP BY conv_id)
    SELECT g.conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
           formatted_chars::BIGINT AS formatted_chars
    FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id"""


@query(_op6_sql())
def op6_chat(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = chat.read_back(chat.windows(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = back.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum(F.char_length("text")).cast("bigint").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", lines.alias("lines"), F.array_join("learnt", "").alias("learnt")))).alias("w"),
    )
    whole = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return one.select(
        "conv_id", "n_turns", F.sha2(whole("lines"), 256).alias("turns_sha256"),
        F.char_length(whole("learnt")).cast("bigint").alias("loss_chars"), F.sha2(whole("learnt"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


URL_RULES = (
    urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block"),
)


def _op8_sql() -> str:
    two = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(string_split(site, '.')[-{n}:], '.')"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(URL_RULES, key=lambda r: -len(r.text))
    case = lambda f: " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in longest)
    strength = lambda t: f"""
      (SELECT CASE WHEN coalesce(n, 0) = 0 OR p IN (0, 1) OR free <= 0 OR rho <= 0 THEN 1000.0
                   ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END AS k
       FROM (SELECT *, (spread / (p * (1 - p)) - (g - 1)) / free AS rho
             FROM (SELECT *, bb - bad * p AS spread, n - nn / n - (g - 1) AS free
                   FROM (SELECT *, bad / n AS p
                         FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS g, sum(n * n)::DOUBLE AS nn,
                                      sum(bad * bad / n::DOUBLE) AS bb FROM {t})))))"""  # noqa: E731
    return rf"""
    WITH p0 AS (
      SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    p AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS site FROM p0),
    said AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
             WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
    lab AS (SELECT page_id, site, max(bad) AS bad FROM p JOIN said USING (page_id) GROUP BY 1, 2),
    seen AS (SELECT site, count(*) AS n, sum(bad) AS bad FROM lab GROUP BY 1),
    sites AS (SELECT DISTINCT site, CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain,
              CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM p),
    bs AS (SELECT * FROM seen JOIN sites USING (site)),
    bd AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM bs GROUP BY 1, 2),
    bx AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM bs GROUP BY 1),
    rate AS (SELECT coalesce(sum(bad)::DOUBLE / sum(n), 0.5) AS p FROM bx),
    k AS (SELECT {strength('bs')} AS k_site, {strength('bd')} AS k_domain, {strength('bx')} AS k_suffix),
    mx AS (SELECT suffix, (bad + k_suffix * rate.p) / (n + k_suffix) AS m FROM bx, k, rate),
    md AS (SELECT domain, (bad + k_domain * mx.m) / (n + k_domain) AS m FROM bd JOIN mx USING (suffix), k),
    ab AS (SELECT s.site, coalesce(bs.bad, 0) + k_site * coalesce(md.m, mx.m, rate.p) AS a,
                  coalesce(bs.n, 0) - coalesce(bs.bad, 0) + k_site * (1 - coalesce(md.m, mx.m, rate.p)) AS b
           FROM sites s LEFT JOIN bs ON s.site = bs.site LEFT JOIN md ON s.domain = md.domain
                LEFT JOIN mx ON s.suffix = mx.suffix, k, rate),
    v AS (SELECT site, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS blocked FROM ab)
    SELECT page_id, host, path, CASE {case(lambda r: r.text)} END AS rule,
           CASE {case(lambda r: r.verdict)} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
    FROM p JOIN v USING (site)"""


@query(_op8_sql())
def op8_urls(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = urls.outcomes(read(spark, sf, "labels"))
    return urls.judge(read(spark, sf, "pages"), outcomes, URL_RULES)


@query()
def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query()
def op7_html(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages").select("page_id", "url", "html"))


@query()
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read(spark, sf, "documents"))


@query()
def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query()
def op2_factors(spark: SparkSession, sf: str) -> DataFrame:
    out = factors.without_repeats(read(spark, sf, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op1_lm(spark: SparkSession, sf: str) -> DataFrame:
    out = lm.score(read(spark, sf, "documents"), fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op13_licences(spark: SparkSession, sf: str) -> DataFrame:
    out = licences.scan(read(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query(conversation_sql.REPAIR)
def op11_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(repair.damaged(read(spark, sf, "conversations"))).drop("repaired")


@query(conversation_sql.TRIE)
def op12_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conv_trie.prefix_trie(conv_trie.with_shared_heads(conv_trie.numbered(read(spark, sf, "conversations"))))
