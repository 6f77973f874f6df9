"""The registered queries opN_<name> and their SQL twins."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from daywatch.llm import (ann, audit, chat, exact_dedup, langid, lexical, mixing, neardup, pieces,
                          quality, simhash, substring, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark, sf_dir):
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)


ORACLE["op1_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY cp DESC, doc_id)
"""


@query
def op2_language(spark, sf_dir):
    """The language of every text, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query
def op3_quality(spark, sf_dir):
    """A quality score of every text."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_chat_format(spark, sf_dir):
    """Conversations rendered, read back from the rendered text and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(odd).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


ORACLE["op4_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) r(i)),
e AS (
  SELECT *, '(\\|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>|<<ROLE>>|<</ROLE>>)' AS risky FROM t),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, risky)) + CASE role WHEN 'user' THEN 15
         WHEN 'system' THEN 17 WHEN 'assistant' THEN 9
         ELSE 23 + length(role) + len(regexp_extract_all(role, risky)) END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256, sum(chars)::bigint AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op5_substring_dedup(spark, sf_dir):
    """What is left of each text without repeats of 50 words."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


ORACLE["op5_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos
      FROM k JOIN f USING (k) WHERE first < doc_id),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
      FROM o ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""


@query
def op6_sentencepiece(spark, sf_dir):
    """Ids by the agenda, checked with the library, and the decoded text."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), digest=True)


@query
def op7_mix_sources(spark, sf_dir):
    """Words that the mix takes of each document."""
    return mixing.taken_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


@query
def op8_neighbours(spark, sf_dir):
    """The ten nearest vectors found for each query."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op9_toxicity(spark, sf_dir):
    """A toxicity score of every text."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_near_dedup(spark, sf_dir):
    """Components of near duplicates on two-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


ORACLE["op10_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m ON m.id = s.doc_id
"""


@query
def op11_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return lexical.best_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLE["op11_lexical_search"] = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(coalesce(t, ''), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM lowered),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::bigint AS n_terms FROM w),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
      FROM benchmark),
p AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM w),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
       FROM p SEMI JOIN i USING (term) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT r, doc_id, term,
             floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint
             * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS x
      FROM tf JOIN df USING (term), s),
f AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(x)::bigint AS score
      FROM i JOIN v USING (term) GROUP BY item_id, r HAVING sum(x) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM f WHERE doc_id IS NOT NULL)
SELECT item_id, rank::int AS rank, doc_id, score FROM k WHERE rank <= 50
"""


@query
def op12_filter_audit(spark, sf_dir):
    """What five filters remove of each language, in all 120 orders."""
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
WITH l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic
           FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS later FROM t),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text)
                     THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN later THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM d GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM f p, f q, f r, f s, f u
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own,
              substr(filter_order, 1, step - 1) AS before
       FROM o, (SELECT unnest(range(1, 6))::int AS step)),
m AS (SELECT c.*, st.*, contains(fails, own) AS hit, translate(fails, before, '') = fails AS reached
      FROM c, st),
g AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (reached AND NOT hit), 0)::bigint AS kept,
             coalesce(sum(n) FILTER (reached AND hit), 0)::bigint AS removed,
             coalesce(sum(n) FILTER (hit AND NOT reached), 0)::bigint AS redundant,
             coalesce(sum(n) FILTER (fails = own), 0)::bigint AS unique_fails,
             coalesce(sum(good) FILTER (reached AND hit), 0)::bigint AS good_lost,
             coalesce(sum(toxic) FILTER (reached AND hit), 0)::bigint AS toxic_lost
      FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley
FROM g
"""


@query
def op13_simhash(spark, sf_dir):
    """Components of near copies by 64-bit fingerprints of four-word shingles."""
    return simhash.near_copies(table(spark, sf_dir, "documents"))
