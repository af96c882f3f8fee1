"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import conversation_trie, decontam, exact_dedup, filter_audit, langid, minhash, mixing, ngram_join, quality, secret_scan, substring_dedup, token_files, warc
from touchline.llm.shared import documents, table


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: The vocabulary of the token files, and the id that ends a document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(documents(spark, sf_dir), vocabulary(), END_ID)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.fit_profiles(docs.filter(_remainder(4) != 2))
    held_out = (F.coalesce(_remainder(4), F.lit(0)) == 2).alias("held_out")
    return langid.predict(docs, profiles).select("doc_id", held_out, "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), _remainder(3) != 1)
    return scored.select("doc_id", (F.coalesce(_remainder(3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = substring_dedup.mark_repeats(documents(spark, sf_dir))
    return marked.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(documents(spark, sf_dir)))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(conversation_trie.numbered(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_source_mix": op3_source_mix,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_ngram_join": op11_ngram_join,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             2.0::DOUBLE * source_size AS cap FROM r),
t AS (SELECT *, cap / weight AS level,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS trial
      FROM w WINDOW p AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT trial AS shared FROM t WHERE trial <= level ORDER BY level, place LIMIT 1),
g AS (SELECT source, source_size, least(cap, coalesce(shared * weight, cap)) AS target FROM t LEFT JOIN l ON true),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
                   < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW best AS (PARTITION BY body ORDER BY points DESC, doc_id)
""",
    "op12_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT body, min(doc_id) AS head FROM w GROUP BY body),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
              100 * (length(w.body) - length(regexp_replace(w.body, '[A-Z]', '', 'g'))) > 2 * length(w.body), regexp_matches(w.body, '[#$%&*|]'),
              coalesce(w.doc_id > head, false)] AS fails
      FROM w JOIN t ON w.body = t.body LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, len(list_filter(fails, lambda x: x)) AS n_fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS places FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, array_to_string(list_transform(places, lambda x: chr(64 + x)), '') AS filter_order, i.x AS step, places[i.x] AS filter, fails, n_fails, n, n_good, n_toxic,
             len(list_filter(places[:i.x - 1], lambda x: fails[x])) > 0 AS gone FROM c, o, i),
g AS (SELECT part, filter_order, step, filter,
             CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails[filter]), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails[filter]), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (gone AND fails[filter]), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (n_fails = 1 AND fails[filter]), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(n_good) FILTER (NOT gone AND fails[filter]), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (NOT gone AND fails[filter]), 0) AS BIGINT) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g
""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': body} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
z AS (SELECT range AS b, list_reduce(list_prepend(range, list_transform(range(8), lambda x: 0)), lambda a, y: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS code FROM range(256)),
h AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                  lambda a, y: xor(a >> 8, codes[CAST(xor(a & 255, y) AS INTEGER) + 1])) AS state
      FROM o, (SELECT list(code ORDER BY b) AS codes FROM z)),
c AS (SELECT o.conv_id, coalesce(p.turns[:xor(state, 4294967295) % 9], []) || coalesce(o.turns[xor(state, 4294967295) % 9 + 1:], []) AS turns
      FROM o JOIN h USING (conv_id) LEFT JOIN o p ON p.conv_id = o.conv_id - o.conv_id % 5),
m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
n AS (SELECT depth, turns[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(strlen(turns[depth].t), 0)) AS bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
      FROM m GROUP BY ALL),
k AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
d AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN d ON k.depth = d.depth AND k.path = d.path),
u AS (SELECT unnest(range(depth + 1)) AS depth, path, n_children, (n_convs - 1) * bytes AS saved FROM x),
s AS (SELECT depth, path[:depth] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY ALL)
SELECT x.conv_id, x.depth, x.parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.ends_sha256
FROM x JOIN s ON x.depth = s.depth AND x.path = s.path
""",
}
