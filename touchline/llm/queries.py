"""One thin query per operator over whole tables, and the SQL that some can be checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    byte_bpe,
    chat,
    decontaminate,
    lm,
    merkle,
    neighbours,
    quality,
    repeats,
    rules,
    simhash,
    spelling,
    token_files,
    warc,
)
from touchline.llm.frames import fold, table
from touchline.session import stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), length=3, radius=2)
    return found.select(
        F.col("doc").alias("doc_id"),
        simhash.fingerprint_hex("fp").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_hits(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13
    )
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(decontaminate.CONTAMINATED).alias("contaminated"),
    )


SQL["op8_decontaminate"] = """
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents),
item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM benchmark),
windows AS (
    SELECT DISTINCT item, len(gram) AS size, array_to_string(gram, ' ') AS gram FROM (
        SELECT item, words[i : i + least(13, len(words)) - 1] AS gram
        FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i
              FROM item_words WHERE len(words) > 0))),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS gram
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
          FROM doc_words, sizes)),
found AS (
    SELECT doc_id, p.size, i, item FROM places p JOIN windows w USING (gram)
    WHERE p.size = w.size),
covered AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS word
          FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("doc", "doc_id").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    found = byte_bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, payloads=False).drop("payload", "url")
    return warc.resolve_revisits(stage(records, "records")).select(
        F.col("page").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL["op7_warc"] = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
heads AS (
    SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM payloads),
latest AS (
    SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest) AS last FROM heads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM latest
"""


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs.where(~quality.held_out()), labels.where(~quality.held_out()))
    return quality.scores(docs, model).select(
        F.col("doc").alias("doc_id"),
        quality.held_out("doc").alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.scores(docs, docs.where(~lm.held_out()))
    return found.select(
        F.col("doc").alias("doc_id"),
        lm.held_out("doc").alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(
        docs, path, tokenizer, end_id=0, pattern=public_tokenizers.PATTERN
    )
    return token_files.read_tokens(spark, path).select(
        F.col("doc").alias("doc_id"),
        "start",
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.maximal_conversations(table(spark, sf_dir, "conversations"))
    return found.withColumnRenamed("conv", "conv_id")


SQL["op3_chat"] = """
WITH whole AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
    WHERE conv_id IS NOT NULL GROUP BY conv_id),
kinds AS (
    SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY turns),
beginnings AS (
    SELECT DISTINCT turns[1 : n] AS turns
    FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM kinds))
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies,
    array_to_string([
        '<|im_start|>' || regexp_replace(coalesce(t.role, ''), '<\\|im_(start|end)\\|>', '', 'g')
        || chr(10)
        || regexp_replace(coalesce(t.text, ''), '<\\|im_(start|end)\\|>', '', 'g')
        || '<|im_end|>' || chr(10) for t in turns], '') AS text
FROM kinds ANTI JOIN beginnings USING (turns)
"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = [merkle.ascii_lower(c) if c == "text" else F.col(c) for c in merkle.FIELDS]
    changed = F.when(fold("doc_id", 3) == 0, merkle.leaf(lowered))
    found = merkle.manifest(docs, carry={"tampered": changed})
    start = F.coalesce("tampered", "leaf")
    folded = found.withColumn("folded_root", merkle.folded("path", start))
    return folded.select(
        F.col("doc").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest("path").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL["op13_merkle"] = """
WITH RECURSIVE texts AS (
    SELECT doc_id, lang, source, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS lowered, hex(encode(CAST(doc_id AS VARCHAR))) AS digits
    FROM documents),
crcs AS (
    -- Eight shifts a byte; the byte comes in before the first of them.
    SELECT *, xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten([
            [CAST('0x' || digits[2 * i + 1 : 2 * i + 2] AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
            for i in range(0, len(digits) // 2)])]),
        lambda c, b : xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc
    FROM texts),
fields AS (
    SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
        || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
        || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
    FROM crcs),
leaves AS (
    SELECT doc_id, lang,
        sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        CASE WHEN crc % 3 = 0
            THEN sha256(head || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-'))
            ELSE leaf END AS start,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx,
        count(*) OVER (PARTITION BY lang) AS n
    FROM fields),
low(lang, level, idx, n, digest) AS (
    SELECT lang, 0, idx, n, leaf FROM leaves
    UNION ALL
    SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
    FROM low WHERE n > 1 GROUP BY lang, level, idx // 8, n),
subroots AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx,
        count(*) OVER () AS n FROM low WHERE n = 1),
high(level, idx, n, digest) AS (
    SELECT 0, idx, n, subroot FROM subroots
    UNION ALL
    SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
    FROM high WHERE n > 1 GROUP BY level, idx // 8, n),
nodes AS (
    SELECT lang, level, idx, digest, idx // 8 AS run FROM low WHERE n > 1
    UNION ALL SELECT s.lang, 1000 + h.level, h.idx, h.digest, h.idx // 8
    FROM high h, subroots s WHERE h.n > 1),
own AS (
    SELECT l.doc_id, l.lang, l.idx AS leaf_idx, n.level, n.idx, n.run FROM leaves l, nodes n
    WHERE l.lang IS NOT DISTINCT FROM n.lang AND n.level < 1000
        AND n.idx = l.idx // CAST(power(8, n.level) AS BIGINT)
    UNION ALL
    SELECT l.doc_id, l.lang, l.idx, n.level, n.idx, n.run
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level >= 1000
        AND n.idx = s.idx // CAST(power(8, n.level - 1000) AS BIGINT)),
steps AS (
    SELECT o.lang, o.leaf_idx, o.level,
        coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx < o.idx), '') AS lefts,
        coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx > o.idx), '') AS rights
    FROM own o JOIN nodes n
        ON n.lang IS NOT DISTINCT FROM o.lang AND n.level = o.level AND n.run = o.run
    GROUP BY o.lang, o.leaf_idx, o.level, o.idx),
paths AS (
    SELECT lang, leaf_idx, string_agg(lefts || rights, '' ORDER BY level) AS siblings,
        list({'l': lefts, 'r': rights} ORDER BY level) AS steps
    FROM steps GROUP BY lang, leaf_idx),
folds(lang, idx, k, digest) AS (
    SELECT lang, idx, 1, start FROM leaves
    UNION ALL
    SELECT f.lang, f.idx, k + 1, sha256(steps[k].l || digest || steps[k].r)
    FROM folds f JOIN paths p ON f.lang IS NOT DISTINCT FROM p.lang AND f.idx = p.leaf_idx
    WHERE k <= len(steps)),
ends AS (SELECT lang, idx, arg_max(digest, k) AS folded_root FROM folds GROUP BY lang, idx)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root,
    folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN ends e ON l.lang IS NOT DISTINCT FROM e.lang AND l.idx = e.idx
LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.idx = p.leaf_idx,
(SELECT digest AS root FROM high WHERE n = 1)
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op12_spelling"] = """
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
    GROUP BY doc_id, run),
hashed AS (
    -- Eight shifts a byte; the byte comes in before the first of them.
    SELECT run, times, xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten([
            [CAST('0x' || digits[2 * i + 1 : 2 * i + 2] AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
            for i in range(0, len(digits) // 2)])]),
        lambda c, b : xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
    FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits
          FROM runs)),
words AS MATERIALIZED (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % 97 = 0
            THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed)
    GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3),
cuts AS MATERIALIZED (
    SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
near AS (
    SELECT c.word, d.word AS near FROM cuts c JOIN cuts d USING (rest, i) WHERE c.word <> d.word
    UNION SELECT word, rest FROM cuts SEMI JOIN words w ON w.word = rest
    UNION SELECT rest, word FROM cuts SEMI JOIN words w ON w.word = rest),
rated AS MATERIALIZED (
    SELECT r.word, count(*) AS n_near,
        first(near ORDER BY w.n DESC, encode(near)) AS best, max(w.n) AS best_n
    FROM near r JOIN words w ON w.word = r.near GROUP BY r.word),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN best_n >= 2 * n THEN best END AS form,
        CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
    FROM words w LEFT JOIN rated USING (word)),
chains(word, last, form) AS (
    SELECT word, word, form FROM forms
    UNION ALL
    SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.last AS root, n, n_near, form_n
FROM forms f JOIN chains c ON c.word = f.word AND c.form IS NULL
"""


@query
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)
    return found.select(
        F.col("query").alias("query_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("vec_id"),
        "score",
    )
