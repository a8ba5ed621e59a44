"""One registered query per operator: it applies the operator, with production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import (
    bpe_codec,
    chat,
    decontam,
    fingerprints,
    html_blocks,
    jaccard_join,
    pii,
    prefix_trie,
    quality,
    token_counts,
    topk,
    toxicity,
    vector_codes,
)
from lapforge.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the byte-level vocabulary, and what they spell, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_codec.encode(table(spark, sf_dir, "documents"), path, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op7_token_counts(spark: SparkSession, sf_dir: str, budget: int = 2048) -> DataFrame:
    """Tokens of every document by the word vocabulary; over the limit if not all words fit the budget."""
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), path, budgets=(budget,), keep=["doc_id"])
    return counted.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_limit"),
        F.col(f"words_in_{budget}").alias("words_in_limit"),
    )


CONTROL_TURN = "</s>[INST] ok [/INST]"


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, one record per turn, and conversation -1, one record of another layout."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text").alias("record"))
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.lit(CONTROL_TURN).alias("prompt"), F.lit(CONTROL_TURN).alias("response"))).alias("record"),
    )
    turns = chat.canonical_turns(rows, "record").select("conv_id", "turn", F.explode("turns").alias("t"))
    more = chat.canonical_turns(extra, "record").select("conv_id", F.posexplode("turns").alias("turn", "t"))
    said = turns.unionByName(more.withColumn("turn", F.col("turn").cast("long"))).select("conv_id", "turn", "t.role", "t.text")
    return chat.digests(chat.formatted(said))


ESCAPE_SQL = r"regexp_replace({0}, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')"
SQL["op10_chat_format"] = f"""
WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TURN}'), (-1, 1, 'assistant', '{CONTROL_TURN}')),
kept AS (SELECT *, length({ESCAPE_SQL.format("text")}) + length({ESCAPE_SQL.format("role")}) + 24 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM kept GROUP BY conv_id"""


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document and all spans, the learnt ones included."""
    found = pii.personal_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[pii.counted(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(F.col("base_spans")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@query
def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = cut_lineage(fingerprints.lexicon(docs))
    add = lambda rows: fingerprints.fingerprinted(rows, words=words)
    chained = fingerprints.with_next(docs, "doc_id", ["text"], add, ("marks",))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    whole = chained.select(
        "doc_id", n.cast("long").alias("n_chars"), "marks", "next_marks", edited.alias("edited")
    )
    again = fingerprints.fingerprinted(whole, text="edited", marks="edited_marks", words=words)
    return again.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written("marks").alias("fingerprint"),
        fingerprints.written("edited_marks").alias("edited_fingerprint"),
        fingerprints.likeness("marks", "edited_marks").alias("near_edited"),
        fingerprints.likeness("marks", "next_marks").alias("near_next"),
    )


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a span of ten words of a benchmark item."""
    found = decontam.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op3_decontamination"] = r"""
WITH d AS (
 SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
 SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
 SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS span
 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
 SELECT r, n, i, w[i:i + n - 1] AS span
 FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, span)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items,
 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles are nine tenths alike."""
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"), size=3, percent=90)


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_blocks.extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", "n_chars")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled ones that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scores = quality.scored(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("quality"), ~held_out
    )
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is more likely graded than not."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.scored(docs, model, keep=["doc_id"])
    return scores.select("doc_id", "severity", (F.col("severity") >= toxicity.REJECT).alias("toxic"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations, each rebuilt on the first turns of its group's base."""
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 4
    how = prefix_trie.Rebuild(base=conv - conv % 20, head=head, most=3)
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), how)


# DuckDB has no crc32 but can compute it bit by bit; sequences are compared as lists of digests of whole turns.
CRC32_SQL = """list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))),
 lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
SQL["op11_prefix_trie"] = rf"""
WITH turns AS (
 SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS ref, turn
 FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT conv_id, list(ref ORDER BY turn NULLS FIRST, ref) AS refs FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, refs, xor({CRC32_SQL.format("CAST(conv_id AS VARCHAR)")}, 4294967295) % 4 AS h FROM said),
built AS (
 SELECT h.conv_id, list_concat(coalesce(b.refs[1:h.h], []), h.refs[h.h + 1:]) AS path
 FROM h LEFT JOIN said b ON b.conv_id = h.conv_id - h.conv_id % 20),
members AS (SELECT conv_id, path, d, path[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM built)),
words AS (SELECT ref, any_value(len(regexp_extract_all(text, '[^ 	-
]+'))) AS words FROM turns GROUP BY ref),
nodes AS (
 SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CASE WHEN len(path) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
 FROM members GROUP BY d, prefix),
costs AS (SELECT n.*, (n_convs - 1) * coalesce(words, 0) AS cost FROM nodes n LEFT JOIN words ON ref = prefix[d]),
kids AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT c.*, coalesce(n_children, 0) AS n_children FROM costs c LEFT JOIN kids USING (prefix)),
below AS (
 SELECT u.prefix, sum(v.cost) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
 FROM full_nodes u JOIN full_nodes v ON v.d >= u.d AND v.prefix[1:u.d] = u.prefix GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
 CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below USING (prefix) LEFT JOIN nodes p ON n.d > 0 AND p.prefix = n.prefix[1:n.d - 1]"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 4 parts, 256 entries each, 4 rounds."""
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"))


FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
INTS_SQL = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes_sql(rounds: int) -> str:
    """Assignment and averaging written out round by round, with all entries compared."""
    nearest = """a{0} AS (
 SELECT r, p, min((dist, e)) AS best, any_value(part) AS part FROM (
  SELECT r, p, part, e, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))) AS dist
  FROM parts JOIN c{0} USING (p)) GROUP BY r, p)"""
    means = """c{1} AS (
 SELECT p, e, CASE WHEN n IS NULL THEN entry ELSE mean END AS entry FROM c{0} LEFT JOIN (
  SELECT p, e, any_value(n) AS n, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM (
   SELECT p, best[2] AS e, i, count(*) AS n, CAST(sum(part[i]) AS BIGINT) AS s
   FROM a{0}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) USING (p, e))"""
    steps = [nearest.format(i) + ", " + means.format(i, i + 1) for i in range(rounds)] + [nearest.format(rounds)]
    return f"""
WITH v AS (
 SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS r, vec_id, label, ints
 FROM (SELECT vec_id, label, {INTS_SQL} AS ints FROM embeddings WHERE {FINITE_SQL})),
parts AS (SELECT r, p, ints[p * len(ints) // 4 + 1:(p + 1) * len(ints) // 4] AS part FROM v, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, r - 1 AS e, part AS entry FROM parts WHERE r <= 256), {", ".join(steps)},
coded AS (
 SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
 FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN coded USING (r)"""


SQL["op12_vector_codes"] = _codes_sql(rounds=4)


@query
def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL["op13_top_products"] = f"""
WITH v AS (
 SELECT row_number() OVER () AS r, vec_id, {INTS_SQL} AS ints FROM embeddings WHERE {FINITE_SQL}),
pairs AS (
 SELECT q.r, q.vec_id AS query_id, c.vec_id,
  CAST(list_inner_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10"""
