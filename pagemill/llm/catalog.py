"""The registered training-data queries and, where SQL can state them, their expected SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import cross_entropy, hyperminhash, kd_shards, pii, suffix_dedup, syncmers, systematic_mix, toxicity, va_file, vector_packing
from pagemill.llm import dual_tree, merkle, token_files
from pagemill.llm.frames import table
from pagemill.plans.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40


def op1_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = kd_shards.shard_documents(table(spark, folder, "documents"), shards=SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents"), k=4, percent=80)


def op3_va_topk(spark: SparkSession, folder: str) -> DataFrame:
    return va_file.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


def tokenizer_path() -> str:
    """The tokenizer file as the executors find it; the vocabulary package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents")).drop("n_plain")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels.filter(~held))
    return toxicity.with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted")
    )


def op8_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Target: documents labelled as good. Every document is scored."""
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").filter("quality = 1")
    return cross_entropy.score(docs, *cross_entropy.train(docs, good))


def op9_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = systematic_mix.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, folder, "documents"))


def op11_dual_tree(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.top_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, tokenizer_path(), keep=("source", "lang"))
    return token_files.token_digests(spark, path)


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Tampering takes the line ends out of every text whose id has an even check sum."""
    docs = table(spark, folder, "documents")
    values = ("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, values, tampered=merkle.leaf_of(*values[:-1], cut))
    folded = merkle.folded(F.col("tampered"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.whole_proof(), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )


OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM worded),
classes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
single AS (SELECT node, n, unnest(s) AS g FROM classes),
shared AS (
  SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM single a JOIN single b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)),
sides AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT DISTINCT u, u FROM sides UNION SELECT r.u, s.v FROM reach r JOIN sides s ON r.v = s.u),
comps AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY u)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.component, c.node, d.doc_id) AS component_id,
       d.doc_id = coalesce(m.component, c.node, d.doc_id) AS kept
FROM shingled d LEFT JOIN classes c ON d.s = c.s LEFT JOIN comps m ON m.node = c.node
"""

OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT source, source_size, 3 * source_size AS most,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM named WINDOW o AS (ORDER BY most::DOUBLE / weight ASC, source ASC NULLS LAST)),
chosen AS (SELECT arg_min(level, (most::DOUBLE / weight, coalesce(source, chr(1114111)))) AS level FROM levels WHERE level * weight <= most),
targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM chosen), 0) * weight) AS target FROM named),
rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size * 16777216)::BIGINT, 50331648) ELSE 0 END AS units,
         ('0x' || substr(md5('mix' || coalesce('=' || s.source, 'null')), 1, 6))::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, start + sum(units) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM rated)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (((upto >> 24) - ((upto - units) >> 24)) * size)::BIGINT AS taken
FROM summed
"""
OP11_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (SELECT row, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM lowered),
sums AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM worded WHERE len(words) > 0),
damped AS (
  SELECT row, doc_id, words, 100 - 75 + (75 * len(words) * docs) // total AS m FROM worded, sums WHERE len(words) > 0),
held AS (SELECT row, doc_id, m, term, count(*) AS tf FROM (SELECT row, doc_id, m, unnest(words) AS term FROM damped) GROUP BY ALL),
weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, sums GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _tree_sql(name: str, leaves: str, order: str) -> str:
    """``{name}_up``: nodes of all levels; ``{name}_flank``: what stands beside each in its run. Leaves: tree, id, digest."""
    run = f"PARTITION BY tree, level, pos // {merkle.FANOUT} ORDER BY pos ROWS BETWEEN"
    return f"""
{name}_up(tree, level, pos, digest, n) AS (
  SELECT tree, 0, row_number() OVER (PARTITION BY tree ORDER BY {order}) - 1, digest, count(*) OVER (PARTITION BY tree) FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // {merkle.FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {merkle.FANOUT - 1}) // {merkle.FANOUT}
  FROM {name}_up WHERE n > 1 GROUP BY tree, level, pos // {merkle.FANOUT}, n),
{name}_flank AS (
  SELECT *, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}_up WHERE n > 1),
{name}_walk(tree, id, level, pos, node, proof) AS (
  SELECT tree, id, 0, row_number() OVER (PARTITION BY tree ORDER BY {order}) - 1, changed, '' FROM {leaves}
  UNION ALL
  SELECT w.tree, w.id, w.level + 1, w.pos // {merkle.FANOUT}, sha256(f.before || w.node || f.after), w.proof || f.before || f.after
  FROM {name}_walk w JOIN {name}_flank f ON f.tree = w.tree AND f.level = w.level AND f.pos = w.pos),
{name}_end AS (SELECT DISTINCT ON (tree, id) * FROM {name}_walk ORDER BY tree, id, level DESC)"""


# The remainders of the check sum's bytes, made by its rule.
_CRC_STEP = "xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END)"
_CRC = "xor(crc >> 8, remainders[(xor(crc, byte) & 255) + 1])"

OP13_SQL = f"""
WITH RECURSIVE steps(i, step, b) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, step + 1, {_CRC_STEP} FROM steps WHERE step < 8),
crc AS (SELECT list(b ORDER BY i) AS remainders FROM steps WHERE step = 8),
d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS id, *,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: {_CRC})) % 2 = 0 AS hit FROM documents, crc),
leaves AS (
  SELECT id, doc_id, source, coalesce('=' || source, '') AS tree, sha256(head || {_value('text')}) AS digest,
         sha256(head || {_value("(CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END)")}) AS changed
  FROM (SELECT *, {" || ".join(map(_value, ("doc_id", "source", "lang", "n_chars")))} AS head FROM d)),
{_tree_sql("low", "leaves", "doc_id, digest")},
subroots AS (SELECT '' AS tree, tree AS id, digest, digest AS changed FROM low_up WHERE n = 1),
{_tree_sql("top", "subroots", "id")},
root AS (SELECT digest FROM top_up WHERE n = 1),
-- The changed leaves' subroots, walked on to the root beside the unchanged siblings.
last(id, level, pos, node, subtree) AS (
  SELECT l.id, 0, t.pos, l.node, l.tree FROM low_end l JOIN (SELECT id AS name, pos FROM top_walk WHERE level = 0) t ON t.name = l.tree
  UNION ALL
  SELECT w.id, w.level + 1, w.pos // {merkle.FANOUT}, sha256(f.before || w.node || f.after), w.subtree
  FROM last w JOIN top_flank f ON f.level = w.level AND f.pos = w.pos),
ended AS (SELECT DISTINCT ON (id) * FROM last ORDER BY id, level DESC)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof || t.proof) AS proof_sha256,
       f.node AS folded_root, f.node = r.digest AS verified
FROM leaves l JOIN low_end e ON e.id = l.id JOIN ended f ON f.id = l.id JOIN subroots s ON s.id = l.tree
JOIN top_end t ON t.id = l.tree, root r
"""

QUERIES: dict[str, Query] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_va_topk": op3_va_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_vector_packing": op5_vector_packing,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_cross_entropy": op8_cross_entropy,
    "op9_systematic_mix": op9_systematic_mix,
    "op10_closed_syncmers": op10_closed_syncmers,
    "op11_dual_tree": op11_dual_tree,
    "op12_token_files": op12_token_files,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = {"op3_va_topk": OP3_SQL, "op2_hyperminhash": OP2_SQL, "op9_systematic_mix": OP9_SQL, "op11_dual_tree": OP11_SQL, "op13_merkle": OP13_SQL}
