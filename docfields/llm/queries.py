"""Registered queries of the training-data operators (one per operator)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.context_mix import score_documents
from docfields.llm.hnsw import nearest
from docfields.llm.html_cut import extract_main_text
from docfields.llm.lexical import ranked_search
from docfields.llm.licenses import scan_licenses
from docfields.llm.merkle import manifest
from docfields.llm.minhash import near_duplicates
from docfields.llm.mixing import plan_mix
from docfields.llm.quality import quality_rules
from docfields.llm.substring import dedup_substrings
from docfields.llm.token_count import count_tokens
from docfields.llm.token_store import token_store
from docfields.llm.unigram import encode_documents
from docfields.sources.tables import read_table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read_table(spark, sf_dir, "documents")).drop("row_key")


def op7_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(read_table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id",
                    altered=more, where=tampered).drop("path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


#: Exact near-duplicates: all pairs that share a shingle, then the smallest id reachable.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
  FROM words),
kinds AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT id, n, unnest(s) AS item FROM kinds),
links AS (
  SELECT a.id AS u, b.id AS v FROM items a JOIN items b ON a.item = b.item AND a.id < b.id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(id, node) AS (
  SELECT id, id FROM kinds UNION SELECT r.id, e.v FROM reach r JOIN edges e ON e.u = r.node),
named AS (SELECT id, min(node) AS component FROM reach GROUP BY id),
found AS (SELECT s.doc_id, len(s.s) AS n, coalesce(m.component, s.doc_id) AS component
          FROM sets s LEFT JOIN kinds k ON k.s = s.s LEFT JOIN named m ON m.id = k.id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM found
"""


#: Scores of all documents that share a term with an item, in whole numbers.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
totals AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM docs WHERE len(words) > 0),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
found AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY row, doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM found, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN found USING (term), totals GROUP BY item_id, row, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_sql(**changed: str) -> str:
    """The leaf hash, with other expressions for changed fields."""
    parts = [f"coalesce(strlen(CAST({changed.get(f, f)} AS VARCHAR)) || ':' || CAST({changed.get(f, f)} AS VARCHAR), '-')" for f in LEAF_FIELDS]
    return f"sha256({' || '.join(parts)})"


def climb_sql(name: str, start: str, group: str) -> str:
    """All nodes above those of ``start``, level by level."""
    return f"""{name} AS (
  SELECT {group}, 0 AS level, pos, h, n FROM {start}
  UNION ALL
  SELECT {group}, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY {group}, level, pos // 2, n)"""


def steps_sql(tree: str, start: str, group: str) -> str:
    """The path of each node of ``start``: l or r and the sibling, ``-`` where there is none."""
    return f"""SELECT s.{group}, s.pos, list(CASE WHEN t.h IS NULL THEN '-' WHEN (s.pos >> e.level) % 2 = 1 THEN 'l' || t.h ELSE 'r' || t.h END
         ORDER BY e.level) FILTER (e.level IS NOT NULL) AS path
  FROM {start} s LEFT JOIN (SELECT DISTINCT {group}, level FROM {tree} WHERE n > 1) e ON e.{group} = s.{group}
  LEFT JOIN {tree} t ON t.{group} = s.{group} AND t.level = e.level AND t.pos = xor(s.pos >> e.level, 1)
  GROUP BY s.{group}, s.pos"""

#: Merkle trees level by level; paths are lists of siblings with their side.
OP13_SQL = f"""
WITH RECURSIVE langs AS (
  SELECT lang AS of, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
sums AS (
  SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
         lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM documents),
leaves AS (
  SELECT tree, doc_id, {leaf_sql()} AS h, CASE WHEN crc % 7 = 0 THEN {leaf_sql(n_chars='(CAST(n_chars AS HUGEINT) + 1)')} END AS changed
  FROM sums JOIN langs ON lang IS NOT DISTINCT FROM of),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
{climb_sql('nodes', 'placed', 'tree')},
tops AS (SELECT 0 AS top, tree AS pos, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
{climb_sql('summit', 'tops', 'top')},
root AS (SELECT h AS root FROM summit WHERE n = 1),
low AS ({steps_sql('nodes', 'placed', 'tree')}),
high AS ({steps_sql('summit', 'tops', 'top')}),
proofs AS (
  SELECT p.doc_id, p.h AS leaf, t.h AS subroot, root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path, changed
  FROM placed p JOIN tops t ON t.pos = p.tree JOIN low ON low.tree = p.tree AND low.pos = p.pos JOIN high ON high.pos = p.tree, root),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256,
         list_reduce([coalesce(changed, leaf)] || path, lambda x, s: CASE substr(s, 1, 1) WHEN 'l' THEN sha256(substr(s, 2) || x)
           WHEN 'r' THEN sha256(x || substr(s, 2)) ELSE sha256(x) END) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": OP3_SQL, "op11_ranked_search": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
