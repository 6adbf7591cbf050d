"""The operators over the driver tables, with the columns their queries return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.llm import (conversation, exact, language, merkle, mixing, packing, quality, repair, simhash, sketch,
                            substring, token_counts, topk_search)
from shelfproof.llm.common import ASCII_LOWER, ASCII_UPPER, size_of, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[job.__name__] = job
    return job


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(length({text})), lambda i: CAST(ord({text}[i + 1]) AS BIGINT))), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z:
        CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)))"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document, and whether it goes beyond a window of 2048."""
    counts = token_counts.token_counts(table(spark, sf, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op2_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return topk_search.top_k(table(spark, sf, "embeddings"), 5, F.col("vec_id") % 50 == 0)


ORACLES["op2_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs = table(spark, sf, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    mix = mixing.plan(stored(docs, "sizes"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.words)
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def learn_quality() -> Column:
    """Documents whose labels the quality classifier may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Probability that a document is labelled good."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.with_quality(docs, table(spark, sf, "labels"), learn_quality())
    return scored.select("doc_id", (~learn_quality()).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def learn_lang() -> Column:
    """Documents that the language predictor may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


@query
def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf, "documents")
    model = language.learn(docs.where(learn_lang()))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (~learn_lang()).alias("held_out"), "lang_pred", "score")


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash of every document and its group of near copies."""
    docs = table(spark, sf, "documents").select("doc_id", simhash.fingerprint(F.col("text"))[0].alias("fp"))
    grouped = simhash.groups(stored(docs, "fingerprints"), "fp")
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring.without_repeats(docs).select(
        "doc_id", "n_units", "n_removed", "removed_words", "removed", F.col("kept_text").alias("text"))


ORACLES["op10_substring"] = r"""
WITH p AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE
           regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+') END AS parts FROM documents),
u AS (
  SELECT doc_id, i, parts[i] AS unit,
         regexp_extract_all(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
d AS (
  SELECT *, len(w) AS n, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         len(w) > 0 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, i) > 1 AS again
  FROM u),
-- a unit without words goes with the run it follows
f AS (SELECT *, max(CASE WHEN n > 0 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM d),
g AS (SELECT f.*, coalesce(h.again, false) AS gone FROM f LEFT JOIN d h ON h.doc_id = f.doc_id AND h.i = f.head),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS run FROM g),
s AS (SELECT *, gone AND sum(n) OVER (PARTITION BY doc_id, gone, run) >= 10 AS cut FROM r),
spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM (
    SELECT doc_id, CAST(min(start) AS BIGINT) AS a, CAST(max(start + length(unit)) AS BIGINT) AS b
    FROM s WHERE cut GROUP BY doc_id, run) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (cut) AS n_removed, sum(n) FILTER (cut) AS removed_words,
         string_agg(unit, '' ORDER BY i) FILTER (NOT cut) AS text FROM s GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(n_units, 0) AS INTEGER) AS n_units, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, coalesce(removed, '') AS removed,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM p LEFT JOIN t ON t.doc_id = p.doc_id LEFT JOIN spans ON spans.doc_id = p.doc_id
"""


@query
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of the text whose last third comes from the next document."""
    return sketch.edited(table(spark, sf, "documents"))


@query
def op5_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document, written to grammar-compressed files and read back."""
    return repair.read(repair.write(table(spark, sf, "documents")))


@query
def op12_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and the one that stays of those with its text."""
    return exact.groups(table(spark, sf, "documents"))


ORACLES["op12_exact"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
                  AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's proof in the manifest of the table, and whether the text shown belongs to it."""
    docs = table(spark, sf, "documents")
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    original = merkle.leaf([*kept, F.col("text")])
    changed = merkle.leaf([*kept, F.translate("text", ASCII_UPPER, ASCII_LOWER)])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), original, F.when(tampered, changed).otherwise(original))
    proof, again = merkle.siblings(F.col("proof")), merkle.folded(F.col("shown"), F.col("proof"))
    return made.withColumn("again", again).select(
        F.col("id").alias("doc_id"), *[merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.text_of(merkle.joined(proof)).alias("proof_sha256"), merkle.text_of(F.col("again")).alias("folded_root"),
        (F.col("again") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format
    return "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"


ORACLES["op11_merkle"] = f"""
WITH RECURSIVE
d AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN
        {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS low FROM documents),
r AS (SELECT doc_id, lang, leaf, coalesce(low, leaf) AS shown, count(*) OVER (PARTITION BY lang) AS n,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
lv AS (
  SELECT 0 AS l, lang, n, idx, leaf AS node FROM r
  UNION ALL
  SELECT l + 1, lang, n, idx // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM lv
  WHERE n > CAST(power(8, l) AS BIGINT) GROUP BY l, lang, n, idx // 8),
sub AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM lv
        WHERE n <= CAST(power(8, l) AS BIGINT) AND (l = 0 OR n > CAST(power(8, l - 1) AS BIGINT))),
tv AS (
  SELECT 0 AS l, n, g AS idx, node FROM sub
  UNION ALL
  SELECT l + 1, n, idx // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM tv
  WHERE n > CAST(power(8, l) AS BIGINT) GROUP BY l, n, idx // 8),
root AS (SELECT node FROM tv WHERE n <= CAST(power(8, l) AS BIGINT) AND (l = 0 OR n > CAST(power(8, l - 1) AS BIGINT))),
steps AS (
  SELECT r.lang, r.idx, 0 AS part, lv.l,
    coalesce(string_agg(node, '' ORDER BY lv.idx) FILTER (lv.idx < r.idx // CAST(power(8, l) AS BIGINT)), '') AS lo,
    coalesce(string_agg(node, '' ORDER BY lv.idx) FILTER (lv.idx > r.idx // CAST(power(8, l) AS BIGINT)), '') AS hi
  FROM r JOIN lv ON lv.lang IS NOT DISTINCT FROM r.lang AND r.idx // CAST(power(8, l + 1) AS BIGINT) = lv.idx // 8
  WHERE r.n > CAST(power(8, l) AS BIGINT) GROUP BY r.lang, r.idx, lv.l
  UNION ALL
  SELECT r.lang, r.idx, 1, tv.l,
    coalesce(string_agg(tv.node, '' ORDER BY tv.idx) FILTER (tv.idx < g // CAST(power(8, l) AS BIGINT)), ''),
    coalesce(string_agg(tv.node, '' ORDER BY tv.idx) FILTER (tv.idx > g // CAST(power(8, l) AS BIGINT)), '')
  FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang JOIN tv ON g // CAST(power(8, l + 1) AS BIGINT) = tv.idx // 8
  WHERE tv.n > CAST(power(8, l) AS BIGINT) GROUP BY r.lang, r.idx, tv.l),
p AS (SELECT lang, idx, string_agg(lo || hi, '' ORDER BY part, l) AS others, list(lo || '/' || hi ORDER BY part, l) AS ways
      FROM steps GROUP BY lang, idx)
SELECT r.doc_id, r.leaf, sub.node AS subroot, root.node AS root, sha256(coalesce(others, '')) AS proof_sha256,
       list_reduce(list_prepend(shown, coalesce(ways, [])), lambda x, s: sha256(split_part(s, '/', 1) || x || split_part(s, '/', 2)))
         AS folded_root, folded_root = root.node AS verified
FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM r.lang AND p.idx = r.idx
CROSS JOIN root
"""


@query
def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest edits that repair it, and what they leave."""
    turns = table(spark, sf, "conversations")
    return conversation.summary(turns, conversation.repair(conversation.damage(turns)))


def _repair_sql() -> str:
    """The cheapest edits row by row: for each state of the role pattern the least cost, letters and lines so far.

    A state is a text: cost in six digits, letters, character 1, lines.  The least text is the cheapest, then the
    ASCII-least.
    """
    def edit(state: str, cost: str, letter: str, line: str) -> str:
        return (f"lpad(CAST(CAST(substr({state}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || "
                f"substr({state}, 7, instr({state}, chr(1)) - 7) || '{letter}' || "
                f"substr({state}, instr({state}, chr(1))) || {line}")

    insert = lambda state, role: edit(state, "3", "I", f"chr(10) || '{role}:'")
    delete = lambda state: edit(state, "4", "D", "''")
    keep = lambda state, initial: f"CASE WHEN initial = '{initial}' AND NOT gone THEN {edit(state, 'late', 'K', 'chr(10) || line')} END"  # noqa: E731, E501
    rerole = lambda state, role: f"CASE WHEN NOT gone THEN {edit(state, '3 + late', 'R', f'chr(10) || {role!r} || text')} END"  # noqa: E731, E501
    relaxed = f"""(SELECT conv, pos, a, b, c, least(d, {insert('c', 'assistant')}) AS d FROM (
      SELECT conv, pos, a, b, d, least(c, {insert('a', 'user')}, {insert('b', 'user')}, {insert('d', 'user')}) AS c FROM st))"""
    key = crc32_sql("k")
    return f"""
WITH RECURSIVE
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k,
        dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv FROM conversations),
dm AS (SELECT conv, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END))
       FROM (SELECT *, {key} % 20 AS f FROM k) WHERE f <> 0),
o AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM dm),
g AS (SELECT *, substr(role, 1, 1) AS initial, tail = '' AS blank,
        tail <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM o),
r AS (SELECT *, blank OR again AS gone, role || ':' || text AS line,
        CASE WHEN NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS late FROM g),
st AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS pos, '000000' || chr(1) AS a, CAST(NULL AS VARCHAR) AS b,
         CAST(NULL AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d FROM r
  UNION ALL
  SELECT r.conv, r.pos, {delete('a')}, least({delete('b')}, {keep('a', 's')}),
         least({delete('c')}, {keep('a', 'u')}, {keep('b', 'u')}, {keep('d', 'u')},
               {rerole('a', 'user:')}, {rerole('b', 'user:')}, {rerole('d', 'user:')}),
         least({delete('d')}, {keep('c', 'a')}, {rerole('c', 'assistant:')})
  FROM {relaxed} s JOIN r ON r.conv = s.conv AND r.pos = s.pos + 1),
ends AS (SELECT conv, least(a, d) AS x FROM {relaxed} WHERE (conv, pos) IN (SELECT (conv, max(pos)) FROM r GROUP BY conv)),
n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again) AS duplicate, count(*) FILTER (late = 3) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(x, 1, 6) AS BIGINT), 0) AS cost, coalesce(substr(x, 7, instr(x, chr(1)) - 7), '') AS audit,
       sha256(coalesce(substr(x, instr(x, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM k) LEFT JOIN n USING (conv) LEFT JOIN ends USING (conv)
"""


ORACLES["op13_conversations"] = _repair_sql()
