"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens.llm import (lines, merkle, mixing, packing, pieces, pii, quality, simhash, spelling,
                          tokens, topk, toxicity, urls)
from costlens.llm.tables import only, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

BYTE_BPE, BYTE_IDS = "byte_bpe_50k.json", 50257
WORD_BPE, WORD_IDS = "word_bpe_49k.json", 49408
PIECE_BPE = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(
        F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


@query
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 5, 256.0)
    return found.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(BYTE_BPE), BYTE_IDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    n, repeats = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    judged = judged.withColumn("base_failed", (n < 10) | (100 * repeats > 20 * n))
    return judged.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines",
                         "_q.n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.col("_kept")).alias("kept"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return clean.select("doc_id", "text", F.col("_n_lines").alias("n_lines"),
                        F.col("_n_removed").alias("n_removed"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    base = F.concat(*[pii.written(k, F.col(f"_base.{k}")) for k in pii.KINDS])
    more = F.coalesce(pii.written("id", F.col("_more")), F.array().cast("array<string>"))
    return found.select(
        "doc_id", *[F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").where(fold != 0).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                         "predicted", F.array_join("evidence", ",").alias("evidence"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokens.token_files(table(spark, sf_dir, "documents"), vocabulary_file(WORD_BPE), WORD_IDS)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Shares of all tokens that the mixture should hold.
SHARES = {"good": 0.94, "poor": 0.03, "toxic": 0.03}


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit(docs, domains_of(table(spark, sf_dir, "labels")))
    mixed = mixing.mix(docs, model, SHARES)
    return mixed.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in
                                                enumerate(model.domains)], "rate")


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), vocabulary_file(PIECE_BPE))
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [more if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    m = merkle.manifest(docs, tampered=F.when(changed, merkle.leaf(fields)))
    proved = merkle.prove(m, m.leaves.select("grp", "rank", "key", "tampered"))
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("trail"))
    return (proved.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot",
                          "root", merkle.proof(F.col("trail")).alias("proof_sha256"),
                          folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


ORACLE["op1_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
      WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
ORACLE["op4_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
             regexp_extract_all(lower(regexp_replace(t, '[[:punct:]]+', '', 'g')),
                                '[^\x20\x09-\x0D]+') AS bare FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n
        FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)
             AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(list_filter(bare, lambda x: x IN ({_STOP}))) AS stops,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered,
             len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) AS twins,
             len(regexp_extract_all(t, '!')) AS bangs, len(l) AS k,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots,
             len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             nullif(n_words, 0) AS n, nullif(k, 0) AS nk FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n BETWEEN 1.5 AND 25 AND n_symbols / n <= 0.1
       AND bangs / n <= 0.5 AND (n < 30 OR stops / n >= 0.01) AND lettered / n >= 0.6
       AND n_repeat_words / n <= 0.2 AND twins / n <= 0.3 AND n_dup_lines / nk <= 0.5
       AND dots / nk <= 0.5 AND bullets / nk <= 0.9 AS kept FROM b"""

ORACLE["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
           WHERE text IS NOT NULL),
x AS (SELECT doc_id, coalesce(source, '') AS site, i, parts[i] AS part
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l)),
c AS (SELECT doc_id, site, i, trim(part, ' ') AS line FROM x
      WHERE regexp_matches(part, '[^ ]+ +[^ ]+ +[^ ]')),
f AS (SELECT line, min(row(doc_id, i)) AS first FROM c GROUP BY line
      HAVING count(DISTINCT site) >= 10),
g AS (SELECT c.doc_id, c.i FROM c JOIN f USING (line) WHERE row(c.doc_id, c.i) <> f.first),
k AS (SELECT x.doc_id, string_agg(x.part, chr(10) ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS text,
             count(*) AS n_lines, count(g.i) AS n_removed
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)"""


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
        for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# DuckDB has no crc32: bytes of the decimal id, eight shifts each, by nested folds.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(
    list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y:
      CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_leaf()} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS tampered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS h, i, n, leaf AS d FROM r
      UNION ALL
      SELECT lang, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM t
      WHERE n > 1 GROUP BY lang, h, n, i // 2),
s AS (SELECT lang, h AS height, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i,
             count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS h, i, n, subroot AS d FROM s
      UNION ALL
      SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM u
      WHERE n > 1 GROUP BY h, n, i // 2),
top AS (SELECT h AS height, d AS root FROM u WHERE n = 1),
step AS (  -- every level that a leaf passes, its place there and the other of its run
  SELECT p.*, x.d FROM (
    SELECT doc_id, r.lang, r.i AS leaf_at, unnest(range(0, height)) AS h, r.i AS pos
    FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang) p
  LEFT JOIN t x ON x.lang IS NOT DISTINCT FROM p.lang AND x.h = p.h AND x.i = xor(p.pos >> p.h, 1)
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf_at, p.h + p.height, p.pos << p.height, x.d FROM (
    SELECT doc_id, r.lang, r.i AS leaf_at, s.height, unnest(range(0, top.height)) AS h, s.i AS pos
    FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN top) p
  LEFT JOIN u x ON x.h = p.h AND x.i = xor(p.pos >> p.h, 1)),
path AS (SELECT lang, leaf_at, list({{'d': d, 'even': (pos >> h) & 1 = 0}} ORDER BY h) AS steps,
                coalesce(string_agg(d, '' ORDER BY h), '') AS joined FROM step GROUP BY ALL),
f AS (SELECT lang, i, 0 AS k, coalesce(tampered, leaf) AS pos FROM r
      UNION ALL
      SELECT f.lang, f.i, k + 1, sha256(CASE WHEN steps[k + 1].d IS NULL THEN f.pos
        WHEN steps[k + 1].even THEN f.pos || steps[k + 1].d ELSE steps[k + 1].d || f.pos END)
      FROM f JOIN path ON path.lang IS NOT DISTINCT FROM f.lang AND leaf_at = f.i
      WHERE k < len(steps)),
done AS (SELECT lang, i, arg_max(pos, k) AS folded FROM f GROUP BY lang, i)
SELECT r.doc_id, r.leaf, s.subroot, top.root, sha256(coalesce(path.joined, '')) AS proof_sha256,
       done.folded AS folded_root, done.folded = top.root AS verified
FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN top
JOIN done ON done.lang IS NOT DISTINCT FROM r.lang AND done.i = r.i
LEFT JOIN path ON path.lang IS NOT DISTINCT FROM r.lang AND path.leaf_at = r.i"""
