"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Each query applies its operator to its whole table and derives the columns that are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, embed_dedup, exact_dedup, fill_in_middle, langid, license_scan, line_dedup, mixing, ngram_join, quality_mil, secret_scan, suffix_dedup
from .common import crc_fold, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' license detections."""
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base_places", lambda b: b["start"])
    labels = F.array_sort(F.array_distinct(F.transform("base_places", lambda b: b["label"])))
    more = F.transform("detections", lambda d: d["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        "score",
    )


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' links of cosine 0.9 or more, and their components."""
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' classes by word triples and a similarity of 0.9."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer() -> tuple[bytes, str]:
    """The public byte-level vocabulary: its ranks and its pattern."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, as digests, and what they decode to."""
    return bpe.encode(table(spark, sf_dir, "documents"), *tokenizer(), with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier one has."""
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.col("text_sha256").alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit_on(docs.filter(crc_fold("doc_id") != 0))
    found = langid.identify(docs, net)
    return found.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets, told from what is ordinary in all documents."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.secret_scan(docs, secret_scan.fit(*secret_scan.default_samples(), documents=secret_scan.document_pairs(docs)))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(said(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' quality, learned from the labels of the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_mil.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= quality_mil.ACCEPT).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_mil.Mil:
    """A model of labels.quality, from the documents whose fold isn't held out."""
    marks = labels.filter((crc_fold("doc_id") != 0) & F.col("quality").isNotNull()).select(F.col("doc_id").alias("_d"), F.col("quality").alias("label"))
    return quality_mil.fit_on(docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_d")))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier too."""
    found = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' clusters after five rounds from 40 centroids."""
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' training texts, and what is rebuilt from them, as digests."""
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


OP6_SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
  ON coalesce(d.text, '') = g.t
"""

OP7_SQL = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS line FROM parts)
),
repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id > r.first, false) AS lost FROM lines l LEFT JOIN repeated r ON l.key = r.key)
GROUP BY doc_id
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p:p + 99] AS w FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d)),
first AS (SELECT w, min(doc_id * 4294967296 + p) AS f FROM w GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS new FROM w JOIN first USING (w) WHERE doc_id * 4294967296 + p > f),
runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 99 AS e
  FROM (SELECT doc_id, p, sum(new::int) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM later) GROUP BY doc_id, k
),
gaps AS (SELECT r.doc_id, s, e, hex(b[coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY s), 0) + 1:s - 1]) AS g FROM runs r JOIN d USING (doc_id)),
sums AS (SELECT doc_id, sum(e - s + 1)::bigint AS n_removed, count(*) AS n_spans, string_agg(g, '' ORDER BY s) AS g, max(e) AS e FROM gaps GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN e IS NULL THEN b ELSE unhex(g || hex(b[e + 1:])) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""


def _op12_sql(dim: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Each round compares all vectors with the few centroids of the round before."""
    near = """
a{r} AS MATERIALIZED (
  SELECT id, v, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT id, v, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, m)])::bigint AS d FROM kept, c{r}) GROUP BY id, v
)"""
    step = """
c{n} AS MATERIALIZED (
  SELECT c, coalesce(s.m, o.m) AS m FROM c{r} o LEFT JOIN (
    SELECT c, list(floor_mean ORDER BY i) AS m
    FROM (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::bigint // count(*) AS floor_mean FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c
  ) s USING (c)
)"""
    first = f"""
kept AS MATERIALIZED (
  SELECT vec_id AS id, [floor(256 * x::double)::bigint for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dim}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || id)) - 1 AS c, v AS m FROM kept QUALIFY c < {k}
)"""
    parts = [first]
    for r in range(rounds):
        parts += [near.format(r=r), step.format(r=r, n=r + 1, dim=dim)]
    parts.append(near.format(r=rounds))
    return f"""WITH {",".join(parts)}
SELECT id AS vec_id, c::int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
g AS (
  SELECT *, ('0x' || s[1:8])::bigint % (n + 1) AS x, ('0x' || s[9:16])::bigint % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || s[17:24])::bigint % 100 >= 90 THEN 'plain'
      WHEN ('0x' || s[25:32])::bigint % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
p AS (SELECT *, substr(t, 1, least(x, y)) AS a, substr(t, least(x, y) + 1, abs(x - y)) AS m, substr(t, greatest(x, y) + 1) AS z FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_embed_dedup": op2_embed_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_source_mix": op4_source_mix,
        "op5_bpe": op5_bpe,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_language_id": op8_language_id,
        "op9_secret_scan": op9_secret_scan,
        "op10_quality_mil": op10_quality_mil,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_centroids": op12_centroids,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_suffix_dedup": OP11_SQL, "op12_centroids": _op12_sql(), "op13_fill_in_middle": OP13_SQL}
