"""Registered queries over the text tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, ann, bpe, centroids, decontaminate, langid, licences, lm, overlap, pii, simhash, toxicity, urlfilter
from .common import held_out
from .components import reliable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op2_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op2_decontaminate"] = r"""
WITH words AS (
  SELECT id, kind, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM (
    SELECT doc_id AS id, 'd' AS kind, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
    UNION ALL SELECT item_id, 'i', text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
items AS (
  SELECT DISTINCT id AS item_id, least(5, len(w)) AS k,
         unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
                               lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS shingle
  FROM words WHERE kind = 'i' AND len(w) > 0),
widths AS (SELECT DISTINCT k FROM items),
docs AS (
  SELECT DISTINCT id AS doc_id, k,
         unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS shingle
  FROM words, widths WHERE kind = 'd'),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM docs JOIN items USING (k, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-12
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = reliable(pii.scan(docs).drop("text"))
    spans = pii.found(scanned, pii.fit(scanned))
    counts = [F.size(F.filter("base", _of_kind(n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)]
    return spans.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


def _of_kind(n: int):
    return lambda x: x["kind"] == n


PLACES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@query
def op5_urls(spark, sf_dir):
    rules = [urlfilter.Rule(verdict, place=place) for place, verdict in PLACES] + urlfilter.PATTERNS
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def _url_sql() -> str:
    places = ", ".join(f"('{place}', '{place.split('/', 1)[0]}', '/{place.split('/', 1)[1]}', '{verdict}')" for place, verdict in PLACES)
    patterns = ", ".join("('{}', '{}', '{}')".format(r.pattern, "^" + r.regex().replace(r"\Z", r"\z"), r.verdict) for r in urlfilter.PATTERNS)
    return rf"""
WITH places(rule, rule_host, rule_path, verdict) AS (VALUES {places}),
patterns(pattern, expression, verdict) AS (VALUES {patterns}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS row_no, r, regexp_extract(r, '^[^/?#]*') AS h,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (
  SELECT page_id, row_no, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
         r[length(h) + 1:] AS tail FROM parts),
placed AS (
  SELECT row_no, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM urls, places
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_no),
fitting AS (SELECT row_no, pattern, verdict FROM urls, patterns
  WHERE (host <> '' OR path <> '') AND regexp_matches(host || tail, expression)),
named AS (
  SELECT row_no, bool_or(verdict = 'allow') AS allowed,
         min((-length(pattern), pattern)) FILTER (verdict = 'allow') AS a, min((-length(pattern), pattern)) AS b
  FROM fitting GROUP BY row_no)
SELECT page_id, host, path, placed.rule AS rule,
       CASE WHEN placed.rule IS NULL THEN CASE WHEN allowed THEN a[2] ELSE b[2] END END AS pattern,
       CASE WHEN placed.rule IS NOT NULL THEN placed.verdict WHEN allowed OR allowed IS NULL THEN 'allow' ELSE 'block' END AS verdict
FROM urls LEFT JOIN placed USING (row_no) LEFT JOIN named USING (row_no)
"""


SQL["op5_urls"] = _url_sql()


@query
def op6_langid(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    guessed = langid.identify(docs, langid.profiles(docs.where(~held)))
    return guessed.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op9_lm(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2)
    scored = lm.score(docs, lm.fit(docs.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op1_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    templates = ", ".join("({}, '{}', [{}])".format(i, t.licence, ", ".join(f"'{b}'" for b in licences._bigrams(t.text)))
                          for i, t in enumerate(licences.TEMPLATES))
    return rf"""
WITH templates(id, licence, grams) AS (VALUES {templates}),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (
  SELECT *, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p,
         string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM docs),
runs AS (
  SELECT row_no, doc_id, 'paragraphs' AS unit, n AS span, p AS pieces FROM pieces, range(2, {licences.SPAN + 1}) AS r(n)
  UNION ALL
  SELECT row_no, doc_id, 'sentences', n, s FROM pieces, range(1, {licences.SPAN + 1}) AS r(n) WHERE len(s) > 1),
units AS (
  SELECT row_no, doc_id, 'line' AS unit, unnest(range(len(l))) AS part, 1 AS span, unnest(l) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs)
  UNION ALL
  SELECT * FROM (SELECT row_no, doc_id, 'paragraph' AS unit, unnest(range(len(p))) AS part, 1 AS span, unnest(p) AS text
                 FROM pieces) WHERE contains(text, chr(10))
  UNION ALL
  SELECT row_no, doc_id, 'text', 0, 1, text FROM docs WHERE regexp_matches(text, '\n[ \t\r]*\n')
  UNION ALL
  SELECT row_no, doc_id, unit, i - 1, span, array_to_string(pieces[i:i + span - 1], chr(10))
  FROM (SELECT *, unnest(range(1, len(pieces) - span + 2)) AS i FROM runs)),
bagged AS (
  SELECT row_no, doc_id, unit, part, span,
         list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM units)),
scored AS (
  SELECT row_no, doc_id, unit, part, span, licence, 2.0 * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice
  FROM bagged, templates WHERE len(b) BETWEEN len(grams) / 2 AND 2 * len(grams))
SELECT doc_id, unit, part::INTEGER AS part, span::INTEGER AS span, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice
FROM scored WHERE dice >= {licences.DICE} - 1e-12 GROUP BY row_no, doc_id, unit, part, span
"""


SQL["op1_licences"] = _licence_sql()


@query
def op8_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_align(spark, sf_dir):
    return align.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_centroids(spark, sf_dir):
    found = centroids.described(centroids.cluster(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _centroid_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT row_no, min((d, c)) AS best FROM (
  SELECT row_no, c, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS BIGINT) AS d
  FROM v, c{r}) GROUP BY row_no)""")
        if r < rounds:
            steps.append(f"""
parts{r} AS (
  SELECT best[2] AS c, i, CAST(sum(x[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n
  FROM near{r} JOIN v USING (row_no), (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(new.m, c{r}.m) AS m FROM c{r}
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM parts{r} GROUP BY c) AS new USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m FROM v
  QUALIFY c < {k}),{",".join(steps)},
summed AS (SELECT best[2] AS c, CAST(sum(best[1]) AS BIGINT) AS cluster_inertia FROM near{rounds} GROUP BY 1),
total AS (SELECT CAST(sum(cluster_inertia) AS BIGINT) AS inertia FROM summed)
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, cluster_inertia, inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM near{rounds} JOIN v USING (row_no) JOIN c{rounds} ON c{rounds}.c = best[2] JOIN summed ON summed.c = best[2], total
"""


SQL["op13_centroids"] = _centroid_sql()


@query
def op12_jaccard(spark, sf_dir):
    return overlap.near_copies(table(spark, sf_dir, "documents"))
