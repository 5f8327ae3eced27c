"""One query per operator over its whole table, and the SQL that says the same where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


#: Words of a text, as the operators read them (DuckDB).
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


@query
def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.recompression import kept_digest

    return kept_digest(table(spark, sf_dir, "documents"))


SQL["op1_recompression"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM (SELECT h.doc_id, p, unnest(range(0, 50)) AS j FROM h JOIN m USING (k) WHERE least < h.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.suffix_tree import scores

    return scores(table(spark, sf_dir, "documents"))


@query
def op3_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.jaccard_tree import near_components

    return near_components(table(spark, sf_dir, "documents"))


SQL["op3_jaccard_tree"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""


@query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.order_minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.template_leaks import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_dac_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.dac_files import read_ids, write_ids

    return read_ids(spark, write_ids(table(spark, sf_dir, "documents")))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.toxicity import predictions

    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.page_templates import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query
def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.feistel_shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.bit_planes import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


SQL["op13_bit_planes"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)])::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


@query
def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_count_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldledger.llm.count_transducers import collocations

    return collocations(table(spark, sf_dir, "documents"))


SQL["op11_count_transducers"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
held AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best ANTI JOIN held USING (lang, phrase))
SELECT * FROM ranked WHERE rank <= 2000
"""
