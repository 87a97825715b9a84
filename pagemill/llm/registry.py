"""Queries of this subpackage and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import annsearch, debruijn, decontaminate, langid, licences, mixing, simhash, surrogates, tokenbin, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
     r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLES["op4_nearest"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.norm * c.norm) AS score
           FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op5_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda t: t <> '') AS w FROM documents),
     i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda t: t <> '') AS w FROM benchmark),
     dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
     it AS (SELECT item_id, len(w) AS n, least(16, len(w)) AS wide, CASE WHEN len(w) < 11 THEN 0 WHEN len(w) < 13 THEN 1 ELSE floor(least(16, len(w)) * 3 / 16) END AS free, unnest(w) AS t, unnest(range(len(w))) AS q FROM i WHERE len(w) >= 7),
     m AS (SELECT doc_id, item_id, wide, free, q, p - q AS diagonal FROM dt JOIN it USING (t)),
     c AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= wide - free),
     b AS (SELECT doc_id, item_id, diagonal, wide, free, count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS matched,
                  count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS best FROM c)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched FROM b WHERE best >= wide - free GROUP BY ALL
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs, most_repeats=2.0, budget="total").select("doc_id", "source", "n_tokens", "copies")


ORACLES["op6_mixing"] = r"""
WITH RECURSIVE
r AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
             ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INTEGER AS bucket FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM r GROUP BY source HAVING sum(n_tokens) > 0),
h AS (SELECT source, t, t / (SELECT sum(t) FROM s) AS p FROM s),
bisect(lo, hi) AS (
    SELECT -1, 1048576
    UNION ALL
    SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
                 (SELECT max(pow(p, ((lo + hi) // 2) / 1048576.0::DOUBLE - 1)) / sum(pow(p, ((lo + hi) // 2) / 1048576.0::DOUBLE)) FROM h) <= 2.0 AS ok
          FROM bisect WHERE hi - lo > 1)),
e AS (SELECT min(hi) / 1048576.0::DOUBLE AS a FROM bisect),
w AS (SELECT source, t, floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM h, e) * (SELECT sum(t) FROM s)::DOUBLE + 1e-6)::BIGINT AS own FROM h, e),
g AS (SELECT source, t, own // t AS passes, own % t AS rest, greatest(0, 16 - ceil(log2(greatest(1.0, t / 1048576.0::DOUBLE))))::INTEGER AS shift FROM w),
d AS (SELECT r.*, g.passes, g.rest, r.bucket >> g.shift AS block FROM r LEFT JOIN g ON r.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source
              ORDER BY md5('42:block:' || coalesce(source, '') || ':' || block::VARCHAR), block, md5('42:document:' || coalesce(doc_id::VARCHAR, '')), doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d)
SELECT doc_id, source, n_tokens, coalesce(passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END, 1)::BIGINT AS copies FROM o
"""


@query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), licences.known(spark))


# Digests of the canonical forms, made without the operator.
ORACLES["op3_licences"] = r"""
WITH r(license_id, digest) AS (VALUES
    ('0BSD', '25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c'),
    ('0BSD', '53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe'),
    ('0BSD', '9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153'),
    ('Apache-2.0', '2316c35019cf9a2053bf351f94a343bdc007a65129922f08ace4116921e508ca'),
    ('Apache-2.0', '5f8be53487b62bdd7a15603348fde1e5f4f1c00b98b4aff56f59344cc3eb0c13'),
    ('BSD-2-Clause', '2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7'),
    ('BSD-2-Clause', '447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2'),
    ('BSD-2-Clause', 'a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30'),
    ('BSD-3-Clause', '9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2'),
    ('BSD-3-Clause', 'cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15'),
    ('BSD-3-Clause', 'e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54'),
    ('CC-BY-4.0', '52d4141a1d26b6fff4836b2f3004659d9d9577ba87cf2e266ffe2bb9204982be'),
    ('CC-BY-4.0', '5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2'),
    ('CC-BY-NC-4.0', 'c7af20eeb7305c41f4b610126e0ac275be027ac39d96ab015c61c3e6d0658636'),
    ('CC-BY-NC-4.0', 'e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16'),
    ('GPL-3.0-only', '6bb410158c068cc4d4af5c6dbed9d12d77f96dc55c10e4cb391695208d09fbc1'),
    ('GPL-3.0-only', 'd77521ab5444e4934d5c0e64409f1ef920e5567d859121b36846519b9bc4ecd1'),
    ('ISC', '217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a'),
    ('ISC', '40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db'),
    ('ISC', 'f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee'),
    ('MIT', '00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541'),
    ('MIT', '0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c'),
    ('MIT', '123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940'),
    ('MIT', '35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164'),
    ('MIT', '6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f'),
    ('MIT', '6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127'),
    ('MIT', 'f191f5007d00f1b971cf7dc8c5a881b6037eb2ba7936bb5f72c7c9693041819a'),
    ('Unlicense', '248c77414369ce4b842760d0241cb8184f0805a4354f498a6fb7f7b027ee767e'),
    ('Unlicense', 'b3327fec5d187be034b9d0df5ec141574c40b758467203e7ceb6fcc068141096'),
    ('Zlib', '1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7'),
    ('Zlib', '99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a'),
    ('Zlib', 'e8b4b40ce77fe1c6b396712780f759e806aa4252d6177655c74c2f9e80b083db')),
     l AS (SELECT doc_id, lower(text) AS t, regexp_matches(lower(text), '(?m)^[ \t#*/;-]*(copyright[ \t]*(©|\(c\))|(copyright|©|\(c\))[ \t,]*(by[ \t]+)?(19|20)[0-9]{2})') AS stated FROM documents WHERE text IS NOT NULL),
     v AS (SELECT doc_id, 1 AS way, stated, regexp_replace(t, '(?m)^[ \t#*/;-]*(copyright[ \t]*(©|\(c\))|(copyright|©|\(c\))[ \t,]*(by[ \t]+)?(19|20)[0-9]{2})[^\n]*$', '', 'g') AS t FROM l
           UNION ALL SELECT doc_id, 2, stated, regexp_replace(t, '(?m)^[ \t#*/;-]*(copyright[ \t]*(©|\(c\))|(copyright|©|\(c\))[ \t,]*(by[ \t]+)?(19|20)[0-9]{2})[^\n.]*(\.[^ \t\n][^\n.]*)*(\.[ \t]+|\.?$)', ' ', 'g') FROM l WHERE stated),
     a AS (SELECT doc_id, way, stated, regexp_replace(t, '(?m)^[ \t#*/;-]*all rights reserved\.?[ \t]*$', '', 'g') AS t FROM v),
     b AS (SELECT doc_id, way, stated, replace(replace(replace(t, 'https://', ' '), 'http://', ' '), '&', ' and ') AS t FROM a),
     c AS (SELECT doc_id, way, stated, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\blicence', 'license', 'g'), '\bsub-licen[cs]e', 'sublicense', 'g'), '\backnowledgement', 'acknowledgment', 'g'), '\bauthoris', 'authoriz', 'g') AS t FROM b),
     d AS (SELECT doc_id, way, stated, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\borganis', 'organiz', 'g'), '\bfavour', 'favor', 'g'), '\bwhilst\b', 'while', 'g'), '\bnon-commercial', 'noncommercial', 'g'), '\bper cent\b', 'percent', 'g') AS t FROM c),
     e AS (SELECT doc_id, way, stated, string_split(regexp_replace(regexp_replace(t, '\bversion ([0-9])', 'v\1', 'g'), '\bv\.? ?([0-9])', 'v\1', 'g'), chr(10)) AS lines FROM d),
     f AS (SELECT doc_id, way, stated, list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[^\pL\pN]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM e),
     u AS (SELECT doc_id, TRUE AS whole, array_to_string(lines, ' ') AS form FROM f
           UNION ALL SELECT doc_id, FALSE, unnest(lines) FROM f WHERE way = 2 OR NOT stated)
SELECT doc_id, license_id, bool_or(whole) AS whole, count(*) FILTER (NOT whole)::BIGINT AS lines FROM u JOIN r ON sha256(form) = digest GROUP BY ALL
"""


@query
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.pagemill.surrogates.key``; without one a key is drawn for this run alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = spark.conf.get("spark.pagemill.surrogates.key", None)
    return surrogates.pseudonymise(docs, key.encode()[:64] if key else secrets.token_bytes(32)).select("doc_id", "text", "n_entities")


ORACLES["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
     k AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS g FROM p),
     f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM k),
     c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE r > 1),
     x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
     t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
