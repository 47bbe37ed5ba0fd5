"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import byte_bpe, exact_dedup, infill, language, lexical, media, mixing, packing, simhash, token_shards, tokens, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; also lets Python workers find this package where it isn't installed but lies in a folder all machines have."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.write_shards(table(spark, sf_dir, "documents"), token_shards.new_folder(spark))
    return token_shards.read_shards(spark, shards).drop("ids")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(table(spark, sf_dir, "documents")))


def queries() -> dict:
    every = (
        op1_language_id, op2_media, op3_exact_dedup, op4_token_counts, op5_simhash, op6_mixing, op7_toxicity, op8_token_shards, op9_packing, op10_url_filter,
        op11_lexical_search, op12_byte_bpe, op13_fill_in_middle,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_SQL, "op10_url_filter": url_sql(), "op11_lexical_search": search_sql(), "op13_fill_in_middle": INFILL_SQL}


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


#: Levels of the tree that the SQL spells out; mixed verdicts must end by then, the operator itself has no such limit.
SQL_LEVELS = 8


def url_sql(rules=url_filter.RULES, settings: url_filter.Settings = url_filter.Settings()) -> str:
    """The template tree in SQL: four tables a level, then the smoothed shares."""
    fits = []
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, _, start = rule.partition("/")
        fits.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}')", rule, what))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    levels = []
    for i in range(1, SQL_LEVELS + 1):
        levels.append(f"""
node{i} AS MATERIALIZED (SELECT host, template, sum(labelled) AS al, sum(blocked) AS ab, (sum(blocked) + 0.5::DOUBLE) / (sum(labelled) + 1) AS pooled FROM at{i - 1} GROUP BY ALL),
open{i} AS MATERIALIZED (SELECT a.*, a.parts[{i}] AS segment, n.pooled, n.ab > 0 AND n.ab < n.al AS mixed FROM at{i - 1} a JOIN node{i} n USING (host, template)),
kept{i} AS MATERIALIZED (SELECT host, template, segment FROM open{i} WHERE mixed AND segment <> '*' GROUP BY host, template, segment, pooled
  HAVING sum(labelled) > 0 AND abs((sum(blocked) + 0.5::DOUBLE) / (sum(labelled) + 1) - pooled) > {settings.z} * sqrt(pooled * (1 - pooled) / greatest(sum(labelled), 1))),
at{i} AS MATERIALIZED (SELECT o.host, o.parts, o.template || '/' || coalesce(k.segment, '*') AS template, o.labelled, o.blocked
  FROM open{i} o LEFT JOIN kept{i} k ON k.host = o.host AND k.template = o.template AND k.segment = o.segment WHERE o.mixed AND o.segment IS NOT NULL)""")
    leaves = " UNION ALL ".join(f"SELECT host, parts, CASE WHEN mixed THEN template ELSE template || '/**' END AS template, labelled, blocked FROM open{i} WHERE NOT mixed OR segment IS NULL" for i in range(1, SQL_LEVELS + 1))
    return rf"""
WITH split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (
  SELECT *, {case(1)} AS rule, {case(2)} AS by_rule, string_split(regexp_replace(path, '^/', ''), '/') AS p FROM split
), shaped AS MATERIALIZED (
  SELECT * EXCLUDE (p), list_transform(p, lambda s: CASE WHEN regexp_matches(s, '[0-9]|^[0-9A-Fa-f-]{{16,}}$') THEN '*' ELSE s END) AS parts FROM ruled
), at0 AS MATERIALIZED (
  SELECT host, parts, '' AS template, count(by_rule)::DOUBLE AS labelled, (count(*) FILTER (by_rule = 'block'))::DOUBLE AS blocked FROM shaped GROUP BY host, parts
),{",".join(levels)},
tree AS MATERIALIZED ({leaves}),
total AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS share FROM tree),
hosts AS (SELECT host, (sum(blocked) + {settings.strength} * any_value(share)) / (sum(labelled) + {settings.strength}) AS host_share FROM tree, total GROUP BY host),
pure AS (SELECT a.host, a.template, (sum(a.blocked) + {settings.strength} * least(any_value(h.host_share), any_value(t.share))) / (sum(a.labelled) + {settings.strength}) AS purity
  FROM tree a JOIN hosts h USING (host), total t GROUP BY a.host, a.template)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.by_rule, CASE WHEN pure.purity >= {settings.reject} THEN 'block' ELSE 'allow' END) AS verdict
FROM shaped s JOIN tree a USING (host, parts) JOIN pure ON pure.host = a.host AND pure.template = a.template
"""


def search_sql(top: int = lexical.TOP) -> str:
    """The scores of all documents for all items; the divisions are of whole numbers that aren't negative."""
    terms = lambda text: rf"regexp_extract_all(translate({text}, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms("coalesce(text, '')")} AS own FROM documents),
items AS MATERIALIZED (SELECT item_id, list_distinct({terms("coalesce(text, '')")}) AS own FROM benchmark),
size AS (SELECT count(*) AS total_n, sum(len(own))::BIGINT AS total_l FROM docs WHERE len(own) > 0),
norm AS (SELECT r, doc_id, 50 + (50 * len(own) * total_n) // total_l AS m FROM docs, size WHERE len(own) > 0),
wanted AS (SELECT item_id, unnest(own) AS term FROM items),
posting AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(own) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * total_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, size GROUP BY term, total_n),
score AS (SELECT q.item_id, n.r, n.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted q JOIN weight USING (term) JOIN posting p USING (term) JOIN norm n ON n.r = p.r GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= {top}
"""


INFILL_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), d AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
