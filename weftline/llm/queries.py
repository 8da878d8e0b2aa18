"""Queries of the document operators over the test tables, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.llm import mixing, packing, sentences, survivors
from weftline.session import cut, once, table

#: The source of claims whose data node is null or blank. It has a space, so no node is called that.
UNKNOWN_NODE = "unknown node"


def _ranked_links(spark: SparkSession, sf: str) -> DataFrame:
    """soft_links with its packed columns unpacked, file name, version day (as a negative number: newest first) and ranks."""
    links, path = table(spark, sf, "soft_links"), F.col("path")
    kinds = table(spark, sf, "type_ranks").groupBy(paths.type_key(F.col("file_type")).alias("kind")).agg(F.min("pref_rank").alias("type_rank"))
    nodes = table(spark, sf, "node_ranks").groupBy(paths.node_key(F.col("data_node")).alias("node")).agg(F.min("pref_rank").alias("node_rank"))
    day = paths.version_day(F.col("version"), F.col("recorded_at"))
    checksum = paths.usable_checksum(paths.unpacked(path, 2, F.col("checksum")))
    rows = once(links, file_name=paths.stem(path)).select(
        "file_name", "path_id", (-F.unix_date(day)).alias("age"), checksum.alias("sum"), paths.type_key(F.col("file_type")).alias("kind"), paths.node_key(F.col("data_node")).alias("node")
    )
    ranked = rows.join(kinds, "kind", "left").join(nodes, "node", "left")
    return ranked.withColumn("node", F.coalesce("node", F.lit(UNKNOWN_NODE)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    best = survivors.survivors(_ranked_links(spark, sf), ["file_name"], "path_id", "node", ["age", "type_rank", "node_rank", "path_id"], {"checksum": ("sum", 1)})
    return best.select("file_name", "path_id", F.coalesce("checksum", F.lit("")).alias("checksum"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ranked_links(spark, sf)
    fields = {"checksum": F.col("sum"), "version": F.date_from_unix_date(-F.col("age")).cast("string"), "file_type": F.col("kind")}
    each = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()))
    return rows.select("file_name", "node", F.explode(each).alias("c")).select("file_name", "node", "c.*")


def p4_truth(spark: SparkSession, sf: str) -> DataFrame:
    chosen = survivors.truth(_claims(spark, sf), ["file_name"], "field", "value", "node").chosen
    return chosen.select("file_name", "field", "value", F.round("support", 6).alias("support"), "claims")


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf, "documents"), table(spark, sf, "pack_sizes"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, sf), table(spark, sf, "pack_sizes"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    chosen = cut(mix.chosen())
    return chosen.join(F.broadcast(mix.shares(chosen).select("source", "target_share", "actual_share")), "source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return mix.shares(mix.chosen())


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents"))


QUERIES = {"p4_found": p4_found, "p4_truth": p4_truth, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}

#: soft_links unpacked, with file name, version day, ranks and usable checksums, in DuckDB's SQL.
_LINKS = r"""s AS (SELECT path_id, recorded_at, split_part(path, '|', 1) AS p, version, lower(trim(file_type)) AS kind,
  regexp_replace(regexp_replace(lower(trim(data_node)), '/+$', ''), ':80$', '') AS node,
  lower(trim(CASE WHEN contains(path, '|') THEN split_part(path, '|', 3) ELSE checksum END)) AS sum FROM soft_links WHERE path IS NOT NULL),
n AS (SELECT *, regexp_replace(replace(regexp_extract(regexp_replace(trim(p), '[?#].*$', ''), '[^/]*$'), '%5F', '_'), '\.nc.*$', '', 'i') AS file_name,
  TRY_CAST(TRY_STRPTIME(regexp_replace(regexp_extract(trim(version), '^[vV]?[0-9]{4}-?[0-9]{2}-?[0-9]{2}$'), '[^0-9]', '', 'g'), '%Y%m%d') AS DATE) AS d FROM s),
r AS (SELECT n.*, CASE WHEN d <= CAST(recorded_at AS DATE) THEN d END AS day, t.pref_rank AS tr, k.pref_rank AS nr,
  regexp_matches(sum, '^([0-9a-f]{32}|[0-9a-f]{64})$') AND replace(sum, sum[1], '') <> '' AS fit
  FROM n LEFT JOIN type_ranks t ON lower(t.file_type) = n.kind LEFT JOIN node_ranks k ON lower(k.data_node) = n.node)"""

_P4_FOUND = f"""WITH {_LINKS},
o AS (SELECT *, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY file_name ORDER BY day DESC NULLS LAST, tr NULLS LAST, nr NULLS LAST, path_id)),
b AS (SELECT file_name, path_id, day FROM o WHERE place = 1),
c AS (SELECT o.file_name, arg_min(o.sum, o.place) AS sum FROM o JOIN b ON o.file_name = b.file_name AND o.day IS NOT DISTINCT FROM b.day WHERE o.fit GROUP BY 1)
SELECT b.file_name, b.path_id, coalesce(c.sum, '') AS checksum FROM b LEFT JOIN c USING (file_name)
WHERE (SELECT count(DISTINCT path_id) FROM o WHERE o.file_name = b.file_name) > 1"""


def _truth_sql(rounds: int) -> str:
    """A chain of rounds, more than the votes take to settle at the size of the comparison: rounds beyond change nothing."""
    parts = [
        f"WITH {_LINKS}",
        "said AS (SELECT file_name, coalesce(nullif(node, ''), 'unknown node') AS s, unnest([struct_pack(f := 'checksum', v := CASE WHEN fit THEN sum END), struct_pack(f := 'version', v := strftime(day, '%Y-%m-%d')), struct_pack(f := 'file_type', v := nullif(kind, ''))]) AS c FROM r)",
        "claim AS MATERIALIZED (SELECT DISTINCT file_name, s, c.f AS f, c.v AS v FROM said WHERE c.v IS NOT NULL AND file_name IS NOT NULL)",
        "item AS MATERIALIZED (SELECT file_name, f, count(DISTINCT v) > 1 AS contested FROM claim GROUP BY 1, 2)",
        "total AS MATERIALIZED (SELECT s, count(*) AS n, count_if(NOT contested) AS sure FROM claim JOIN item USING (file_name, f) GROUP BY 1)",
        "w0 AS MATERIALIZED (SELECT s, (sure + (n - sure) * 0.5 + 0.5) / (n + 1.0) AS w FROM total)",
    ]
    for i in range(rounds):
        parts.append(f"t{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file_name, f ORDER BY round(votes, 9) DESC, claims DESC, v) AS place, sum(votes) OVER (PARTITION BY file_name, f) AS every FROM (SELECT file_name, f, v, sum(w) AS votes, count(*) AS claims FROM claim JOIN w{i} USING (s) GROUP BY 1, 2, 3) x)")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT n.s, (count(t.v) + 0.5) / (any_value(n.n) + 1.0) AS w FROM total n JOIN claim c USING (s) LEFT JOIN t{i} t ON t.place = 1 AND t.file_name = c.file_name AND t.f = c.f AND t.v = c.v GROUP BY 1)")
    return ",\n".join(parts) + f"\nSELECT file_name, f AS field, v AS value, round(votes / every, 6) AS support, claims FROM t{rounds - 1} WHERE place = 1"


#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
SQL = {"p4_found": _P4_FOUND, "p4_truth": _truth_sql(12)}
