"""Attribute statistics and the roles that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: by the size of the group, total, not by the entities that have the path
ROLE = """case when coverage = 1 and cardinality = 1 then 'A_BASE'
 when total >= 8 and (cardinality > total / 2 or entropy_norm > 0.8) then 'C'
 when total < 8 and (cardinality >= total or entropy_norm > 0.9) then 'C'
 when len_mean > 200 and cardinality < sqrt(total) then 'C' else 'B' end"""
SIGNAL = """case when role = 'A_BASE' then 'VALUE' when coverage < 0.2 then 'PRESENCE'
 when cardinality <= 3 and coverage > 0.95 and entropy_norm < 0.3 then 'VALUE' else 'NONE' end"""
#: composites and template references are no phone book
STORAGE = "case when role <> 'C' then 'CLASS' when coverage = 1 and value_type not in ('map', 'list', 'composite_template_ref') then 'PHONE_BOOK' else 'INSTANCE_ATTRS' end"


def profile(leaves: DataFrame, group: str = "section") -> DataFrame:
    """A row a (group, path): values are counted first, so the second aggregation sees distinct values only.

    The type of a path is that of its first entity. Null values have no row, and a group without leaves none.
    """
    kind = next((c for c in ("value_type", "attr_type") if c in leaves.columns), None)
    leaves = leaves.withColumn("value_type", F.col(kind) if kind else F.lit("string"))
    size = leaves.groupBy(group).agg(F.countDistinct("entity_id").alias("total"))
    each = leaves.groupBy(group, "path", "value").agg(F.count("*").alias("c"), F.min(F.struct("entity_id", "value_type")).alias("t"))
    q = F.length("value") / 4
    per = each.groupBy(group, "path").agg(
        F.count("*").alias("cardinality"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clog"),
        F.sum(F.col("c") * q).alias("s1"), F.sum(F.col("c") * q * q).alias("s2"), F.min("t")["value_type"].alias("value_type"),
    )
    out = per.join(size, group)
    out = out.withColumn("entropy", F.expr("round(greatest(0d, log2(n) - clog / n), 6)"))
    out = out.withColumn("coverage", F.expr("round(n / total, 6)")).withColumn("entropy_norm", F.expr("round(if(cardinality <= 1, 0d, greatest(0d, log2(n) - clog / n) / log2(cardinality)), 6)"))
    out = out.withColumn("len_mean", F.expr("round(s1 / n, 6)")).withColumn("len_var", F.expr("round(greatest(0d, s2 / n - (s1 / n) * (s1 / n)), 6)"))
    out = out.withColumn("role", F.expr(ROLE)).withColumn("signal", F.expr(SIGNAL)).withColumn("storage", F.expr(STORAGE))
    return out.select(group, "path", "cardinality", "n", "coverage", "entropy", "entropy_norm", "len_mean", "len_var", "role", "signal", "storage")


def profile_sql(leaves: str, group: str = "section") -> str:
    """The same from the definitions: entropy as the sum of p * log2(1 / p), moments over the leaves, roles rule by rule."""
    return f"""WITH l AS ({leaves}), size_ AS (SELECT {group}, count(DISTINCT entity_id) AS total FROM l GROUP BY 1),
v AS (SELECT {group}, path, value, count(*) AS c FROM l GROUP BY 1, 2, 3), w AS (SELECT *, c / sum(c) OVER (PARTITION BY {group}, path) AS p FROM v),
h AS (SELECT {group}, path, count(*) AS cardinality, sum(p * log2(1 / p)) AS bits FROM w GROUP BY 1, 2),
m AS (SELECT {group}, path, count(*) AS n, avg(length(value) / 4.0::DOUBLE) AS len_mean, var_pop(length(value) / 4.0::DOUBLE) AS len_var FROM l GROUP BY 1, 2),
q AS (SELECT {group}, path, cardinality, n, total, bits, n / total AS share, CASE WHEN cardinality > 1 THEN bits / log2(cardinality) ELSE 0 END AS even, len_mean, len_var FROM h JOIN m USING ({group}, path) JOIN size_ USING ({group})),
r AS (SELECT *, CASE WHEN n = total AND cardinality = 1 THEN 'A_BASE' WHEN CASE WHEN total >= 8 THEN 2 * cardinality > total OR even > 0.8 ELSE cardinality >= total OR even > 0.9 END THEN 'C' WHEN len_mean > 200 AND cardinality * cardinality < total THEN 'C' ELSE 'B' END AS role FROM q)
SELECT {group}, path, cardinality, n, round(share, 6) AS coverage, round(bits, 6) AS entropy, round(even, 6) AS entropy_norm, round(len_mean, 6) AS len_mean, round(len_var, 6) AS len_var, role,
CASE WHEN role = 'A_BASE' THEN 'VALUE' WHEN share < 0.2 THEN 'PRESENCE' WHEN cardinality < 4 AND share > 0.95 AND even < 0.3 THEN 'VALUE' ELSE 'NONE' END AS signal,
CASE WHEN role = 'C' AND n = total THEN 'PHONE_BOOK' WHEN role = 'C' THEN 'INSTANCE_ATTRS' ELSE 'CLASS' END AS storage FROM r"""
