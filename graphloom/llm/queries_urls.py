"""Query and SQL of the URL filters."""

from graphloom.llm.common import table
from graphloom.llm.url_filters import url_verdicts

#: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_url_filters(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


SQL = f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(x) for x in RULES)}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS h, rest FROM a),
p AS (SELECT row_number() OVER () AS n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM b),
m AS (SELECT n, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""

QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE = {"op1_url_filters": SQL}
