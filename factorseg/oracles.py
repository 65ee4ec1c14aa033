"""The same results as plain SQL over the same tables, for checking."""

from __future__ import annotations

CUST = """
li AS (
  SELECT l_orderkey, SUM(l_extendedprice) AS gross, SUM(l_extendedprice * (1 - l_discount)) AS net,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS refunds
  FROM lineitem GROUP BY l_orderkey),
oj AS (
  SELECT o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice, o.o_orderpriority, o.o_orderstatus,
         li.gross, li.net, li.refunds,
         ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS rn
  FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
fo AS (SELECT o_custkey, o_orderkey AS first_orderkey, o_orderpriority AS first_priority,
              o_orderstatus AS first_status FROM oj WHERE rn = 1),
sku AS (
  SELECT fo.o_custkey, STRING_AGG(DISTINCT p_type, ',' ORDER BY p_type) AS first_sku
  FROM fo JOIN lineitem ON l_orderkey = first_orderkey JOIN part ON p_partkey = l_partkey GROUP BY fo.o_custkey),
ag AS (
  SELECT o_custkey, CAST(COUNT(*) AS DOUBLE) AS order_count, MAX(o_orderdate) AS last_dt,
         AVG(o_totalprice) AS avg_order_value, SUM(gross) AS gross_ltv, SUM(net) AS net_ltv,
         CAST(SUM(refunds) AS DOUBLE) AS refund_count
  FROM oj GROUP BY o_custkey),
cust AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS segment, r_name AS region, first_priority, first_status, first_sku,
         order_count, CAST(DATE_DIFF('day', CAST(last_dt AS DATE), DATE '2001-08-01') AS DOUBLE) AS days_since_last_order,
         c_acctbal AS acctbal, refund_count, net_ltv, avg_order_value, gross_ltv
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN ag ON ag.o_custkey = c_custkey LEFT JOIN fo ON fo.o_custkey = c_custkey
  LEFT JOIN sku ON sku.o_custkey = c_custkey)"""

CATS = ["segment", "region", "first_priority", "first_status", "first_sku"]
NUMS = ["order_count", "days_since_last_order", "acctbal", "refund_count", "net_ltv", "avg_order_value", "gross_ltv"]

FILLED = f"""
filled AS (SELECT customer_id, {', '.join(f"COALESCE({c}, 'missing') AS {c}" for c in CATS)},
  {', '.join(f"COALESCE({c}, 0.0) AS {c}" for c in NUMS)} FROM cust)"""

RAW = """
raw AS (
  SELECT customer_id, CASE WHEN region = 'ASIA' THEN 'no' ELSE 'Yes' END AS quiz_taker,
    ' ' || segment || ' ' AS quiz_result,
    CASE WHEN first_status = 'P' THEN 'unspecified' ELSE first_status END AS bm_pattern,
    NULLIF(region, 'AFRICA') AS gi_symptom_cat,
    CASE WHEN first_priority = '5-LOW' THEN '-' ELSE first_priority END AS primary_goal,
    NULLIF(first_priority, '1-URGENT') AS ancestor_discount_code,
    CASE WHEN acctbal > 5000 THEN ' F ' END AS gender,
    CASE WHEN acctbal >= 0 THEN CAST(acctbal > 2500 AS INT) END AS is_male,
    first_sku, order_count, days_since_last_order, acctbal AS symptom_count,
    refund_count / order_count AS gut_issue_score,
    CASE WHEN refund_count >= 10 THEN 1.0 WHEN refund_count IS NOT NULL THEN 0.0 END AS high_stress,
    refund_count, net_ltv, avg_order_value, gross_ltv
  FROM cust)"""

MONEY = "REPLACE (ROUND(net_ltv, 6) AS net_ltv, ROUND(avg_order_value, 6) AS avg_order_value, ROUND(gross_ltv, 6) AS gross_ltv)"
TIDY = f"tidy AS (SELECT * {MONEY} FROM cust)"

NAME = """CASE TRIM({0}) WHEN 'FURNITURE' THEN 'Furniture' WHEN 'HOUSEHOLD' THEN 'Household'
  WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery' ELSE NULLIF(TRIM({0}), '') END"""
BUCKET = """CASE TRIM({0}) WHEN 'FURNITURE' THEN 'home' WHEN 'HOUSEHOLD' THEN 'home'
  WHEN 'BUILDING' THEN 'trade' WHEN 'MACHINERY' THEN 'trade' END"""
TOKENS = """
tok AS (
  SELECT customer_id, CASE TRIM(t) WHEN 'ECONOMY' THEN 'home' WHEN 'STANDARD' THEN 'home' WHEN 'PROMO' THEN 'offer'
    WHEN 'MEDIUM' THEN 'trade' WHEN 'LARGE' THEN 'trade' END AS b
  FROM (SELECT customer_id, UNNEST(STRING_SPLIT(first_sku, ',')) AS t FROM cust)),
sets AS (
  SELECT customer_id, STRING_AGG(DISTINCT b, '|' ORDER BY b) AS buckets, COUNT(DISTINCT b) AS k, MIN(b) AS one
  FROM tok WHERE b IS NOT NULL GROUP BY customer_id),
sku_bucket AS (
  SELECT cust.customer_id, first_sku, segment, COALESCE(buckets, '') AS buckets,
    CASE WHEN k = 1 THEN one WHEN k > 1 THEN 'multi' ELSE 'none' END AS bucket
  FROM cust LEFT JOIN sets ON sets.customer_id = cust.customer_id)"""
MATCH = f"""CASE WHEN CONTAINS('|' || buckets || '|', '|' || ({BUCKET.format('segment')}) || '|') THEN 1 ELSE 0 END"""
CODE = """CASE WHEN {0} IS NULL OR TRIM({0}) = '' THEN 'none'
  WHEN LOWER(TRIM({0})) IN ('2-high', '3-medium') THEN LOWER(TRIM({0})) ELSE 'other' END"""
GENDER = """COALESCE(LOWER(NULLIF(TRIM(gender), '')),
  CASE WHEN is_male = 1 THEN 'male' WHEN is_male IS NOT NULL THEN 'female' END, 'missing')"""

MODEL = f"""
model AS (
  SELECT raw.customer_id, COALESCE({NAME.format('quiz_result')}, 'missing') AS quiz_result,
    {CODE.format('ancestor_discount_code')} AS acquisition_code_group,
    COALESCE(CASE WHEN bm_pattern = 'unspecified' THEN 'missing' ELSE bm_pattern END, 'missing') AS bm_pattern,
    COALESCE(gi_symptom_cat, 'missing') AS gi_symptom_cat,
    COALESCE(CASE WHEN primary_goal = '-' THEN 'missing' ELSE primary_goal END, 'missing') AS primary_goal,
    {GENDER} AS gender_cat, sku_bucket.bucket AS first_sku_bucket,
    COALESCE(order_count, 0.0) AS order_count, COALESCE(days_since_last_order, 0.0) AS days_since_last_order,
    COALESCE(symptom_count, 0.0) AS symptom_count, COALESCE(gut_issue_score, 0.0) AS gut_issue_score,
    COALESCE(CAST(high_stress AS DOUBLE), 0.0) AS high_stress, COALESCE(refund_count, 0.0) AS refund_count,
    CAST({MATCH} AS DOUBLE) AS quiz_reco_match,
    COALESCE(net_ltv, 0.0) AS net_ltv, COALESCE(avg_order_value, 0.0) AS avg_order_value,
    COALESCE(gross_ltv, 0.0) AS gross_ltv
  FROM raw JOIN sku_bucket ON sku_bucket.customer_id = raw.customer_id
  WHERE LOWER(quiz_taker) = 'yes'),
tidy_model AS (SELECT * {MONEY[:-1]}, ROUND(gut_issue_score, 6) AS gut_issue_score) FROM model),
status AS (SELECT *, CASE bm_pattern WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS cluster FROM tidy_model)"""
MODEL_ALL = f"WITH {CUST},{RAW},{TOKENS},{MODEL}"

NATION = """
nat AS (
  SELECT n_name AS variable, SUM(o_totalprice) AS amount, c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
  GROUP BY n_name, c_nationkey)"""


def rounded(x: str, digits: int) -> str:
    """Half-to-even rounding by scaling."""
    scale = float(10 ** digits)
    return f"round_even(({x}) * {scale}, 0) / {scale}"


def profile_sql(head: str, source: str, cluster: str, cats, nums, match=None, promo=None, zero=True, top=3,
                order=True) -> str:
    """A wide cluster profile."""
    parts, cols = [], ["base.cluster", "n_customers"]
    means = [f"{rounded(f'AVG(COALESCE({c}, 0.0))' if zero else f'AVG({c})', 2)} AS {c}_mean, "
             f"{rounded(f'MEDIAN({c})', 2)} AS {c}_median" for c in nums]
    if match:
        means.append(f"{rounded(f'AVG(COALESCE({match}, 0.0)) * 100', 1)} AS {match}_pct")
    parts.append(f"base AS (SELECT {cluster} AS cluster, COUNT(*) AS n_customers{''.join(', ' + m for m in means)} "
                 f"FROM {source} GROUP BY 1)")
    joins = ""
    for c in cats:
        parts.append(f"""t_{c} AS (SELECT * FROM (SELECT {cluster} AS cluster, {c} AS {c}_top,
          {rounded('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY ' + cluster + ') * 100', 1)} AS {c}_pct,
          ROW_NUMBER() OVER (PARTITION BY {cluster} ORDER BY COUNT(*) DESC, {c}) AS rk
          FROM {source} WHERE {c} IS NOT NULL GROUP BY {cluster}, {c}) WHERE rk = 1)""")
        joins += f" LEFT JOIN t_{c} ON t_{c}.cluster = base.cluster"
        cols += [f"{c}_top", f"{c}_pct"]
    for c in nums:
        cols += [f"{c}_mean", f"{c}_median"]
    if match:
        cols.append(f"{match}_pct")
    if promo:
        parts.append(f"""promo AS (SELECT cluster, {', '.join(f"MAX(CASE WHEN rk = {i} THEN label END) AS promo_{i}" for i in range(1, top + 1))}
          FROM (SELECT {cluster} AS cluster, {promo} || ':' ||
            CAST({rounded('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY ' + cluster + ') * 100', 1)} AS VARCHAR) || '%' AS label,
            ROW_NUMBER() OVER (PARTITION BY {cluster} ORDER BY COUNT(*) DESC, {promo}) AS rk
            FROM {source} WHERE {promo} IS NOT NULL GROUP BY {cluster}, {promo}) GROUP BY cluster)""")
        joins += " LEFT JOIN promo ON promo.cluster = base.cluster"
        cols += [f"promo_{i}" for i in range(1, top + 1)]
    return f"{head}, {', '.join(parts)} SELECT {', '.join(cols)} FROM base{joins}"


ONES = """
coded AS (SELECT o_orderkey, DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1 AS a, DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 AS b,
    DENSE_RANK() OVER (ORDER BY o_custkey) - 1 AS c FROM orders),
top AS (SELECT MAX(a) AS na, MAX(b) AS nb FROM coded),
ones AS (SELECT o_orderkey, LIST_FILTER([CASE WHEN a > 0 THEN a - 1 END, CASE WHEN b > 0 THEN na + b - 1 END,
    CASE WHEN c > 0 THEN na + nb + c - 1 END], lambda x: x IS NOT NULL) AS ones FROM coded, top)"""

PROFILE_CATS = ["quiz_result", "bm_pattern", "gi_symptom_cat", "acquisition_code_group", "gender_cat", "first_sku_bucket"]
PROFILE_NUMS = ["order_count", "days_since_last_order", "symptom_count", "gut_issue_score", "high_stress",
                "refund_count", "quiz_reco_match", "net_ltv", "avg_order_value", "gross_ltv"]
STATUS_PROFILE = profile_sql(MODEL_ALL, "status", "cluster", PROFILE_CATS, PROFILE_NUMS, "quiz_reco_match",
                             "acquisition_code_group")
VALUE = ["cluster", "n_customers", "net_ltv_mean", "net_ltv_median", "avg_order_value_mean", "avg_order_value_median"]
SKU = f"""WITH {CUST},
lab AS (SELECT cust.*, COALESCE(code, -1) AS cluster FROM cust LEFT JOIN
  (SELECT first_sku AS s, CAST(ROW_NUMBER() OVER (ORDER BY first_sku) - 1 AS INT) AS code
   FROM (SELECT DISTINCT first_sku FROM cust WHERE first_sku IS NOT NULL)) ON s = first_sku),
merged AS (SELECT lab.*, CASE WHEN COUNT(*) OVER (PARTITION BY cluster) <
  GREATEST(1, FLOOR(0.05 * COUNT(*) OVER ())) THEN -1 ELSE cluster END AS cluster_final FROM lab)"""

_MIX = "CASE WHEN region = 'ASIA' THEN region || '/' || segment ELSE region END"
MIX = f"""WITH {CUST},
lab AS (SELECT cust.*, code AS cluster FROM cust JOIN
  (SELECT mix, CAST(ROW_NUMBER() OVER (ORDER BY mix) - 1 AS INT) AS code
   FROM (SELECT DISTINCT {_MIX} AS mix FROM cust)) ON mix = {_MIX}),
merged AS (SELECT lab.*, CASE WHEN COUNT(*) OVER (PARTITION BY cluster) <
  GREATEST(1, FLOOR(0.05 * COUNT(*) OVER ())) THEN -1 ELSE cluster END AS cluster_final FROM lab)"""


def phi_sql(head: str, source: str, cats, correction: bool) -> str:
    """Pairwise chi-squared over ``source``; all cells, empty ones included."""
    parts = []
    for i, a in enumerate(cats):
        for b in cats[i + 1:]:
            parts.append(f"""SELECT '{a}' AS var_a, '{b}' AS var_b, CAST(MAX(n) AS BIGINT) AS n, SUM(
              CASE WHEN {str(correction).upper()} AND ka * kb = 4 THEN POW(GREATEST(ABS(o - e) - 0.5, 0.0), 2) ELSE POW(o - e, 2) END / e) AS chi2
              FROM (SELECT COALESCE(o.c, 0) AS o, ra.c * cb.c / CAST(t.n AS DOUBLE) AS e, t.n AS n,
                      COUNT(*) OVER (PARTITION BY ra.v) AS kb, COUNT(*) OVER (PARTITION BY cb.v) AS ka
                FROM (SELECT {a} AS v, COUNT(*) AS c FROM {source} GROUP BY 1) ra
                CROSS JOIN (SELECT {b} AS v, COUNT(*) AS c FROM {source} GROUP BY 1) cb
                CROSS JOIN (SELECT COUNT(*) AS n FROM {source}) t
                LEFT JOIN (SELECT {a} AS va, {b} AS vb, COUNT(*) AS c FROM {source} GROUP BY 1, 2) o
                  ON o.va = ra.v AND o.vb = cb.v)""")
    return f"{head}, phi AS (SELECT var_a, var_b, n, chi2, chi2 / n AS phi2 FROM ({' UNION ALL '.join(parts)}))"


def eta_sql(source: str, nums, cats) -> str:
    parts = []
    for x in nums:
        for c in cats:
            parts.append(f"""SELECT '{x}' AS num_var, '{c}' AS cat_var, CASE WHEN COUNT(DISTINCT g) < 2 OR SUM(POW(v - m, 2)) = 0
              THEN 0.0 ELSE SUM(POW(mg - m, 2)) / SUM(POW(v - m, 2)) END AS eta2
              FROM (SELECT {x} AS v, {c} AS g, AVG({x}) OVER () AS m, AVG({x}) OVER (PARTITION BY {c}) AS mg
                    FROM {source} WHERE {x} IS NOT NULL AND {c} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


def corr_sql(source: str, nums, power: int) -> str:
    """(a, b, r^power) for a before b."""
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, POW(CORR({a}, {b}), {power}) AS r FROM {source}"
             for i, a in enumerate(nums) for b in nums[i + 1:]]
    return " UNION ALL ".join(parts)


def relationship_sql(nums, cats, correction: bool, extra: str = "") -> str:
    head = phi_sql(f"WITH {CUST},{FILLED.replace(' FROM cust', extra + ' FROM cust')}", "filled", cats, correction)
    diag = [f"SELECT '{c}', '{c}', 1.0" for c in nums]
    diag += [f"SELECT '{c}', '{c}', COUNT(DISTINCT {c}) - 1.0 FROM filled" for c in cats]
    return f"""{head}, r2 AS ({corr_sql('filled', nums, 2)}), eta AS ({eta_sql('filled', nums, cats)}),
      allp AS (SELECT a AS x, b AS y, r AS value FROM r2 UNION ALL SELECT b, a, r FROM r2
        UNION ALL SELECT var_a, var_b, phi2 FROM phi UNION ALL SELECT var_b, var_a, phi2 FROM phi
        UNION ALL SELECT num_var, cat_var, eta2 FROM eta UNION ALL SELECT cat_var, num_var, eta2 FROM eta
        UNION ALL {' UNION ALL '.join(diag)})
      SELECT x AS row_var, y AS col_var, ROUND(CAST(value AS DOUBLE), 6) AS value FROM allp"""


CORR = f"""WITH {CUST},{FILLED}, pairs AS ({corr_sql('filled', NUMS, 1)}),
m AS (SELECT a AS row_var, b AS col_var, r FROM pairs UNION ALL SELECT b, a, r FROM pairs
  UNION ALL {' UNION ALL '.join(f"SELECT '{c}', '{c}', 1.0" for c in NUMS)})"""

NUMBER_TEXT = r"REGEXP_REPLACE(CAST(CAST({0} AS DECIMAL(38,2)) AS VARCHAR), '(\.\d+?)0+$', '\1')"


def persona_sql() -> str:
    t = lambda c: f"COALESCE({c}, '—')"
    n = lambda c: NUMBER_TEXT.format(c)
    return f"""SELECT CAST(cluster AS BIGINT) AS cluster, 'by_status — Cluster ' || cluster || ' — ' || n_customers ||
      ' customers' || CHR(10) || '- Quiz result: ' || {t('quiz_result_top')} || '; Gender: ' || {t('gender_cat_top')} ||
      '; First-SKU: ' || {t('first_sku_bucket_top')} || CHR(10) || '- GI/BM: ' || {t('gi_symptom_cat_top')} || ', ' ||
      {t('bm_pattern_top')} || '; Avg symptoms: ' || {n('symptom_count_mean')} || CHR(10) || '- Behavior: avg orders ' ||
      {n('order_count_mean')} || ', days since last order ' || {n('days_since_last_order_mean')} || '; Quiz-match: ' ||
      {n('quiz_reco_match_pct')} || '%' || CHR(10) || '- VALUE: mean LTV $' || {n('net_ltv_mean')} || ', mean AOV $' ||
      {n('avg_order_value_mean')} || CHR(10) || '- Top promos: ' || {t('promo_1')} || ' ' || {t('promo_2')} || CHR(10) AS persona
      FROM ({STATUS_PROFILE})"""


def share_union(source: str, group: str, cats) -> str:
    return " UNION ALL ".join(
        f"""SELECT {group} AS cluster, '{c}' AS variable, {c} AS level, COUNT(*) AS n,
        ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY {group}), 8) AS share
        FROM {source} WHERE {c} IS NOT NULL GROUP BY {group}, {c}""" for c in cats)


def coverage_sql(cols, threshold: float, op: str) -> str:
    parts = [f"SELECT '{c}' AS \"column\", COUNT({c}) AS non_null, COUNT(*) AS n_rows, COUNT({c}) {op} {threshold} * COUNT(*) AS kept FROM holes"
             for c in cols]
    return f"""WITH {CUST}, holes AS (SELECT customer_id, NULLIF(first_priority, '1-URGENT') AS priority,
      NULLIF(segment, 'BUILDING') AS segment, CASE WHEN acctbal > 5000 THEN acctbal END AS acctbal, first_sku, net_ltv FROM cust)
      {' UNION ALL '.join(parts)}"""


def zscore_sql(cols, sd: str) -> str:
    cells = ", ".join(f"ROUND((COALESCE({c}, 0.0) - AVG(COALESCE({c}, 0.0)) OVER ()) / {sd}(COALESCE({c}, 0.0)) OVER (), 6) AS {c}"
                      for c in cols)
    return f"WITH {CUST} SELECT customer_id, {cells} FROM cust"


def silhouette_sql(distance: str) -> str:
    """Mean silhouette of the embeddings under their own labels, from all pairs."""
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      d AS (SELECT a.vec_id, a.label AS own, b.label AS other, SUM({distance}) AS s, COUNT(*) AS n
            FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
      ab AS (SELECT vec_id, MAX(CASE WHEN own = other THEN s / NULLIF(n - 1, 0) END) AS a,
             MIN(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY vec_id)
      SELECT ROUND(AVG(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / GREATEST(a, b) END), 6) AS silhouette FROM ab"""


def variance_sql(target: float) -> str:
    return f"""WITH {NATION}, s AS (SELECT c_nationkey + 1 AS component, amount AS eigenvalue,
        amount / SUM(amount) OVER () AS explained FROM nat),
      c AS (SELECT *, SUM(explained) OVER (ORDER BY component) AS cumulative, ROW_NUMBER() OVER (ORDER BY component) AS pos,
        COUNT(*) OVER () AS len FROM s),
      k AS (SELECT *, LEAST(GREATEST(COALESCE(MIN(CASE WHEN cumulative >= {target} THEN pos END) OVER (), len), 2), len) AS keep FROM c)"""


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
              "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
              "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def profile_top_sql(table: str, types: dict, top: int) -> str:
    counts = " UNION ALL ".join(f"SELECT '{c}' AS col, '{t}' AS data_type, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n "
                                f"FROM {table} GROUP BY {c}" for c, t in types.items())
    return f"""WITH u AS ({counts}),
      r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, value NULLS FIRST) AS rk FROM u)
      SELECT col AS "column", data_type, CAST(rk AS INT) AS rank, value, n FROM r WHERE rk <= {top}"""


ORACLES: dict[str, str] = {
    "typed_projection": """
      WITH t AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS t FROM customer)
      SELECT c_custkey AS customer_id, COALESCE(TRY_CAST(t AS DOUBLE), 0.0) AS acctbal, TRY_CAST(t AS DOUBLE) AS acctbal_kept,
        COALESCE(TRY_CAST(c_mktsegment AS DOUBLE), 0.0) AS bad, COALESCE(c_mktsegment, 'missing') AS segment FROM t""",
    "positional_select": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "sentinel_replace": """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing' ELSE o_orderpriority END AS priority,
      CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE o_orderstatus END AS status FROM orders""",
    "normalize_map": f"""WITH c AS (SELECT c_custkey, c_mktsegment, '  ' || NULLIF(c_mktsegment, 'AUTOMOBILE') || ' ' AS nm FROM customer)
      SELECT c_custkey AS customer_id, {NAME.format('nm')} AS name, {NAME.format('c_mktsegment')} AS name_exact FROM c""",
    "bucket_lookup": f"SELECT c_custkey AS customer_id, {BUCKET.format('c_mktsegment')} AS bucket FROM customer",
    "token_buckets": f"WITH {CUST},{TOKENS} SELECT customer_id, buckets, bucket FROM sku_bucket",
    "token_buckets_table": """SELECT l_orderkey, COALESCE(STRING_AGG(DISTINCT p_brand, '|' ORDER BY p_brand), '') AS brands,
      CAST(COUNT(DISTINCT p_brand) AS INT) AS n_brands FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""",
    "one_hot_sparse": f"WITH {ONES} SELECT o_orderkey, ARRAY_TO_STRING(ones, ',') AS ones FROM ones",
    "sparse_cross_products": f"""WITH {ONES}, i AS (SELECT ones, UNNEST(ones) AS i FROM ones),
      ij AS (SELECT i, UNNEST(ones) AS j FROM i) SELECT i, j, COUNT(*) AS n FROM ij WHERE j >= i GROUP BY i, j""",
    "bucket_match": f"WITH {CUST},{TOKENS} SELECT customer_id, CAST({MATCH} AS INT) AS \"match\" FROM sku_bucket",
    "code_group": f"""WITH o AS (SELECT o_orderkey, NULLIF(o_orderpriority, '1-URGENT') AS code FROM orders)
      SELECT o_orderkey, {CODE.format('code')} AS code_any_case, CASE WHEN code IS NULL THEN 'none'
        WHEN code IN ('2-HIGH', '3-MEDIUM') THEN code ELSE 'other' END AS code_exact FROM o""",
    "fallback_category": f"WITH {CUST},{RAW} SELECT customer_id, {GENDER} AS gender_cat FROM raw",
    "slugify": "SELECT p_partkey, REGEXP_REPLACE(LOWER(p_brand || ' / ' || p_name), '[^a-z0-9]+', '', 'g') AS slug FROM part",
    "share_labels": f"""SELECT o_orderpriority || ':' || CAST({rounded('COUNT(*) / SUM(COUNT(*)) OVER () * 100', 1)} AS VARCHAR) || '%' AS label
      FROM orders GROUP BY o_orderpriority""",
    "ordinal_codes": f"{SKU} SELECT customer_id, cluster AS code FROM lab",
    "one_hot_drop_first": f"""WITH {CUST} SELECT customer_id,
      CAST(region = 'AMERICA' AS INT) AS region_AMERICA, CAST(region = 'ASIA' AS INT) AS region_ASIA,
      CAST(region = 'EUROPE' AS INT) AS region_EUROPE, CAST(region = 'MIDDLE EAST' AS INT) AS "region_MIDDLE EAST",
      COALESCE(CAST(first_status = 'O' AS INT), 0) AS first_status_O, COALESCE(CAST(first_status = 'P' AS INT), 0) AS first_status_P FROM cust""",
    "zscore_pop": zscore_sql(["acctbal", "order_count"], "STDDEV_POP"),
    "zscore_sample": zscore_sql(["acctbal", "net_ltv"], "STDDEV_SAMP"),
    "flag_fill": f"""WITH {CUST} SELECT customer_id, CASE WHEN acctbal > 2500 THEN 1 ELSE 0 END AS is_rich,
      CASE WHEN refund_count > 10 THEN 1 ELSE 0 END AS refund_flag, 0 AS sx_far, order_count AS flag_other FROM cust""",
    "row_index": "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS customer_index FROM orders",
    # the file is ordered by key
    "row_index_by_file": "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS customer_index FROM orders",
    "flag_filter": f"WITH {CUST},{RAW} SELECT customer_id, quiz_taker FROM raw WHERE LOWER(quiz_taker) = 'yes'",
    "group_filter": f"""WITH {CUST},{RAW} SELECT customer_id, {CODE.format('ancestor_discount_code')} AS acquisition_code_group
      FROM raw WHERE ancestor_discount_code IS NOT NULL""",
    "coverage_report": coverage_sql(["customer_id", "priority", "segment", "acctbal", "first_sku", "net_ltv"], 0.6, ">="),
    "coverage_strict": coverage_sql(["customer_id", "priority", "segment", "acctbal", "first_sku", "net_ltv"], 0.8, ">"),
    "dominance_report": f"""WITH {CUST}, x AS (SELECT segment, COALESCE(first_sku, 'missing') AS first_sku,
        CASE WHEN acctbal < -980 THEN 'b' ELSE 'a' END AS dominated, 'one' AS constant_text,
        COALESCE(acctbal, 0.0) AS acctbal, COALESCE(net_ltv, 0.0) AS net_ltv, 1.0 AS constant_number FROM cust),
      c AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, MAX(n) / SUM(n) AS metric, COUNT(*) AS k FROM (SELECT COUNT(*) AS n FROM x GROUP BY {c})" for c in ['segment', 'first_sku', 'dominated', 'constant_text'])})
      SELECT col AS "column", 'categorical' AS kind, ROUND(CAST(metric AS DOUBLE), 4) AS metric, CAST(k AS DOUBLE) AS n_levels, (k >= 2 AND metric <= 0.995) AS kept FROM c
      UNION ALL {' UNION ALL '.join(f"SELECT '{c}', 'numeric', ROUND(STDDEV_POP(CAST({c} AS DOUBLE)), 4), NULL, STDDEV_POP(CAST({c} AS DOUBLE)) > 1e-8 FROM x" for c in ['acctbal', 'net_ltv', 'constant_number'])}""",
    "labels_left_join": """SELECT o_custkey AS customer_id, o_orderkey, c_mktsegment FROM orders
      LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""",
    "labels_inner_join": """SELECT o_custkey AS customer_id, o_orderkey, c_mktsegment FROM orders
      JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0""",
    "lookup_join": """SELECT s_suppkey, s_nationkey, n_name AS nation FROM supplier
      LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) ON n_nationkey = s_nationkey""",
    "size_outer_join": """WITH a AS (SELECT o_orderpriority AS c, COUNT(*) AS n FROM orders GROUP BY 1),
      b AS (SELECT o_orderpriority AS c, COUNT(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 200000 GROUP BY 1)
      SELECT COALESCE(a.c, b.c) AS cluster, CAST(a.n AS DOUBLE) AS orig_size, CAST(b.n AS DOUBLE) AS new_size,
        CAST(b.n - a.n AS DOUBLE) AS delta FROM a FULL OUTER JOIN b ON a.c = b.c""",
    "value_counts_share": """SELECT l_quantity AS value, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 8) AS share
      FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity""",
    "column_profile_top10": profile_top_sql("orders", ORDER_TYPES, 10),
    "column_profile_lineitem": profile_top_sql("lineitem", LINE_TYPES, 10),
    "cluster_sizes": "SELECT l_returnflag, COUNT(*) AS n_customers FROM lineitem GROUP BY 1",
    "profile_by_group": profile_sql(f"WITH {CUST}, {TIDY}", "tidy", "segment", ["region", "first_status", "first_sku"], NUMS, promo="first_priority"),
    "group_medians": " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS variable, MEDIAN({c}) AS median FROM lineitem GROUP BY l_returnflag"
        for c in ("l_extendedprice", "l_quantity", "l_discount")),
    "group_numeric_means": f"WITH {CUST} SELECT segment AS cluster, {', '.join(f'ROUND(AVG({c}) + 1e-7, 4) AS {c}_mean' for c in NUMS)} FROM cust GROUP BY segment",
    "group_value_shares": f"WITH {CUST} {share_union('cust', 'segment', ['region', 'first_status', 'first_sku'])}",
    "contingency": f"""WITH {CUST} SELECT COALESCE(segment, 'missing') AS level_a, COALESCE(first_sku, 'missing') AS level_b,
      COUNT(*) AS n FROM cust GROUP BY 1, 2""",
    "r_squared": f"WITH {CUST},{FILLED} SELECT a AS var_a, b AS var_b, ROUND(r, 6) AS r2 FROM ({corr_sql('filled', NUMS, 2)})",
    "eta_squared": f"WITH {CUST} SELECT num_var, cat_var, ROUND(eta2, 6) AS eta2 FROM ({eta_sql('cust', NUMS, CATS)})",
    "relationship_matrix": relationship_sql(["acctbal", "order_count", "net_ltv"], ["segment", "region", "first_sku"], True),
    "famd_relationship_blocks": relationship_sql(NUMS, CATS, False),
    "correlation_matrix": f"{CORR} SELECT row_var, col_var, ROUND(CAST(r AS DOUBLE), 6) AS r FROM m",
    "correlation_summary": f"""{CORR} SELECT COUNT(DISTINCT row_var) AS n_columns, ROUND(MIN(r), 6) AS min_r, ROUND(MAX(r), 6) AS max_r,
      ROUND(AVG(ABS(r)), 6) AS mean_abs_r FROM m WHERE row_var <> col_var""",
    "top_correlated_pair": f"""{CORR} SELECT row_var, col_var, ROUND(r, 6) AS r,
      CASE WHEN ABS(r) < 0.3 THEN 'low' WHEN ABS(r) < 0.7 THEN 'moderate' ELSE 'high' END AS band
      FROM m WHERE row_var <> col_var ORDER BY ABS(r) DESC, row_var, col_var LIMIT 1""",
    "cumulative_share": f"""{variance_sql(0.85)} SELECT component, ROUND(eigenvalue, 6) AS eigenvalue, ROUND(explained, 6) AS explained,
      ROUND(cumulative, 6) AS cumulative, pos <= keep AS retained FROM k""",
    "components_to_target": f"{variance_sql(0.5)} SELECT COUNT(*) AS n_keep FROM k WHERE pos <= keep",
    "contribution_prune": f"""WITH {NATION}, s AS (SELECT variable, amount * 100 / SUM(amount) OVER () AS p FROM nat),
      r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p DESC, variable) AS rk, COUNT(*) OVER () AS n FROM s)
      SELECT variable, ROUND(p, 6) AS total_contrib_pct, CAST(rk AS INT) AS rank, (rk > n - FLOOR(0.15 * n) OR p < 3.6) AS dropped FROM r""",
    "famd_inertia": f"""WITH {CUST},{FILLED} SELECT CAST({len(NUMS)} + {' + '.join(f'COUNT(DISTINCT {c}) - 1' for c in CATS)} AS DOUBLE) AS inertia,
      COUNT(*) AS n FROM filled""",
    "famd_score_moments": "SELECT 0.0::DOUBLE AS mean_abs, 1.0::DOUBLE AS ratio_min, 1.0::DOUBLE AS ratio_max, 0.0::DOUBLE AS r_abs",
    "famd_scaling_invariance": "SELECT 0.0::DOUBLE AS max_gap, COUNT(*) AS n FROM customer",
    "adjusted_rand": f"""WITH {CUST}, c AS (SELECT segment AS a, region AS b, COUNT(*) AS n FROM cust GROUP BY 1, 2),
      s AS (SELECT (SELECT SUM(n * (n - 1) / 2) FROM c) AS s, (SELECT SUM(n) FROM c) AS t,
        (SELECT SUM(n * (n - 1) / 2) FROM (SELECT SUM(n) AS n FROM c GROUP BY a)) AS sa,
        (SELECT SUM(n * (n - 1) / 2) FROM (SELECT SUM(n) AS n FROM c GROUP BY b)) AS sb)
      SELECT CAST(t AS BIGINT) AS n, ROUND((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 8) AS ari FROM s""",
    "silhouette_exact": silhouette_sql("list_distance(a.v, b.v)"),
    "silhouette_squared": silhouette_sql("POW(list_distance(a.v, b.v), 2)"),
    "small_group_merge": f"{MIX} SELECT customer_id, cluster, CAST(cluster_final AS INT) AS cluster_final FROM merged",
    "unclustered_summary": f"""{MIX} SELECT COUNT(CASE WHEN cluster_final = -1 THEN 1 END) AS n_unclustered, COUNT(*) AS n_total,
      ROUND(100.0 * COUNT(CASE WHEN cluster_final = -1 THEN 1 END) / COUNT(*), 6) AS pct FROM merged""",
    "mean_value_by_group": f"""{MIX} SELECT CAST(cluster_final AS INT) AS cluster, COUNT(*) AS n_customers,
      ROUND(AVG(net_ltv) + 1e-7, 4) AS net_ltv_mean FROM merged GROUP BY 1""",
    "clean_profiles": profile_sql(MIX + f", kept AS (SELECT * {MONEY} FROM merged WHERE cluster_final <> -1)", "kept", "cluster_final",
                                  ["segment", "region", "first_status", "first_sku"], NUMS, promo="first_priority", zero=False),
    "modeling_frame": f"{MODEL_ALL} SELECT * FROM tidy_model",
    "wide_profile": STATUS_PROFILE,
    "value_summary": f"SELECT {', '.join(VALUE)}, 'by_status' AS tag FROM ({STATUS_PROFILE})",
    "value_comparison": f"""WITH p AS ({STATUS_PROFILE}) SELECT 'full' AS approach, {', '.join(VALUE)}, order_count_mean FROM p
      UNION ALL SELECT 'no_orders', {', '.join(VALUE)}, 0.0 FROM p""",
    "value_bars": f"""WITH p AS ({STATUS_PROFILE}) {' UNION ALL '.join(f"SELECT 'by_status' AS approach, 'by_status C' || cluster AS label, '{c}' AS panel, CAST({c} AS DOUBLE) AS value FROM p" for c in ['net_ltv_mean', 'avg_order_value_mean', 'order_count_mean', 'n_customers'])}""",
    "persona_text": persona_sql(),
}

ORACLES["famd_relationship_table"] = relationship_sql(
    ["acctbal", "order_count"], ["segment", "rich", "late"], True,
    ", CASE WHEN acctbal > 2500 THEN 'y' ELSE 'n' END AS rich, CASE WHEN days_since_last_order > 200 THEN 'y' ELSE 'n' END AS late")

_PHI = ["segment", "region", "first_sku", "rich", "late"]
ORACLES["phi_squared"] = phi_sql(f"""WITH {CUST}, x AS (SELECT segment, region, COALESCE(first_sku, 'missing') AS first_sku,
  CASE WHEN acctbal > 2500 THEN 'y' ELSE 'n' END AS rich, CASE WHEN days_since_last_order > 200 THEN 'y' ELSE 'n' END AS late FROM cust)""",
    "x", _PHI, True) + " SELECT var_a, var_b, n, ROUND(chi2, 6) AS chi2, ROUND(phi2, 6) AS phi2 FROM phi"

_HOLED = f"""WITH {CUST}, holed AS (SELECT region, segment, CASE WHEN acctbal > 0 THEN acctbal END AS acctbal,
  CASE WHEN refund_count <> 3 THEN refund_count END AS refund_count FROM cust)"""
ORACLES["profile_skip_null"] = profile_sql(_HOLED, "holed", "region", ["segment"], ["acctbal", "refund_count"], zero=False)
ORACLES["profile_null_as_zero"] = profile_sql(_HOLED, "holed", "region", ["segment"], ["acctbal", "refund_count"])
ORACLES["promo_mix"] = f"""WITH {CUST}, l AS (SELECT region AS cluster, first_sku || ':' ||
    CAST({rounded('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY region) * 100', 1)} AS VARCHAR) || '%' AS label,
    ROW_NUMBER() OVER (PARTITION BY region ORDER BY COUNT(*) DESC, first_sku) AS rk
    FROM cust WHERE first_sku IS NOT NULL GROUP BY region, first_sku)
  SELECT cluster, MAX(CASE WHEN rk = 1 THEN label END) AS promo_1, MAX(CASE WHEN rk = 2 THEN label END) AS promo_2,
    MAX(CASE WHEN rk = 3 THEN label END) AS promo_3 FROM l GROUP BY cluster"""
ORACLES["encoded_matrix"] = f"""WITH {CUST},{RAW}, q AS (
    SELECT customer_id, CASE quiz_result WHEN ' FURNITURE ' THEN 'Furniture' WHEN ' HOUSEHOLD ' THEN 'Household' ELSE quiz_result END AS r,
      CASE WHEN ancestor_discount_code IS NULL THEN 'none' WHEN ancestor_discount_code IN ('2-HIGH', '3-MEDIUM')
        THEN ancestor_discount_code ELSE 'other' END AS g, order_count, days_since_last_order, symptom_count,
      CAST(high_stress AS DOUBLE) AS high_stress FROM raw WHERE LOWER(quiz_taker) = 'yes')
  SELECT customer_id, {', '.join(f"ROUND((COALESCE({c}, 0.0) - AVG(COALESCE({c}, 0.0)) OVER ()) / STDDEV_POP(COALESCE({c}, 0.0)) OVER (), 6) AS {c}" for c in ['order_count', 'days_since_last_order', 'symptom_count'])},
    high_stress, CAST(r = ' BUILDING ' AS INT) AS quiz_result_building, CAST(r = ' MACHINERY ' AS INT) AS quiz_result_machinery,
    CAST(r = 'Furniture' AS INT) AS quiz_result_furniture, CAST(r = 'Household' AS INT) AS quiz_result_household,
    CAST(g = '3-MEDIUM' AS INT) AS acquisition_code_group_3_medium, CAST(g = 'none' AS INT) AS acquisition_code_group_none,
    CAST(g = 'other' AS INT) AS acquisition_code_group_other FROM q"""


# The first factor by power iteration on the cross-product matrix of the standardised columns.
FAMD = f"""WITH RECURSIVE {CUST},{FILLED},
lev AS ({' UNION ALL '.join(f"SELECT '{c}' AS var, {c} AS level, COUNT(*) / SUM(COUNT(*)) OVER () AS p, ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS code FROM filled GROUP BY {c}" for c in CATS)}),
z AS MATERIALIZED (
  {' UNION ALL '.join(f"SELECT customer_id, '{c}' AS var, '' AS level, ({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS v FROM filled" for c in NUMS)}
  UNION ALL {' UNION ALL '.join(f"SELECT f.customer_id, l.var, l.level, (CASE WHEN f.{c} = l.level THEN 1 ELSE 0 END - l.p) / SQRT(l.p) FROM filled f JOIN lev l ON l.var = '{c}'" for c in CATS)}),
m AS MATERIALIZED (
  SELECT a.var AS va, a.level AS la, b.var AS vb, b.level AS lb, SUM(a.v * b.v) / (SELECT COUNT(*) FROM filled) AS v
  FROM z a JOIN z b ON a.customer_id = b.customer_id GROUP BY 1, 2, 3, 4),
pw AS (
  SELECT 0 AS i, va AS var, la AS level, 1.0 / ROW_NUMBER() OVER (ORDER BY va, la) AS x FROM (SELECT DISTINCT va, la FROM m)
  UNION ALL
  SELECT i + 1, va, la, y / SQRT(SUM(y * y) OVER ()) FROM (
    SELECT pw.i, m.va, m.la, SUM(m.v * pw.x) AS y FROM pw JOIN m ON m.vb = pw.var AND m.lb = pw.level
    WHERE pw.i < 60 GROUP BY 1, 2, 3)),
axis AS (SELECT var, level, x * (SELECT SIGN(ARG_MAX(x, ABS(x))) FROM pw WHERE i = 60) AS x FROM pw WHERE i = 60),
eig AS (SELECT SUM(a.x * m.v * b.x) AS e FROM m JOIN axis a ON a.var = m.va AND a.level = m.la
        JOIN axis b ON b.var = m.vb AND b.level = m.lb),
score AS (SELECT customer_id, SUM(z.v * axis.x) AS f FROM z JOIN axis ON axis.var = z.var AND axis.level = z.level GROUP BY 1)"""

ORACLES["famd_spectrum"] = f"""{FAMD} SELECT ROUND(SUM(CASE WHEN va = vb AND la = lb THEN v END), 6) AS total,
  ROUND(SUM(v * v), 6) AS squares FROM m"""
ORACLES["famd_first_factor"] = f"""{FAMD} SELECT var AS variable, ROUND(SUM(x * x), 6) AS contribution,
  ROUND((SELECT e FROM eig), 6) AS eigenvalue FROM axis GROUP BY var"""
ORACLES["famd_first_scores"] = f"{FAMD} SELECT customer_id, ROUND(f, 5) AS Factor_1 FROM score"
ORACLES["famd_first_loadings"] = f"{FAMD} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS variable, ROUND(CORR({c}, f), 5) AS loading FROM filled JOIN score USING (customer_id)" for c in NUMS]
    + [f"SELECT '{c}', ROUND(CORR(code, f), 5) FROM filled JOIN score USING (customer_id) JOIN lev ON lev.var = '{c}' AND lev.level = {c}" for c in CATS])
ORACLES["famd_first_centroids"] = f"{FAMD} " + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, ROUND(AVG(f), 5) AS centroid, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 5) AS share "
    f"FROM filled JOIN score USING (customer_id) GROUP BY {c}" for c in CATS)

# All learned factors: the leading axis by repeated squaring of the matrix, then the same on what is left of it.
SQUARINGS = 13


def axes_sql(tag: str, matrix: str, count: int, learned: str | None = None) -> str:
    """CTEs ``{tag}fac`` (f, i, x), ``{tag}eig`` (f, e) and ``{tag}keep`` (explained shares) of a matrix table (i, j, v)."""
    out = [f"{tag}d0 AS MATERIALIZED (SELECT i, j, v FROM {matrix})"]
    for f in range(1, count + 1):
        d, s, a = f"{tag}d{f - 1}", f"{tag}s{f}", f"{tag}a{f}"
        out.append(f"""{s} AS (
  SELECT 0 AS k, i, j, v / SUM(CASE WHEN i = j THEN v END) OVER () AS v FROM {d}
  UNION ALL
  SELECT k + 1, i, j, v / SUM(CASE WHEN i = j THEN v END) OVER () FROM (
    SELECT a.k, a.i, b.j, SUM(a.v * b.v) AS v FROM {s} a JOIN {s} b ON a.j = b.i WHERE a.k < {SQUARINGS} GROUP BY 1, 2, 3)),
{a} AS MATERIALIZED (
  SELECT i, x * SIGN(ARG_MAX(x, ABS(x)) OVER ()) AS x FROM (
    SELECT i, v / SQRT(SUM(v * v) OVER ()) AS x FROM {s} WHERE k = {SQUARINGS} AND j = (
      SELECT ARG_MAX(i, v) FROM {s} WHERE k = {SQUARINGS} AND i = j))),
{tag}e{f} AS MATERIALIZED (SELECT SUM(p.x * v * q.x) AS e FROM {d} JOIN {a} p USING (i) JOIN {a} q ON q.i = {d}.j),
{tag}d{f} AS MATERIALIZED (SELECT {d}.i, {d}.j, v - e * p.x * q.x AS v FROM {d} JOIN {a} p USING (i) JOIN {a} q ON q.i = {d}.j, {tag}e{f})""")
    out.append(f"{tag}fac AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {f} AS f, i, x FROM {tag}a{f}" for f in range(1, count + 1)) + ")")
    out.append(f"{tag}eig AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {f} AS f, e FROM {tag}e{f}" for f in range(1, count + 1)) + ")")
    out.append(kept_sql(tag, learned or count))
    return ",\n".join(out)


def kept_sql(tag: str, count: int | str, name: str = "keep") -> str:
    return f"""{tag}{name} AS MATERIALIZED (
  SELECT *, f <= GREATEST(2, MIN(CASE WHEN cum >= 0.85 THEN f END) OVER ()) AS retained FROM (
    SELECT f, e, e / SUM(e) OVER () AS share, SUM(e) OVER (ORDER BY f) / SUM(e) OVER () AS cum FROM {tag}eig WHERE f <= {count}))"""


LEARNED = len(CATS) + len(NUMS) - 1  # one less than there are variables, at most 20
ALL_AXES = f"""{FAMD[:FAMD.index('pw AS (')]}
ix AS MATERIALIZED (SELECT va AS var, la AS level, ROW_NUMBER() OVER (ORDER BY va, la) AS i FROM (SELECT DISTINCT va, la FROM m)),
mi AS MATERIALIZED (SELECT a.i, b.i AS j, m.v FROM m JOIN ix a ON a.var = va AND a.level = la JOIN ix b ON b.var = vb AND b.level = lb),
{axes_sql('', 'mi', LEARNED)},
nk AS (SELECT COUNT(*) AS n FROM keep WHERE retained),
inertia AS (SELECT SUM(v) AS total FROM mi WHERE i = j),
part AS MATERIALIZED (SELECT var AS variable, f AS component, SUM(x * x) AS c FROM fac JOIN ix USING (i), nk WHERE f <= n GROUP BY 1, 2),
whole AS (SELECT variable, 100 * SUM(c) / SUM(SUM(c)) OVER () AS pct FROM part GROUP BY 1),
coord AS (SELECT variable, CASE WHEN variable IN ({', '.join(f"'{c}'" for c in NUMS)}) THEN 'numeric' ELSE 'categorical' END AS kind,
  component, e * c AS squared, SQRT(e) * x AS signed FROM part JOIN eig ON f = component
  LEFT JOIN (SELECT var, f AS g, x FROM fac JOIN ix USING (i) WHERE level = '' AND var IN ({', '.join(f"'{c}'" for c in NUMS)})) ON var = variable AND g = component),
cent AS (SELECT lev.var AS variable, lev.level, code, f AS component, e * x / SQRT(p) AS centroid, p AS share
  FROM fac JOIN ix USING (i) JOIN lev ON lev.var = ix.var AND lev.level = ix.level JOIN eig USING (f), nk WHERE f <= n),
load AS (
  SELECT variable, component, signed AS loading FROM coord WHERE kind = 'numeric' UNION ALL
  SELECT variable, component, SUM(share * (code - mean) * centroid) / SQRT(SUM(share * (code - mean) * (code - mean)) * MAX(e))
  FROM (SELECT *, SUM(share * code) OVER (PARTITION BY variable, component) AS mean FROM cent) JOIN eig ON f = component GROUP BY 1, 2),
points AS (SELECT customer_id, f AS component, SUM(z.v * x) AS score FROM z JOIN ix USING (var, level) JOIN fac USING (i), nk WHERE f <= n GROUP BY 1, 2)"""


def explained_sql(keep: str, total: str) -> str:
    return f"""SELECT CAST(f AS INT) AS component, ROUND(e, 5) AS eigenvalue, ROUND(share, 5) AS explained_variance,
      ROUND(cum, 5) AS cumulative_variance, ROUND(100 * e / ({total}), 5) AS inertia_pct, retained FROM {keep}"""


def leading_sql(i: int) -> str:
    return (f"MAX(CASE WHEN r = {i} THEN variable END) AS top_variable_{i}, ROUND(MAX(CASE WHEN r = {i} THEN c END), 2) AS top_contrib_{i}")


DIMS = lambda v: ", ".join(f"ROUND(MAX(CASE WHEN component = {j} THEN {v} END), 5) AS dim{j}" for j in (1, 2))
RANKED = f"""ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY pct DESC, variable) AS rank, COUNT(*) OVER () AS n_all FROM whole),
pruned AS (SELECT *, rank > n_all - FLOOR(0.15 * n_all) OR pct < 0.40 AS dropped FROM ranked)"""
ORACLES |= {
    "famd_explained": f"{ALL_AXES} {explained_sql('keep', 'SELECT total FROM inertia')}",
    "scree_table": f"{ALL_AXES} SELECT component, eigenvalue, explained_variance, inertia_pct FROM ({explained_sql('keep', 'SELECT total FROM inertia')})",
    "famd_component_counts": f"{ALL_AXES}, " + ", ".join(kept_sql("", n, f"keep{n}") for n in (2, 5, 6, 8)) + " " + " UNION ALL ".join(
        f"SELECT *, {n} AS n_components FROM ({explained_sql(f'keep{n}', 'SELECT total FROM inertia')})" for n in (2, 5, 6, 8)),
    "famd_contributions": f"""{ALL_AXES} SELECT variable, CAST(component AS INT) AS component, ROUND(c, 5) AS contribution,
      ROUND(pct, 5) AS total_contribution_pct FROM part JOIN whole USING (variable)""",
    "famd_variable_coordinates": f"""{ALL_AXES} SELECT variable, kind, CAST(component AS INT) AS component, ROUND(squared, 5) AS squared,
      ROUND(signed, 5) + 0.0 AS signed FROM coord""",
    "famd_loadings": f"{ALL_AXES} SELECT variable, CAST(component AS INT) AS component, ROUND(loading, 5) + 0.0 AS loading FROM load",
    "loading_summary": f"""{ALL_AXES} SELECT COUNT(*) FILTER (WHERE loading > 0) AS n_positive, COUNT(*) FILTER (WHERE loading < 0) AS n_negative,
      ROUND(MIN(loading), 5) AS min_loading, ROUND(MAX(loading), 5) AS max_loading FROM load""",
    "famd_scores": f"{ALL_AXES} SELECT customer_id, CAST(component AS INT) AS component, ROUND(score, 5) + 0.0 AS score FROM points",
    "individuals_map": f"{ALL_AXES} SELECT customer_id, {DIMS('score')} FROM points GROUP BY customer_id",
    "category_centroids": f"""{ALL_AXES} SELECT variable, level, CAST(component AS INT) AS component, ROUND(centroid, 5) + 0.0 AS centroid,
      ROUND(share, 5) AS share FROM cent""",
    "category_map": f"{ALL_AXES} SELECT variable, level, {DIMS('centroid')} FROM cent GROUP BY 1, 2",
    "correlation_circle": f"{ALL_AXES} SELECT variable, kind, {DIMS('COALESCE(signed, squared)')} FROM coord GROUP BY 1, 2",
    "variable_quality": f"""{ALL_AXES} SELECT variable, {DIMS('squared')}, ROUND(SUM(c) FILTER (WHERE component <= 2), 5) AS contribution
      FROM coord JOIN part USING (variable, component) GROUP BY variable""",
    "famd_interpretation": f"""{ALL_AXES}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY component ORDER BY c DESC, variable) AS r FROM part)
      SELECT 'Factor_' || component AS component, ROUND(100 * MAX(share), 2) AS explained_variance_pct, ROUND(100 * MAX(cum), 2) AS cumulative_variance_pct,
      {', '.join(leading_sql(i) for i in (1, 2, 3))} FROM o JOIN keep ON f = component GROUP BY o.component""",
    "feature_ranking": f"""{ALL_AXES}, {RANKED} SELECT variable, ROUND(pct, 5) AS total_contrib_pct, CAST(rank AS INT) AS rank, dropped FROM pruned""",
    "famd_refit": f"""{ALL_AXES}, {RANKED}, stay AS (SELECT i FROM ix JOIN pruned ON variable = var WHERE NOT dropped),
      mr AS MATERIALIZED (SELECT i, j, v FROM mi WHERE i IN (SELECT i FROM stay) AND j IN (SELECT i FROM stay)), {axes_sql('r', 'mr', LEARNED - 1, '(SELECT COUNT(*) - 1 FROM pruned WHERE NOT dropped)')}
      {explained_sql('rkeep', 'SELECT SUM(v) FROM mr WHERE i = j')}""",
}

# one numeric and one column of levels: the first eigenvalue is 1 + eta, the axis is half the number, half the group means
ORACLES["famd_many_levels"] = """WITH x AS (SELECT CAST(l_partkey AS VARCHAR) AS level, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem),
s AS (SELECT AVG(x) AS m, STDDEV_POP(x) AS sd, COUNT(*) AS n FROM x),
g AS (SELECT level, COUNT(*) / MAX(n) AS share, AVG((x - m) / sd) AS mean FROM x, s GROUP BY level),
e AS (SELECT SQRT(SUM(share * mean * mean)) AS eta FROM g)
SELECT 'l_partkey' AS variable, level, ROUND(share, 8) AS share, ROUND(SQRT(share) * mean / eta / SQRT(2.0), 6) + 0.0 AS weight,
  ROUND(1 + eta, 6) AS eigenvalue FROM g, e
UNION ALL SELECT 'l_extendedprice', '', 1.0, ROUND(1 / SQRT(2.0), 6), ROUND(1 + eta, 6) FROM e"""
